"""Encoder jobs over tables of encoded graphs: corpus embedding, query embedding, augmented training pairs.

Encoded graphs are the structs of ``graphs.encode(..., both_ways=False)``; weights are broadcast (their size is the
model's, not the corpus's) and graphs are encoded in Arrow batches, so a batch is one block-diagonal graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import augment, encoder
from ..functions.workers import ship

_VIEW = "struct<tag:array<int>,symbol:array<int>,edges:array<struct<src:int,dst:int,type:int>>>"


def _arrays(g: dict | None) -> dict | None:
    if g is None or not g["tag"]:
        return None
    side = lambda k: np.array([e[k] for e in g["edges"]], np.int64)
    return {"tag": np.array(g["tag"], np.int64), "symbol": np.array(g["symbol"], np.int64), "src": side("src"), "dst": side("dst"), "type": side("type")}


def _struct(g: dict | None) -> dict | None:
    if g is None:
        return None
    return {"tag": [int(x) for x in g["tag"]], "symbol": [int(x) for x in g["symbol"]], "edges": [{"src": int(a), "dst": int(b), "type": int(t)} for a, b, t in zip(g["src"], g["dst"], g["type"], strict=True)]}


def embed(graphs: DataFrame, weights: dict, config: encoder.EncoderConfig, key: str = "visual_id", slt: str = "slt", opt: str = "opt", batch: int = 256) -> DataFrame:
    """(key, vector): unit vectors; a row without any graph gets the all-missing vector."""
    spark = graphs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                views = [{"slt": _arrays(s), "opt": _arrays(o)} for s, o in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                v = encoder.encode(views, shared.value, config).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(v), pa.list_(pa.float32()))], [key, "vector"])

    kind = graphs.schema[key].dataType.simpleString()
    return graphs.select(key, slt, opt).mapInArrow(work, f"{key} {kind}, vector array<float>")


def augmented_pairs(graphs: DataFrame, vocabs: dict, config: augment.Augmentation = augment.Augmentation(), seed: int = 0, epoch: int = 0, key: str = "visual_id", item: str = "item") -> DataFrame:
    """Two augmented views of each row: (key, a_slt, a_opt, b_slt, b_opt).

    item: a long column that numbers the rows; with seed and epoch it fixes the random draws, whatever the partitions."""
    spark = graphs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = augment.Augmenter(shared.value, config)
        edge = pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("type", pa.int32())])
        kind = pa.struct([("tag", pa.list_(pa.int32())), ("symbol", pa.list_(pa.int32())), ("edges", pa.list_(edge))])
        for b in batches:
            pairs = [make.pair({"slt": _arrays(s), "opt": _arrays(o)}, seed, epoch, int(i)) for i, s, o in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            columns = [pa.array([_struct(p[side][r]) for p in pairs], kind) for side in (0, 1) for r in ("slt", "opt")]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [key, "a_slt", "a_opt", "b_slt", "b_opt"])

    t = graphs.schema[key].dataType.simpleString()
    return graphs.select(key, F.col(item).cast("long"), "slt", "opt").mapInArrow(work, f"{key} {t}, a_slt {_VIEW}, a_opt {_VIEW}, b_slt {_VIEW}, b_opt {_VIEW}")


def anchors(graphs: DataFrame, least: int = 3) -> DataFrame:
    """Rows with at least ``least`` nodes in either representation (encoded graphs)."""
    size = lambda g: F.coalesce(F.size(f"{g}.tag"), F.lit(0))
    return graphs.where((size("slt") >= least) | (size("opt") >= least))
