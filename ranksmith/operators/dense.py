"""Exact dense retrieval: broadcast query blocks against corpus batches, a top-k per task, one merge.

The queries are the small side (a topic set); their values are counted first, and beyond BLOCK_VALUES they are collected,
broadcast and searched block by block, so no more than a block is ever on the driver or in a task.  Each task keeps k rows
per query, so the shuffle is k per query and task, whatever the corpus holds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import ship
from ..schema import DEPTH
from .ranking import truncate
from .settings import Best

BLOCK_VALUES = 8 << 20  # most query values in one broadcast (64 MiB)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.values if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().values
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def topk(queries: DataFrame, corpus: DataFrame, k: int = DEPTH, query: str = "topic_id", doc: str = "visual_id", vector: str = "vector", digits: int | None = 6, normalise: bool = False) -> DataFrame:
    """(topic_id, visual_id, score, rank) by inner product (cosine with normalise); null vectors take no part."""
    spark = corpus.sparkSession
    ship(spark)
    asked = queries.select(F.col(query).cast("string").alias("q"), vector).where(F.col(vector).isNotNull())
    values = asked.agg(F.sum(F.size(vector))).first()[0] or 0
    blocks = -(-values // BLOCK_VALUES)
    slim = corpus.select(F.col(doc).cast("string").alias("visual_id"), vector).where(F.col(vector).isNotNull())
    if not blocks:
        return truncate(slim.select(F.lit("").alias("topic_id"), "visual_id", F.lit(0.0).alias("score")).limit(0), k)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def part(i: int) -> DataFrame:
        table = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)).toArrow()
        m = _matrix(table[vector]) if table.num_rows else np.empty((0, 0))
        shared = spark.sparkContext.broadcast((table["q"].to_pylist(), unit(m) if normalise and len(m) else m))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            who, qs = shared.value
            best = Best(who, k)
            for batch in batches:
                if not batch.num_rows or not who:
                    continue
                ids = np.array(batch.column(0).to_pylist(), object)
                m = _matrix(batch.column(1))
                s = qs @ (unit(m) if normalise else m).T
                if digits is not None:
                    s = np.round(s, digits)
                for j in range(len(who)):
                    best.add(j, s[j], ids)
            yield from best.batches()

        return slim.mapInArrow(work, "topic_id string, visual_id string, score double")

    return truncate(reduce(DataFrame.unionByName, map(part, range(blocks))), k)


def dot(a: str, b: str):
    """Inner product of two array columns as an expression (for candidate pairs)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_distractors(judged: DataFrame, corpus: DataFrame, n: int, doc: str = "visual_id", seed: int = 0) -> DataFrame:
    """The reduced corpus of a quick evaluation: all judged documents and n others in a seeded hash order."""
    from .ranking import hash_sample

    keep = judged.select(doc).distinct()
    others = hash_sample(corpus.select(doc).join(keep, doc, "left_anti"), n, doc, seed)
    return corpus.join(keep.union(others).distinct(), doc, "left_semi")
