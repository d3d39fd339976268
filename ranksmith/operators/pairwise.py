"""Structural features of candidate pairs: overlaps, edit similarities, sizes, for both representations.

Graphs are prepared once per formula and compared once per candidate pair (topics times depth), in Arrow batches; the
inverse document frequencies come as a map column of just the pair's tuples or as a bounded broadcast."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trees
from ..functions.workers import ship
from .features import IDF_LEVELS, LEVELS, PROTO_LEVELS, base_names, proto_names

MOST_IDF_KEYS = 4_000_000  # most keys of a broadcast document-frequency table: two sorted arrays, 48 MB


class Prepared:
    """One graph, ready for many comparisons."""

    def __init__(self, g: trees.Graph):
        self.size = len(g.tags)
        order, kids = trees.canonical_order(g)
        label = {lv: trees.alpha_labels(g, order) if lv == "alpha" else trees.labels(g, lv) for lv in PROTO_LEVELS}
        self.bags = {(lv, kind): bag for lv in PROTO_LEVELS for kind, bag in trees.tuples(g, label[lv]).items()}
        self.trees = trees.comparison_trees(g, order, kids, label)


def _agreement(q: Counter, c: Counter, weight=None) -> tuple[float, float]:
    """Recall and precision of the multiset intersection; two empty sides agree."""
    if weight is None:
        nq, nc = sum(q.values()), sum(c.values())
        inter = sum([min(n, c[t]) for t, n in q.items() if t in c])
    else:
        nq, nc = sum(n * weight(t) for t, n in q.items()), sum(n * weight(t) for t, n in c.items())
        inter = sum(min(n, c[t]) * weight(t) for t, n in q.items() if t in c)
    if not nq and not nc:
        return 1.0, 1.0
    return (inter / nq if nq else 0.0), (inter / nc if nc else 0.0)


def _rpf(q: Counter, c: Counter) -> list[float]:
    r, p = _agreement(q, c)
    return [r, p, 2 * r * p / (r + p) if r + p else 0.0]


def compare(q: Prepared | None, c: Prepared | None, idf=None) -> tuple[list[float], list[float]]:
    """The base and proto features of one representation; a missing graph is zeros with the flag set."""
    if q is None or c is None:
        return [0.0] * (len(base_names()) // 2 - 1) + [1.0], [0.0] * (len(proto_names()) // 2)
    base = [x for lv in LEVELS for kind in ("edge", "path") for x in _rpf(q.bags[lv, kind], c.bags[lv, kind])]
    base += [trees.edit_similarity(q.trees[t], c.trees[t]) for t in ("exact", "unified")]
    base += [min(q.size, c.size) / max(q.size, c.size), 0.0]
    proto = [x for kind in ("edge", "path") for x in _rpf(q.bags["alpha", kind], c.bags["alpha", kind])]
    proto += [x for lv in PROTO_LEVELS for x in _rpf(q.bags[lv, "path3"], c.bags[lv, "path3"])]
    for lv in IDF_LEVELS:
        for kind in ("edge", "path"):
            proto += _agreement(q.bags[lv, kind], c.bags[lv, kind], None if idf is None else lambda t, k=(lv, kind): idf(*k, t))
    proto += [trees.edit_similarity(q.trees[t], c.trees[t]) for t in ("exact_canon", "alpha_canon")]
    return base, proto


@dataclass
class IdfTable:
    """Hashed document frequencies: sorted keys, their frequencies, and the number of formulas."""

    keys: np.ndarray
    df: np.ndarray
    n: int

    def weight(self, level: str, kind: str, t: tuple) -> float:
        h = xxhash.xxh64_intdigest("\x1f".join((level, kind, *t)).encode(), 42)
        h -= (1 << 64) if h >> 63 else 0
        i = int(np.searchsorted(self.keys, h))
        d = int(self.df[i]) if i < len(self.keys) and self.keys[i] == h else 0
        return float(np.log1p((self.n - d + 0.5) / (d + 0.5)))


def _idf_keys(tuples: DataFrame, owner: str) -> DataFrame:
    """(owner, key) of every different tuple of the levels and kinds that are weighed."""
    rows = tuples.where(F.col("level").isin(*IDF_LEVELS) & F.col("kind").isin("edge", "path"))
    return rows.select(owner, F.xxhash64(F.concat_ws("\x1f", "level", "kind", "tuple")).alias("key")).distinct()


def idf_tables(tuples: DataFrame, owner: str, pairs: DataFrame, side: str, most: int = MOST_IDF_KEYS) -> Iterator[tuple[DataFrame, IdfTable]]:
    """The pairs in blocks, each with the document frequencies that it needs; tuples: owner, level, kind, tuple.

    Frequencies count all formulas.  Where the whole table has at most ``most`` keys there is one block.  Otherwise pairs go
    by a hash of the column ``side`` (the query of a pair) into blocks, more of them until each block's own formulas, named
    by the columns ``side`` and ``owner`` of the pairs, have no more keys than that: nothing is sampled or left out.
    """
    each = _idf_keys(tuples, owner)
    df, n = each.groupBy("key").agg(F.count("*").alias("df")), each.select(owner).distinct().count()

    def table(part: DataFrame) -> IdfTable:
        got = part.orderBy("key").toArrow()
        return IdfTable(got["key"].to_numpy(), got["df"].to_numpy().astype(np.int32), n)

    if df.count() <= most:
        yield pairs, table(df)
        return
    blocks = 2
    while True:
        block = F.pmod(F.xxhash64(side), F.lit(blocks))
        needed = pairs.select(block.alias("block"), F.explode(F.array(side, owner)).alias(owner)).distinct().join(each, owner).select("block", "key").distinct()
        sizes = {r["block"]: r["count"] for r in needed.groupBy("block").count().collect()}
        if max(sizes.values(), default=0) <= most:
            break
        if blocks > 1 << 16:
            raise ValueError("one query's pairs alone need more document frequencies than a block may hold")
        blocks *= 2
    for i in sorted(sizes):
        yield pairs.where(block == i), table(df.join(needed.where(F.col("block") == i).select("key"), "key", "left_semi"))


def idf_table(tuples: DataFrame, owner: str) -> IdfTable:
    """The document frequencies of all keys, refused beyond MOST_IDF_KEYS; ``idf_tables`` has no such bound."""
    each = _idf_keys(tuples, owner)
    df = each.groupBy("key").agg(F.count("*").alias("df"))
    if df.count() > MOST_IDF_KEYS:
        raise ValueError("the document-frequency table is too large for one broadcast; use idf_tables")
    got = df.orderBy("key").toArrow()
    return IdfTable(got["key"].to_numpy(), got["df"].to_numpy().astype(np.int32), each.select(owner).distinct().count())


def graph_pairs(q: DataFrame, c: DataFrame, on: str) -> DataFrame:
    """The two sides of candidate pairs joined by a shuffle: parsed graphs are hundreds of times larger than the files from
    which the optimiser reckons their size, so a broadcast that it takes for small can exceed the driver."""
    return q.hint("merge").join(c, on)


def pair_features(pairs: DataFrame, idf: IdfTable | None = None) -> DataFrame:
    """pairs with one double column per feature name (base, then proto).

    pairs: q_slt, q_opt, c_slt, c_opt (graph structs, nullable) beside any keys."""
    names = base_names() + proto_names()
    graphs = ("q_slt", "q_opt", "c_slt", "c_opt")
    keys = [c for c in pairs.columns if c not in graphs]
    ship(pairs.sparkSession)
    shared = pairs.sparkSession.sparkContext.broadcast(idf) if idf is not None else None

    def work(parts):
        weight = None if shared is None else lru_cache(1 << 16)(shared.value.weight)
        ready: dict = {}

        def prepared(row):
            if row is None:
                return None
            edges = tuple((e["src"], e["dst"], e["type"]) for e in row["edges"])
            key = (tuple(row["tags"]), tuple(row["symbols"]), edges)
            if key not in ready:
                if len(ready) > 5000:
                    ready.clear()
                ready[key] = Prepared(trees.Graph(*key))
            return ready[key]

        for part in parts:
            rows = []
            for qs, qo, cs, co in zip(*(part[g] for g in graphs), strict=True):
                sides = [compare(prepared(q), prepared(c), weight) for q, c in ((qs, cs), (qo, co))]
                rows.append([x for b, _ in sides for x in b] + [x for _, p in sides for x in p])
            out = pd.DataFrame(np.array(rows, np.float64).reshape(len(rows), len(names)), columns=names)
            yield pd.concat([part[keys].reset_index(drop=True), out], axis=1)

    from pyspark.sql import types as T

    schema = T.StructType([*pairs.select(*keys).schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return pairs.mapInPandas(work, schema)


