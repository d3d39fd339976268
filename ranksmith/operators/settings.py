"""Measures of many settings of a ranking at once: one group per topic, whose arrays are ordered again for each setting.

A topic's group is its run and its judgments, as deep as the runs are; what a setting changes is only the order, so a grid
multiplies the arithmetic within a group and no rows of any plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import ship
from ..schema import DEPTH, RELEVANT


class Topic:
    """The documents of one topic: their ids, columns by name, whether they are in the run, and grades (-1: unjudged)."""

    def __init__(self, table: pa.Table):
        ids = np.array(table["visual_id"].to_pylist(), object)
        self.columns = {c: table[c].to_numpy() for c in table.column_names if c not in ("topic_id", "visual_id")}
        self.grade, self.ranked = self.columns["grade"], np.flatnonzero(self.columns["in_run"])
        place = np.empty(len(ids), np.int64)
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        self.id_place = place
        gains = np.sort(self.grade[self.grade > 0])[::-1]
        self.ideal = float((gains / np.log2(np.arange(len(gains)) + 2)).sum())
        self.relevant = int((self.grade >= RELEVANT).sum())

    def by_score(self, score: np.ndarray) -> np.ndarray:
        """The run's documents by score, ties by id, both descending."""
        return self.ranked[np.lexsort((-self.id_place[self.ranked], -score[self.ranked]))]

    def measures(self, order: np.ndarray, depth: int = DEPTH) -> tuple[float, float, float]:
        """nDCG, AP and P@10 of the judged documents within the first ``depth``."""
        grade = self.grade[order[:depth] if depth > 0 else order]
        grade = grade[grade >= 0]
        rank, rel = np.arange(1, len(grade) + 1), grade >= RELEVANT
        ndcg = float((grade / np.log2(rank + 1)).sum()) / self.ideal if self.ideal > 0 else 0.0
        ap = float((np.cumsum(rel) / rank)[rel].sum()) / self.relevant if self.relevant else 0.0
        return ndcg, ap, float(rel[:10].sum()) / 10


def evaluate(run: DataFrame, qrels: DataFrame, settings: Sequence[tuple], schema: str, order: Callable[[Topic, tuple], np.ndarray], depth: int = DEPTH) -> DataFrame:
    """(topic_id, the settings' columns as in ``schema``, ndcg, ap, p10) for every judged topic and setting.

    run: topic_id, visual_id and what ``order`` reads to rank a topic's documents under a setting."""
    ship(run.sparkSession)
    judged = qrels.select("topic_id", "visual_id", F.col("grade").cast("int").alias("grade"))
    rows = run.withColumn("in_run", F.lit(True)).join(judged, ["topic_id", "visual_id"], "full").withColumns({"grade": F.coalesce("grade", F.lit(-1)), "in_run": F.coalesce("in_run", F.lit(False))})
    kind = f"topic_id string, {schema}, ndcg double, ap double, p10 double"
    to = run.sparkSession.createDataFrame([], kind).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(to)

    def each(table: pa.Table) -> pa.Table:
        topic = Topic(table)
        if not (topic.grade >= 0).any():
            return arrow.empty_table()
        name = table["topic_id"][0].as_py()
        got = [(name, *s, *topic.measures(order(topic, s), depth)) for s in settings]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), arrow, strict=True)], schema=arrow)

    return rows.groupBy("topic_id").applyInArrow(each, to)


class Best:
    """The k best (score, id) of each of several queries, from batches of candidates; ties go to the greater id."""

    def __init__(self, names: Sequence, k: int):
        self.names, self.k = names, k
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, object)) for _ in names]

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        held, k = self.held[i], self.k
        if len(held[0]) >= k:
            worth = score >= held[0].min()
            score, ids = score[worth], ids[worth]
        if not len(score):
            return
        v, d = np.concatenate([held[0], score]), np.concatenate([held[1], ids])
        if len(v) > k:
            keep = v >= np.partition(v, len(v) - k)[len(v) - k]  # with all ties at the edge
            v, d = v[keep], d[keep]
            if len(v) > k:
                first = sorted(range(len(v)), key=lambda j: (v[j], d[j]), reverse=True)[:k]
                v, d = v[first], d[first]
        self.held[i] = (v, d)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for name, (v, d) in zip(self.names, self.held, strict=True):
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(list(d), pa.string()), pa.array(v)], ["topic_id", "visual_id", "score"])
