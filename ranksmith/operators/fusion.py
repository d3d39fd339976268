"""Fusion of runs: reciprocal ranks and weighted min-max scores, weight tuning and its cross-validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEPTH, RRF_K
from .ranking import minmax, ranked, truncate
from .settings import evaluate

GRID = tuple(round(0.05 * i, 2) for i in range(21))


def _sum(parts: Sequence[DataFrame]) -> DataFrame:
    """One union and one sum instead of a chain of outer joins."""
    return reduce(DataFrame.unionByName, parts).groupBy("topic_id", "visual_id").agg(F.sum("part").alias("score"))


def rrf(runs: Sequence[DataFrame], k: int = RRF_K, depth: int = DEPTH, digits: int | None = None) -> DataFrame:
    fused = _sum([ranked(r).select("topic_id", "visual_id", (1.0 / (k + F.col("rank"))).alias("part")) for r in runs])
    return truncate(fused if digits is None else fused.withColumn("score", F.round("score", digits)), depth)


def linear(runs: Sequence[DataFrame], weights: Sequence[float] | None = None, depth: int = DEPTH, digits: int | None = None) -> DataFrame:
    """Weighted sum of per-topic min-max scores; equal weights by default, a document missing in a run adds 0."""
    weights = weights or [1.0 / len(runs)] * len(runs)
    fused = _sum([minmax(r).select("topic_id", "visual_id", (F.lit(float(w)) * F.col("norm")).alias("part")) for r, w in zip(runs, weights, strict=True)])
    return truncate(fused if digits is None else fused.withColumn("score", F.round("score", digits)), depth)


def grid(run_a: DataFrame, run_b: DataFrame, qrels: DataFrame, weights: Sequence[float] = GRID, depth: int = DEPTH, digits: int = 6) -> DataFrame:
    """(w, topic_id, ndcg, ap, p10) for every weight w of run_b, 1 - w of run_a.

    Both scores of a document meet once; each topic's group is then ordered under every weight."""
    a = minmax(run_a).select("topic_id", "visual_id", F.col("norm").alias("a"), F.lit(0.0).alias("b"))
    b = minmax(run_b).select("topic_id", "visual_id", F.lit(0.0).alias("a"), F.col("norm").alias("b"))
    both = a.unionByName(b).groupBy("topic_id", "visual_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    mixed = lambda t, s: t.by_score(np.round((1 - s[0]) * t.columns["a"] + s[0] * t.columns["b"], digits))
    return evaluate(both, qrels, [(float(w),) for w in weights], "w double", mixed, depth)


def best_weight(scored: DataFrame, by: Sequence[str] = (), measure: str = "ndcg", digits: int = 9) -> DataFrame:
    """The weight with the best mean; ties go to the one closest to one half, then to the smallest."""
    means = scored.groupBy(*by, "w").agg(F.round(F.avg(measure), digits).alias("mean"))
    order = F.struct(-F.col("mean"), F.round(F.abs(F.col("w") - 0.5), 6), F.col("w"))
    if by:
        return means.groupBy(*by).agg(F.min_by(F.struct("w", "mean"), order).alias("m")).select(*by, "m.w", "m.mean")
    return means.agg(F.min_by(F.struct("w", "mean"), order).alias("m")).select("m.w", "m.mean")


def cross_validate(scored: DataFrame, folds: DataFrame, measure: str = "ndcg") -> DataFrame:
    """(fold, w, held_out_mean): each fold's topics are scored with the weight tuned on the others; folds: topic_id, fold."""
    rows = scored.join(folds, "topic_id")
    all_folds = folds.select(F.col("fold").alias("held")).distinct()
    others = rows.join(F.broadcast(all_folds), F.col("fold") != F.col("held"))
    tuned = best_weight(others, ["held"], measure).select(F.col("held").alias("fold"), "w")
    return rows.join(tuned, ["fold", "w"]).groupBy("fold", "w").agg(F.avg(measure).alias("held_out_mean"), F.count("*").alias("topics"))


