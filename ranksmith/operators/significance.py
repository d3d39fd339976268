"""Paired comparison of two runs: win/loss counts, topic gains and losses, randomisation test and bootstrap interval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9
DRAWS = 10_000


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(measure, topic_id, delta = b - a) of two long-form tables; fails where the topics differ."""
    both = a.select("measure", "topic_id", F.col("value").alias("va")).join(b.select("measure", "topic_id", F.col("value").alias("vb")), ["measure", "topic_id"], "full_outer")
    same = F.assert_true(F.col("va").isNotNull() & F.col("vb").isNotNull(), "the runs have different topics")
    return both.withColumn("__same", same).where(F.col("__same").isNull()).select("measure", "topic_id", "va", "vb", (F.col("vb") - F.col("va")).alias("delta"))


def win_loss_tie(deltas: DataFrame) -> DataFrame:
    d = F.col("delta")
    return deltas.groupBy("measure").agg(F.avg("delta").alias("delta"), F.count_if(d > TOLERANCE).alias("wins"), F.count_if(d < -TOLERANCE).alias("losses"), F.count_if(F.abs(d) <= TOLERANCE).alias("ties"))


def gains_and_losses(deltas: DataFrame, n: int = 5) -> DataFrame:
    """The n largest gains and the n largest losses per measure."""
    from pyspark.sql import Window

    up = Window.partitionBy("measure").orderBy(F.desc("delta"), "topic_id")
    down = Window.partitionBy("measure").orderBy("delta", "topic_id")
    best = deltas.withColumn("place", F.row_number().over(up)).where(F.col("place") <= n).withColumn("side", F.lit("gain"))
    worst = deltas.withColumn("place", F.row_number().over(down)).where(F.col("place") <= n).withColumn("side", F.lit("loss"))
    return best.unionByName(worst)


def _chunks(draws: int, n: int, most: int = 1 << 20):
    """Numbers of draws whose random numbers fit a buffer of ``most``, for n each."""
    step = max(1, most // max(n, 1))
    return [min(step, draws - lo) for lo in range(0, draws, step)]


def randomisation_p(delta: np.ndarray, draws: int = DRAWS, seed: int = 0) -> float:
    """Two-sided p of the mean difference under random signs; nothing to flip gives 1.

    With bits b for the positive signs a draw's sum is 2 b.delta - sum(delta), so a chunk of draws is one product; extreme
    sums are counted as they come.
    """
    total, n = float(delta.sum()), len(delta)
    if not np.count_nonzero(delta):
        return 1.0
    rng, extreme = np.random.default_rng(seed), 0
    for k in _chunks(draws, n):
        sums = 2.0 * (rng.integers(0, 2, (k, n)) @ delta) - total
        extreme += int(np.count_nonzero(np.abs(sums) >= abs(total) - n * 1e-12))
    return (1 + extreme) / (1 + draws)


def bootstrap_interval(delta: np.ndarray, draws: int = DRAWS, seed: int = 0, level: float = 0.95) -> tuple[float, float]:
    """The central ``level`` of the means of samples drawn with replacement, read off the sorted means between neighbours."""
    n = len(delta)
    if n == 0:
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = np.sort(np.concatenate([delta.take(rng.integers(0, n, (k, n))).sum(axis=1) for k in _chunks(draws, n)]) / n)

    def at(share: float) -> float:
        place = share * (draws - 1)
        lo = int(place)
        return float(means[lo] + (place - lo) * (means[min(lo + 1, draws - 1)] - means[lo]))

    return at((1 - level) / 2), at((1 + level) / 2)


def significance(deltas: DataFrame, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """One group per measure (topics are few): delta, wins, losses, ties, p_value, ci_low, ci_high."""

    def test(part: pd.DataFrame) -> pd.DataFrame:
        d = part.sort_values("topic_id").delta.to_numpy(float)
        low, high = bootstrap_interval(d, draws, seed)
        return pd.DataFrame([[part.measure.iloc[0], d.mean(), int((d > TOLERANCE).sum()), int((d < -TOLERANCE).sum()), int((abs(d) <= TOLERANCE).sum()), randomisation_p(d, draws, seed), low, high]])

    from ..functions.workers import ship

    ship(deltas.sparkSession)
    return deltas.select("measure", "topic_id", "delta").groupBy("measure").applyInPandas(test, "measure string, delta double, wins long, losses long, ties long, p_value double, ci_low double, ci_high double")
