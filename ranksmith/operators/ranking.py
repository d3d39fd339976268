"""Rank order, depth cut, normalisation and stable sampling, the base of every run operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEPTH


def rank_order(topic: str = "topic_id", doc: str = "visual_id", score: str = "score"):
    """Score descending, ties by document id as a string, descending."""
    return Window.partitionBy(topic).orderBy(F.desc(score), F.col(doc).cast("string").desc())


def ranked(run: DataFrame, topic: str = "topic_id", doc: str = "visual_id", score: str = "score") -> DataFrame:
    return run.withColumn("rank", F.row_number().over(rank_order(topic, doc, score)))


def truncate(run: DataFrame, depth: int = DEPTH, **names) -> DataFrame:
    """The first ``depth`` per topic with their rank; 0 or less keeps all.  Spark prunes before the shuffle
    (WindowGroupLimit), so a hot topic sends only ``depth`` rows per task."""
    rows = ranked(run, **names)
    return rows.where(F.col("rank") <= depth) if depth > 0 else rows


def minmax(run: DataFrame, topic: str = "topic_id", score: str = "score", out: str = "norm") -> DataFrame:
    """Scores scaled to 0..1 per topic; a constant topic is 1.  Extremes are aggregated with partial sums and joined."""
    ends = run.groupBy(topic).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    scaled = (F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    return run.join(ends, topic).withColumn(out, F.when(F.col("__hi") > F.col("__lo"), scaled).otherwise(1.0)).drop("__lo", "__hi")


def seeded(seed: int, *parts: Column | str) -> Column:
    """A seeded hash of the parts as hexadecimal text: md5 of the seed and the parts joined by '|', the same in any engine."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols).cast("binary"))


def below(n: Column, draw: Column) -> Column:
    """A draw below n from a seeded hash: its first 12 hexadecimal digits modulo n."""
    return F.pmod(F.conv(F.substring(draw, 1, 12), 16, 10).cast("long"), n)


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement in a seeded hash order: the same rows however the table is partitioned."""
    return df.orderBy(seeded(seed, key), key).limit(n)


def every_nth(df: DataFrame, n: int, key: str) -> DataFrame:
    """A systematic sample of about 1 in n rows by the key's hash."""
    return df.where(below(F.lit(n), seeded(0, key)) == 0)


def topic_folds(topics: list[str], k: int, seed: int = 0) -> dict[str, int]:
    """Fold of each topic: position in a seeded permutation modulo k (driver side; topics are few)."""
    import numpy as np

    names = sorted(topics)
    return {names[int(t)]: i % k for i, t in enumerate(np.random.default_rng(seed).permutation(len(names)))}


def round_score(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)
