"""Retrieval measures over runs and judgments: prime and standard nDCG, AP, precision, bpref, judged share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEPTH, RELEVANT
from .ranking import truncate

CUTS = (5, 10, 100, 1000)


def prime(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Only judged (topic, document) pairs stay."""
    return run.join(qrels.select("topic_id", "visual_id"), ["topic_id", "visual_id"], "left_semi")


def _gain(grade, rank):
    return grade / F.log2(rank + 1.0)


def ideal(qrels: DataFrame, cuts: Sequence[int] = ()) -> DataFrame:
    """Per topic: ideal gain over all judged documents (idcg), at the cuts, and the numbers of relevant and other ones."""
    rows = qrels.withColumn("r", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("grade"), F.desc("visual_id"))))
    part = lambda k: F.sum(F.when(F.col("r") <= k, _gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias(f"idcg_{k}")
    return rows.groupBy("topic_id").agg(
        F.sum(_gain(F.col("grade"), F.col("r"))).alias("idcg"), *[part(k) for k in cuts], F.count_if(F.col("grade") >= RELEVANT).alias("n_rel"), F.count_if(F.col("grade") < RELEVANT).alias("n_non")
    )


def graded(run: DataFrame, qrels: DataFrame, depth: int = DEPTH, mode: str = "prime") -> DataFrame:
    """The cut run with grades and ranks: cut to depth, then filtered to judged documents (prime), then ranked again."""
    cut = truncate(run.select("topic_id", "visual_id", "score"), depth).drop("rank")
    rows = cut.join(qrels, ["topic_id", "visual_id"], "inner" if mode == "prime" else "left")
    order = Window.partitionBy("topic_id").orderBy(F.desc("score"), F.col("visual_id").cast("string").desc())
    g = F.coalesce("grade", F.lit(0))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("judged", F.col("grade").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .withColumn("rel", (g >= RELEVANT).cast("int"))
        .withColumn("rel_so_far", F.sum((g >= RELEVANT).cast("int")).over(so_far))
        .withColumn("non_before", F.sum((F.col("judged") & (g < RELEVANT)).cast("int")).over(so_far))
        .withColumn("grade", g)
    )


def per_topic(run: DataFrame, qrels: DataFrame, depth: int = DEPTH, mode: str = "prime") -> DataFrame:
    """(topic_id, ndcg, ap, p10) for every judged topic; a topic the run lacks scores 0."""
    rows = graded(run, qrels, depth, mode)
    sums = rows.groupBy("topic_id").agg(
        F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"),
        F.sum(F.when(F.col("rel") == 1, F.col("rel_so_far") / F.col("rank")).otherwise(0.0)).alias("hits"),
        F.sum(F.when(F.col("rank") <= 10, F.col("rel")).otherwise(0)).alias("top"),
    )
    zero = F.lit(0.0)
    return (
        ideal(qrels)
        .join(sums, "topic_id", "left")
        .select(
            "topic_id",
            F.when(F.col("idcg") > 0, F.coalesce(F.col("dcg") / F.col("idcg"), zero)).otherwise(0.0).alias("ndcg"),
            F.when(F.col("n_rel") > 0, F.coalesce(F.col("hits") / F.col("n_rel"), zero)).otherwise(0.0).alias("ap"),
            F.coalesce(F.col("top") / 10.0, zero).alias("p10"),
        )
    )


def at_cuts(run: DataFrame, qrels: DataFrame, cuts: Sequence[int] = CUTS, depth: int = DEPTH, mode: str = "prime") -> DataFrame:
    """ndcg_k, map_k and p_k per topic, and bpref."""
    rows = graded(run, qrels, depth, mode)
    ends = ideal(qrels, cuts)
    bp = F.when(F.col("non_before") == 0, 1.0).otherwise(1 - F.least("non_before", "n_rel") / F.least("n_rel", "n_non"))
    joined = rows.join(ends.select("topic_id", "n_rel", "n_non"), "topic_id")
    sums = joined.groupBy("topic_id").agg(
        *[F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}") for k in cuts],
        *[F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), F.col("rel_so_far") / F.col("rank")).otherwise(0.0)).alias(f"hits_{k}") for k in cuts],
        *[F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"top_{k}") for k in cuts],
        F.sum(F.when(F.col("rel") == 1, bp).otherwise(0.0)).alias("bp"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a) / F.col(b), F.lit(0.0))).otherwise(0.0)
    return ends.join(sums, "topic_id", "left").select(
        "topic_id",
        *[share(f"dcg_{k}", f"idcg_{k}").alias(f"ndcg_{k}") for k in cuts],
        *[share(f"hits_{k}", "n_rel").alias(f"map_{k}") for k in cuts],
        *[F.coalesce(F.col(f"top_{k}") / float(k), F.lit(0.0)).alias(f"p_{k}") for k in cuts],
        share("bp", "n_rel").alias("bpref"),
    )


def judged_at_10(run: DataFrame, qrels: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Judged documents among the unfiltered first ten, over ten, for every judged topic."""
    top = truncate(run, min(depth, 10) if depth > 0 else 10)
    n = prime(top, qrels).groupBy("topic_id").agg(F.count("*").alias("n"))
    return qrels.select("topic_id").distinct().join(n, "topic_id", "left").select("topic_id", (F.coalesce("n", F.lit(0)) / 10.0).alias("judged_at_10"))


def mean(values: DataFrame, *measures: str) -> DataFrame:
    """Means over all judged topics."""
    return values.agg(*[F.avg(m).alias(m) for m in measures], F.count("*").alias("topics"))


def missing_topics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judged topics without a run entry."""
    return qrels.select("topic_id").distinct().join(run.select("topic_id"), "topic_id", "left_anti")


def unknown_topics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run topics without judgments: noted, and ignored by the measures."""
    return run.select("topic_id").distinct().join(qrels.select("topic_id"), "topic_id", "left_anti")


def long_form(values: DataFrame, run: str) -> DataFrame:
    """(run, topic_id, measure, value) for comparisons."""
    measures = [c for c in values.columns if c != "topic_id"]
    return values.unpivot("topic_id", measures, "measure", "value").withColumn("run", F.lit(run))
