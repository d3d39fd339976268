"""Runs, submissions and judgments between formula ids and visual ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEPTH, RELEVANT
from .ranking import ranked, truncate


def formula_to_visual(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(formula_id, visual_id) of the wanted formula ids."""
    return index.select(F.col("id").cast("string").alias("formula_id"), "visual_id").join(wanted.select(F.col("formula_id").cast("string")).distinct(), "formula_id", "left_semi")


def import_run(submission: DataFrame, mapping: DataFrame) -> DataFrame:
    """(topic_id, visual_id, score): the first formula of each visual id in score order, ties in file order."""
    mapped = submission.withColumn("formula_id", F.col("formula_id").cast("string")).join(mapping, "formula_id")
    order = F.struct(-F.col("score"), F.col("pos"))
    return mapped.groupBy("topic_id", "visual_id").agg(F.min_by("score", order).alias("score"))


def unmapped(submission: DataFrame, mapping: DataFrame) -> DataFrame:
    return submission.withColumn("formula_id", F.col("formula_id").cast("string")).join(mapping, "formula_id", "left_anti")


def export_submission(run: DataFrame, corpus: DataFrame, run_id: str, depth: int = DEPTH) -> DataFrame:
    """(topic_id, formula_id, post_id, rank, score, run_id): cut by rank first, then rows without a representative are
    dropped and ranks closed up."""
    rows = truncate(run, depth).join(corpus.select("visual_id", "formula_id", "post_id"), "visual_id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy("rank"))).select("topic_id", "formula_id", "post_id", "rank", "score", F.lit(run_id).alias("run_id"))


def dropped_by_export(run: DataFrame, corpus: DataFrame, depth: int = DEPTH) -> DataFrame:
    return truncate(run, depth).join(corpus.select("visual_id"), "visual_id", "left_anti")


def rekey(judgments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Judgments by formula id -> by visual id; where instances disagree the highest grade counts."""
    return judgments.withColumn("formula_id", F.col("formula_id").cast("string")).join(mapping, "formula_id").groupBy("topic_id", "visual_id").agg(F.max("grade").alias("grade"))


def conflicts(judgments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Visual ids whose instances have different grades: the instances in order, the spread, whether relevance differs."""
    rows = judgments.withColumn("formula_id", F.col("formula_id").cast("string")).join(mapping, "formula_id")
    each = F.array_sort(F.collect_list(F.struct("formula_id", "grade")))
    grouped = rows.groupBy("topic_id", "visual_id").agg(F.min("grade").alias("lo"), F.max("grade").alias("hi"), each.alias("each")).where("lo < hi")
    return grouped.select(
        "topic_id",
        "visual_id",
        F.array_join(F.transform("each", lambda e: F.concat_ws(":", e["formula_id"], e["grade"].cast("string"))), " ").alias("grades"),
        (F.col("hi") - F.col("lo")).alias("spread"),
        ((F.col("lo") < RELEVANT) & (F.col("hi") >= RELEVANT)).alias("straddles"),
    )


def to_lines(run: DataFrame, run_id: str, depth: int = DEPTH) -> DataFrame:
    """(topic_id, rank, value): run file lines 'topic Q0 id rank score run_id'."""
    rows = ranked(run).where(F.col("rank") <= depth) if depth > 0 else ranked(run)
    valid = F.assert_true(F.regexp_like(F.lit(run_id), F.lit("^[A-Za-z0-9_-]+$")), f"bad run id {run_id!r}")
    line = F.concat_ws(" ", "topic_id", F.lit("Q0"), "visual_id", F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(run_id))
    return rows.withColumn("__ok", valid).where(F.col("__ok").isNull()).select("topic_id", "rank", line.alias("value"))
