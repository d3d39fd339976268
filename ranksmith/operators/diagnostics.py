"""Data-quality reports: id-space verdict, LaTeX mismatch buckets, failure causes, index scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def latex_similarity(pairs: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """Trigram Jaccard similarity of two LaTeX columns."""
    return pairs.withColumn(out, C.jaccard(C.trigrams(C.formula_text(a)), C.trigrams(C.formula_text(b))))


def id_space_scan(index: DataFrame, column: str, has_xml: str = "has_xml", examples: int = 3) -> DataFrame:
    """Per cleaned id of the column: instances, types, whether any has markup, and the first non-empty LaTeX by id."""
    rows = index.withColumn("value", C.clean_id(column)).where("value is not null")
    order = Window.partitionBy("value").orderBy("id")
    first = rows.where(C.strip("latex") != "").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= examples)
    texts = first.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "latex"))), lambda x: x["latex"]).alias("latex"))
    stats = rows.groupBy("value").agg(F.count("*").alias("instances"), F.count_distinct("type").alias("types"), F.bool_or(has_xml).alias("has_xml"))
    each = rows.groupBy("value", "type").agg(F.count("*").alias("n"))
    by_type = each.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("by_type"))
    return stats.join(by_type, "value").join(texts, "value", "left")


def id_space_summary(index: DataFrame, new: str = "visual_id", old: str = "old_visual_id") -> DataFrame:
    """One row for the whole index: the range of the ids that are numbers, and how many old ids equal the new or are missing."""
    n, o, v = C.clean_id(new).try_cast("long"), C.clean_id(old), C.clean_id(new)
    return index.agg(F.min(n).alias("least"), F.max(n).alias("greatest"), F.count("*").alias("rows"), F.count_if(o == v).alias("old_equal"), F.count_if(o.isNull()).alias("old_missing"))


def grade_similarity(hits: DataFrame, by: tuple[str, ...] = ("column",)) -> DataFrame:
    """(by, grade, mean similarity, n): hits has one row per judged pair with its best similarity."""
    return hits.groupBy(*by, "grade").agg(F.avg("similarity").alias("mean_similarity"), F.count("*").alias("n"))


def verdict(hits: DataFrame, judged: DataFrame, by: tuple[str, ...] = ("column",), least: float = 0.05, digits: int = 6) -> DataFrame:
    """Per column: coverage of the judged pairs, separation (mean similarity of relevant minus of grade 0), place by
    (coverage, separation) and whether the separation is enough.  judged: one row, n_judged."""
    mean = lambda cond: F.avg(F.when(cond, F.col("similarity")))
    each = hits.groupBy(*by).agg(F.count("*").alias("covered"), (mean(F.col("grade") >= 2) - mean(F.col("grade") == 0)).alias("separation"))
    rows = each.join(F.broadcast(judged)).withColumn("coverage", F.round(F.col("covered") / F.col("n_judged"), digits)).withColumn("separation", F.round("separation", digits))
    order = Window.orderBy(F.desc("coverage"), F.desc_nulls_last("separation"))
    return rows.select(*by, "coverage", "separation", F.rank().over(order).alias("place"), F.coalesce(F.col("separation") >= least, F.lit(False)).alias("plausible"))


def mismatch_buckets(rows: DataFrame, group: str, latex: str = "latex", alt: str = "alttext") -> DataFrame:
    """Rows per group and kind of difference between the LaTeX and the markup's own."""
    return rows.groupBy(group, C.mismatch_bucket(latex, F.col(alt)).alias("bucket")).agg(F.count("*").alias("n"))


def failure_causes(rows: DataFrame, rep: str, cause: str, key: str, examples: int = 3) -> DataFrame:
    """Causes with their counts and the first keys of each."""
    order = Window.partitionBy(rep, cause).orderBy(key)
    numbered = rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= examples)
    shown = numbered.groupBy(rep, cause).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return rows.groupBy(rep, cause).agg(F.count("*").alias("n")).join(shown, [rep, cause])
