"""From raw formula tables to the retrieval corpus: three-way merge, flags, representatives, statistics, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def merge_mismatches(latex: DataFrame, opt: DataFrame, slt: DataFrame) -> DataFrame:
    """(id, in_latex, in_opt, in_slt) of ids that are not in all three tables."""
    mark = lambda df, i: df.select("id", *[F.lit(int(i == j)).alias(n) for j, n in enumerate(("in_latex", "in_opt", "in_slt"))])
    every = mark(latex, 0).unionByName(mark(opt, 1)).unionByName(mark(slt, 2))
    seen = every.groupBy("id").agg(*[F.max(n).alias(n) for n in ("in_latex", "in_opt", "in_slt")])
    return seen.where("in_latex + in_opt + in_slt < 3")


def merge(latex: DataFrame, opt: DataFrame, slt: DataFrame, strict: bool = True) -> DataFrame:
    """The formula index from the three representations, joined on id (tables bucketed by id join without a shuffle).

    strict: a full outer join that fails on the first id missing from a table; otherwise such ids are left out."""
    how = "full_outer" if strict else "inner"
    side = lambda df, name: df.select("id", F.col("issue").alias(f"issue_{name}"), C.blank_to_null("formula").alias(name), F.lit(True).alias(f"has_{name}"))
    rows = latex.withColumn("has_latex", F.lit(True)).join(side(opt, "opt"), "id", how).join(side(slt, "slt"), "id", how)
    if strict:
        whole = F.col("has_latex").isNotNull() & F.col("has_opt").isNotNull() & F.col("has_slt").isNotNull()
        rows = rows.withColumn("__ok", F.assert_true(whole, F.concat(F.lit("formula id without all three representations: "), F.col("id").cast("string")))).where(F.col("__ok").isNull())
    flags = C.union_flags("issue", "issue_opt", "issue_slt")
    return rows.select(
        "id", "post_id", "thread_id", "type", C.blank_to_null("comment_id").alias("comment_id"), "old_visual_id", "visual_id",
        flags.alias("issue"), C.retrievable(flags).alias("retrievable"), F.coalesce(C.strip("formula"), F.lit("")).alias("latex"), "opt", "slt",
    )


def flag_disagreements(latex: DataFrame, opt: DataFrame, slt: DataFrame) -> DataFrame:
    """Rows whose flags differ between the tables."""
    f = lambda df, n: df.select("id", F.coalesce(C.strip("issue"), F.lit("")).alias(n))
    return f(latex, "a").join(f(opt, "b"), "id").join(f(slt, "c"), "id").where("a <> b or b <> c")


def representatives(index: DataFrame) -> DataFrame:
    """The visual index: per visual_id its best retrievable row (both markups, then not a comment, then least id) and
    the number of retrievable instances.

    One pass: the payload travels as min_by of the sort key, with partial aggregation, so a frequent formula sends one
    row per task."""
    priority = 2 * (F.col("opt").isNull() | F.col("slt").isNull()).cast("int") + F.coalesce((F.col("type") == "comment").cast("int"), F.lit(0))
    payload = F.struct(F.col("id").alias("formula_id"), "post_id", "type", "latex", "slt", "opt")
    best = index.where("retrievable").groupBy("visual_id").agg(F.min_by(payload, F.struct(priority.alias("p"), F.col("id"))).alias("r"), F.count("*").alias("n_instances"))
    return best.select("visual_id", "r.formula_id", "r.post_id", "r.type", "n_instances", "r.latex", "r.slt", "r.opt")


def build_stats(index: DataFrame) -> DataFrame:
    """Rows, distinct visual ids, retrievable ones, and representatives without markup."""
    per = index.groupBy("visual_id").agg(F.count("*").alias("n"), F.bool_or("retrievable").alias("any"), F.bool_or(F.col("retrievable") & F.col("opt").isNotNull() & F.col("slt").isNotNull()).alias("xml"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("visual_ids"), F.count_if("any").alias("retrievable_ids"), F.count_if(F.col("any") & ~F.col("xml")).alias("without_xml"))


def ingest_stats(index: DataFrame) -> DataFrame:
    """Per flag: rows, rows without markup, and the share whose LaTeX equals the markup's alttext."""
    alt = C.alttext("slt")
    match = F.coalesce(C.latex_key(alt) == C.latex_key("latex"), F.lit(False))
    return index.groupBy(F.coalesce("issue", F.lit("")).alias("issue")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("opt").isNull() | F.col("slt").isNull()).alias("without_xml"), F.count_if(match & F.col("slt").isNotNull()).alias("matched"), F.count("slt").alias("compared")
    )


def coverage(qrels: DataFrame, corpus: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Relevant documents and how many of them the corpus lacks (the recall ceiling)."""
    relevant = qrels.where("grade >= 2").select(*by, "visual_id").distinct()
    known = corpus.select("visual_id").distinct().withColumn("__in", F.lit(1))
    return relevant.join(known, "visual_id", "left").groupBy(*by).agg(F.count("*").alias("relevant"), F.count_if(F.col("__in").isNull()).alias("missing"))


def missing_relevant(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    return qrels.where("grade >= 2").select("visual_id").distinct().join(corpus, "visual_id", "left_anti")


def lookup(corpus: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns of the wanted visual_ids; the id list is broadcast where Spark finds it small."""
    return corpus.join(wanted.select("visual_id").distinct(), "visual_id", "left_semi").select("visual_id", *columns)
