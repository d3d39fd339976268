"""Similarity features between tuple multisets, and the feature schema.

Tuples are long tables (owner, level, kind, tuple, n); overlaps are equi-joins on (level, kind, tuple) with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPS = ("slt", "opt")
LEVELS = ("exact", "unified", "structure")
PROTO_LEVELS = ("exact", "alpha", "unified", "structure")
IDF_LEVELS = ("exact", "alpha", "unified")
FIRST_STAGE = ("bm25", "cosine", "rrf_score", "rrf_rank")


# Fixed: the names of the features and their order, which stored feature tables and models share.


def base_names() -> list[str]:
    each = lambda r: [f"{r}_{lv}_{k}_{m}" for lv in LEVELS for k in ("edge", "path") for m in ("recall", "precision", "f1")] + [f"{r}_{x}" for x in ("ted_exact", "ted_unified", "size_ratio", "missing")]
    return [n for r in REPS for n in each(r)]


def proto_names() -> list[str]:
    def each(r):
        yield from (f"{r}_alpha_{k}_{m}" for k in ("edge", "path") for m in ("recall", "precision", "f1"))
        yield from (f"{r}_{lv}_path3_{m}" for lv in PROTO_LEVELS for m in ("recall", "precision", "f1"))
        yield from (f"{r}_idf_{lv}_{k}_{m}" for lv in IDF_LEVELS for k in ("edge", "path") for m in ("recall", "precision"))
        yield from (f"{r}_ted_exact_canon", f"{r}_ted_alpha_canon")

    return [n for r in REPS for n in each(r)]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _rpf(inter: Column, nq: Column, nc: Column) -> list[Column]:
    """Recall, precision and F1; two empty sides agree fully."""
    both = (nq == 0) & (nc == 0)
    r, p = F.when(both, 1.0).otherwise(_ratio(inter, nq)), F.when(both, 1.0).otherwise(_ratio(inter, nc))
    return [r.alias("recall"), p.alias("precision"), F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0).alias("f1")]


def overlap(queries: DataFrame, docs: DataFrame, pairs: DataFrame, within: tuple[str, ...] = (), tuple_: str = "tuple") -> DataFrame:
    """Multiset overlap of each (q, c) pair: recall, precision, f1, within the given grouping columns.

    queries: q, *within, tuple, n; docs: c, *within, tuple, n; pairs: q, c.  The join is on the pair and the tuple."""
    w = list(within)
    sums = lambda df, k, name: df.groupBy(k, *w).agg(F.sum("n").alias(name))
    inter = pairs.join(queries.withColumnRenamed("n", "nq"), "q").join(docs.withColumnRenamed("n", "nc"), ["c", *w, tuple_]).groupBy("q", "c", *w).agg(F.sum(F.least("nq", "nc")).alias("inter"))
    frame = pairs.join(sums(queries, "q", "nq"), "q", "left").join(sums(docs, "c", "nc"), ["c", *w], "left").join(inter, ["q", "c", *w], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return frame.select("q", "c", *w, *_rpf(z("inter"), z("nq"), z("nc")))


def document_frequency(tuples: DataFrame, owner: str, keys: tuple[str, ...] = ("tuple",)) -> DataFrame:
    return tuples.select(owner, *keys).distinct().groupBy(*keys).agg(F.count("*").alias("df"))


def idf(n: Column | int, df: Column) -> Column:
    """log(1 + (N - df + 0.5) / (df + 0.5)); an unseen key has df 0, the maximum."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.log1p((n - df + 0.5) / (df + 0.5))


def idf_overlap(queries: DataFrame, docs: DataFrame, pairs: DataFrame, df: DataFrame, n_docs: DataFrame, keys: tuple[str, ...] = ("tuple",), within: tuple[str, ...] = ()) -> DataFrame:
    """Overlap weighted by inverse document frequency: recall and precision.  n_docs: one row, n_docs."""
    k, w = list(keys), list(within)
    weigh = lambda t: t.join(df, k, "left").join(F.broadcast(n_docs)).withColumn("w", idf(F.col("n_docs"), F.coalesce("df", F.lit(0)))).drop("df", "n_docs")
    qs, cs = weigh(queries), weigh(docs)
    sums = lambda t, o, name: t.groupBy(o, *w).agg(F.sum(F.col("n") * F.col("w")).alias(name))
    inter = pairs.join(qs.withColumnRenamed("n", "nq"), "q").join(cs.drop("w").withColumnRenamed("n", "nc"), ["c", *k]).groupBy("q", "c", *w).agg(F.sum(F.least("nq", "nc") * F.col("w")).alias("inter"))
    frame = pairs.join(sums(qs, "q", "nq"), "q", "left").join(sums(cs, "c", "nc"), ["c", *w], "left").join(inter, ["q", "c", *w], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = (z("nq") == 0) & (z("nc") == 0)
    return frame.select("q", "c", *w, F.when(both, 1.0).otherwise(_ratio(z("inter"), z("nq"))).alias("recall"), F.when(both, 1.0).otherwise(_ratio(z("inter"), z("nc"))).alias("precision"))


def size_ratio(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def assemble(candidates: DataFrame, qrels: DataFrame, pair_features: DataFrame) -> DataFrame:
    """(topic_id, visual_id, grade, features): grade -1 where unjudged; candidates without features are left out."""
    judged = candidates.join(qrels, ["topic_id", "visual_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(-1)))
    return judged.join(pair_features, ["topic_id", "visual_id"])


def candidates(run: DataFrame, qrels: DataFrame, depth: int) -> DataFrame:
    """Judged documents and the run's first ``depth``, each pair once."""
    from .ranking import truncate

    return truncate(run, depth).select("topic_id", "visual_id").union(qrels.select("topic_id", "visual_id")).distinct()
