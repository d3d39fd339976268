"""Mixing sources to target weights: capped water-filling over sources, then seeded whole and fractional repetitions.

Targets.  The budget is shared by weight; a source stops at ``most_epochs`` times its own size and what it cannot take
is shared again among the others, until none is above.  In order of cap per weight the stopped sources come first, so
one pass over the per-source sums finds the water level.

Repetitions.  Every document of a source is taken floor(target / size) times, and the words still missing come from one
more repetition of some of its documents: those first in a seeded order (md5 of seed, key and text), up to the document
that brings the sum nearest to the target.  Where that order crosses the missing amount is found by a radix search: sums
by source and the first three hex digits, then, inside the digit that crosses, by the next three, then row by row in the
one cell left, about a sixteen-millionth of a source.  No source's rows meet in one task; each level moves sums only.

Defined results for odd input
    null source: a source of its own, last in order.  null, empty or blank text: size 0, taken 0, copies as its place
    in the order says.  null key: hashed as empty.  repeated rows: each a document; equal rows are interchangeable.
    Empty table: empty result.  All sizes zero: targets 0.  Extra columns are kept, except those named like an output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, columns_free_of, digest_text, renamed, stored

OUT = ("size", "source_size", "target", "copies", "taken")


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code-point order; share of all sizes; cap in epochs; seed of the choice."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most_epochs: int = 2
    seed: int = 11


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sums: DataFrame, how: Mix) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, so a window over all is small."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(place) - 1) % len(how.weights)
    fill = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in how.weights]), rank.cast("int") + 1)).withColumn("cap", F.col("source_size").cast("double") * how.most_epochs)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    left = how.share * F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), zero)
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)
    leveled = fill.withColumn("level", left / weight_left)
    water = F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(everything)
    return leveled.withColumn("water", water).select("source", "source_size", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), "cap").alias("target"))


def _sized(documents: DataFrame, key: str, text: str, source: str, how: Mix) -> DataFrame:
    """The order's digest is of key and text, so rows that share a key, or have none, are not one cell of the search."""
    body = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return documents.withColumn("size", word_count(text)).withColumn("__h", digest_text(str(how.seed), F.col(key), body))


def _crossing(rows: DataFrame, digit: Column) -> DataFrame:
    """Per source, the digit value in whose sums the missing amount lies, and the words before it."""
    w = Window.partitionBy("source").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", digit.alias("d")).agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    run = sums.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0).cast("long")))
    return run.where("2 * before <= 2 * need and before + words > need").groupBy("source").agg(F.min_by(F.struct("d", "before"), "d").alias("c"))


def mix(documents: DataFrame, how: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source", narrow_only: bool = False) -> DataFrame:
    """documents with size, source_size, target, copies and taken = copies * size (narrow_only: key and source alone)."""
    kept = columns_free_of(documents, *OUT, "__h")
    slim = _sized(documents.select(key, text, F.col(source).alias("source")), key, text, "source", how).select(key, "source", "size", "__h")
    slim = stored(slim, "sizes")
    plan = stored(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), how), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    one, two = F.substring("__h", 1, 3), F.substring("__h", 4, 3)

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        """Equi-join on source, null equal to null; the right side has a row per source."""
        r = right.withColumnRenamed("source", "__s")
        return left.join(r, left["source"].eqNullSafe(r["__s"]), "left").drop("__s")

    rows = beside(slim, plan.select("source", "need"))
    at1 = _crossing(rows, one).select("source", F.col("c.d").alias("d1"), F.col("c.before").alias("before1"))
    plan = stored(beside(plan, at1), "plan")
    inner = beside(slim, plan.select("source", "need", "d1", "before1")).where(one == F.col("d1"))
    at2 = _crossing(inner.withColumn("need", F.col("need") - F.col("before1")), two).select("source", F.col("c.d").alias("d2"), F.col("c.before").alias("before2"))
    plan = stored(beside(plan, at2), "plan")

    frame = slim if narrow_only else _sized(kept, key, text, source, how)
    if not narrow_only and source != "source":
        frame = frame.withColumn("source", F.col(source))
    frame = beside(frame, plan)
    prefix = F.concat(one, two)
    cell = F.concat("d1", F.coalesce("d2", F.lit("")))
    in_cell = F.col("d2").isNotNull() & (prefix == cell)
    order = Window.partitionBy("source").orderBy("__h", F.col(key).asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.col("before1") + F.col("before2") + F.coalesce(F.sum("size").over(order), F.lit(0).cast("long")), F.lit(0).cast("long"))
    # Without a crossing the missing amount is zero (nothing more is taken).
    outside = frame.where(~F.coalesce(in_cell, F.lit(False))).withColumn("more", (F.col("need") > 0) & F.coalesce(prefix < cell, F.lit(False)))
    inside = frame.where(F.coalesce(in_cell, F.lit(False))).withColumn("more", 2 * run + F.col("size") <= 2 * F.col("need"))
    both = outside.unionByName(inside)
    copies = (F.col("whole") + F.col("more").cast("long")).cast("int")
    base = [F.col(key)] + ([F.col("source")] if key != "source" else []) if narrow_only else [F.col(f"`{c}`") for c in kept.columns]
    return both.select(*base, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op2_mixing(documents: DataFrame) -> DataFrame:
    """The query's columns; sizes and choices come from one scan of the texts."""
    return mix(documents, narrow_only=True).select("doc_id", "size", "source_size", "target", "taken", "copies")


def repeated(documents: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns only, whatever their names."""
    rows, new = renamed(documents)
    taken = mix(rows, how, new["doc_id"], new["text"], new["source"]).where("copies > 0")
    again = taken.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*new.values()).toDF(*documents.columns)


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('11|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
      FROM w),
t AS (SELECT source, source_size, coalesce(least(cap, max(CASE WHEN cap / weight > level THEN level END) OVER () * weight), cap) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN need > 0 AND 2 * before + size <= 2 * need THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
       CAST(whole + CASE WHEN need > 0 AND 2 * before + size <= 2 * need THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM r
"""
