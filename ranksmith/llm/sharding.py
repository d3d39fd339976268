"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Each record hashes its key with every shard's number to a uniform value u and goes to the shard with the least
-ln(u) / weight.  A shard's value does not depend on the others, so one more shard takes records only into itself, about
its share of them, and nothing moves between the old ones.

A record's slot within its shard is a running number in a seeded order, without gathering a shard in one task: rows are
numbered within (shard, first three hex digits of the md5 of key and text's crc32), and the counts of the digits before
are added.  One key of many texts is thus no hot cell.  The counts are at most 4096 a shard, so they are broadcast whatever
the size of the data.

Defined results for odd input
    null text: size 1, crc32 of the empty text.  null key: hashed as empty.  repeated rows or keys: the same shard, slots
    of their own.  Empty table: empty result.  Texts of any length are hashed whole; extra columns are dropped, so a
    clash of names cannot arise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import digest_text, stored

SEED = 3
SHARDS = 8


def _cost(key: Column, shard: int, weight: float) -> Column:
    uniform = (F.conv(F.substring(digest_text(f"{SEED}.{shard}", key), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight




def shard(documents: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, more: Sequence[float] = (1.0,), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (the shard once those of ``more`` are added)."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    costs = F.array(*[_cost(F.col(key), i, w) for i, w in enumerate([*weights, *more])])
    rows = documents.select(key, (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"), digest_text(str(SEED), F.col(key), F.crc32(content)).alias("__h"), costs.alias("__c"))
    old = F.slice("__c", 1, len(weights))
    place = lambda c: (F.array_position(c, F.array_min(c)) - 1).cast("int")
    rows = stored(rows.select(key, "size", "text_crc32", "__h", F.substring("__h", 1, 3).alias("__d"), place(old).alias("shard"), place(F.col("__c")).alias("grown_shard")), "shards")
    before = Window.partitionBy("shard").orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "__d").agg(F.count("*").alias("n")).select("shard", "__d", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("shard", "__d").orderBy("__h", F.col(key).asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("__n", F.row_number().over(within)).join(F.broadcast(counts), ["shard", "__d"])
    return numbered.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__before") + F.col("__n") - 1).cast("long").alias("slot"), "grown_shard")


def op7_sharding(documents: DataFrame) -> DataFrame:
    return shard(documents)


#: The crc32 is folded byte by byte over a table made from its polynomial.
OP7_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, encode(coalesce(text, '')) AS b FROM documents),
u AS (SELECT doc_id, CAST(octet_length(b) + 1 AS BIGINT) AS size, k,
             xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(b), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) AS text_crc32,
             list_transform(range(9), lambda j: -ln((CAST('0x' || substr(md5('3.' || j || '|' || k), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)) AS c
      FROM d, crc),
s AS (SELECT *, CAST(list_position(c[1:8], list_min(c[1:8])) - 1 AS INTEGER) AS shard, CAST(list_position(c, list_min(c)) - 1 AS INTEGER) AS grown_shard FROM u)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5('3|' || k || '|' || text_crc32), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""
