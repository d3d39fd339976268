import zlib

from ranksmith.llm import sharding

from .helpers import empty, odd


def test_contract(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    got = sharding.op7_sharding(docs).toPandas()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert (got.law == "key").all() and set(got.shard) == set(range(8))
    for r in got.itertuples():
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id])
        assert r.grown_shard in (r.shard, 8)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part))) and 60 < len(part) < 190
    assert 60 < (got.grown_shard == 8).sum() < 165


def test_the_key_and_the_shard_count_decide(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.op7_sharding(docs).collect()}
    part = docs.where("doc_id > 50").repartition(5)
    b = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.op7_sharding(part).collect()}
    assert all(a[k] == v for k, v in b.items())


def test_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    counts = {r["shard"]: r["count"] for r in sharding.shard(docs, weights=(1.0, 3.0), more=(4.0,)).groupBy("shard").count().collect()}
    assert 0.22 < counts[0] / 20_000 < 0.28
    one = sharding.shard(docs.limit(100), weights=(1.0,)).collect()
    assert {r["shard"] for r in one} == {0} and sorted(r["slot"] for r in one) == list(range(100))


def test_odd_rows(spark):
    got = sharding.op7_sharding(odd(spark, ["size", "slot", "shard"])).collect()
    assert len(got) == 12 and {r["size"] for r in got if r["doc_id"] in (2, 3)} == {1}
    assert {r["text_crc32"] for r in got if r["doc_id"] == 2} == {0}
    assert len({r["slot"] for r in got if r["doc_id"] == 6}) == 2  # a repeated row has a slot of its own
    assert sharding.op7_sharding(empty(spark)).count() == 0


def test_rows_without_a_key_are_no_one_cell(spark):
    """Rows that share a key are numbered in many cells: the order's digest is of key and text."""
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text")
    got = sharding.op7_sharding(docs).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(3000))
    again = {r["text_crc32"]: r["slot"] for r in sharding.op7_sharding(docs.repartition(7)).collect()}
    assert again == {r["text_crc32"]: r["slot"] for r in got}
