"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last return the columns of documents.

Stages decide on names of 16 bytes, of key and text; texts are read again and filtered by them, not shuffled, as long as
the names that go are few enough to be broadcast (shared.split_off).

Defined results for odd input: null and empty texts are scored as texts without words, share a fingerprint, are never
contaminated and have size 0; rows without a key stay through near-duplicates; rows that share a doc_id, or have none,
stay or go each by its own text; repeated rows are one document from near-duplicates on; extra columns are carried along
under their names, and do not reach the last stage's result; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.llm import classify, mixing, sharding, simhash, winnow
from ranksmith.llm.shared import mark, name_of, renamed, split_off, stored, sweep, table, text_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects (predicted 0) go."""
    model = classify.fit(docs, table(spark, sf_dir, "labels"), classify.QUALITY)
    rows, new = renamed(docs)
    return model.score(rows, new["doc_id"], new["text"]).where("predicted = 1").select(*new.values()).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the one with the smallest doc_id (with the smallest digest
    of its text, where several have it)."""
    return simhash.first_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go, and no others of their doc_id: key and digest of the text
    name a document."""
    since = mark()
    rows, new = renamed(docs)
    rows = rows.withColumn("__name", name_of(F.col(new["doc_id"]), text_digest(F.col(new["text"]))))
    texts = rows.select("__name", F.col(new["text"]).alias("text"))
    hits = winnow.decontaminate(texts, table(spark, sf_dir, "benchmark"), "__name").where("contaminated")
    dirty = stored(hits.select("__name").distinct(), "contaminated")
    sweep(spark, since, dirty)
    return split_off(rows, dirty, "left_anti").select(*new.values()).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them; those it does not take go."""
    return mixing.repeated(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row that is left."""
    return sharding.shard(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]

#: The classifier and the XXH64 fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    since, docs = mark(), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(spark, since, docs)  # what the stage and those before it left
    return STAGES[-1][1](spark, docs, sf_dir)
