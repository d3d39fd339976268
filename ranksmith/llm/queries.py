"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import classify, fst, gif, gru, mixing, sharding, simhash, warc, winnow
from .shared import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.op1_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op2_mixing(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.op4_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.op5_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.op6_lm_scoring(table(spark, sf_dir, "documents"))


def op7_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op7_sharding(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst.op8_token_counts(table(spark, sf_dir, "documents"))


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.op9_gif(table(spark, sf_dir, "documents"))


def op10_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op10_warc(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_mixing": op2_mixing,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_rendezvous_sharding": op7_rendezvous_sharding,
    "op8_token_counts": op8_token_counts,
    "op9_gif_media": op9_gif_media,
    "op10_warc_normaliser": op10_warc_normaliser,
}

SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op5_benchmark_decontamination": winnow.OP5_SQL,
    "op7_rendezvous_sharding": sharding.OP7_SQL,
    "op10_warc_normaliser": warc.OP10_SQL,
}
