"""End-to-end plans: sparse search evaluated, and the two-stage retriever."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import bm25, evaluation, fusion
from . import standins as S


def sparse_search(spark: SparkSession, d: str, depth: int = 1000) -> DataFrame:
    """BM25 over documents for every benchmark item: two scans from text to ranked run."""
    return bm25.search_corpus(S.corpus(spark, d), S.topics(spark, d), depth, digits=6)


def fused_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Two runs fused by reciprocal rank and evaluated with the prime measures, in one plan."""
    run = fusion.rrf([S.run_a(spark, d), S.run_b(spark, d)])
    return evaluation.per_topic(run, S.synth_qrels(spark, d))
