"""The Python function surface: Arrow-batched UDFs and a table function, and one pass that derives everything from markup."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import GRAPH, struct
from . import mathml, trees
from .workers import ship

_GRAPH = "struct<tags:array<string>,symbols:array<string>,edges:array<struct<src:int,dst:int,type:string>>>"


def _series(f):
    return lambda s: s.map(lambda x: None if x is None else f(x))


@F.pandas_udf(T.StringType())
def canonical(s: pd.Series) -> pd.Series:
    return _series(mathml.canonical)(s)


@F.pandas_udf(T.ArrayType(T.StringType()))
def slt_symbols(s: pd.Series) -> pd.Series:
    return _series(mathml.leaf_symbols)(s)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return _series(lambda x: unicodedata.normalize("NFKC", x))(s)


@F.pandas_udf(T.StringType())
def normalize_symbol(s: pd.Series) -> pd.Series:
    return _series(mathml.symbol)(s)


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return _series(html.unescape)(s)


_EDGE = pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("type", pa.string())])
_KIND = pa.struct([("tags", pa.list_(pa.string())), ("symbols", pa.list_(pa.string())), ("edges", pa.list_(_EDGE))])


def _graphs(build, markup: pa.Array) -> pa.Array:
    return pa.array([None if x is None or (g := build(x)) is None else g.as_dict() for x in markup.to_pylist()], _KIND)


@F.arrow_udf(GRAPH)
def slt_graph(xml: pa.Array) -> pa.Array:
    return _graphs(trees.slt_graph, xml)


@F.arrow_udf(GRAPH)
def opt_graph(xml: pa.Array) -> pa.Array:
    return _graphs(trees.opt_graph, xml)


@F.pandas_udf(T.StringType())
def slt_failure(xml: pd.Series) -> pd.Series:
    return _series(lambda x: mathml.failure(x, trees.slt_graph))(xml)


@F.pandas_udf(T.StringType())
def opt_failure(xml: pd.Series) -> pd.Series:
    return _series(lambda x: mathml.failure(x, trees.opt_graph))(xml)


@F.pandas_udf(T.StringType())
def error_context(xml: pd.Series) -> pd.Series:
    return _series(mathml.error_context)(xml)


@F.udtf(returnType=struct("level string, kind string, tuple string, n int"))
class GraphTuples:
    """LATERAL graph_tuples(graph): one row per level, kind and distinct tuple."""

    def eval(self, graph):
        if graph is not None:
            edges = [(e["src"], e["dst"], e["type"]) for e in graph["edges"]]
            yield from trees.all_tuples(trees.Graph(graph["tags"], graph["symbols"], edges))


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL."""
    ship(spark)
    for name, f in (("mathml_canonical", canonical), ("slt_symbols", slt_symbols), ("nfkc", nfkc), ("normalize_symbol", normalize_symbol), ("html_unescape", html_unescape), ("slt_graph", slt_graph), ("opt_graph", opt_graph)):
        spark.udf.register(name, f)
    spark.udtf.register("graph_tuples", GraphTuples)


def parse_formulas(df: DataFrame, slt: str = "slt", opt: str = "opt") -> DataFrame:
    """df with slt_symbols, slt_graph and opt_graph: each markup string is parsed in one pass through the worker."""
    ship(df.sparkSession)
    names = df.columns
    at = {r: names.index(c) for r, c in (("slt", slt), ("opt", opt))}
    schema = df.select("*", F.lit(None).cast("array<string>").alias("slt_symbols"), F.lit(None).cast(_GRAPH).alias("slt_graph"), F.lit(None).cast(_GRAPH).alias("opt_graph")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            symbols = pa.array([mathml.leaf_symbols(x) for x in b.column(at["slt"]).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, symbols, _graphs(trees.slt_graph, b.column(at["slt"])), _graphs(trees.opt_graph, b.column(at["opt"]))], [*names, "slt_symbols", "slt_graph", "opt_graph"])

    return df.mapInArrow(work, schema)
