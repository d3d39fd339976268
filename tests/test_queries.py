"""Every registered engine query against its SQL on the smallest tables; those without SQL must run with a stable schema."""

import os

import duckdb
import pytest

from ranksmith.plans.queries import IDS, ORACLE, QUERIES

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    d = f"{DATA}/sf0.001"
    for f in os.listdir(d):
        c.sql(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    return c


def rows(frame, cols):
    fix = lambda v: None if v is None or v != v else (round(v, 9) + 0.0 if isinstance(v, float) else v)
    return sorted(repr(tuple(fix(v) for v in r)) for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    frame = QUERIES[name](spark, small)
    assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)


def test_markup_sanitize_has_every_repair(spark, tmp_path):
    from ranksmith.functions import mathml

    pages = ['<?xml version="1.0"?> <p>a</p>', '<math alttext="x">b</math>', "<mpadded w='1'>c</mpadded>", "<p>d & e &amp; f</p>", "<p>1 < 2</p>", " <p>g</p> "]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["n"] for r in QUERIES["markup_sanitize"](spark, str(tmp_path)).collect()}
    assert got == {i: len(mathml.repair(x)) for i, x in enumerate(pages)}


def test_every_query_names_its_operators():
    assert set(IDS) == set(QUERIES) and all(IDS.values())


def test_entry(spark):
    import __spark_entry__ as e

    frame = e.entry(spark)
    assert frame.columns == ["topic_id", "visual_id", "score", "rank"] and frame.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_graph_encode_cuts_no_graph(spark, small):
    """Every order's graph has its order and all of its lines."""
    want = {r["l_orderkey"]: r["count"] for r in spark.read.parquet(f"{small}/lineitem.parquet").groupBy("l_orderkey").count().collect()}
    got = QUERIES["graph_encode"](spark, small).collect()
    assert max(want.values()) >= 5 and {r["l_orderkey"]: len(r["tag"]) - 1 for r in got} == want and not any(r["truncated"] for r in got)
