"""The SQL of this subpackage's queries against Spark on the smallest tables."""

import os

import duckdb
import pytest

from ranksmith.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, name):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    got, want = QUERIES[name](spark, small).toPandas(), c.sql(SQL[name]).df()
    cols = sorted(got.columns)
    plain = lambda x: sorted(map(repr, x[cols].astype(object).where(x[cols].notna(), None).map(lambda v: float(v) if isinstance(v, float) else v).itertuples(index=False, name=None)))
    assert cols == sorted(want.columns) and plain(got) == plain(want)


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
