"""Queries of the corpus operators against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from voltrace.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got, want = queries()[name](spark, SF), c.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, got.select(columns).collect())) == sorted(repr(r) for r in (__row(columns, x) for x in want.project(", ".join(columns)).fetchall()))


def __row(columns, values):
    from pyspark.sql import Row

    return Row(*columns)(*values)
