"""Every named query against its SQL on the small tables."""

import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from voltrace.plans.oracles import ORACLES
from voltrace.plans.queries import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def plain(v):
    if v is None or (not isinstance(v, (list, dict, str, bool)) and pd.isna(v)):
        return None
    if str(type(v)).find("bool") >= 0:
        return bool(v)
    if isinstance(v, numbers.Real):
        return float(f"{float(v):.12g}") if math.isfinite(v) else str(v)
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(queries()[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_every_query_has_sql_or_a_reason():
    assert set(queries()) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.queries())
