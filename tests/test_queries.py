"""Every query with an SQL form gives the same rows as DuckDB."""

import math
import os

import duckdb
import pytest

from recallframe.plans import queries as plans

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return list(v) if isinstance(v, (list, tuple)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) if not isinstance(r[i], int) or isinstance(r[i], bool) else r[i] for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    as_float = lambda r: [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r]
    a, b = rows(got.columns, [as_float(tuple(r)) for r in got.collect()]), rows(want.columns, [as_float(r) for r in want.fetchall()])
    assert a == b


def test_every_query_has_rows_or_says_why(spark):
    assert set(plans.QUERIES) == set(plans.ORACLES)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(plans.QUERIES) <= set(e.queries())
