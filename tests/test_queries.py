"""Every query of the workload against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from quern.sources.tables import CORE
from quern.workloads.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in CORE:
        con.sql(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    flat = lambda v: round(v, 3) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(flat(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["sort_asc", "sort_desc"])
def test_sort_queries_fail_without_the_sort(spark, monkeypatch, duck, name):
    from quern.operators import frames

    def unsorted(query, tables, scope):
        query.order = None
        return frames.build(query, tables, scope)

    monkeypatch.setattr("quern.workloads.queries.build", unsorted)
    got, want = QUERIES[name](spark, FOLDER), duck.sql(ORACLE_SQL[name])
    assert normal([tuple(r) for r in got.collect()], got.columns) != normal(want.fetchall(), want.columns)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["q3_spj"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan
    assert "l_comment" not in plan and "c_name" not in plan
