"""Every registered query with SQL gives DuckDB's rows at the smallest size."""

import glob
import os

import duckdb
import pytest

from wavegrid.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(names, records):
    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 9) + 0.0
        if isinstance(v, int) and not isinstance(v, bool):
            return v
        return v if v is None or isinstance(v, bool) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_matches_sql(spark, small, con, name):
    df = catalog.queries()[name](spark, small)
    got = rows(df.columns, df.collect())
    cur = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_broadcasts_and_pushdown(spark, small):
    """Filters and columns reach the scan; the recurrence and interpolation plans hold no cross join."""
    q = catalog.queries()
    plan = q["resume_pending"](spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), EqualTo(l_quantity,50.0)" in plan and "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan
    for name in ("even_clock_interp", "nearest_onset", "finding_overlap", "local_ratio"):
        plan = q[name](spark, small)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan.split("== Physical Plan ==")[1], name
    # rates are compared with the few shared ones in a loop, of which the smaller side is a report
    plan = q["rates_not_shared"](spark, small)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
