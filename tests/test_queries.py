"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from sievewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    at = [want.columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_imports_and_names():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["latest_per_key"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "Window" not in plan
    plan = catalog.QUERIES["rerank_outcomes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "WindowGroupLimit" in plan
    above = plan[: plan.index("Exchange")]
    assert "contains" not in above.lower()  # the boosts are computed before the shuffle


def test_the_entry_imports_without_a_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
