"""Every registered query of the core engine against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
import known_rows
from mensura.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows_of(cols, rows):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    ours = registry.QUERIES[name](spark, SF)
    theirs = con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(cols)
    assert rows_of(ours.columns, [tuple(r) for r in ours.collect()]) == rows_of(cols, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(known_rows.ORACLE_SQL))
def test_known_rows(spark, con, name):
    """Operators over rows whose results are stated."""
    ours = known_rows.QUERIES[name](spark, SF)
    theirs = con.execute(known_rows.ORACLE_SQL[name])
    cols = [c[0] for c in theirs.description]
    assert rows_of(ours.columns, [tuple(r) for r in ours.collect()]) == rows_of(cols, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_known_totals(spark):
    total = {r["section"]: r["amount"] for r in known_rows.QUERIES["boq_total"](spark, SF).collect()}
    assert total[None] == pytest.approx(1823687.32)
    rates = {r["name"]: (r["rate"], r["total"]) for r in known_rows.QUERIES["rate_build_up"](spark, SF).collect()}
    assert rates["yard"] == (44.89, 1170731.20) and rates["yard by defaults"][0] == 45.07
    assert rates["unknown mesh"] == (None, None) and rates["zero"][1] is None
