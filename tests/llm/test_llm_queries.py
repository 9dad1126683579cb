"""Registered queries: against SQL where there is some, and on odd and empty tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from mensura.llm import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


def rows_of(cols, rows):
    return sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in rows), key=repr)


def check(spark, name, folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        path = f"{folder}/{t}"
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    ours = registry.QUERIES[name](spark, folder)
    theirs = con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(cols)
    assert rows_of(ours.columns, [tuple(r) for r in ours.collect()]) == rows_of(cols, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    check(spark, name, SF)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_source_mix", "op11_ball_kmeans", "op13_quantised_index"])
def test_matches_sql_on_odd_rows(spark, name, odd_dir):
    check(spark, name, odd_dir)


PER_DOCUMENT = [n for n in registry.QUERIES if n.split("_")[0] in ("op1", "op2", "op3", "op4", "op6", "op7", "op10")]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_rows(spark, name, odd_dir, odd_rows):
    rows = registry.QUERIES[name](spark, odd_dir).collect()
    if name in PER_DOCUMENT:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in odd_rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, name, empty_dir):
    assert registry.QUERIES[name](spark, empty_dir).count() == 0


def test_entry_lists_them():
    names = set(__spark_entry__.queries())
    assert names >= set(registry.QUERIES) | {"pipeline"}
    assert sorted(int(n.split("_")[0][2:]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 14))


def test_vectors_that_take_no_part(spark, odd_dir):
    rows = registry.QUERIES["op5_maxscore_topk"](spark, odd_dir).collect()
    assert {r["query_id"] for r in rows} == {0, 100}
    assert {r["vec_id"] for r in rows} <= {0, 1, 6, 7, 8, 100}
    zero = [(r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == 0]
    # floor(1024 * x): 512, -256; own id left out, ties to the smaller id, repeated rows are separate candidates
    assert sorted(zero)[:4] == [(1, 1, 512 * 512 + 256 * 256), (2, 1, 512 * 512 + 256 * 256), (3, 100, 512 * 512 - 256 * 512), (4, 100, 512 * 512 - 256 * 512)]
