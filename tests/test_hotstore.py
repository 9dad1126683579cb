"""Archive moves: both stores change at once, or not at all."""

import pytest
from pyspark.sql import functions as F

from mensura.sources.hotstore import ARCHIVE, Conflict, HotStore

JOBS = [("a", "pending", None), ("b", "processing", None), ("c", "approved", "approved"), ("d", "rejected", "rejected"), ("e", "pending", None)]
SCHEMA = "job_id string, status string, decision string"


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "job_id string")


def rows(df):
    return sorted((r["job_id"], r["status"]) for r in df.collect())


def test_archive_and_restore_round_trip(spark, tmp_path):
    store = HotStore(spark, f"file://{tmp_path}/jobs")
    assert store.version() == 0 and store.read() is None
    with pytest.raises(ValueError):
        store.archive(ids(spark, "a"), "2024-01-01")
    assert store.commit(0, hot=spark.createDataFrame(JOBS, SCHEMA)) == 1
    refused = store.archive(ids(spark, "a", "b", "c", "d", "d", "x"), "2024-01-01 10:00:00", "duplicates")
    assert sorted((r["job_id"], r["reason"]) for r in refused.collect()) == [("b", "job is still processing"), ("c", "job is already approved"), ("x", "not found")]
    assert rows(store.read()) == [("b", "processing"), ("c", "approved"), ("e", "pending")]
    assert rows(store.read(ARCHIVE)) == [("a", "deleted"), ("d", "deleted")]
    assert {r["archive_note"] for r in store.read(ARCHIVE).collect()} == {"duplicates"}
    unknown = store.restore(ids(spark, "a", "d", "e"))
    assert [(r["job_id"], r["reason"]) for r in unknown.collect()] == [("e", "not found")]
    assert rows(store.read()) == sorted((j, s) for j, s, _ in JOBS) and rows(store.read(ARCHIVE)) == []
    assert rows(store.read(version=1)) == sorted((j, s) for j, s, _ in JOBS) and store.version() == 3


def test_a_commit_that_dies_leaves_the_old_version(spark, tmp_path):
    store = HotStore(spark, f"file://{tmp_path}/jobs")
    store.commit(0, hot=spark.createDataFrame(JOBS, SCHEMA))
    dies = F.udf(lambda x: 1 // 0 if x == "c" else x, "string")
    with pytest.raises(Exception):
        store.commit(1, archive=spark.createDataFrame(JOBS[:1], SCHEMA), hot=spark.createDataFrame(JOBS, SCHEMA).withColumn("job_id", dies("job_id")))
    assert store.version() == 1 and store.read(ARCHIVE) is None and rows(store.read()) == sorted((j, s) for j, s, _ in JOBS)


def test_of_two_writers_one_fails(spark, tmp_path):
    one, two = (HotStore(spark, f"file://{tmp_path}/jobs") for _ in range(2))
    one.commit(0, hot=spark.createDataFrame(JOBS, SCHEMA))
    one.commit(1, hot=spark.createDataFrame(JOBS[:2], SCHEMA))
    with pytest.raises(Conflict):
        two.commit(1, hot=spark.createDataFrame(JOBS[3:], SCHEMA))
    assert rows(two.read()) == [("a", "pending"), ("b", "processing")]
