"""JSON and JSONL stores: permissive reads that keep what can't be parsed, and writes that replace as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON store; a corrupt one is kept in ``_corrupt``."""
    full = f"{schema}, _corrupt string"
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def clean_log(lines: DataFrame, fixture) -> DataFrame:
    """Lines(value) of a JSONL log without blank ones and those of tests; malformed lines stay as they are.

    ``fixture`` takes the parsed line (a map) and tells whether it is a test's.
    """
    parsed = F.from_json("value", "map<string,string>")
    object_ = F.trim("value").startswith("{") & parsed.isNotNull()
    return lines.where(F.trim("value") != "").where(~(object_ & F.coalesce(fixture(parsed), F.lit(False))))


def replace(df: DataFrame, path: str) -> None:
    """Writes ``df`` beside ``path`` and moves it there: readers never see a part of it, but between the two renames they may find nothing."""
    spark = df.sparkSession
    staged = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(staged)
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staged)
    fs = target.getFileSystem(hadoop)
    old = jvm.org.apache.hadoop.fs.Path(f"{staged}.old")
    had = fs.exists(target)
    if had:
        fs.rename(target, old)
    fs.rename(source, target)
    if had:
        fs.delete(old, True)


def append_revision(df: DataFrame, path: str) -> None:
    """Adds issued rows under their revision; earlier revisions aren't touched."""
    df.write.mode("append").partitionBy("revision").parquet(path)


def expand(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder, once each, in case-blind order of their paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return found.dropDuplicates(["path"]).orderBy(F.lower("path"), "path")
