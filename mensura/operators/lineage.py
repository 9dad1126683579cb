"""Cutting lineage in the folder that all executors share, and connected components on top of it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is sent to all tasks rather than shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of the local machine only where the master is local and none is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="mensura-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` computed once, written to the shared folder and read back, so that a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored table, marked for broadcast if its rows have been counted and are few, else against it.

    Left alone, Spark goes by the bytes of files and of plans, which don't tell how many rows come of them.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to all shuffle partitions, also where its rows are few bytes but much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """``nodes`` with the least node of the component that each lies in, as ``component``; edges are (a, b).

    In a round every root that has a neighbouring root below it is hung under the
    least of these, paths are shortened by one step, and edges move to the roots, so
    rounds grow with the logarithm of the longest chain. Nodes stay out of the loop:
    they follow the roots' last table once, at the end.
    """
    open_ = stored(edges.select("a", "b").where("a <> b").distinct())
    parents = stored(open_.select(F.explode(F.array("a", "b")).alias("child")).distinct().withColumn("root", F.col("child")))
    while n := open_.count():
        both = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a"))
        over = up.select(F.col("a").alias("to"), F.col("to").alias("further"))
        step = small(stored(up.join(small(over, n), "to", "left").select("a", F.coalesce("further", "to").alias("to"))), n)
        parents = stored(parents.join(step.withColumnRenamed("a", "root"), "root", "left").select("child", F.coalesce("to", "root").alias("root")))
        for c in ("a", "b"):
            other = "b" if c == "a" else "a"
            moved = step.select(F.col("a").alias(c), F.col("to").alias("__to"))
            open_ = open_.join(moved, c, "left").select(F.coalesce("__to", c).alias(c), other)
        open_ = stored(open_.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    met = nodes.join(parents.select(F.col("child").alias(node), "root"), node, "left")
    return met.withColumn("component", F.coalesce("root", node)).drop("root")
