"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = {0: 6_000, 1: 6_000}


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; an id of null has none."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def usable(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """doc_id and y of the labels that may be learned from, one row an id; ids whose labels contradict one another teach nothing."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    return known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("__most")).where("y = __most").select("doc_id", "y")


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: dict[int, int] = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """doc_id, text and y of about ``rows[y]`` labelled documents of each class y for which ``learn`` holds.

    ``rows`` bounds what a caller may gather, whatever the size of the tables; of
    rows that share an id the one with the least text is the document.
    """
    rows_of = usable(labels, label, learn)
    counts = {r["y"]: r["n"] for r in rows_of.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, rows[y] / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = docs.select("doc_id", "text").join(F.broadcast(rows_of.where(draw < share)), "doc_id")
    return drawn.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
