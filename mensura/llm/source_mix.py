"""Mixing sources to target weights by capped water-filling.

Each source has a weight; its share of all words is its target, but a source is
repeated at most ``max_epochs`` times: targets above that are clamped and the
excess is shared again by weight among the others until none is above. A
document is then taken a whole number of times, and a seeded order of each
source's documents decides which get the fractional repetition, the last of
them in part, so that a source's taken words equal the whole part of its target.

Only one number per round of water-filling reaches the driver. A source's
documents are never gathered: the seeded order is first resolved over a fixed
number of hash buckets a source, then among the documents of the one bucket in
which the target falls.

Defined results: a null or empty text has size 0 and is taken 0 words; a null
source is a source of its own, last in order; equal rows are separate documents
and share a result up to their order; a table without words, or without rows,
has targets 0; rows without an id, or of one id, are documents of their own that
share a place in the seeded order, and are ordered among themselves by their size;
columns of other names pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mensura.llm._store import cut, table
from mensura.llm.quality_rules import words

# Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
BUCKETS_HEX = 3  # 16**3 buckets a source
BROADCAST_SOURCES = 100_000


def seeded(doc_id: Column, seed: str) -> Column:
    """A reproducible order of documents, the same on any engine."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 in code point order, null last, without gathering them in one task."""
    parts = cut(
        sources.orderBy(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each partition, whose number is bounded by the shuffle setting
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return parts.join(F.broadcast(before.select("part", "before")), "part").withColumn(
        "rank", F.col("place") + F.coalesce("before", F.lit(0))
    )


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds ``target`` to sources(source, source_size, weight): shares of the total by weight, clamped and reshared."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = None  # words a unit of weight, as numerator and denominator
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * level[0] > F.col("source_size") * max_epochs * level[1]
        row = sources.agg(
            F.sum(F.when(capped, F.col("source_size") * max_epochs)).alias("held"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
        ).first()
        new = (total - (row["held"] or 0), row["open"] or 1)
        if new == level:
            break
        level = new
    even = (F.col("weight") * F.lit(level[0])).cast("double") / F.lit(float(level[1]))
    cap = F.col("source_size") * max_epochs
    over = F.col("weight") * level[0] > cap * level[1]
    return sources.withColumn("target", F.when(over, cap.cast("double")).otherwise(even))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, whole and part: each document's whole repetitions, and words of one more."""
    sized = table(
        docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), seeded(F.col("doc_id"), seed).alias("order")),
        "mix-sizes",
    ).withColumn("bucket", F.substring("order", 1, BUCKETS_HEX))
    buckets = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    sources = ranked(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    filled = water_fill(cut(sources.select("source", "source_size", weight.alias("weight"))), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    filled = cut(
        filled.withColumn("whole", F.least(whole, F.lit(max_epochs)).cast("long")).withColumn(
            "need", F.greatest(F.floor("target") - F.col("whole") * F.col("source_size"), F.lit(0)).cast("long")
        )
    )
    n = filled.count()
    small = (lambda d: F.broadcast(d)) if n <= BROADCAST_SOURCES else (lambda d: d)

    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = buckets.withColumn("before", F.sum("bucket_size").over(by_bucket) - F.col("bucket_size")).withColumnRenamed("source", "s")
    edge = cut(
        run.join(small(filled.select(F.col("source").alias("t"), "need")), F.col("s").eqNullSafe(F.col("t")))
        .where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("bucket_size")))
        .select(F.col("s").alias("e"), F.col("bucket").alias("edge"), F.col("need") - F.col("before"))
        .toDF("e", "edge", "edge_need")
    )
    plan = filled.join(small(edge), F.col("source").eqNullSafe(F.col("e")), "left").drop("e").withColumnRenamed("source", "p")
    joined = sized.join(small(cut(plan)), F.col("source").eqNullSafe(F.col("p"))).drop("p")
    # without an edge the need is the whole source or nothing
    inside = F.when(F.col("edge").isNull(), F.when(F.col("need") > 0, F.col("size")).otherwise(F.lit(0))).when(
        F.col("bucket") < F.col("edge"), F.col("size")
    )
    at_edge = F.col("bucket").eqNullSafe(F.col("edge"))
    far = joined.where(~at_edge).withColumn("part", F.coalesce(inside, F.lit(0)).cast("long"))
    run_docs = Window.partitionBy("source", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = joined.where(at_edge).withColumn(
        "part",
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("edge_need") - (F.sum("size").over(run_docs) - F.col("size")))).cast("long"),
    )
    cols = ["doc_id", "source", "size", "source_size", "target", "whole", "part"]
    return far.select(cols).unionByName(near.select(cols))


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: whole repetitions, then the part of one more, cut after its words.

    ``doc_id`` must be unique in ``docs`` and not null.
    """
    plan = mixed.select(F.col("doc_id").alias("__id"), F.col("whole").alias("__whole"), F.col("part").alias("__part"), F.col("size").alias("__size"))
    joined = docs.join(plan, F.col("doc_id") == F.col("__id"))
    turns = F.col("__whole") + F.when(F.col("__part") > 0, 1).otherwise(0)
    each = joined.where(turns > 0).withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), turns)))
    short = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("__part").cast("int")), " ")
    in_part = (F.col("__turn") > F.col("__whole")) & (F.col("__part") < F.col("__size"))
    return each.withColumn("text", F.when(in_part, short).otherwise(F.col("text"))).select(*docs.columns)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` repeated and cut as the mix takes them, whatever their ids; documents without words are not taken."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return repeat(docs, mix(docs, weights, max_epochs, seed))
    rows = table(docs.withColumnRenamed("doc_id", "__doc_id").withColumn("doc_id", F.monotonically_increasing_id()), "mix-rows")
    return repeat(rows, mix(rows, weights, max_epochs, seed)).drop("doc_id").withColumnRenamed("__doc_id", "doc_id").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
             md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w FROM s),
t AS (SELECT sum(source_size) AS total FROM r),
o AS (SELECT source, source_size, w, total, sum(3 * source_size) OVER v - 3 * source_size AS held, sum(w) OVER () - sum(w) OVER v + w AS open
      FROM r, t WINDOW v AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT CAST(total - held AS BIGINT) AS num, CAST(open AS BIGINT) AS den FROM o
      WHERE (total - held) * w <= 3 * source_size * open ORDER BY 3.0 * source_size / w, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN w * num > 3 * source_size * den THEN CAST(3 * source_size AS DOUBLE)
        ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM r, l),
e AS (SELECT *, least(CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END, 3) AS whole FROM g),
n AS (SELECT *, greatest(CAST(floor(target) AS BIGINT) - whole * source_size, 0) AS need FROM e),
c AS (SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, n.need,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size, d.rid ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, need - before)) AS BIGINT) AS taken FROM c"""
