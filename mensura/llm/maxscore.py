"""Exact top-k search by MaxScore over dense or sparse integer vectors.

Dimensions are terms, components are impacts. The corpus is packed into shards
with a posting array per term; queries are packed into blocks; every block meets
every shard (a stated query set against all rows, in blocks). Inside a shard the
terms of a query are ordered by the span of their contribution. The essential
ones, without which no document can reach the current k-th score, are traversed;
the others are probed only for documents whose score so far plus the bounds of
what is left is still competitive. Tasks carry each query's threshold from shard
to shard and the k best of all tasks are merged.

Defined results: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; missing components of shorter vectors count as
zero; a query meets every vector but those of its own id; repeated rows are
separate candidates and separate queries; ties go to the smaller id; fewer than k
candidates are all returned; other columns are ignored. Scores are exact while
they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mensura.llm._store import frugal, table

SHARD = 8192
BLOCK = 512
PROBE = 8


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for a vector that takes no part."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _pack(key: tuple, group: pa.Table) -> pa.Table:
    """One row of a shard or block: its ids and its vectors, term-major, as the narrowest integers that hold them."""
    vectors = group.column("v").combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, int)
    dims = int(lengths.max(initial=0))
    full = np.zeros((len(lengths), dims), np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    full[np.arange(dims)[None, :] < lengths[:, None]] = flat
    ids = group.column("vec_id").to_numpy().astype(np.int64)
    by_id = np.argsort(ids, kind="stable")
    low, high = full.min(initial=0), full.max(initial=0)
    width = next(w for w in (2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    terms = np.ascontiguousarray(full[by_id].T).astype(f"<i{width}")
    return pa.table({
        "part": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(ids)], pa.int32()), "dims": pa.array([dims], pa.int32()), "width": pa.array([width], pa.int32()),
        "ids": pa.array([ids[by_id].tobytes()], pa.binary()), "terms": pa.array([terms.tobytes()], pa.binary()),
    })


def packed(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows (vec_id, v) as parts of about ``size`` vectors, dealt in turn so that no id or vector is a hot key."""
    n = max(1, -(-vectors.count() // size))
    dealt = vectors.withColumn("part", F.monotonically_increasing_id() % n)
    return dealt.groupBy("part").applyInArrow(_pack, "part long, n int, dims int, width int, ids binary, terms binary"), n


def _matrix(blob: bytes, width: int, dims: int, n: int, want: int) -> np.ndarray:
    m = np.frombuffer(blob, f"<i{width}").reshape(dims, n).astype(np.int64)
    return m if dims >= want else np.vstack([m, np.zeros((want - dims, n), np.int64)])


def shard_search(q_ids, queries, ids, terms, best: list, k: int) -> None:
    """Merges a shard (terms x documents) into ``best``: for each query its (score, id) arrays so far."""
    high, low = terms.max(axis=1), terms.min(axis=1)
    small = float(np.abs(terms).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, len(terms)) < 2**52
    impacts = terms.astype(np.float64) if small else terms
    for i in range(len(q_ids)):
        q = queries[:, i]
        most, least = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        scores, found = best[i]
        threshold = scores[-1] if len(scores) == k else None
        order = np.argsort(least - most, kind="stable")
        left = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])  # bound of the terms from each place on
        if threshold is None:
            essential = len(order)
        else:
            # contributions above their least: a document at the least in all essential terms can't reach the threshold
            spare = threshold - least.sum()
            essential = int((np.cumsum((most - least)[order][::-1])[::-1] >= spare).sum())
        head = order[:essential]
        weights = q[head].astype(impacts.dtype)
        total = weights @ impacts[head] if essential else np.zeros(len(ids), impacts.dtype)
        total = total.astype(np.int64)
        alive = np.arange(len(ids)) if threshold is None else np.flatnonzero(total + left[essential] >= threshold)
        total = total[alive]
        for at in range(essential, len(order), PROBE):
            if not len(alive):
                break
            some = order[at : at + PROBE]
            total = total + q[some] @ terms[np.ix_(some, alive)]
            keep = total + left[min(at + PROBE, len(order))] >= threshold
            alive, total = alive[keep], total[keep]
        other = ids[alive] != q_ids[i]
        scores, found = np.concatenate([scores, total[other]]), np.concatenate([found, ids[alive][other]])
        if len(scores) > k:
            bar = np.partition(scores, len(scores) - k)[len(scores) - k]
            close = scores >= bar
            scores, found = scores[close], found[close]
        first = np.lexsort((found, -scores))[:k]
        best[i] = (scores[first], found[first])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, held = None, [], None

        def results():
            n = [len(s) for s, _ in best]
            return pa.record_batch({
                "block": pa.array(np.full(sum(n), block, np.int64)), "row": pa.array(np.repeat(np.arange(len(best), dtype=np.int32), n)),
                "query_id": pa.array(np.repeat(held[0], n)), "vec_id": pa.array(np.concatenate([f for _, f in best]) if n else np.zeros(0, np.int64)),
                "score": pa.array(np.concatenate([s for s, _ in best]) if n else np.zeros(0, np.int64)),
            })

        for batch in batches:
            for r in batch.to_pylist():
                dims = max(r["dims"], r["q_dims"])
                if r["block"] != block:
                    if block is not None:
                        yield results()
                    block, held = r["block"], (np.frombuffer(r["q_ids"], np.int64),)
                    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * r["q_n"]
                shard_search(
                    held[0], _matrix(r["q_terms"], r["q_width"], r["q_dims"], r["q_n"], dims),
                    np.frombuffer(r["ids"], np.int64), _matrix(r["terms"], r["width"], r["dims"], r["n"], dims), best, k,
                )
        if block is not None:
            yield results()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for two tables of (vec_id, v: array<long>)."""
    q, n_blocks = packed(queries, block)
    q = q.select(F.col("part").alias("block"), F.col("n").alias("q_n"), F.col("dims").alias("q_dims"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("terms").alias("q_terms"))
    shards, n_shards = packed(vectors, shard)
    shards = table(shards, "maxscore-shards")
    # each block meets each shard; a block's shards are dealt over runs so that a task carries thresholds over several
    runs = max(1, n_shards // 4)
    grid = shards.withColumn("run", F.col("part") % runs).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")))
    met = grid.join(table(q, "maxscore-queries"), "block")
    dealt = met.repartition(min(n_blocks * runs, 4096) if n_blocks * runs > 1 else 1, "block", "run").sortWithinPartitions("block", "run")
    found = dealt.mapInArrow(frugal(_search(k)), "block long, row int, query_id long, vec_id long, score long")
    best = Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantised(F.col("embedding")).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)]) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
