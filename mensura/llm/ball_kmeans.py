"""Centroid clustering by ball k-means, in exact integers.

A cluster is a ball: its centroid and a radius that no member is beyond. A round
begins with the balls as the last one left them, their radii longer by the way
that the centroid has moved. Two balls are neighbours where half the distance of
their centroids is within the radius; no member can be nearer to any other
centroid. A member nearer to its own centroid than half the way to the nearest
neighbour is in the stable core and stays without a comparison. The others lie in
annuli between half the distances to the neighbours in their order, and a member
is compared exactly with the neighbours up to its annulus only.

The tests for core and annulus are of squared distances in integers, ties
included, so results equal those of comparing every vector with every centroid.
Tasks return a count, sums and a radius a cluster; the rows of all tasks are
summed by Spark and one row a cluster reaches the driver. Vectors and their
clusters are written once a round, as integers of the narrowest width.

Defined results: a vector takes part if it has exactly ``dims`` components, none
null or non-finite; rows without an id are clustered and are never a first
centroid, rows that share an id are separate vectors; with fewer vectors than
``k`` each is a first centroid; equal hashes go by components; ties of distance
go to the smaller number; an empty cluster keeps its centroid; components beyond
2**26 steps either way count as that, since squared distances must fit 64 bits;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm._store import bounded, frugal, table

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
MOST = 1 << 26
STATE = "vec_id long, width int, x binary, cluster int, distance long"


def whole(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component; null for a vector that takes no part."""
    fine = (F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    step = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * scale))).cast("int")
    return F.when(fine, F.transform(vector, step))


def _pack(dims: int):
    """Each batch's vectors as the narrowest integers that hold them, all in cluster 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, dims)
            width = 2 if np.abs(x).max(initial=0) < 1 << 15 else 4
            x = np.ascontiguousarray(x.astype(f"<i{width}"))
            n = len(x)
            yield pa.record_batch({
                "vec_id": batch.column("vec_id"), "width": pa.array(np.full(n, width, np.int32)), "x": pa.array([r.tobytes() for r in x], pa.binary()),
                "cluster": pa.array(np.zeros(n, np.int32)), "distance": pa.array(np.zeros(n, np.int64)),
            })

    return run


def _matrices(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a batch, by the width that they are kept in."""
    width = batch.column("width").to_numpy()
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        values = batch.column("x").take(pa.array(rows))
        blob = b"".join(v.as_py() for v in values)
        yield rows, np.frombuffer(blob, f"<i{w}").reshape(-1, dims).astype(np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows, as integers."""
    d = x - y
    return (d * d).sum(axis=-1)


class Balls:
    """Centroids with, for each ball, its neighbours by distance."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray | None = None):
        self.centroids = centroids
        k = len(centroids)
        self.gaps = squared(centroids[:, None, :], centroids[None, :, :])  # between centroids, squared
        self.neighbours, self.annuli = [], []
        for i in range(k):
            near = np.flatnonzero(np.arange(k) != i)
            if radii is not None:
                near = near[np.sqrt(self.gaps[i, near].astype(float)) <= 2 * radii[i] + 1]
            near = near[np.argsort(self.gaps[i, near], kind="stable")]
            self.neighbours.append(near)
            self.annuli.append(self.gaps[i, near])

    def nearest(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each vector's nearest centroid and its squared distance, from the cluster it was in; and how many pairs were compared."""
        out, distance, compared = cluster.copy(), np.zeros(len(x), np.int64), 0
        for i in np.unique(cluster):
            rows = np.flatnonzero(cluster == i)
            own = squared(x[rows], self.centroids[i])
            # vectors whose own distance is half the way to a neighbour or more are compared with it
            upto = np.searchsorted(self.annuli[i], 4 * own, "right")
            order = np.argsort(-upto, kind="stable")
            rows, own, upto = rows[order], own[order], upto[order]
            best, at = own.copy(), np.full(len(rows), i)
            reach = len(rows) - np.searchsorted(upto[::-1], np.arange(len(self.annuli[i])), "right")
            for j, m in zip(self.neighbours[i], reach):
                if not m:
                    break
                d = squared(x[rows[:m]], self.centroids[j])
                nearer = (d < best[:m]) | ((d == best[:m]) & (j < at[:m]))
                best[:m][nearer], at[:m][nearer] = d[nearer], j
                compared += int(m)
            out[rows], distance[rows] = at, best
        return out, distance, compared


def _assign(balls: Balls, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = batch.column("cluster").to_numpy().astype(np.int64), np.zeros(batch.num_rows, np.int64)
            for rows, x in _matrices(batch, dims):
                cluster[rows], distance[rows], _ = balls.nearest(x, cluster[rows])
            yield pa.record_batch({**{c: batch.column(c) for c in ("vec_id", "width", "x")}, "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)})

    return run


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = batch.column("cluster").to_numpy(), batch.column("distance").to_numpy()
            for rows, x in _matrices(batch, dims):
                ids, of = np.unique(cluster[rows], return_inverse=True)
                members = np.argsort(of, kind="stable")
                begins = np.searchsorted(of[members], np.arange(len(ids)))
                far, all_ = (f.reduceat(distance[rows][members], begins) if len(ids) else np.zeros(0, np.int64) for f in (np.maximum, np.add))
                totals = np.add.reduceat(x[members], begins, axis=0) if len(ids) else np.zeros((0, dims), np.int64)
                yield pa.record_batch({
                    "cluster": pa.array(ids.astype(np.int32)), "n": pa.array(np.bincount(of, minlength=len(ids)).astype(np.int64)), "far": pa.array(far), "inertia": pa.array(all_),
                    "sums": pa.ListArray.from_arrays(np.arange(0, len(ids) * dims + 1, dims, dtype=np.int32), pa.array(totals.ravel())),
                })

    return run


def summaries(state: DataFrame, dims: int) -> list:
    """A row for each cluster that has members: cluster, n, far, inertia and the sums of its components."""
    partial = state.mapInArrow(frugal(_sums(dims)), "cluster int, n long, far long, inertia long, sums array<long>")
    totals = F.array(*(F.sum(F.col("sums")[i]) for i in range(dims))).alias("sums")
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("inertia").alias("inertia"), totals).collect()


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose hash of seed and id is smallest, in that order."""
    hashed = vectors.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in hashed.orderBy("h", "v").limit(k).collect()], np.int64)


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector(vec_id, embedding) that takes part."""
    spark = bounded(vectors).sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), dims, scale).alias("v")).where("v IS NOT NULL")
    centroids = first_centroids(rows, k, seed)
    named = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id long, cluster int, distance long, {named.partition(', ')[2]}")
    state, radii = table(rows.mapInArrow(frugal(_pack(dims)), STATE), "ball-vectors"), None
    for turn in range(rounds + 1):
        state = table(state.mapInArrow(frugal(_assign(Balls(centroids, radii), dims)), STATE), "ball-state")
        found = summaries(state, dims)
        if turn == rounds:
            break
        new, radii = centroids.copy(), np.zeros(len(centroids))
        for r in found:
            new[r["cluster"]] = np.array(r["sums"], np.int64) // r["n"]
            radii[r["cluster"]] = np.sqrt(float(r["far"])) + np.sqrt(float(squared(new[r["cluster"]], centroids[r["cluster"]])))
        centroids = new
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    whole_inertia = sum(r["inertia"] for r in found)
    ends = spark.createDataFrame([(r["cluster"], r["inertia"], whole_inertia, digest[r["cluster"]]) for r in found], named)
    return state.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL that compares every vector with every centroid in every round."""
    steps = [
        f"""v AS (SELECT row_number() OVER () AS row, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
             WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "x AS (SELECT row, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v)",
        f"""f AS (SELECT row, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1 AS cluster FROM v WHERE vec_id IS NOT NULL),
c0 AS (SELECT cluster, i, x AS c FROM f JOIN x USING (row) WHERE cluster < {k})""",
    ]
    for t in range(rounds + 1):
        steps.append(f"d{t} AS (SELECT row, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{t} USING (i) GROUP BY row, cluster)")
        steps.append(f"a{t} AS (SELECT row, cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, cluster) AS r FROM d{t}) WHERE r = 1)")
        if t < rounds:
            mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            steps.append(f"m{t} AS (SELECT cluster, i, {mean} AS c FROM (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN x USING (row) GROUP BY cluster, i))")
            steps.append(f"c{t + 1} AS (SELECT cluster, i, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (cluster, i))")
    last = f"a{rounds}"
    steps.append(f"h AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM {last} JOIN v USING (row) JOIN h USING (cluster)"""
