"""Near-duplicates of embeddings by a pivot-permutation index and exact verification.

Reference points are taken from a bounded sample of the vectors. A vector is
described by the ``NEAREST`` of them that are nearest to it, and two vectors are
candidates if they share ``SHARED`` of these. The index holds, for each group of
comparable vectors and each reference point, the list of vectors described by it.
Vectors that share enough points also share one of the first NEAREST - SHARED + 1
in any fixed order of all points, so a vector is only put into those lists. Lists
of more than ``SPLIT`` vectors are split by a further shared point, as long as
more are asked for, so lists stay short while the number of vectors grows. What
is still long then is dealt into blocks, and every two blocks of a list meet in a
cell. In a cell shared points are counted and the candidates verified by cosine in
double precision, each pair in the list of its first shared points only.

No pair leaves a cell: what comes out is the number of links of each vector and,
for each vector, the least one that it is connected with there. Copies of one
vector are one node of the index, which counts as many as it stands for.

Sample: the about ``SAMPLE`` different vectors of least hash, from which points
too near an earlier one are left out, up to ``POINTS``. All vectors are indexed.
What can be missed are pairs that share too few points: about 1 in 20,000 random
pairs of 64 or 256 components at cosine 0.93 to 0.94, and fewer above.

Defined results: only vectors of one label, not null, and of one length are
compared; vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, link with nothing and stay; every row is a
vector of its own, so rows that share an id count each other as links if they are
near enough, and belong to one component; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm._store import bounded, cut, frugal, meet, table
from mensura.llm.graph import components

COSINE = 0.93
NEAREST, SHARED = 12, 3
POINTS, SAMPLE, APART = 512, 4096, 0.7
SPLIT, BLOCK = 2048, 256
STRIP = 128
#: Classes of several equal vectors that are sent to all tasks.
FEW = 20_000
CELL = "node long, links long, least long"


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, and isn't zero."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Vectors of length one; components are scaled first, so that squares stay in range."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def reference_points(sample: np.ndarray, most: int = POINTS, nearest: int = NEAREST) -> np.ndarray:
    """Unit vectors of the sample, each apart from those before, the ones that describe fewest first."""
    sample = _unit(sample)
    chosen = np.zeros((0, sample.shape[1]))
    for at in range(0, len(sample), 64):
        fresh = sample[at : at + 64]
        for v in fresh[(fresh @ chosen.T).max(axis=1, initial=-1.0) < APART]:
            if len(chosen) < most and (chosen @ v).max(initial=-1.0) < APART:
                chosen = np.vstack([chosen, v])
    often = np.bincount(described(sample, chosen, nearest).ravel(), minlength=len(chosen))
    return chosen[np.argsort(often, kind="stable")]


def described(vectors: np.ndarray, points: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The numbers of the points nearest to each vector, ascending."""
    m = min(nearest, len(points))
    return np.sort(np.argsort(-(vectors @ points.T), axis=1, kind="stable")[:, :m], axis=1)


def _describe(points: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            vectors, lengths = batch.column("v"), np.diff(batch.column("v").offsets.to_numpy())
            found = np.empty(batch.num_rows, object)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                near = described(_unit(_matrix(vectors.take(pa.array(rows)))), points[int(n)])
                for r, p in zip(rows, near.astype(np.int16)):
                    found[r] = p
            yield pa.record_batch({**{c: batch.column(c) for c in ("node", "label", "size", "w", "v")}, "p": pa.array(found.tolist(), pa.list_(pa.int16()))})

    return run


def _joined(links: np.ndarray, one: np.ndarray, two: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each row the least node that it is connected with; links[i, j] joins one[i] and two[j]."""
    least, none = node.copy(), np.iinfo(np.int64).max
    while True:
        before = least.copy()
        least[one] = np.minimum(least[one], np.where(links, least[two][None, :], none).min(axis=1, initial=none))
        least[two] = np.minimum(least[two], np.where(links, least[one][:, None], none).min(axis=0, initial=none))
        if (before == least).all():
            return least


def _cell(cosine: float, shared: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        node, w, block = (group.column(c).to_numpy() for c in ("node", "w", "block"))
        first = group.column("key")[0].as_py()
        x, p = _unit(_matrix(group.column("v"))), _matrix(group.column("p")).astype(np.int64)
        points = np.unique(p)
        has = np.zeros((len(p), len(points)), np.float32)
        np.put_along_axis(has, np.searchsorted(points, p), 1, axis=1)
        early = has[:, points <= first[-1]]
        wanted = min(shared, p.shape[1])
        i, j = key[-2].as_py(), key[-1].as_py()
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = np.zeros((len(one), len(two)), bool)
        for at in range(0, len(one), STRIP):
            rows = one[at : at + STRIP]
            # candidates: enough shared points, and none but the list's own up to its last
            links[at : at + STRIP] = (has[rows] @ has[two].T >= wanted) & (early[rows] @ early[two].T == len(first))
            if links[at : at + STRIP].any():
                links[at : at + STRIP] &= x[rows] @ x[two].T >= cosine
        if i == j:
            np.fill_diagonal(links, False)
        count = np.zeros(len(node), np.int64)
        count[one] += links @ w[two]
        if i != j:
            count[two] += links.T @ w[one]
        some = np.flatnonzero(count)
        least = _joined(links, one, two, node) if len(some) else node
        return pa.table({"node": node[some], "links": count[some], "least": least[some]})

    return run


def lists(nodes: DataFrame, nearest: int = NEAREST, shared: int = SHARED, split: int | None = None) -> DataFrame:
    """(label, size, key, c, node, w, v, p): the vectors of each list and how many it has; ``key`` are its points."""
    split = SPLIT if split is None else split
    many = F.size("p")
    asked = F.least(F.lit(shared), many)
    place = F.posexplode(F.expr(f"slice(p, 1, size(p) - least({shared}, size(p)) + 1)")).alias("at", "last")
    rows = nodes.select("*", place).withColumn("key", F.array("last")).drop("last")
    out, by = None, ["label", "size", "key"]
    for depth in range(1, shared + 1):
        sizes = cut(rows.groupBy(*by).agg(F.count("*").alias("c"), F.max(asked).alias("asked")).where("c > 1"))
        more = (F.col("c") > split) & (F.col("asked") > depth)
        known = meet(rows, sizes.withColumn("more", more), by, "node", stored=True)
        done = known.where("NOT more").select(*by, "c", "node", "w", "v", "p")
        out = done if out is None else out.unionByName(done)
        if depth == shared or sizes.where(more).isEmpty():
            return out
        # the next point of the key may be any later one that leaves enough after it
        rest = F.expr(f"slice(p, at + 2, greatest(size(p) - least({shared}, size(p)) + {depth} - at, 0))")
        rows = known.where("more").select("node", "label", "size", "w", "v", "p", "at", "key", F.posexplode(rest).alias("step", "last"))
        rows = rows.withColumn("at", F.col("at") + 1 + F.col("step")).withColumn("key", F.concat("key", F.array("last"))).drop("step", "last")
    return out


def links_within(nodes: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED, split: int | None = None, block: int | None = None) -> DataFrame:
    """node, links, least: of each cell, its nodes with links, how many vectors they are linked with there, and the least node connected."""
    block = BLOCK if block is None else block
    rows = lists(nodes, nearest, shared, split)
    n = F.ceil(F.col("c") / block).cast("int")
    rows = rows.withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    cells = rows.select("label", "size", "key", "node", "w", "v", "p", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return cells.groupBy("label", "size", "key", "i", "j").applyInArrow(_cell(cosine, shared), CELL)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, points: int = POINTS, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors(vec_id, embedding, label)."""
    bounded(vectors)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), "label")
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    same = ["label", "v"]
    live = rows.where(takes_part)
    classes = live.groupBy(*same).agg(F.min("vec_id").alias("id"), F.count("*").alias("w"))
    classes = table(classes.select(F.monotonically_increasing_id().alias("node"), *same, "id", "w"), "pivot-classes")
    multi = classes.where("w > 1").select(*same, F.col("node").alias("of"), F.col("w").alias("copies"))
    # a row that is alone is its class; the others are led to theirs
    member = meet(live, multi, same, "vec_id", "left", most=FEW).select("vec_id", "of", "copies")
    n = classes.count()
    if not n:
        none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return none.withColumn("kept", F.lit(True))
    at = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    few = classes.where(at < int(sample / n * (1 << 30)) + 1).select("v", at.alias("at")).collect()
    by_length: dict[int, list] = {}
    for r in sorted(few, key=lambda r: (r["at"], r["v"])):
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    for (length,) in classes.select(F.size("v")).distinct().collect():
        if length not in by_length:  # a length that the sample has not met: one point, all its vectors are candidates
            by_length[length] = [[1.0] * length]
    known = {k: reference_points(np.array(v, np.float64), points) for k, v in by_length.items()}
    nodes = classes.select("node", "label", F.size("v").alias("size"), "w", "v")
    schema = T.StructType([*nodes.schema.fields, T.StructField("p", T.ArrayType(T.ShortType()))])
    nodes = table(nodes.mapInArrow(frugal(_describe(known)), schema), "pivot-nodes")
    found = table(links_within(nodes, cosine), "pivot-links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    return _rows(rows, member, classes, linked, found.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))


def _rows(rows: DataFrame, member: DataFrame, classes: DataFrame, linked: DataFrame, hooks: DataFrame) -> DataFrame:
    """A row for each vector from the classes' links and hooks."""
    single = classes.where("w = 1").select("node", F.col("id").alias("vec_id"), "w")
    several = member.where("of IS NOT NULL").select(F.col("of").alias("node"), "vec_id", F.col("copies").alias("w"))
    whose = cut(single.unionByName(several))
    # rows of one id belong together, whatever their vectors
    ids = whose.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("vec_id", "a")
    shared = meet(whose, ids, ["vec_id"], "node").where("a <> node").select("a", F.col("node").alias("b"))
    labels = components(hooks.unionByName(shared).distinct())
    placed = classes.select("node", "id").join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("root"))
    roots = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    of = cut(meet(placed, roots, ["root"], "node").join(linked, "node", "left").select("node", "component_id", F.coalesce("links", F.lit(0)).alias("links")))
    mine = meet(whose, of, ["node"], "vec_id", stored=True).select("vec_id", (F.col("links") + F.col("w") - 1).alias("n_links"), "component_id")
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    zero = F.lit(0).cast("long")
    rest = rows.where(~takes_part).select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs; equal where the index misses none. Ids are unique in the tables that this is run on.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id AND r.c < l.b)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, min(r.c) AS component_id, min(r.c) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN r ON r.vec_id = e.vec_id GROUP BY e.vec_id, n.n"""
