"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set are its distinct word shingles. Two permutations make all
signature coordinates: sigma scatters a shingle, and coordinate k is the least of
pi(sigma(s) + k), the same pi circularly shifted by k. Coordinates are banded;
documents with equal sets are first joined into one class, so that copies cost
nothing. In every bucket that holds several components the members are verified
on their full sets against one of them, another in each bucket and turn, and
confirmed links join components, turn by turn, until one joins little; then all
pairs left across components in a bucket are compared: in crowded buckets on
full sets, block by block, in others by signature and then on full sets. No bucket
is capped and no group is gathered or expanded into all its pairs.

What can be missed: a pair at similarity 0.75 shares no band of 4 coordinates
among 32 with probability 5e-6, and a pair that does is left out by the signature
comparison (under half of 128 coordinates equal) with probability below 1e-9.

Defined results: a null or empty text has no shingles, is linked with nothing and
stays; fewer words than a shingle make one shingle of the whole sequence; rows of
one id count as one document, which links all that any of its texts is like; rows
without an id take no part and stay; an empty table gives an empty result;
columns of other names are ignored. Sets are equal if their sizes and two 64-bit
sums of hashed shingles are; all other links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mensura.llm._store import bounded, cut, frugal, meet, table
from mensura.llm._text import LOWER, hash_words, mix, shingles, slices
from mensura.llm.graph import components

BANDS, ROWS = 32, 4
SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
COMPARE_BLOCK = 256
PIVOT_YIELD = 8
CROWD = 48
BROADCAST_IDS = 1_000_000
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)
_SIGMA = np.uint64(0xD1B54A32D192ED03)
#: A pair of nodes and the components that they lie in.
LINK = "a long, b long, ca long, cb long"


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit integers, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(0x85EBCA6B)
    np.right_shift(x, np.uint32(13), out=t)
    x ^= t
    x *= np.uint32(0xC2B2AE35)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def signature(values: np.ndarray) -> np.ndarray:
    """The circulant MinHash coordinates of a set of 64-bit values, as 16-bit integers."""
    sigma = (mix(values ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), 512):
        np.minimum(least, _pi(sigma[at : at + 512, None] + _SHIFTS).min(axis=0), out=least)
    return least.astype(np.uint16)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    for s in slices(batch.column("text")):
        data = LOWER[s.data]
        starts, ends, first = s.words(data)
        hashes, at = shingles(hash_words(data, starts, ends), first, SHINGLE)
        for i in range(len(s)):
            values = np.sort(hashes[at[i] : at[i + 1]])
            if len(values) > 1:
                values = values[np.concatenate([[True], values[1:] != values[:-1]])]
            yield s.rows.start + i, values


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        count, f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        bands = np.zeros((n, BANDS), np.int64)
        for row, values in _sets(batch):
            count[row] = len(values)
            if len(values):
                f1[row], f2[row] = mix(values + np.uint64(1)).sum(), mix(values ^ np.uint64(0xA5A5A5A5)).sum()
                bands[row] = signature(values).view(np.int64)
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "n": pa.array(count), "f1": pa.array(f1.view(np.int64)), "f2": pa.array(f2.view(np.int64)),
            "bands": pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), pa.array(bands.ravel())),
        })


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [b""] * batch.num_rows
        for row, values in _sets(batch):
            blobs[row] = values.tobytes()
        yield pa.record_batch({"id": batch.column("doc_id"), "items": pa.array(blobs, pa.binary())})


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = DENOMINATOR * shared >= NUMERATOR * (len(both) - shared)
        yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(keep))


def shingle_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, items) of the documents in ids(id), as a table."""
    ids = cut(ids)
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
    return table(texts.mapInArrow(frugal(_set_rows), "id long, items binary"), "minhash-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b, ca, cb) whose full shingle sets are similar enough."""
    second = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    both = second.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    return cut(both.select("a", "b", "ca", "cb", "x", "y").mapInArrow(frugal(_confirm), LINK))


def _links(node: np.ndarray, comp: np.ndarray, found: list[tuple[int, np.ndarray]]) -> pa.Table:
    """Rows of LINK for each (row, rows linked with it), the smaller node first."""
    one = np.repeat(np.array([i for i, _ in found], np.int64), [len(x) for _, x in found])
    two = np.concatenate([np.zeros(0, np.int64), *(x for _, x in found)])
    swap = node[one] > node[two]
    a, b = np.where(swap, two, one), np.where(swap, one, two)
    return pa.table({"a": node[a], "b": node[b], "ca": comp[a], "cb": comp[b]})


def _across(key: tuple, group: pa.Table) -> pa.Table:
    """Pairs of a block's members and the bucket's outsiders that lie in different components and look similar."""
    node, comp, n = (group.column(c).to_numpy() for c in ("node", "comp", "n"))
    outside, inside = (np.flatnonzero(group.column(c).to_numpy(zero_copy_only=False)) for c in ("outsider", "member"))
    sig = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS).view(np.uint16)
    found = []
    for i in outside:
        near = inside[comp[inside] != comp[i]]
        near = near[DENOMINATOR * np.minimum(n[near], n[i]) >= NUMERATOR * np.maximum(n[near], n[i])]
        near = near[(sig[near] == sig[i]).sum(axis=1) * 2 >= BANDS * ROWS]
        found.append((i, near))
    return _links(node, comp, found)


def _grid(key: tuple, group: pa.Table) -> pa.Table:
    """Confirmed links between a block's members and the outsiders sent to it, one for each outsider and component.

    Full sets are compared by a postings list of the block's shingles, so an
    outsider meets all members at once.
    """
    node, comp, n = (group.column(c).to_numpy() for c in ("node", "comp", "n"))
    outside, inside = (np.flatnonzero(group.column(c).to_numpy(zero_copy_only=False)) for c in ("outsider", "member"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("items")]
    found = []
    if len(inside):
        shingle = np.concatenate([sets[i] for i in inside])
        owner = np.repeat(np.arange(len(inside)), [len(sets[i]) for i in inside])
        order = np.argsort(shingle, kind="stable")
        shingle, owner = shingle[order], owner[order]
        for i in outside:
            low, high = np.searchsorted(shingle, sets[i], "left"), np.searchsorted(shingle, sets[i], "right")
            many = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            both = np.bincount(owner[at], minlength=len(inside))
            fine = np.flatnonzero((comp[inside] != comp[i]) & (DENOMINATOR * both >= NUMERATOR * (n[inside] + n[i] - both)))
            _, first = np.unique(comp[inside][fine], return_index=True)
            found.append((i, inside[fine[first]]))
    return _links(node, comp, found)


def crowded_links(members: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links across the components that meet in crowded buckets.

    Components that share such buckets make a cluster. Its members, and those
    outside its largest component, are dealt into blocks of bounded size, and every
    two blocks meet in a cell, so the comparisons of a crowd are spread over tasks
    and only links come out.
    """
    least = members.groupBy("key").agg(F.min("comp").alias("a"))
    meet = cut(members.join(least, "key").where("comp <> a").select("a", F.col("comp").alias("b")).distinct())
    clusters = components(meet).select(F.col("node").alias("comp"), F.col("label").alias("cluster"))
    rows = cut(members.select("node", "comp").distinct().join(clusters, "comp"))
    by = rows.groupBy("cluster", "comp").agg(F.count("*").alias("c"))
    sizes = cut(by.groupBy("cluster").agg(F.sum("c").alias("c"), F.max_by("comp", "c").alias("main")))
    outsider = F.col("comp") != F.col("main")
    known = rows.join(sizes, "cluster").withColumn("outsider", outsider)
    n_out = cut(known.groupBy("cluster").agg(F.count_if("outsider").alias("n_out")))
    known = known.join(n_out, "cluster")
    count = lambda c: F.greatest(F.ceil(F.col(c) / COMPARE_BLOCK), F.lit(1)).cast("int")
    place = lambda c: F.pmod(F.xxhash64("node"), count(c)).cast("int")
    span = lambda c: F.sequence(F.lit(0), count(c) - 1)
    # a cell of the grid holds one block of outsiders and one of all members
    cols = ["cluster", "row", "column", "node", "comp", "outsider", "member"]
    across_ = known.where("outsider").withColumn("row", place("n_out")).withColumn("column", F.explode(span("c"))).withColumn("member", F.lit(False))
    down = known.withColumn("column", place("c")).withColumn("row", F.explode(span("n_out"))).withColumn("outsider", F.lit(False)).withColumn("member", F.lit(True))
    dealt = across_.select(cols).unionByName(down.select(cols))
    full = dealt.join(nodes.select("node", "n"), "node").join(sets.select(F.col("id").alias("node"), "items"), "node")
    return cut(full.groupBy("cluster", "row", "column").applyInArrow(_grid, LINK).distinct())


def placed(members: DataFrame, more: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of members(key, node, comp) after the links ``more``, of the buckets that still hold several components."""
    merged = components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), "label")
    known = meet(members, merged, ["comp"], "node", "left", stored=True).select("key", "node", F.coalesce("label", "comp").alias("comp"))
    split = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return cut(meet(known, split, ["key"], "node", bound=n))


def pivoted(members: DataFrame, turn: int, n: int) -> DataFrame:
    """Pairs of each bucket's members (``n`` in all) and one of them, another in every turn and bucket, across components."""
    at = F.col("node").bitwiseXOR(F.xxhash64("key", F.lit(turn)))
    pivots = members.groupBy("key").agg(F.min_by("node", at).alias("pivot"), F.min_by("comp", at).alias("pivot_comp"))
    met = meet(members, pivots, ["key"], "node", bound=n).where("comp <> pivot_comp")
    ends = {"a": ("node", "pivot"), "b": ("pivot", "node"), "ca": ("comp", "pivot_comp"), "cb": ("pivot_comp", "comp")}
    return met.select(*(F.when(F.col("node") < F.col("pivot"), F.col(x)).otherwise(F.col(y)).alias(c) for c, (x, y) in ends.items())).distinct()


def across(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs across the components of a bucket whose sizes and signatures are similar.

    Members are dealt into blocks; only those outside a bucket's largest
    component are sent to every block.
    """
    by = members.groupBy("key", "comp").agg(F.count("*").alias("c"))
    buckets = by.groupBy("key").agg(F.sum("c").alias("c"), F.max_by("comp", "c").alias("main"))
    blocks = F.ceil(F.col("c") / COMPARE_BLOCK).cast("int")
    dealt = meet(members, buckets, ["key"], "node").withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    outsider = F.col("comp") != F.col("main")
    dealt = dealt.withColumn("block", F.explode(F.when(outsider, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("mine"))))
    dealt = dealt.select("key", "block", "node", "comp", outsider.alias("outsider"), (F.col("block") == F.col("mine")).alias("member"))
    return dealt.join(nodes, "node").groupBy("key", "block").applyInArrow(_across, LINK).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of documents(doc_id, text)."""
    spark = bounded(docs).sparkSession
    signed = table(docs.select("doc_id", "text").mapInArrow(frugal(_sign), "doc_id long, n long, f1 long, f2 long, bands array<bigint>"), "minhash-signed")
    live = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    same = ["f1", "f2", "n"]
    multi = live.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    member = meet(live, multi, same, "doc_id", "left").withColumn("node", F.coalesce("rep", "doc_id"))
    membership = table(member.select("doc_id", "node"), "minhash-classes")
    nodes = table(member.where("doc_id = node").select("node", "n", "bands"), "minhash-nodes")

    spread = nodes.select("node", F.posexplode("bands")).select("node", F.xxhash64("pos", "col").alias("key"))
    buckets = spread.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    shared = table(meet(spread, buckets, ["key"], "node"), "minhash-buckets")
    sets = shingle_sets(shared.select(F.col("node").alias("id")).distinct(), docs)

    # an id whose rows have different texts is one document, which belongs to the classes of all of them
    ids = membership.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    links = cut(membership.join(ids, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct())
    members, tested, turn = shared.withColumn("comp", F.col("node")), spark.createDataFrame([], "a long, b long"), 0
    if not links.isEmpty():
        members = placed(members, links.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), shared.count())
    while n := members.count():
        full = turn < 0
        if full:
            crowd = cut(members.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("key"))
            if not crowd.isEmpty():
                more = crowded_links(meet(members, crowd, ["key"], "node", stored=True, bound=n), nodes, sets)
                links = links.unionByName(more.select("a", "b"))
                members = placed(meet(members, crowd, ["key"], "node", "left_anti", stored=True, bound=n), more, n)
        found = across(members, nodes) if full else pivoted(members, turn, n)
        found = cut(found.join(tested, ["a", "b"], "left_anti"))
        more = verified(found, sets)
        joined = more.count()
        if joined:
            links = links.unionByName(more.select("a", "b"))
        if full:
            break
        if joined:
            members = placed(members, more, n)
        # a turn of pivots that joins little is the last: what is left is compared in full, once
        tested, turn = tested.unionByName(found.select("a", "b")), turn + 1 if joined and joined * PIVOT_YIELD >= found.count() else -1

    labels = components(links)
    of = meet(membership, labels, ["node"], "doc_id", "left", stored=True).select("doc_id", F.coalesce("label", "node").alias("component_id"))
    least = F.col("component_id")
    out = signed.select("doc_id", "n").join(of.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(least, F.col("doc_id")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, and every document without an id.

    Of rows that share an id the one with the least text hash stays, of those that
    also share the text the one with the least hash of all columns.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = cut(gone)
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    stay = docs.join(few, F.col("doc_id") == F.col("__gone"), "left_anti")
    again = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__again")))
    if again.isEmpty():
        return stay
    single = stay.join(again, F.col("doc_id") == F.col("__again"), "left_anti")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    several = stay.join(again, F.col("doc_id") == F.col("__again"), "left_semi").withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    return single.unionByName(several)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id AND r.c < l.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id, n.n"""
