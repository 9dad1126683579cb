"""Ranked lexical search over a two-level quantised index.

The index is cut into shards of documents. A shard holds, for each term that any
query asks for, the documents with it and how often they hold it (the exact
level). When the statistics of the corpus are known, every posting gets a byte:
its impact, rounded up to 255 steps (the cheap level). A query adds up the bytes
of its terms, which gives each document of the shard an upper bound, and one step
less a term a lower bound. Every document whose upper bound reaches the k-th
lower bound, or the k-th exact score that the task has met so far, is scored
again from its counts in exact integers. Tasks carry their k best from shard to
shard; the k best of all tasks are merged by a first and a last ranking.

Texts are read once. Terms are compared by hash and then by their bytes, so no
result hangs on a hash. What is sent to tasks are the terms of one batch of
queries; ``PAIRS`` (item, term) pairs make a batch, and more queries more batches.

Defined results: a document counts in N and in the statistics if it has a term;
rows without a doc_id count there too and are never returned; rows that share a
doc_id are separate documents; items that share an item_id are one item with the
terms of all, rows without an item_id take no part; null and empty texts have no
terms; equal scores go to the smaller doc_id; an item without a document above 0
has no rows; other columns are ignored. Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mensura.llm._store import bounded, cut, frugal, table
from mensura.llm._text import _MASK, hash_words, slices

#: Bytes of terms as they are compared; all others part terms, and read as a space.
TERM = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    TERM[_low:_high] = np.arange(_low, _high)
TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STEPS = 255
WHOLE = 1_000_000  # what an impact stays below
PAIRS = 1_000_000
MERGE = 64
SHARD = "ids binary, named binary, sizes binary, n long, total long, terms array<int>, dfs array<int>, docs binary, tf binary"


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))


class Vocabulary:
    """The terms that a batch of queries asks for, numbered from 0 in the order of their hashes."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        lengths = np.array([len(t) for t in raw], np.int64)
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths)
        hashes = hash_words(data, ends - lengths, ends)
        order = np.argsort(hashes, kind="stable")
        self.data, self.hashes, self.lengths, self.starts = data, hashes[order], lengths[order], (ends - lengths)[order]
        self.number = {terms[i]: k for k, i in enumerate(order.tolist())}

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words that aren't asked for."""
        out = np.full(len(starts), -1, np.int64)
        if not len(starts) or not len(self.hashes):
            return out
        h = hash_words(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == h) & (self.lengths[at] == ends - starts))
        term = at[hit]
        ours, theirs, left = starts[hit], self.starts[term], self.lengths[term]
        here, there, same, live = _eights(data), _eights(self.data), np.ones(len(hit), bool), np.arange(len(hit))
        while len(live):
            part = (here[ours[live]] ^ there[theirs[live]]) & _MASK[np.minimum(left[live], 8)]
            same[live] = part == 0
            live = live[(part == 0) & (left[live] > 8)]
            ours[live], theirs[live], left[live] = ours[live] + 8, theirs[live] + 8, left[live] - 8
        out[hit[same]] = term[same]
        return out


def _index(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy().astype(np.int64)
            for s in slices(batch.column("text")):
                data = TERM[s.data]
                starts, ends, first = s.words(data)
                sizes = np.diff(first)
                term = vocabulary.find(data, starts, ends)
                hit = np.flatnonzero(term >= 0)
                doc = np.searchsorted(first, hit, "right") - 1
                key, tf = np.unique(term[hit] * len(s) + doc, return_counts=True)
                kept, docs = np.unique(key % len(s), return_inverse=True)
                terms, dfs = np.unique(key // len(s), return_counts=True)
                yield pa.record_batch({
                    "ids": pa.array([ids[s.rows][kept].tobytes()], pa.binary()), "named": pa.array([known[s.rows][kept].tobytes()], pa.binary()),
                    "sizes": pa.array([sizes[kept].astype("<i8").tobytes()], pa.binary()), "n": pa.array([int((sizes > 0).sum())], pa.int64()),
                    "total": pa.array([int(sizes.sum())], pa.int64()), "terms": pa.array([terms.astype(np.int32)], pa.list_(pa.int32())),
                    "dfs": pa.array([dfs.astype(np.int32)], pa.list_(pa.int32())), "docs": pa.array([docs.astype("<i4").tobytes()], pa.binary()),
                    "tf": pa.array([tf.astype("<i4").tobytes()], pa.binary()),
                })

    return run


def norm(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of so many terms in a corpus of ``n`` documents and ``total`` terms."""
    return 100 - 90 + (90 * sizes * n) // total


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The exact factor that a term's weight is multiplied with."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def rounded_up(exact: np.ndarray) -> np.ndarray:
    """The byte of each impact: the least whose share of WHOLE is not below it."""
    return (-(-exact * STEPS // WHOLE)).astype(np.uint8)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Shard:
    """A shard as it is searched: postings by term, with their bytes, and the counts behind them."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, total: int):
        self.ids, self.named = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["named"], bool)
        self.docs, self.tf = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("docs", "tf"))
        self.m = norm(np.frombuffer(row["sizes"], "<i8"), n, total)
        self.ends = np.cumsum(np.array(row["dfs"], np.int64))
        self.begins = self.ends - np.array(row["dfs"], np.int64)
        self.slot = np.full(len(weights), -1, np.int64)
        self.slot[row["terms"]] = np.arange(len(row["terms"]))
        self.of = np.repeat(weights[np.array(row["terms"], np.int64)], row["dfs"])  # each posting's weight
        byte = rounded_up(impacts(self.tf, self.m[self.docs]))
        # sums of whole numbers below 2**53, so doubles hold them exactly
        self.high, self.low = (self.of * byte).astype(float), (self.of * (byte.astype(np.int64) - 1)).astype(float)

    def search(self, terms: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best (scores, ids) of those given and this shard's documents."""
        slots = self.slot[terms]
        slots = slots[slots >= 0]
        if not len(slots):
            return scores, ids
        at = np.concatenate([np.arange(self.begins[s], self.ends[s]) for s in slots])
        docs = self.docs[at]
        upper = np.bincount(docs, self.high[at], len(self.ids))
        live = self.named & (upper > 0)
        bar = -1.0  # what a bound must reach, in WHOLE / STEPS
        if len(scores) == k:
            bar = float(scores[-1]) * STEPS / WHOLE * (1 - 1e-12)
        elif live.sum() >= k:
            lower = np.bincount(docs, self.low[at], len(self.ids))[live]
            bar = np.partition(lower, len(lower) - k)[len(lower) - k]
        live &= upper >= bar
        if not live.any():
            return scores, ids
        exact = at[live[docs]]
        gain = self.of[exact] * impacts(self.tf[exact], self.m[self.docs[exact]])
        full = np.bincount(self.docs[exact], gain.astype(float), len(self.ids)).astype(np.int64)
        found = np.flatnonzero(full > 0)
        scores, ids = np.concatenate([scores, full[found]]), np.concatenate([ids, self.ids[found]])
        best = np.lexsort((ids, -scores))[:k]
        return scores[best], ids[best]


def _search(items: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, weights, n, total)
                best = [shard.search(terms, *known, k) for terms, known in zip(items, best)]
        lengths = [len(s) for s, _ in best]
        if sum(lengths):
            yield pa.record_batch({
                "item": pa.array(np.repeat(np.arange(len(best), dtype=np.int32), lengths)),
                "doc_id": pa.array(np.concatenate([d for _, d in best])), "score": pa.array(np.concatenate([s for s, _ in best])),
            })

    return run


def _ranked(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and each different term of the item's text."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({TERM_PATTERN})"), F.lit(1))
    return items.where("item_id IS NOT NULL").select("item_id", F.explode(found).alias("term")).distinct()


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents(doc_id, text) of every item(item_id, text)."""
    spark = bounded(docs).sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = cut(item_terms(items))
    kind = dict(asked.dtypes)["item_id"]
    batches = max(1, -(-asked.count() // pairs))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for batch in range(batches):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == batch)
        lists = [(r["item_id"], r["terms"]) for r in mine.groupBy("item_id").agg(F.collect_set("term").alias("terms")).collect()]
        vocabulary = Vocabulary(sorted({t for _, terms in lists for t in terms}))
        shards = table(docs.mapInArrow(frugal(_index(vocabulary)), SHARD), "lexical-shards")
        sums = shards.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        if not lists or not sums["total"]:
            continue
        df = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).groupBy(F.col("p.terms").alias("t")).agg(F.sum("p.dfs").alias("df"))
        weights = np.zeros(len(vocabulary.number), np.int64)
        for r in df.collect():
            weights[r["t"]] = weight(sums["n"], r["df"])
        numbers = [np.array([vocabulary.number[t] for t in terms], np.int64) for _, terms in lists]
        found = shards.mapInArrow(frugal(_search(numbers, weights, sums["n"], sums["total"], k)), "item int, doc_id long, score long")
        found = _ranked(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE))), k, "item", "part").drop("rank")
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(lists)], f"item int, item_id {kind}")
        out = out.unionByName(_ranked(found, k, "item").join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return top_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_PATTERN}') AS ws FROM documents),
d AS (SELECT row, doc_id, ws, len(ws) AS n FROM t WHERE len(ws) > 0),
s AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM d),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_all),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_PATTERN}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (row), s GROUP BY item_id, row, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10"""
