"""Language-model scores by prediction by partial matching (PPM).

A trie of byte contexts up to five bytes long is counted over the training
documents. A symbol is predicted from the longest context seen; where it is new
there, the escape probability (method C: distinct symbols against occurrences) is
paid and the next shorter context is asked, with the symbols of the longer one
excluded; last comes a uniform choice among bytes never seen. ``adaptive_score``
learns from the text itself as it goes; the corpus operator uses the pretrained
trie, in which all of that is fixed for each context, so it scores arrays.

All nodes are kept. Those of the three longest orders are dealt by the last three
bytes of their context, where every key that any document holds gets its exact
score; the shorter orders, 2**24 nodes at most whatever the corpus, are sent to
all tasks. The scores of the most frequent keys (at most 2**21) are then sent to
the scoring tasks, all others are joined. Words for the base score are counted
exactly: frequent ones (at least one token in 2**18, at most 2**18 words) are
sent to the scoring tasks, all others are joined.

The text that is scored is the lower-cased words with one space between, and an
end mark, which is what the tokens of the base score hold.

Defined results: a null or empty text is the end mark alone; texts of any length
are used whole; equal rows get equal scores; a row without an id counts as
training if the empty string's checksum does; without training documents all
bytes are equally likely; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm._store import bounded, frugal, table
from mensura.llm._text import LOWER, WORD, Slice, hash_words, slices
from mensura.llm.labelled import remainder

ORDER = 5
SENT, HEAD_NODES, HEAD_BITS = 3, 1 << 21, 18
END = 0x0A  # words hold no line break, so it can mark both ends of a text
END_KEY = np.uint64(0x5D588B656C078965)
SLOT_BITS = 21
HELD = 1 << 20
CHUNK = 1 << 19
NO_KEY = np.uint64(2**64 - 1)
_SLOT = np.uint64(0x9E3779B97F4A7C15)


def stream(s: Slice) -> tuple[np.ndarray, np.ndarray, tuple]:
    """The scored bytes of a slice's texts, each behind ORDER end marks; each text's first place; and its words."""
    data = LOWER[s.data]
    starts, ends, first = s.words(data)
    sizes, n = ends - starts, len(s)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    run = np.concatenate([[0], np.cumsum(sizes + 1)])
    length = run[first[1:]] - run[first[:-1]] + (count == 0) + ORDER
    begin = np.concatenate([[0], np.cumsum(length)])
    out = np.full(begin[-1], END, np.uint8)
    to = begin[doc] + ORDER + run[:-1] - run[first[:-1]][doc]
    inside = np.flatnonzero(WORD[data])
    out[np.repeat(to - starts, sizes) + inside] = data[inside] if len(inside) else 0
    after = to + sizes
    out[after] = 0x20
    out[after[first[1:][count > 0] - 1]] = END
    return out, begin, (data, starts, ends, first)


def grams(out: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each scored byte behind its ORDER bytes of context as one integer, and each text's first place among them."""
    wide = out.astype(np.uint64)
    key = np.zeros(len(out), np.uint64)
    for k in range(ORDER + 1):
        key[ORDER:] |= wide[ORDER - k : len(out) - k] << np.uint64(8 * k)
    scored = np.ones(len(out), bool)
    for k in range(ORDER):
        scored[begin[:-1] + k] = False
    return key[scored], begin - ORDER * np.arange(len(begin))


def _merge(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    return k[at], np.add.reduceat(c, at) if len(at) else c


class _Tally:
    """Counts of keys, merged now and then, and handed out when there are many."""

    def __init__(self, kind: int):
        self.kind, self.keys, self.counts, self.n = kind, [], [], 0

    def add(self, keys: np.ndarray, counted: bool = True) -> None:
        """The keys, each occurrence once, or with a count of zero."""
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k.astype(np.uint64))
        self.counts.append(c.astype(np.int64) * counted)
        self.n += len(k)

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.n < least or not self.keys:
            return
        k, c = _merge(self.keys, self.counts)
        self.keys, self.counts, self.n = [k], [c], len(k)
        if self.n >= least // 2:
            for at in range(0, len(k), 50_000):
                part = k[at : at + 50_000]
                yield pa.record_batch({
                    "kind": pa.array(np.full(len(part), self.kind, np.int32)), "key": pa.array(part.view(np.int64)), "n": pa.array(c[at : at + 50_000]),
                })
            self.keys, self.counts, self.n = [], [], 0


#: Bytes of texts that are counted or scored at once; what a task holds besides what all tasks are sent is in proportion to it.
SCORE_SLICE = 1 << 20


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, trie = _Tally(0), _Tally(1)
    for batch in batches:
        learned = batch.column("learn").to_numpy(zero_copy_only=False)
        for s in slices(batch.column("text"), SCORE_SLICE):
            out, begin, (data, starts, ends, first) = stream(s)
            learn = learned[s.rows.start : s.rows.start + len(s)]
            hashes, (key, at) = hash_words(data, starts, ends), grams(out, begin)
            words.add(np.append(hashes[np.repeat(learn, np.diff(first))], np.full(learn.sum(), END_KEY)))
            of = np.repeat(learn, np.diff(at))
            trie.add(key[of])
            trie.add(key[~of], False)
            yield from words.take(HELD)
            yield from trie.take(HELD)
    yield from words.take(0)
    yield from trie.take(0)


class Trie:
    """Contexts and symbols of all orders with what prediction needs, as sorted arrays."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        """``orders[j]``: keys (j context bytes and the symbol, as one integer, ascending) and counts."""
        self.grams = [np.asarray(k, np.uint64) for k, _ in orders]
        self.counts = [np.asarray(c, float) for _, c in orders]
        self.contexts, self.total, self.kinds, self.left, self.left_kinds = [], [], [], [], []
        for j, (k, c) in enumerate(zip(self.grams, self.counts)):
            ctx = k >> np.uint64(8)
            at = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(k) else np.zeros(0, int)
            self.contexts.append(ctx[at])
            self.total.append(np.add.reduceat(c, at) if len(at) else np.zeros(0))
            self.kinds.append(np.diff(np.append(at, len(k))).astype(float))
            if j:
                # what the next shorter context has left when the symbols of this one are excluded
                low = (k & np.uint64(256**j - 1)).astype(np.uint64)
                place = np.searchsorted(self.grams[j - 1], low)
                used = np.add.reduceat(self.counts[j - 1][place], at) if len(at) else np.zeros(0)
                parent = np.searchsorted(self.contexts[j - 1], (ctx[at] & np.uint64(256 ** (j - 1) - 1)))
                self.left.append(self.total[j - 1][parent] - used)
                self.left_kinds.append(self.kinds[j - 1][parent] - self.kinds[j])
            else:
                self.left.append(np.zeros(0))
                self.left_kinds.append(np.zeros(0))

    def predict(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's last byte behind its other ones."""
        out = np.zeros(len(keys))
        alive = np.arange(len(keys))
        above = np.full(len(keys), -1)
        for j in range(ORDER, -1, -1):
            if not len(alive):
                return out
            key = keys[alive] & np.uint64((1 << (8 * (j + 1))) - 1)
            known = self.contexts[j]
            if not len(known):
                continue
            ctx = key >> np.uint64(8)
            at = np.minimum(np.searchsorted(known, ctx), len(known) - 1)
            seen = known[at] == ctx
            total, kinds = self.total[j][at], self.kinds[j][at]
            if j < ORDER and len(self.left[j + 1]):
                longer = above >= 0
                total = np.where(longer, self.left[j + 1][above], total)
                kinds = np.where(longer, self.left_kinds[j + 1][above], kinds)
            place = np.minimum(np.searchsorted(self.grams[j], key), len(self.grams[j]) - 1)
            hit = seen & (self.grams[j][place] == key)
            whole = np.log10(np.maximum(total + kinds, 1))
            out[alive[hit]] += np.log10(self.counts[j][place[hit]]) - whole[hit]
            miss = ~hit
            pay = miss & seen & (kinds > 0)
            out[alive[pay]] += np.log10(kinds[pay]) - whole[pay]
            above = np.where(seen, at, -1)[miss]
            alive = alive[miss]
        rest = 256 - (self.kinds[0][0] if len(self.kinds[0]) else 0)
        out[alive] -= math.log10(max(rest, 1))
        return out

    def score(self, keys: np.ndarray) -> np.ndarray:
        some, back = np.unique(keys, return_inverse=True)
        return self.predict(some)[back]


class Head:
    """Scores of frequent keys; a table of slots answers for most of them."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, order: np.ndarray):
        """``keys`` ascending; ``order``: their places from rare to frequent, as of two that share a slot the more frequent has it."""
        self.keys, self.logs = keys, logs
        where = ((keys * _SLOT) >> np.uint64(64 - SLOT_BITS))[order]
        self.slot_key, self.slot_log = np.full(1 << SLOT_BITS, NO_KEY), np.zeros(1 << SLOT_BITS)
        self.slot_key[where], self.slot_log[where] = keys[order], logs[order]

    def score(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of keys, 0 where a key isn't held, and the places of those."""
        slot = (keys * _SLOT) >> np.uint64(64 - SLOT_BITS)
        out = self.slot_log[slot]
        miss = np.flatnonzero(self.slot_key[slot] != keys)
        if not len(miss) or not len(self.keys):
            out[miss] = 0
            return out, miss
        some, back = np.unique(keys[miss], return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        held = self.keys[place] == some
        out[miss] = np.where(held, self.logs[place], 0.0)[back]
        return out, miss[~held[back]]


def adaptive_score(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a byte string by PPM that starts empty and learns each byte after coding it."""
    counts: dict[bytes, dict[int, int]] = {}
    total = 0.0
    for i, symbol in enumerate(text):
        excluded: set[int] = set()
        for j in range(min(order, i), -1, -1):
            seen = {s: c for s, c in counts.get(text[i - j : i], {}).items() if s not in excluded}
            whole = sum(seen.values()) + len(seen)
            if symbol in seen:
                total += math.log10(seen[symbol] / whole)
                break
            if seen:
                total += math.log10(len(seen) / whole)
                excluded |= set(seen)
        else:
            total -= math.log10(256 - len(excluded))
        for j in range(min(order, i) + 1):
            node = counts.setdefault(text[i - j : i], {})
            node[symbol] = node.get(symbol, 0) + 1
    return total


def _level(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return _merge([keys & np.uint64(256 ** (order + 1) - 1)], [counts])


def _predicted(low):
    """Scores of keys that come sorted by the last SENT bytes of their context, with all keys of such a context in one task."""

    def scored(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        learned = n > 0
        trie = Trie([*low.value, *(_level(keys[learned], n[learned], j) for j in range(SENT, ORDER + 1))])
        logs = trie.predict(keys)
        for at in range(0, len(keys), 50_000):
            part = slice(at, at + 50_000)
            yield pa.record_batch({"key": pa.array(keys[part].view(np.int64)), "n": pa.array(n[part]), "log": pa.array(logs[part])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            keys.append(batch.column("key").to_numpy().view(np.uint64))
            counts.append(batch.column("n").to_numpy())
            held += len(batch)
            if held >= CHUNK:
                k, n = np.concatenate(keys), np.concatenate(counts)
                ctx = (k >> np.uint64(8)) & np.uint64(256**SENT - 1)
                cut = int(np.searchsorted(ctx, ctx[-1]))
                if cut:
                    yield from scored(k[:cut], n[:cut])
                keys, counts, held = [k[cut:]], [n[cut:]], len(k) - cut
        if held:
            yield from scored(np.concatenate(keys), np.concatenate(counts))

    return run


def train(docs: DataFrame, learn) -> tuple[DataFrame, DataFrame]:
    """Counts of the words of documents(text) where ``learn`` holds, as (key, n), and the scores by all of their nodes
    of each key that any document holds, as (key, n, log)."""
    sc = docs.sparkSession.sparkContext
    counted = table(
        docs.select("text", F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(frugal(_count), "kind int, key long, n long")
        .groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts"
    )
    top = counted.where("kind = 1").select("key", "n")
    got = top.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(256**SENT - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    keys, n = got.column("key").to_numpy().astype(np.uint64), got.column("n").to_numpy()
    low = sc.broadcast([_level(keys, n, j) for j in range(SENT)])
    ctx = F.shiftright("key", 8).bitwiseAND(F.lit(256**SENT - 1))
    dealt = top.withColumn("ctx", ctx).repartition("ctx").sortWithinPartitions("ctx").select("key", "n")
    return counted.where("kind = 0").select("key", "n"), table(dealt.mapInArrow(frugal(_predicted(low)), "key long, n long, log double"), "ppm-logs")


def _bar(logs: DataFrame, most: int) -> int:
    """A count that at most ``most`` keys reach."""
    level = F.floor(F.log2(F.col("n") + 1) * 16)
    bar, held = (1 << 63) - 1, 0
    for r in sorted(logs.groupBy(level.alias("level")).agg(F.count("*").alias("m"), F.min("n").alias("n")).collect(), key=lambda r: -r["level"]):
        held += r["m"]
        if held > most:
            break
        bar = r["n"]
    return bar


def _lists(doc: np.ndarray, keys: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """The distinct keys of each of ``n`` texts, and how often each occurs."""
    order = np.lexsort((keys, doc))
    w, d = keys[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    firsts = np.flatnonzero(new)
    at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(d[firsts], minlength=n))]).astype(np.int32))
    times = np.diff(np.append(firsts, len(w))).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(w[firsts].view(np.int64))), pa.ListArray.from_arrays(at, pa.array(times))


def _scored(nodes, head_keys, head_logs):
    shared: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared:
            shared.append(Head(*nodes.value))
        keys, logs = head_keys.value, head_logs.value
        for batch in batches:
            for s in slices(batch.column("text"), SCORE_SLICE):
                out, begin, (data, starts, ends, first) = stream(s)
                key, at = grams(out, begin)
                got, rare = shared[0].score(key)
                run_ = np.concatenate([[0], np.cumsum(got)])
                nodes_, node_times = _lists(np.searchsorted(at, rare, "right") - 1, key[rare], len(s))
                words = hash_words(data, starts, ends)
                count = np.diff(first)
                doc = np.repeat(np.arange(len(s)), count)
                place = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
                head = keys[place] == words if len(keys) else np.zeros(len(words), bool)
                base = np.bincount(doc[head], logs[place[head]], len(s)) if len(words) else np.zeros(len(s))
                known = np.bincount(doc[head], minlength=len(s))
                tail, times = _lists(doc[~head], words[~head], len(s))
                yield pa.record_batch({
                    "rid": batch.column("rid").slice(s.rows.start, len(s)), "doc_id": batch.column("doc_id").slice(s.rows.start, len(s)),
                    "n_tokens": pa.array(count + 1), "score": pa.array(run_[at[1:]] - run_[at[:-1]]), "base": pa.array(base), "known": pa.array(known),
                    "tail": tail, "times": times, "nodes": nodes_, "node_times": node_times,
                })

    return run


SCORED = "rid long, doc_id long, n_tokens long, score double, base double, known long, tail array<bigint>, times array<int>, nodes array<bigint>, node_times array<int>"


def language_scores(docs: DataFrame, learn) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of documents(doc_id, text), trained where ``learn`` holds."""
    spark = bounded(docs).sparkSession
    words, logs = train(docs, learn)
    row = words.agg(F.sum("n"), F.count("*")).first()
    n, v = row[0] or 0, row[1]
    head = words.where(F.col("n") * F.lit(1 << HEAD_BITS) >= F.lit(n)).toArrow()
    keys, times = head.column("key").to_numpy().astype(np.int64).view(np.uint64), head.column("n").to_numpy()
    at = np.argsort(keys)
    keys, times = keys[at], times[at]
    ends = words.where(F.col("key") == F.lit(int(END_KEY.view(np.int64)))).first()
    ends = ends["n"] if ends else 0
    bar = _bar(logs, HEAD_NODES)
    sent = logs.where(F.col("n") >= F.lit(bar)).toArrow().sort_by("key")
    sc = spark.sparkContext
    nodes = (sent.column("key").to_numpy().view(np.uint64), sent.column("log").to_numpy(), np.argsort(sent.column("n").to_numpy(), kind="stable").astype(np.int32))
    run = _scored(sc.broadcast(nodes), sc.broadcast(keys), sc.broadcast(np.log10(times + 1.0)))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    scored = table(rows.mapInArrow(frugal(run), SCORED), "ppm-scored")
    tails = lambda kind, keys, times: scored.select("rid", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("t")).select(
        "rid", F.lit(kind).alias("kind"), "t.key", "t.times"
    )
    rare = tails(0, "tail", "times").unionAll(tails(1, "nodes", "node_times"))
    values = words.where(F.col("n") * F.lit(1 << HEAD_BITS) < F.lit(n)).select(F.lit(0).alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("value"))
    values = values.unionAll(logs.where(F.col("n") < F.lit(bar)).select(F.lit(1).alias("kind"), "key", F.col("log").alias("value")))
    word = F.col("kind") == 0
    met = rare.join(values, ["kind", "key"]).groupBy("rid").agg(
        F.sum(F.when(word, F.col("times") * F.col("value"))).alias("more"), F.sum(F.when(word, F.col("times"))).alias("more_known"),
        F.sum(F.when(~word, F.col("times") * F.col("value"))).alias("more_score"),
    )
    all_ = scored.select("rid", "doc_id", "n_tokens", "score", "base", "known").join(met, "rid", "left")
    return all_.select(
        "doc_id", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = remainder(F.col("doc_id"), 7) == 2
    out = language_scores(docs, ~held)
    return out.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
