"""Toxicity by multiple-instance learning.

Only documents are labelled, but what makes them toxic are single sentences. A
sentence's probability is logistic in its words and word beginnings; a document's
is the noisy-or of its sentences. The weights are trained from document labels by
the gradient of the noisy-or likelihood on a bounded sample, and the sentences
that carry a document's score are located afterwards.

Defined results: a null or empty text has no sentence and the score 0; very long
texts are used whole; equal rows get equal scores; without labels of both kinds
every score is 0; an empty table gives an empty result; rows without an id are
scored and teach nothing; rows that share an id are scored each by its text, and
that with the least text stands for the id's label; ids whose labels contradict one
another teach nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm._store import bounded, frugal, table
from mensura.llm._text import LOWER, Slice, bare, hash_words, mix, slices
from mensura.llm.labelled import remainder, sample

SAMPLE = {0: 9_000, 1: 4_000}
PREFIXES = (4, 5, 6, 7)
LEAST_DOCS = 3
EPOCHS, RATE, DECAY, MOST_BIAS = 150, 0.15, 1e-5, -5.0
CUT_SCORE = 0.3
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


def _tokens(s: Slice):
    """Starts and ends of words without outer punctuation, their hashes, and each one's document and sentence."""
    data = LOWER[s.data]
    starts, ends, first = s.words(data)
    doc = np.repeat(np.arange(len(s)), np.diff(first))
    # a sentence begins with a text, and after a word that ends in a stop or is followed by a line break
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    turn = np.ones(len(starts), bool)
    turn[1:] = (doc[1:] != doc[:-1]) | (stops[starts[1:]] != stops[starts[:-1]])
    sentence = np.cumsum(turn) - 1
    begin, end = bare(data, starts, ends, _PUNCT)
    return data, starts, ends, begin, end, doc, sentence


def _kinds(data, begin, end) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct words of a slice: hashes of each word's features, and each word's place among the distinct ones."""
    hashes, index, back = np.unique(hash_words(data, begin, end), return_index=True, return_inverse=True)
    b, e = begin[index], end[index]
    parts = [hashes]
    for k in PREFIXES:
        part = mix(hash_words(data, b, np.minimum(e, b + k)) + np.uint64(k))
        part[e - b <= k] = np.uint64(0)
        parts.append(part)
    return hashes, parts, back


COUNTS = "feature long, plain long, toxic long"
EXAMPLES = "doc_id long, y int, n int, sentences array<int>, features array<int>"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many plain and how many toxic texts of a slice hold each feature."""
    for batch in batches:
        y = batch.column("y").to_numpy()
        for s in slices(batch.column("text")):
            data, _, _, begin, end, doc, _ = _tokens(s)
            _, parts, back = _kinds(data, begin, end)
            f, d = np.concatenate([p[back] for p in parts]), np.tile(doc, len(parts))
            some = np.flatnonzero(f)
            order = some[np.lexsort((d[some], f[some]))]
            f, d = f[order], d[order]
            once = np.ones(len(f), bool)
            once[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
            keys, back = np.unique(f[once], return_inverse=True)
            toxic = np.bincount(back, y[s.rows.start + d[once]], len(keys)).astype(np.int64)
            yield pa.record_batch({"feature": pa.array(keys.view(np.int64)), "plain": pa.array(np.bincount(back, minlength=len(keys)) - toxic), "toxic": pa.array(toxic)})


def _examples(known: np.ndarray):
    """Each text's number of sentences, and its sentences' distinct known features as (sentence, place among the known), in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                data, _, _, begin, end, doc, sentence = _tokens(s)
                at, f = _met(known, data, begin, end, sentence)
                firsts = np.flatnonzero(np.diff(sentence, prepend=-1))
                n = np.bincount(doc[firsts], minlength=len(s))
                before = np.concatenate([[0], np.cumsum(n)])
                owner = doc[firsts][at] if len(at) else at
                cuts = pa.array(np.searchsorted(owner, np.arange(len(s) + 1)), pa.int32())
                yield pa.record_batch({
                    **{c: batch.column(c).slice(s.rows.start, len(s)) for c in ("doc_id", "y")}, "n": pa.array(n, pa.int32()),
                    "sentences": pa.ListArray.from_arrays(cuts, pa.array(at - before[owner], pa.int32())), "features": pa.ListArray.from_arrays(cuts, pa.array(f, pa.int32())),
                })

    return run


def _met(known: np.ndarray, data, begin, end, sentence) -> tuple[np.ndarray, np.ndarray]:
    """The known features of a slice's sentences, each once in a sentence: (sentence, place among the known), by sentence."""
    _, parts, back = _kinds(data, begin, end)
    size, met = len(known), [np.zeros(0, np.int64)]
    for part in parts:
        at = np.minimum(np.searchsorted(known, part), size - 1)
        at = np.where(known[at] == part, at, -1)[back]
        hit = np.flatnonzero(at >= 0)
        met.append(sentence[hit] * size + at[hit])
    both = np.unique(np.concatenate(met))
    return both // size, both % size


def _telling(keys: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    """Features (with their plain and toxic texts) that occur in toxic documents more often than chance explains, among all the features tried."""
    total = counts.sum(axis=1)
    safe = lambda a, e: np.where(a > 0, a * np.log(np.maximum(a, 1) / e), 0.0)
    gain = 2 * (safe(counts[:, 1], total * share) + safe(counts[:, 0], total * (1 - share)))
    return np.sort(keys[(counts[:, 1] > total * share) & (gain > 2 * np.log(max(len(keys), 2)) - 6)])


def loss(w: np.ndarray, bias: float, feature, of_sentence, of_doc, y):
    """Mean negative log-likelihood of document labels under the noisy-or of sentences, and its gradient by weights and bias."""
    p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(of_sentence, w[feature], len(of_doc)), -30, 30)))
    none = np.bincount(of_doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))  # log of no toxic sentence
    any_ = np.maximum(-np.expm1(none), 1e-9)
    pull = np.where(y == 1, -(1 - any_) / any_, 1.0)
    g = pull[of_doc] * p / len(y)
    return -np.where(y == 1, np.log(any_), none).mean(), np.bincount(feature, g[of_sentence], len(w)), float(g.sum())


def fit(examples: pa.Table, known: np.ndarray) -> dict:
    """Weights of known features and the bias from rows of EXAMPLES."""
    y = examples.column("y").to_numpy()
    n = examples.column("n").to_numpy().astype(np.int64)
    lists = examples.column("features").combine_chunks()
    doc = np.repeat(np.arange(len(y)), np.diff(np.asarray(lists.offsets)))
    feature, of_doc = np.asarray(lists.flatten()), np.repeat(np.arange(len(y)), n)
    of_sentence = np.asarray(examples.column("sentences").combine_chunks().flatten()).astype(np.int64) + (np.cumsum(n) - n)[doc]
    w, bias = np.zeros(len(known)), -6.0
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        _, gw, gb = loss(w, bias, feature, of_sentence, of_doc, y)
        gw = gw + DECAY * w
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw**2
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w = w - RATE * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-8)
        bias = min(bias - 0.3 * RATE * (b1 / fix1) / (np.sqrt(b2 / fix2) + 1e-8), MOST_BIAS)
    return {"keys": known, "w": w, "bias": bias}


def sentence_scores(model: dict | None, s: Slice):
    """For each text its score, and for each sentence its document, byte span in the text and probability."""
    n = len(s)
    data, starts, ends, begin, end, doc, sentence = _tokens(s)
    if model is None or not len(starts):
        return np.zeros(n), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    at, f = _met(model["keys"], data, begin, end, sentence)
    z = model["bias"] + np.bincount(at, model["w"][f], int(sentence[-1]) + 1)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    firsts = np.flatnonzero(np.diff(sentence, prepend=-1))
    lasts = np.append(firsts[1:], len(sentence)) - 1
    owner = doc[firsts]
    none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), n)
    return -np.expm1(none), owner, starts[firsts] - s.offsets[owner], ends[lasts] - s.offsets[owner], p


def train(docs: DataFrame, labels: DataFrame, learn, rows: dict[int, int] = SAMPLE) -> dict | None:
    """The model from a bounded sample of the labels for which the column ``learn`` holds.

    Features are counted where the texts are; what is gathered are the counts of
    those that several toxic documents hold, and then the sentences' places of the
    telling ones.
    """
    some = table(bounded(sample(docs, labels, "toxic", learn, rows)), "toxicity-sample")
    shares = some.agg(F.avg("y").alias("share")).first()["share"]
    if not 0 < (shares or 0) < 1:
        return None
    counts = some.mapInArrow(frugal(_counts), COUNTS).groupBy("feature").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))
    got = counts.where(F.col("toxic") >= LEAST_DOCS).toArrow()
    known = _telling(got.column("feature").to_numpy().view(np.uint64), np.stack([got.column(c).to_numpy() for c in ("plain", "toxic")], axis=1), shares)
    if not len(known):
        return None
    return fit(some.mapInArrow(frugal(_examples(known)), EXAMPLES).toArrow().sort_by([("doc_id", "ascending")]), known)


SCORED = "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: dict | None, at_least: float = CUT_SCORE) -> DataFrame:
    """doc_id, score, and ``offending``: byte spans in the text of the sentences with at least that probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                value, owner, start, end, p = sentence_scores(model, s)
                bad = np.flatnonzero(p >= at_least)
                count = np.bincount(owner[bad], minlength=len(s)) if len(bad) else np.zeros(len(s), int)
                spans = pa.StructArray.from_arrays([pa.array(start[bad], pa.int32()), pa.array(end[bad], pa.int32()), pa.array(p[bad], pa.float64())], ["start", "end", "score"])
                at = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(s.rows.start, len(s)), "score": pa.array(value), "offending": pa.ListArray.from_arrays(at, spans),
                })

    return bounded(docs).select("doc_id", "text").mapInArrow(frugal(run), SCORED)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    return score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"), F.size("offending").alias("n_offending"),
    )
