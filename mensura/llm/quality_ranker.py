"""Quality by Bradley-Terry ranking.

A document's worth is linear in its features; document i is preferred to j with
probability sigmoid(worth_i - worth_j). The weights are learned from preference
pairs (a document labelled good against one labelled bad) by logistic loss on
feature differences, on a bounded sample of labelled rows. The threshold is the
exact quantile of the worths of all labelled rows that may be learned from, below
which as many documents lie as are labelled bad; worths are mapped so that it has
score 0.3.

Defined results: a null or empty text has all features zero and gets a score like
any other; very long texts are used whole; equal rows get equal scores; without
labels of both kinds every score is 0.5; an empty table gives an empty result;
rows without an id are scored and teach nothing, and count as not held out; rows
that share an id are scored each by its text, and that with the least text stands
for the id's label; ids whose labels contradict one another teach nothing; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm._store import bounded, frugal, table
from mensura.llm._text import LOWER, Slice, hash_words, slices
from mensura.llm.labelled import SAMPLE_ROWS, remainder, sample, usable

PAIRS = 60_000
RIDGE = 1e-3
CUT_SCORE = 0.3
FEATURE_SLICE = 1 << 20
BINS, FEW = 4096, 10_000
# classes of bytes: each ASCII punctuation mark its own, then capitals, digits, white space, newline, non-ASCII, letters
_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(_PUNCT):
    CLASS[_c] = _i + 1
CLASS[65:91], CLASS[48:58], CLASS[32], CLASS[10], CLASS[128:] = 33, 34, 35, 36, 37
N_CLASS = 38
N_FEATURES = 2 * N_CLASS + 10


def features(s: Slice) -> np.ndarray:
    """A row of bounded numbers for each text of a slice."""
    n = len(s)
    data = s.data
    doc = np.repeat(np.arange(n), np.diff(s.offsets))
    counts = np.bincount(doc * N_CLASS + CLASS[data], minlength=n * N_CLASS).reshape(n, N_CLASS)
    starts, ends, first = s.words()
    size = np.diff(first)
    words = np.maximum(size, 1)[:, None]
    of = np.repeat(np.arange(n), size)
    lengths = (ends - starts).astype(float)
    hashes = hash_words(LOWER[data], starts, ends)
    key = (of.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    key.sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(key)))
    kind = (key[at] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, kind, times)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    mean = np.bincount(of, lengths, n) / words[:, 0]
    last = data[ends - 1] if len(ends) else data
    stop = np.isin(last, np.frombuffer(b".!?,;:", np.uint8))
    extra = np.stack([
        np.log1p(size), np.minimum(mean, 40) / 10, np.sqrt(np.maximum(np.bincount(of, lengths**2, n) / words[:, 0] - mean**2, 0)).clip(0, 40) / 10,
        np.bincount(kind, minlength=n) / words[:, 0], most / words[:, 0], np.bincount(of, again, n) / words[:, 0],
        np.bincount(of, lengths <= 3, n) / words[:, 0], np.bincount(of, lengths > 20, n) / words[:, 0], np.bincount(of, stop, n) / words[:, 0],
        (size == 0).astype(float),
    ], axis=1)
    rate = counts / words
    return np.concatenate([np.minimum(rate, 4.0), counts > 0, extra], axis=1)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """Weights by logistic loss on differences of pairs (good, bad)."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = 1.0
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(seed)
    d = z[draw.choice(good, PAIRS)] - z[draw.choice(bad, PAIRS)]
    w = np.zeros(z.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / PAIRS + RIDGE * np.eye(len(w)), d.T @ p / PAIRS - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "w": w}


def worths(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["scale"], -6, 6) @ model["w"]


def nth(values: DataFrame, k: int) -> float:
    """The ``k``-th least (from 1) of the column ``v``, exactly: bins are counted, and the one that holds it is cut again."""
    row = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")).first()
    while row["low"] < row["high"] and row["n"] > FEW:
        inside = values.where(F.col("v").between(row["low"], row["high"]))
        bin_ = F.floor((F.col("v") - F.lit(row["low"])) / F.lit(row["high"] - row["low"]) * BINS)
        for r in sorted(inside.groupBy(bin_.alias("bin")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")).collect(), key=lambda r: r["bin"]):
            row = r
            if k <= r["n"]:
                break
            k -= r["n"]
    if row["low"] == row["high"]:
        return row["low"]
    found = values.where(F.col("v").between(row["low"], row["high"])).toArrow().column("v").to_numpy()
    return float(np.sort(found)[k - 1])


def threshold(values: DataFrame, share: float) -> float:
    """The quantile of the column ``v`` at ``share``, in the middle of the gap."""
    n = values.count()
    k = min(max(int(np.ceil(share * n - 1e-9)), 1), n - 1)
    if k < 1:
        return nth(values, 1)
    low = nth(values, k)
    up_to, above = values.agg(F.count_if(F.col("v") <= F.lit(low)), F.min(F.when(F.col("v") > F.lit(low), F.col("v")))).first()
    return (low + (low if up_to > k else above)) / 2


def scores(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(worths(model, x) - model["cut"] + np.log(CUT_SCORE / (1 - CUT_SCORE)), -30, 30)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch.column("text"), FEATURE_SLICE):
            x = features(s)
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), pa.array(x.ravel()))
            yield pa.record_batch({"doc_id": batch.column("doc_id").slice(s.rows.start, len(s)), "y": batch.column("y").slice(s.rows.start, len(s)), "x": flat})


def train(docs: DataFrame, labels: DataFrame, learn, rows: dict[int, int] = SAMPLE_ROWS) -> dict | None:
    """The model of the labels for which the column ``learn`` holds; None without both kinds.

    Weights come from a bounded sample of them, the threshold from all.
    """
    shares = usable(labels, "quality", learn).agg(F.avg(1 - F.col("y"))).first()[0]
    some = sample(docs, labels, "quality", learn, rows).mapInArrow(frugal(_featured), "doc_id long, y int, x array<double>").toArrow()
    some = some.sort_by([("doc_id", "ascending")])
    y = some.column("y").to_numpy()
    if not 0 < y.sum() < len(y):
        return None
    model = fit(np.array(some.column("x").combine_chunks().flatten()).reshape(-1, N_FEATURES), y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text"), FEATURE_SLICE):
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(s.rows.start, len(s)), "v": pa.array(worths(model, features(s)))})

    ids = usable(labels, "quality", learn).select("doc_id")
    mine = bounded(docs).select("doc_id", "text").where(learn).mapInArrow(frugal(run), "doc_id long, v double")
    return model | {"cut": threshold(table(mine.join(ids, "doc_id", "left_semi").select("v"), "quality-worths"), float(shares))}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score of every row of documents(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text"), FEATURE_SLICE):
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(s.rows.start, len(s)), "score": pa.array(scores(model, features(s)))})

    return bounded(docs).select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, score double")


def kept(docs: DataFrame, model: dict | None, at_least: float = CUT_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least that much; nothing is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [scores(model, features(s)) >= at_least for s in slices(batch.column("text"), FEATURE_SLICE)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return bounded(docs).mapInArrow(frugal(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted")
    )
