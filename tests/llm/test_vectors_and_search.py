"""Clustering and near-duplicates of vectors, and ranked search, against plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from mensura.llm import ball_kmeans, lexical, pivots, registry
from mensura.llm._text import slices

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def lloyd(rows, k, rounds, scale, seed=2):
    """(id, cluster, distance), inertia by cluster and the last centroids of (id, vector) rows."""
    vectors = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    seeds = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)[:k]
    centroids = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in vectors]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(vectors, of) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in vectors]
    inertia = Counter()
    for _, j, d in out:
        inertia[j] += d
    return out, inertia, centroids


@pytest.mark.parametrize("spread,k,rounds", [(1.0, 6, 5), (0.02, 9, 3), (40.0, 3, 2), (1.0, 400, 1)])
def test_clusters_are_those_of_comparing_all(spark, spread, k, rounds):
    r = np.random.default_rng(k)
    middles = r.normal(size=(5, 3)) * spread
    rows = [(i, (middles[i % 5] + r.normal(size=3) * spread / 8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(i, rows[i - 200][1]) for i in range(200, 230)] + [(7, [0.0, 0.0, 0.0]), (7, [-0.0, 0.5, 0.25]), (None, [1.0, 1.0, 1.0])]
    odd = [(300, None), (301, [1.0, 2.0]), (302, [1.0, None, 2.0]), (303, [float("nan"), 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0]), (305, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    got = ball_kmeans.clusters(table, k, rounds, 3, 256).collect()
    want, inertia, centroids = lloyd(rows, k, rounds, 256)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == sorted(want, key=repr)
    assert {(r["cluster"], r["cluster_inertia"], r["inertia"]) for r in got} == {(j, d, sum(inertia.values())) for j, d in inertia.items()}
    names = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(centroids)}
    assert all(r["centroid_sha256"] == names[r["cluster"]] for r in got)


@pytest.mark.parametrize("seed", range(8))
def test_balls_leave_out_only_what_is_farther(seed):
    r = np.random.default_rng(seed)
    centroids = r.integers(-40, 40, size=(12, 4)) * (1 if seed % 2 else 8)
    centroids[3] = centroids[5]  # ties between equal centroids go to the smaller number
    x = centroids[r.integers(0, 12, 500)] + r.integers(-9, 10, size=(500, 4))
    cluster = r.integers(0, 12, 500)
    radii = np.array([np.sqrt(ball_kmeans.squared(x[cluster == i], centroids[i]).max(initial=0)) for i in range(12)])
    all_ = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    for balls in (ball_kmeans.Balls(centroids), ball_kmeans.Balls(centroids, radii)):
        found, distance, _ = balls.nearest(x, cluster)
        assert (found == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()
    settled = all_.argmin(axis=1)
    _, _, compared = ball_kmeans.Balls(centroids).nearest(x, settled)
    assert compared < 500 * 11 / 2


def test_huge_components_are_held_to_the_range(spark):
    rows = [(i, [x, 0.0]) for i, x in enumerate([3e38, -3e38, 1.0, 2.0])]
    got = ball_kmeans.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2, 1, 2, 256).collect()
    assert len(got) == 4 and all(r["distance"] >= 0 for r in got)


def linked(rows, cosine=0.93):
    """Links and least id reachable of each row (id, vector, label), by comparing all rows."""
    ok = [i is not None and y is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, y in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if fine else None for fine, (_, v, _) in zip(ok, rows)]
    near = lambda a, b: rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine
    live = [i for i in range(len(rows)) if ok[i]]
    links = {a: [b for b in live if a != b and near(a, b)] for a in live}
    least = {a: rows[a][0] for a in live}
    while True:
        before = dict(least)
        for a in live:
            least[a] = min([least[a], *(least[b] for b in links[a]), *(least[b] for b in live if rows[b][0] == rows[a][0])])
        if before == least:
            break
    return [(rows[i][0], len(links.get(i, [])), least.get(i, rows[i][0]), rows[i][0] == least.get(i, rows[i][0])) for i in range(len(rows))]


def planted(seed, n=150, dims=12):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = middles[i % 6] + r.normal(size=dims) * (0.02, 0.1, 0.3)[i % 3] if i % 2 else r.normal(size=dims)
        rows.append((int(i * 3 + seed), v.astype(np.float32).tolist(), i % 7 % 3))
    rows += [(900 + i, rows[5][1], rows[5][2]) for i in range(40)] + [(950, [2 * x for x in rows[5][1]], rows[5][2]), (950, rows[8][1], rows[8][2])]
    nan = float("nan")
    rows += [(960, None, 1), (961, [], 1), (962, [0.0] * dims, 1), (963, [nan] * dims, 1), (964, [None] * dims, 1), (965, rows[5][1], None), (None, rows[5][1], rows[5][2])]
    return rows + [(966, [1.0, 2.0], 1), (967, [1.0, 2.001], 1), (968, [-1.0, 2.0], 1)]


@pytest.mark.parametrize("seed,split,block", [(0, 2048, 256), (1, 4, 3), (2, 10, 1000), (3, 1, 1)])
def test_near_vectors_are_those_of_comparing_all(spark, monkeypatch, seed, split, block):
    monkeypatch.setattr(pivots, "SPLIT", split)
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows = planted(seed)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = pivots.near_vectors(table, points=40).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(linked(rows), key=repr)


def test_one_long_list_and_few_points(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    r = np.random.default_rng(5)
    rows = [(i, (np.ones(8) + r.normal(size=8) * 0.2).tolist(), 0) for i in range(90)]  # one reference point describes them all
    got = pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    rows = [(i, np.array(v, np.float32).tolist(), y) for i, v, y in rows]
    assert sorted(tuple(r) for r in got) == sorted(linked(rows))


def test_recall_of_shared_points():
    r = np.random.default_rng(1)
    points = pivots.reference_points(r.normal(size=(4096, 64)))
    assert len(points) == pivots.POINTS
    one = pivots._unit(r.normal(size=(5000, 64)))
    way = r.normal(size=one.shape)
    way = pivots._unit(way - (way * one).sum(axis=1, keepdims=True) * one)
    c = r.uniform(0.93, 0.94, (5000, 1))
    a, b = pivots.described(one, points), pivots.described(c * one + np.sqrt(1 - c * c) * way, points)
    shared = np.array([len(np.intersect1d(x, y)) for x, y in zip(a, b)])
    assert (shared >= pivots.SHARED).mean() > 0.998
    apart = np.array([len(np.intersect1d(x, y)) for x, y in zip(a, a[::-1])])
    assert (apart >= pivots.SHARED).mean() < 0.02  # few candidates that aren't near


def test_recall_on_a_large_table_with_planted_copies(spark):
    d = pd.read_parquet(f"{LARGE}/embeddings.parquet")
    r = np.random.default_rng(4)
    x = pivots._unit(np.array(d.embedding.tolist(), np.float64))
    source = np.concatenate([np.arange(0, len(x), 2), np.zeros(600, int)])  # and one large group
    way = r.normal(size=(len(source), x.shape[1]))
    way = pivots._unit(way - (way * x[source]).sum(axis=1, keepdims=True) * x[source])
    c = r.uniform(0.93, 0.99, (len(source), 1))
    copies = c * x[source] + np.sqrt(1 - c * c) * way
    vectors = np.vstack([x, copies]).astype(np.float32)
    labels = np.concatenate([d.label, d.label.to_numpy()[source]])
    table = pd.DataFrame({"vec_id": np.arange(len(vectors)), "embedding": vectors.tolist(), "label": labels.astype(int)})
    unit, links = pivots._unit(vectors.astype(np.float64)), np.zeros(len(vectors), int)
    for y in np.unique(labels):
        rows = np.flatnonzero(labels == y)
        links[rows] = (unit[rows] @ unit[rows].T >= 0.93).sum(axis=1) - 1
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").repartition(8)
    got = {x["vec_id"]: x["n_links"] for x in pivots.near_vectors(frame).collect()}
    found = np.array([got[i] for i in range(len(vectors))])
    assert links.sum() > 2000 and (found <= links).all() and found.sum() >= 0.995 * links.sum()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    texts = [(i, Counter(terms(t))) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n_all, l_all = len(texts), sum(sum(t.values()) for _, t in texts)
    df = Counter(w for _, t in texts for w in t)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, t in texts:
            m = 10 + (90 * sum(t.values()) * n_all) // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * ((10**9 * t[w]) // (1000 * t[w] + 8 * m)) for w in words if w in t)
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


ITEMS = [(1, "the quick Brown fox"), (2, None), (3, ""), (4, "nothing-of-this qqq"), (5, "the THE the"), (None, "river stone"), (6, "river stone"), (6, "é ü path"), (7, "xxx0 " + "x" * 5000)]


@pytest.mark.parametrize("pairs,merge", [(1_000_000, 64), (4, 1)])
def test_ranked_search_is_that_of_scoring_all(spark, monkeypatch, odd_rows, pairs, merge):
    monkeypatch.setattr(lexical, "MERGE", merge)
    rows = [(r[0], r[1]) for r in odd_rows] + [(20 + i, "river " * (i % 4) + "stone and the é" + " wind" * (i % 7)) for i in range(60)] + [(None, "river stone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.top_documents(docs, items, 7, pairs).collect()
    assert sorted(tuple(r) for r in got) == ranked(rows, ITEMS, 7)


def test_documents_below_the_bar_are_not_scored_again(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    words = lexical.Vocabulary(sorted({w for t in d.text.head(3) for w in terms(t)}))
    batch = pa.record_batch({"doc_id": pa.array(d.doc_id), "text": pa.array(d.text, pa.string())})
    rows = [r for b in lexical._index(words)(iter([batch])) for r in b.to_pylist()]
    n, total = sum(r["n"] for r in rows), sum(r["total"] for r in rows)
    df = Counter()
    for r in rows:
        df.update(dict(zip(r["terms"], r["dfs"])))
    weights = np.array([lexical.weight(n, df[t]) for t in range(len(words.number))], np.int64)
    shard = lexical.Shard(rows[0], weights, n, total)
    byte = lexical.rounded_up(lexical.impacts(shard.tf, shard.m[shard.docs])).astype(np.int64)
    exact = lexical.impacts(shard.tf, shard.m[shard.docs])
    assert (byte * lexical.WHOLE >= exact * lexical.STEPS).all() and ((byte - 1) * lexical.WHOLE < exact * lexical.STEPS).all()
    scored, plain = [], lexical.impacts
    asked = np.array([words.number[w] for w in set(terms(d.text[0]))], np.int64)
    lexical.impacts = lambda tf, m: scored.append(len(tf)) or plain(tf, m)
    try:
        shard.search(asked, np.zeros(0, np.int64), np.zeros(0, np.int64), 3)
    finally:
        lexical.impacts = plain
    postings = sum(int(shard.ends[s] - shard.begins[s]) for s in shard.slot[asked])
    assert 0 < sum(scored) < postings / 2


def test_terms_are_compared_by_their_bytes(monkeypatch):
    plain = lexical.hash_words
    words = ["alpha", "beta", "a long word of terms".replace(" ", ""), "alongwordofstems"]
    vocabulary = lexical.Vocabulary(words[:3])
    monkeypatch.setattr(lexical, "hash_words", lambda data, s, e: np.full(len(s), plain(np.frombuffer(words[2].encode(), np.uint8), np.array([0]), np.array([len(words[2])]))[0]))
    s = next(iter(slices(pa.array([" ".join([words[2], "alongwordoftermz", words[2][:-1], words[3]])]))))
    starts, ends, _ = s.words()
    assert vocabulary.find(s.data, starts, ends).tolist() == [vocabulary.number[words[2]], -1, -1, -1]
