"""Operators on inputs above the sizes at which they once left something out."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mensura.llm import licenses, ppm, quality_ranker, tokens, toxicity
from mensura.llm._text import slices

LARGE = "/root/testdata/sf0.1"


def test_ppm_keeps_rare_nodes_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(ppm, "HEAD_NODES", 20_000, raising=False)  # so that most nodes are joined
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").where("doc_id < 2600")
    frame = docs.select("doc_id", "text").toPandas()
    learn = frame.doc_id.to_numpy() % 7 != 2
    keys = []
    for text in frame.text:
        out, begin, _ = ppm.stream(next(iter(slices(pa.array([text], pa.string())))))
        keys.append(ppm.grams(out, begin)[0])
    all_ = np.concatenate([k for k, f in zip(keys, learn) if f])
    assert len(all_) > 1 << 22
    trie = ppm.Trie([np.unique(all_ & np.uint64(256 ** (j + 1) - 1), return_counts=True) for j in range(ppm.ORDER + 1)])
    got = {r["doc_id"]: r["score"] for r in ppm.language_scores(docs, F.col("doc_id") % 7 != 2).collect()}
    assert len(got) == len(frame)
    for i, k in zip(frame.doc_id, keys):
        assert got[i] == pytest.approx(trie.score(k).sum())


@pytest.mark.parametrize("few", [10_000, 3])
def test_quality_threshold_is_of_all_labels(spark, monkeypatch, few):
    monkeypatch.setattr(quality_ranker, "FEW", few, raising=False)
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = docs.selectExpr("doc_id", "int(pmod(xxhash64(doc_id), 3) > 0) AS quality")  # scores of good and bad overlap
    model = quality_ranker.train(docs, labels, F.col("doc_id") % 5 != 0, {0: 20, 1: 20})
    got = quality_ranker.score(docs, model).join(labels, "doc_id").where("doc_id % 5 <> 0").toPandas()
    bad = int((got.quality == 0).sum())
    assert len(got) > 100 and bad > 20
    ordered = np.sort(got.score)
    assert ordered[bad - 1] - 1e-9 <= quality_ranker.CUT_SCORE <= ordered[bad] + 1e-9


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_single_word_edits_of_templates_are_found(name):
    words = licenses.TEMPLATES[name].split()
    size = len(words)
    texts, least = [], []
    for i in range(size):
        texts += [words[:i] + ["zzz"] + words[i + 1 :], words[:i] + words[i + 1 :], words[:i] + ["zzz"] + words[i:]]
        least += [size - 1, size - 1, size]
    texts = ["qqq www " + " ".join(t) + " eee" for t in texts]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    rows = [r for b in licenses._scan(licenses.TEMPLATES, licenses.COVERAGE)(iter([batch])) for r in b.to_pylist()]
    for i, n in enumerate(least):
        if n >= licenses.COVERAGE * size:
            assert any(r["doc_id"] == i and (r["license"] == name or r["matched_words"] >= n) for r in rows), texts[i]


@pytest.mark.parametrize("marks", [*range(0, 12), 40, 5000])
def test_marks_around_words_hide_nothing(marks):
    fence, notice = "#" * marks, "All rights reserved."
    header = licenses.TEMPLATES["gpl-header"].split()
    lines = "\n".join(f" {'*' * max(marks, 1)} {' '.join(header[i : i + 6])}" for i in range(0, len(header), 6))
    batch = pa.record_batch({"doc_id": pa.array([0, 1, 2]), "text": pa.array([f"{fence}{notice}{fence}", lines, f"{fence} {fence}"])})
    rows = [r for b in licenses._scan(licenses.TEMPLATES, licenses.COVERAGE)(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["license"], r["coverage"]) for r in rows] == [(0, "all-rights-reserved", 1.0), (1, "gpl-header", 1.0)]
    data, _, _, begin, end, _, _ = toxicity._tokens(next(iter(slices(pa.array([f"{fence}grobnik{fence} {fence} a.b"])))))
    assert [data[a:b].tobytes() for a, b in zip(begin, end)] == [b"grobnik", *([b""] if marks else []), b"a.b"]


def alignment(text, template):
    """Words matched of the best local alignment, over all cells."""
    best, score = 0, [(0, 0)] * (len(text) + 1)
    for word in template:
        row = [(0, 0)]
        for j, other in enumerate(text):
            same = int(word == other)
            row.append(max((0, 0), (score[j][0] + (2 if same else -1), score[j][1] + same), (score[j + 1][0] - 1, score[j + 1][1]), (row[-1][0] - 1, row[-1][1])))
        best, score = max(best, max(row)[1]), row
    return best


def test_recall_of_templates_with_several_edits():
    r = random.Random(3)
    index, texts, wanted = licenses.Index(), [], []
    for name, words in zip(index.names, index.words):
        plain = licenses.TEMPLATES[name].split()
        for share in (0.05, 0.1, 0.2):
            for _ in range(6):
                out = []
                for w in plain:
                    roll = r.random()
                    out += [w] if roll >= share else r.choice([["zzz"], [], [w, "yyy"]])
                texts.append(" ".join(["qqq", *out, "eee"]))
                local = licenses.bare_words(next(iter(slices(pa.array([texts[-1]])))))[2]
                if alignment(local.tolist(), words.tolist()) >= licenses.COVERAGE * len(words):
                    wanted.append((len(texts) - 1, name))
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    found = {r["doc_id"] for b in licenses._scan(licenses.TEMPLATES, licenses.COVERAGE)(iter([batch])) for r in b.to_pylist()}
    assert len(wanted) > 200 and sum(i in found for i, _ in wanted) >= 0.97 * len(wanted)


def test_words_of_a_slice_beyond_the_cache(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    encoder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in (" ".join(f"alpha{i}" for i in range(40)), " ".join(f"alpha{i}" for i in range(120)), "alpha3 beta7"):
        ids, at = encoder.encode(next(iter(slices(pa.array([text])))))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids and at.tolist() == [0, len(ids)]
