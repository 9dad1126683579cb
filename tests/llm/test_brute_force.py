"""Operators that SQL can't express, against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from mensura.llm import _store, graph, licenses, maxscore, minhash, packing, ppm, quality_ranker, registry, source_mix, suffix_dedup, toxicity
from mensura.llm._text import hash_words, shingles, slices
from mensura.llm.interleave import classes, merge

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(folder=SF):
    return pd.read_parquet(f"{folder}/documents.parquet")


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t.\x1cZ", max_size=60)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    found = []
    for s in slices(pa.array(texts, pa.string()), most=40):
        starts, ends, first = s.words()
        raw = s.data.tobytes()
        found += [[raw[starts[k] : ends[k]].decode() for k in range(first[i], first[i + 1])] for i in range(len(s))]
    assert found == [SPACE.findall(t or "") for t in texts]


def test_shingles_by_sequence():
    texts = ["a b c d e f", "b c d e f", "a b", "", "a b c d e", "a b c d e f a b c d e"]
    s = next(iter(slices(pa.array(texts))))
    starts, ends, first = s.words()
    values, at = shingles(hash_words(s.data, starts, ends), first)
    sets = [set(values[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    assert [len(x) for x in sets] == [2, 1, 1, 0, 1, 6]
    assert sets[1] < sets[0] and sets[4] < sets[0] and not sets[2] & sets[0]


def brute_dedup(rows):
    """(id, text) in order: what stays, bytes removed and spans."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def dedup_check(spark, pairs, folder):
    spark.createDataFrame(pairs, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.query(spark, str(folder)).collect()}
    assert [got[i] for i, _ in pairs] == brute_dedup(pairs)


def test_suffix_dedup_on_the_table(spark):
    d = documents().sort_values("doc_id")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.query(spark, SF).collect()}
    assert [got[i] for i in d.doc_id] == brute_dedup(list(zip(d.doc_id, d.text)))


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_on_hard_rows(spark, tmp_path, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    pairs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 40)))]
        for _ in range(r.randint(0, 3)):
            a = r.randint(0, 120)
            parts += [passage[a : a + r.choice([90, 99, 100, 101, 150, 300])], word()]
        pairs.append((i * 2 + seed, " ".join(parts)))
    pairs += [(500, "z" * 700), (501, "z" * 99), (502, "z" * 100), (503, "ab" * 200), (504, None), (505, ""), (506, pairs[3][1]), (507, "é" * 120), (508, "xé" * 130)]
    dedup_check(spark, pairs, tmp_path)


@pytest.mark.parametrize("kinds,held,chunk,few,most", [(0, 64, 50, 0, 9), (1, 200, 10, 3, 1), (2, 1 << 18, 1 << 14, 4, 4096), (10**6, 100, 10**6, 10**6, 5), (10**6, 100, 5, 1, 10**6)])
def test_suffix_dedup_of_crowded_marks(spark, kinds, held, chunk, few, most):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefghij ") for _ in range(260))
    line = "".join(r.choice("vwxyz ") for _ in range(95))
    noise = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    pairs = [(i, noise("kl", 150) + passage + noise("qrs", r.randint(0, 150)) + noise("kl", 3) + line + noise("qr", 3) + noise("mn", 90)) for i in range(60)]
    docs = spark.createDataFrame(pairs, "doc long, text string").repartition(3)
    got = {x["doc"]: (x["n_removed"], x["n_spans"]) for x in suffix_dedup.repeated_parts(docs, held=held, kinds=kinds, chunk=chunk, few=few, most=most).collect()}
    assert [got.get(i, (0, 0)) for i, _ in pairs] == [x[1:3] for x in brute_dedup(pairs)]


def test_suffix_dedup_holds_few_rows_of_a_mark_that_is_crowded_in_no_task(spark):
    """A passage that occurs a few times in each of many flushes."""
    r = random.Random(11)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = noise(130)
    pairs = [(i, noise(120) + (passage if i % 5 == 0 else noise(20)) + noise(90)) for i in range(400)]
    docs = spark.createDataFrame(pairs, "doc long, text string").repartition(3)
    got = {x["doc"]: x["n_removed"] for x in suffix_dedup.repeated_parts(docs, held=60, most=8).collect()}
    assert [got.get(i, 0) for i, _ in pairs] == [x[1] for x in brute_dedup(pairs)]


@pytest.mark.parametrize("most,size", [(3, 7), (1, 1), (50, 16), (10**6, 5)])
def test_settled_groups_are_whole_or_come_in_order(most, size):
    r = random.Random(most + size)
    rows = sorted({(r.choice([0, 0, 0, 1]), r.choice([5, -3, 9, 9, 9, 9]), r.randint(-6, 9) or 1, r.randint(0, 3), r.randint(0, 2)) for _ in range(160)} | {(0, 9, 0, 0, suffix_dedup.NO_PLACE)})
    columns = {c: pa.array(v, pa.int32() if c == "kind" else pa.int64()) for c, v in zip(("kind", "h", "s", "doc", "at"), zip(*rows))}
    batch = pa.record_batch(columns)
    later, single, large, crowded = [], {}, [], []

    def whole(told, h, s, doc, at):
        assert not set(h.tolist()) & set(single)
        for x in zip(h.tolist(), s.tolist(), doc.tolist(), at.tolist()):
            single.setdefault(x[0], []).append(x)
        for k in set(h.tolist()):
            single[k] += [k in told, None]
        return []

    steps = [batch.slice(i, size) for i in range(0, len(rows), size)]
    list(suffix_dedup._settled(
        iter(steps), ("h", "s", "doc", "at"), lambda *c: later.extend(zip(*(x.tolist() for x in c))) or [], whole,
        lambda *c: large.extend(zip(*(x.tolist() for x in c))) or [], lambda first, *c: crowded.extend(zip(first.tolist(), *(x.tolist() for x in c))) or [], lambda *c: [], most,
    ))
    mine = [x[1:] for x in rows if x[0] == 0 and x[4] != suffix_dedup.NO_PLACE]
    firsts = {}
    for x in mine:
        firsts.setdefault(x[:2], x)
    groups = {}
    for x in firsts.values():
        groups.setdefault(x[0], []).append(x)
    assert sorted(later) == sorted(x for x in mine if x not in firsts.values())
    assert sorted(large + [x for v in single.values() for x in v if isinstance(x, tuple)]) == sorted(firsts.values())
    for h, v in single.items():
        assert v[:-2] == groups[h] and v[-2] == (h == 9) and len(v) - 2 <= max(most, size + most)
    assert [x[1:] for x in crowded] == [x[1:] for x in rows if x[0] == 1] and sum(x[0] for x in crowded) == len({x[1:3] for x in rows if x[0] == 1})


def test_suffix_dedup_of_parts_of_a_long_text(spark, tmp_path):
    r = random.Random(4)
    long = " ".join(str(r.randrange(10**9)) for _ in range(320_000))
    passage = long[suffix_dedup.MARK_SLICE - 300 : suffix_dedup.MARK_SLICE + 300]
    assert len(long) > 3 * suffix_dedup.MARK_SLICE
    dedup_check(spark, [(1, passage), (2, long), (3, long[-250:])], tmp_path)


def test_suffix_dedup_keeps_columns(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


@given(st.lists(st.tuples(st.integers(0, 2), st.binary(min_size=4, max_size=4).map(lambda b: bytes(x % 3 for x in b))), min_size=1, max_size=40), st.integers(1, 9))
@settings(max_examples=80, deadline=None)
def test_merge_by_interleave_refinement(rows, shard):
    laid = [(i, *x) for i in range(0, len(rows), shard) for x in sorted(rows[i : i + shard])]
    number, group = np.array([x[0] for x in laid]), np.array([x[1] for x in laid])
    strings = np.array([list(x[2]) for x in laid], np.uint8)
    order, common = merge(number, group, strings)
    assert [laid[i][1:] for i in order] == sorted(rows)
    for depth in range(5):
        ids = classes(order, common, depth)
        keys = [(g, s[:depth]) for _, g, s in laid]
        assert all((ids[i] == ids[j]) == (keys[i] == keys[j]) for i in range(len(rows)) for j in range(len(rows)))


def test_merge_relies_on_the_orders_of_shards():
    strings = np.frombuffer(b"adbcabcd", np.uint8).reshape(8, 1)  # the first shard isn't sorted
    order, _ = merge(np.repeat([0, 1], 4), np.zeros(8, int), strings)
    assert bytes(strings[order, 0].tolist()) != b"aabbccdd"
    strings = np.frombuffer(b"abcdabcd", np.uint8).reshape(8, 1)
    order, _ = merge(np.repeat([0, 1], 4), np.zeros(8, int), strings)
    assert bytes(strings[order, 0].tolist()) == b"aabbccdd"


def test_ppm_and_base_scores(spark):
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_ppm_scores"](spark, SF).collect()}
    d = documents()
    tokens = [SPACE.findall(lower(t)) for t in d.text]
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i in d.doc_id]
    count, nodes, k = collections.Counter(), collections.defaultdict(collections.Counter), ppm.ORDER
    code = lambda w: b"\n" * k + " ".join(w).encode() + b"\n"
    for w, f in zip(tokens, learn):
        if f:
            count.update([*w, None])
            x = code(w)
            for i in range(k, len(x)):
                for j in range(k + 1):
                    nodes[x[i - j : i]][x[i]] += 1
    n, v = sum(count.values()), len(count)

    def predict(x, i):
        out, gone = 0.0, set()
        for j in range(k, -1, -1):
            seen = {s: c for s, c in nodes.get(x[i - j : i], {}).items() if s not in gone}
            if x[i] in seen:
                return out + math.log10(seen[x[i]] / (sum(seen.values()) + len(seen)))
            if seen:
                out += math.log10(len(seen) / (sum(seen.values()) + len(seen)))
                gone |= set(seen)
        return out - math.log10(256 - len(gone))

    for i, w, f in list(zip(d.doc_id, tokens, learn)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (not f, len(w) + 1, n)
        assert r["n_known"] == sum(count[t] > 0 for t in [*w, None])
        assert r["base_score"] == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in [*w, None]))
    for i, w in list(zip(d.doc_id, tokens))[:25]:
        x = code(w)
        assert got[i]["score"] == pytest.approx(sum(predict(x, q) for q in range(k, len(x))))


def test_ppm_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    text = r.choice(np.frombuffer(b"abcd", np.uint8), 400)
    orders = []
    for j in range(ppm.ORDER + 1):
        c = collections.Counter(int.from_bytes(bytes(text[i - j : i + 1].tolist()), "big") for i in range(ppm.ORDER, len(text)))
        keys = sorted(c)
        orders.append((np.array(keys, np.uint64), np.array([c[x] for x in keys])))
    trie = ppm.Trie(orders)
    for context in (b"abcda", b"zzzzz", b"zzzab", bytes(text[:5].tolist())):
        keys = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** trie.predict(keys)).sum() == pytest.approx(1)
        assert trie.score(keys) == pytest.approx(trie.predict(keys))


def test_adaptive_ppm_learns():
    assert ppm.adaptive_score(b"") == 0
    assert ppm.adaptive_score(b"a") == pytest.approx(-math.log10(256))
    assert ppm.adaptive_score(b"abcabcabcabcabcabc") > ppm.adaptive_score(b"abcdefghijklmnopqr")


def test_packing_round_trip(spark, odd_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for folder in (SF, odd_dir):
        pieces = registry.QUERIES["op9_vector_packing"](spark, folder).toPandas()
        docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").toPandas()
        sequences = pieces.groupby("sequence_id").agg(n=("length", "sum"), low=("offset", "min"))
        assert (sequences.n <= 2048).all() and (sequences.low == 0).all()
        padding = sum(0 if (n & (n - 1)) == 0 else 2048 - n for n in sequences.n)
        assert padding == 0
        for _, g in pieces.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)])[:-1]).all()
        want = collections.Counter()
        once = docs.doc_id.notna() & ~docs.doc_id.duplicated(keep=False)
        for i, text in zip(docs.doc_id, docs.text):
            want[None if pd.isna(i) else int(i)] += len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        by_id = pieces.assign(k=pieces.doc_id.map(lambda x: None if pd.isna(x) else int(x)))
        assert {k: int(g.length.sum()) for k, g in by_id.groupby("k", dropna=False)} == {k if k is not None else k: v for k, v in want.items()} or {
            (None if pd.isna(k) else int(k)): int(g.length.sum()) for k, g in by_id.groupby("k", dropna=False)
        } == dict(want)
        for i, text in zip(docs.doc_id[once], docs.text[once]):
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
            at = 0
            for p in by_id[by_id.k == int(i)].sort_values("start").itertuples():
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids)


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 40)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_dot_product_packing_keeps_all_limits(items):
    demand = np.array([(t, 1, loss) for t, loss in items], float).reshape(-1, 3)
    limits = np.array([100.0, 5, 60])
    bins = packing.dot_product_pack(demand, limits)
    assert sorted(i for b in bins for i in b) == list(range(len(items)))
    assert all((demand[b].sum(axis=0) <= limits).all() for b in bins)


@given(st.lists(st.one_of(st.integers(1, 4), st.integers(1, 200)), max_size=80), st.sampled_from([(64, 5, 64), (64, 64, 64), (64, 4, 40), (128, 1, 128)]))
@settings(max_examples=80, deadline=None)
def test_packed_pieces_keep_all_limits(sizes, limits):
    tokens, segments, loss = limits
    packer = packing._Packer(1, tokens, segments, loss)
    for doc, n in enumerate(sizes):
        packer.add(doc, np.arange(n, dtype=np.uint32))
        if doc % 20 == 19:
            packer.pack()
    packer.finish()
    by, found = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in packer.rows:
        by[sequence].append((offset, length))
        found[doc].append((start, length))
        assert total == sizes[doc] and crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes())
    for doc, n in enumerate(sizes):
        ends = [0]
        for start, length in sorted(found[doc]):
            assert start == ends[-1]
            ends.append(start + length)
        assert ends[-1] == n
    for pieces in by.values():
        size = sum(n for _, n in pieces)
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert size <= tokens and len(pieces) <= segments and size - len(pieces) <= loss
        assert size & (size - 1) == 0


def test_conversations_are_packed_under_three_limits(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want[r["conv_id"]][0] += n
        want[r["conv_id"]][1] += n * (r["role"] == "assistant")
    rows = registry.QUERIES["instruction_packing"](spark, SF).collect()
    assert {r["conv_id"]: [r["tokens"], r["loss_tokens"]] for r in rows} == dict(want) and len(rows) == len(want)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["tokens"], 1, r["loss_tokens"]))
    assert all(len(g) == 1 or all(sum(x) <= most for x, most in zip(zip(*g), (2048, 8, 1536))) for g in by.values())
    assert len(by) < len(rows) / 2


def test_examples_are_packed_whole(spark):
    talk = spark.read.parquet(f"{SF}/conversations.parquet")
    asked = talk.selectExpr("conv_id * 1000 + turn AS id", "length(text) AS tokens", "CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS loss_tokens")
    got = packing.pack_examples(asked, tokens=4000, segments=6, loss_tokens=2500).groupBy("sequence_id")
    for r in got.agg({"tokens": "sum", "loss_tokens": "sum", "id": "count"}).collect():
        assert r["count(id)"] == 1 or (r["count(id)"] <= 6 and r["sum(tokens)"] <= 4000 and r["sum(loss_tokens)"] <= 2500)


@pytest.mark.parametrize("name,label", [("op2_quality_ranker", "quality"), ("op3_toxicity_mil", "toxic")])
def test_held_out_accuracy(spark, name, label):
    folder = "/root/testdata/sf0.1"
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    got = registry.QUERIES[name](spark, folder).toPandas().merge(labels, on="doc_id")
    held = got[got.held_out]
    assert got.score.between(0, 1).all() and len(held) > 500
    good, bad = held[held[label] == 1].score.to_numpy(), held[held[label] == 0].score.to_numpy()
    auc = np.searchsorted(np.sort(bad), good).mean() / len(bad)
    assert auc > (0.99 if label == "quality" else 0.96)
    assert (held.predicted == held[label]).mean() > (0.99 if label == "quality" else 0.96)


def test_noisy_or_gradient():
    r = np.random.default_rng(3)
    w, bias = r.normal(0, 0.5, 6), -1.2
    of_doc = np.sort(np.append(r.integers(0, 5, 7), range(5)))
    feature, of_sentence, y = r.integers(0, 6, 40), r.integers(0, 12, 40), np.array([1, 0, 1, 0, 1])
    value, gw, gb = toxicity.loss(w, bias, feature, of_sentence, of_doc, y)
    p = [1 / (1 + math.exp(-(bias + sum(w[f] for f, s in zip(feature, of_sentence) if s == k)))) for k in range(12)]
    none = [math.prod(1 - p[k] for k in range(12) if of_doc[k] == d) for d in range(5)]
    assert value == pytest.approx(-np.mean([math.log(1 - q) if t else math.log(q) for q, t in zip(none, y)]))
    at = lambda v, b: toxicity.loss(v, b, feature, of_sentence, of_doc, y)[0]
    for k in range(6):
        e = np.eye(6)[k] * 1e-6
        assert gw[k] == pytest.approx((at(w + e, bias) - at(w - e, bias)) / 2e-6, abs=1e-6)
    assert gb == pytest.approx((at(w, bias + 1e-6) - at(w, bias - 1e-6)) / 2e-6, abs=1e-6)


def test_toxic_sentences_are_located(spark):
    r = random.Random(1)
    plain = [f"word{i}" for i in range(60)]
    line = lambda n: " ".join(r.choice(plain) for _ in range(n)) + "."
    rows, labels, where = [], [], {}
    for i in range(240):
        parts = [line(8) for _ in range(r.randint(2, 6))]
        if i % 4 == 0:
            k = r.randrange(len(parts))
            parts[k] = f"{r.choice(plain)} you vilest {r.choice(['grobnik', 'snarfle'])} {r.choice(plain)}!"
            where[i] = parts[k]
        rows.append((i, " ".join(parts)))
        labels.append((i, int(i % 4 == 0)))
    docs, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(1, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, y, F.col("doc_id") < 160)
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    for i, text in rows[160:]:
        spans = [text.encode()[s["start"] : s["end"]].decode() for s in got[i]["offending"]]
        assert spans == ([where[i]] if i in where else []) and (got[i]["score"] >= 0.3) == (i in where)
        none = math.prod(1 - s["score"] for s in got[i]["offending"])
        assert got[i]["score"] >= 1 - none - 1e-9


def test_pair_loss_is_least_at_the_fit():
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (80, 4))
    y = (x @ [1.0, -2.0, 0.0, 0.5] + r.normal(0, 1, 80) > 0).astype(int)
    model = quality_ranker.fit(x, y, seed=3)
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    draw = np.random.default_rng(3)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[draw.choice(good, quality_ranker.PAIRS)] - z[draw.choice(bad, quality_ranker.PAIRS)]
    loss = lambda w: float(np.mean(np.log1p(np.exp(-(d @ w)))) + quality_ranker.RIDGE / 2 * (w @ w))
    best = loss(model["w"])
    assert all(loss(model["w"] + r.normal(0, s, 4)) >= best for s in (1e-3, 1e-2, 0.1, 1.0) for _ in range(20))


def test_quality_features_by_plain_python():
    texts = ["One two, two. THREE 44\n", "", "aaa aaa a!", "é É x", "z" * 30 + " ok?"]
    got = quality_ranker.features(next(iter(slices(pa.array(texts)))))
    kinds = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
    for row, text in zip(got, texts):
        words = SPACE.findall(text)
        n = max(len(words), 1)
        low = [lower(w) for w in words]
        sizes = [len(w.encode()) for w in words]
        most = max(collections.Counter(low).values(), default=0)
        mean = sum(sizes) / n
        want = [
            math.log1p(len(words)), min(mean, 40) / 10, min(math.sqrt(max(sum(s * s for s in sizes) / n - mean**2, 0)), 40) / 10, len(set(low)) / n, most / n,
            sum(a == b for a, b in zip(low, low[1:])) / n, sum(s <= 3 for s in sizes) / n, sum(s > 20 for s in sizes) / n,
            sum(w[-1] in ".!?,;:" for w in words) / n, float(not words),
        ]
        assert row[-10:] == pytest.approx(want)
        for k, c in enumerate(kinds):
            assert row[k + 1] == pytest.approx(min(text.count(c) / n, 4)) and row[quality_ranker.N_CLASS + k + 1] == (c in text)


def test_license_spans_by_aligning_every_template():
    r = random.Random(2)
    index = licenses.Index()
    names = list(licenses.TEMPLATES)
    for _ in range(60):
        texts = []
        for _ in range(r.randint(0, 3)):
            words = licenses.TEMPLATES[r.choice(names)].split()
            words = [w if r.random() > 0.08 else "zzz" for w in words]
            texts += [" ".join(f"q{r.randrange(99)}" for _ in range(r.randint(3, 20))), " ".join(words)]
        _, _, words, first = licenses.bare_words(next(iter(slices(pa.array([" ".join(texts)])))))
        place, which, at, _ = index.hits(words, first)
        got = licenses.matches(index, words, list(zip(place.tolist(), which.tolist(), at.tolist())), licenses.COVERAGE)
        # every template on every diagonal, without the index
        every = [(p, t, 0) for t in range(len(names)) for p in range(-len(index.words[t]) // 4, len(words))]
        want = licenses.matches(index, words, every, licenses.COVERAGE)
        assert {(m[0], m[1]) for m in got} >= {(m[0], m[1]) for m in want} or sum(m[1] for m in got) >= sum(m[1] for m in want)
        assert all(a[3] < b[2] for a, b in zip(got, got[1:]))


def test_licenses_are_found_with_spans(spark):
    header = licenses.TEMPLATES["mit"]
    words = header.split()
    noisy = " ".join(w.upper() if i % 3 else w for i, w in enumerate(words[:30] + ["really"] + words[30:50] + words[52:]))
    rows = [(1, "aa bb " + header + " cc"), (2, "é ü " + noisy), (3, " ".join(words[:20])), (4, None), (5, ""), (6, "All rights reserved.\nxx All rights reserved!"), (7, "the of and rights")]
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append(r)
    assert set(got) == {1, 2, 6}
    assert got[1][0]["coverage"] == 1 and rows[0][1][got[1][0]["span_start"] : got[1][0]["span_end"]] == header.rstrip(".")
    assert 0.9 < got[2][0]["coverage"] < 1 and got[2][0]["span_start"] == 4
    assert [r["license"] for r in got[6]] == ["all-rights-reserved"] * 2


@given(st.integers(0, 10_000))
@settings(max_examples=25, deadline=None)
def test_maxscore_is_exact(seed):
    r = np.random.default_rng(seed)
    n, d, k = int(r.integers(1, 60)), int(r.integers(1, 9)), int(r.integers(1, 6))
    x = r.integers(-5, 6, (n, d)) * (r.random((n, d)) < r.choice([0.2, 1.0]))
    ids, q = np.arange(n) * 3, r.integers(-5, 6, (4, d))
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 4
    for at in range(0, n, 7):
        maxscore.shard_search(np.array([0, 3, 1, 2]), np.ascontiguousarray(q.T), ids[at : at + 7], np.ascontiguousarray(x[at : at + 7].T), best, k)
    for i, own in enumerate([0, 3, 1, 2]):
        want = sorted((-int(q[i] @ x[j]), int(ids[j])) for j in range(n) if ids[j] != own)[:k]
        assert [(-int(s), int(v)) for s, v in zip(*best[i])] == want


def test_maxscore_over_several_shards_and_blocks(spark):
    r = np.random.default_rng(8)
    rows = [(i, [int(x) for x in r.integers(-9, 10, 5)]) for i in range(300)] + [(300, [10**6, 0, 0, 0, 1]), (302, [1 << 40, 1, 0, 0, 0])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<bigint>").repartition(3)
    got = maxscore.top_k(vectors, vectors.where("vec_id % 10 = 0"), 4, shard=40, block=7).collect()
    want = []
    for i, q in rows:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:4]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 199), (199, 300), (7, 7)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[300] == 199


def test_components_beyond_the_size_that_is_sent_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(_store, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(_store.meet, "__defaults__", ("inner", 0, False))
    links = [(i, i + 1) for i in range(9)] + [(20, k) for k in range(21, 60)] + [(70, 70), (81, 80), (80, 81)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(10)} | {k: 20 for k in range(20, 60)} | {80: 80, 81: 80}


def test_near_duplicates_that_the_leader_misses(spark, monkeypatch):
    # a chain: neighbours are alike, ends are not, so one bucket's leader can't confirm all
    monkeypatch.setattr(minhash, "COMPARE_BLOCK", 4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(30)]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r["component_id"] == 0 and r["kept"] == (i == 0) for i, r in got.items()) and got[3]["n_shingles"] == 56


def brute_components(rows):
    """doc_id -> (sizes of its sets, least id reachable), by all pairs."""
    sets = []
    for i, text in rows:
        w = SPACE.findall(lower(text))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()))
    up = {i: i for i, _ in rows}

    def root(i):
        return i if up[i] == i else root(up[i])

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("crowd,salted", [(2, False), (48, True)])
def test_near_duplicates_in_crowds(spark, monkeypatch, crowd, salted):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    monkeypatch.setattr(minhash, "COMPARE_BLOCK", 8)
    monkeypatch.setattr(minhash, "PIVOT_YIELD", 0.5)  # so that turns of pivots end early
    if salted:
        monkeypatch.setattr(_store.meet, "__defaults__", ("inner", 0, False))
    r = random.Random(crowd)
    rows = []
    for family in range(2):
        words = [f"f{family}w{i}" for i in range(70)]
        for _ in range(30):
            own = [w if r.random() > 0.02 else f"x{r.randrange(10**6)}" for w in words]
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    rows += [(900, rows[5][1]), (901, rows[5][1]), (902, "a b"), (903, "A  b"), (904, ""), (905, None)]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_rows_that_share_an_id(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(5, text(1)), (9, text(1)), (9, text(2)), (12, text(2) + " more"), (13, text(2)), (14, text(3))]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 9: 5, 12: 5, 13: 5, 14: 14}


def test_water_filling_shares_the_excess(spark):
    rows = [("a", 10, 5), ("b", 1000, 2), ("c", 100, 1)]
    got = {r["source"]: r["target"] for r in source_mix.water_fill(spark.createDataFrame(rows, "source string, source_size long, weight long"), 3).collect()}
    assert got == {"a": 30, "b": 780, "c": 300}


def test_mix_meets_targets(spark):
    rows = source_mix.query(spark, SF).toPandas()
    sources = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "source"]]
    by = rows.merge(sources, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (by.target - by.taken).between(0, 1).all() and (rows.taken <= 3 * rows["size"]).all()
    again = source_mix.query(spark, SF).toPandas()
    assert rows.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_pipeline_stages(spark, odd_dir, empty_dir):
    for folder in (SF, odd_dir, empty_dir):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.table(stage(spark, docs, folder), "test")
            if name != "packing":
                assert out.columns == docs.columns
            if name in ("quality", "near_duplicates"):
                assert out.exceptAll(docs).count() == 0
            if name == "repeated_passages":
                assert out.count() == docs.count()
            docs = out
        assert (docs.count() > 0) == (folder != empty_dir)
