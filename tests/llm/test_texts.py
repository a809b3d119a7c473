import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import blobs, lm, quality, suffix

# ---- blobs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50), st.binary(max_size=40))
def test_blobs_round_trip(numbers, raw):
    a, b, c = np.array(numbers, np.uint32), np.frombuffer(raw, np.uint8), np.array(numbers, np.float64)
    for x, y in zip((a, b, c), blobs.unpack(blobs.pack(a, b, c)), strict=True):
        assert x.dtype == y.dtype and x.tolist() == y.tolist()


# ---- language model


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 1 << 50).flatmap(lambda u: st.tuples(st.just(u), st.lists(st.integers(0, u - 1), max_size=200), st.integers(0, u - 1))))
def test_elias_fano(case):
    universe, values, x = case
    v = np.sort(np.array(values, np.uint64))
    e = lm.EliasFano.build(v, universe)
    assert e.get(np.arange(len(v))).tolist() == v.tolist()
    xs = np.array([x, *values, *(min(universe - 1, y + 1) for y in values)], np.uint64)
    whole = np.zeros(len(xs), np.int64)
    assert e.successor(xs, whole, whole + len(v)).tolist() == np.searchsorted(v, xs).tolist()
    lo, hi = len(v) // 3, len(v) - len(v) // 4
    want = np.minimum(hi, np.maximum(lo, np.searchsorted(v, xs)))
    assert e.successor(xs, whole + lo, whole + hi).tolist() == want.tolist()
    assert [i if i < 0 else int(v[i]) for i in e.find(xs, whole + lo, whole + hi)] == [int(y) if y in v[lo:hi] else -1 for y in xs]


def test_trie_finds_what_it_holds_under_its_context_alone():
    rng = np.random.default_rng(0)
    words = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    pairs = sorted({(int(rng.integers(len(words))), int(rng.integers(1 << 32))) for _ in range(2000)})
    triples = sorted({(int(rng.integers(len(pairs))), int(rng.integers(1 << 24))) for _ in range(5000)})
    column = lambda rows, n: np.array([r[n] for r in rows])
    p, weight, p3 = rng.random(len(pairs)), rng.random(len(pairs)), rng.random(len(triples))
    model = lm.ShardModel(words, np.arange(len(words)), (column(pairs, 0), column(pairs, 1), p, weight), (column(triples, 0), column(triples, 1), p3))
    assert 8 * model.bytes < 0.62 * (128 * len(words) + 128 * len(pairs) + 112 * len(triples))
    assert model.find_words(words).tolist() == list(range(len(words)))
    assert model.find_words(words ^ np.uint64(1)).max() == -1
    at = model.find_followers(2, column(pairs, 0), column(pairs, 1))
    assert at.tolist() == list(range(len(pairs)))
    assert lm.dequantise(model.pair_codes[at]) == pytest.approx(p, rel=1e-3) and lm.dequantise(model.weight_codes[at]) == pytest.approx(weight, rel=1e-3)
    assert lm.dequantise(model.triple_codes[model.find_followers(3, column(triples, 0), column(triples, 1))]) == pytest.approx(p3, rel=1e-3)
    # the keys of one context are not found under another
    other = [((w + 1) % len(words), k) for w, k in pairs]
    assert [i >= 0 for i in model.find_followers(2, column(other, 0), column(other, 1))] == [o in set(pairs) for o in other]
    assert model.find_followers(3, np.array([-1]), np.array([5])).tolist() == [-1]


def plain_model(rows, mu=lm.MU, mu3=lm.MU3):
    tokens = [(i, [None, *re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]) for i, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in tokens]
    c, b, t, starts = Counter(), Counter(), Counter(), 0
    for (_, x), out in zip(tokens, held, strict=True):
        if not out:
            c.update(x[1:])
            b.update(zip(x, x[1:], strict=False))
            t.update(zip(x, x[1:], x[2:], strict=False))
            starts += 1
    n, floor = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    for (i, x), out in zip(tokens, held, strict=True):
        first = [(c[w] + 0.1) / floor for w in x[1:]]
        p = [(b[v, w] + mu * q) / ((starts if v is None else c[v]) + mu) for v, w, q in zip(x, x[1:], first, strict=False)]
        p[1:] = [(t[u, v, w] + mu3 * q) / (b[u, v] + mu3) for u, v, w, q in zip(x, x[1:], x[2:], p[1:], strict=False)]
        yield i, out, len(x) - 1, sum(c[w] > 0 for w in x[1:]), n, sum(map(math.log10, first)), sum(map(math.log10, p))


@pytest.mark.parametrize("sizes", [{}, {"batch_tokens": 500, "shard_tokens": 3000}, {"batch_tokens": 37, "shard_tokens": 100}])
def test_scores_against_plain_counts(documents, odd_documents, sizes):
    for docs in (documents, odd_documents):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[5])
        want = sorted(plain_model(rows), key=key)
        got = sorted(map(tuple, lm.score(docs.repartition(3), **sizes).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=key)
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) < 2e-4 * g[2]


def test_held_out_texts_score_better_than_by_single_words(spark):
    from pathlib import Path

    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("driver tables are not here")
    r = lm.score(spark.read.parquet(str(path))).filter("held_out").selectExpr("sum(score) as s", "sum(base_score) as b", "sum(n_tokens) as n").first()
    assert r["s"] / r["n"] > r["b"] / r["n"] + 0.5


def test_counts_beyond_32_bits(spark, monkeypatch, no_documents):
    """Two batches that hold one word 2^31 times each."""
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 10][:2]
    docs = spark.createDataFrame([(i, "a", "en", "s", 1) for i in ids], no_documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
    rows = []
    for r in lm.make_batches(docs.coalesce(1), 2).collect():
        words, counts = blobs.unpack(r["words"])
        counts[words == lm._hash_words([b"a"])[0]] = 1 << 31
        rows.append((r["batch"], (1 << 31) + 1, bytearray(blobs.pack(words, counts)), r["body"]))
    assert len(rows) == 2
    batches = spark.createDataFrame(rows, "batch long, train_tokens long, words binary, body binary")
    monkeypatch.setattr(lm, "make_batches", lambda *_: batches)
    floor = (1 << 32) + 2 + lm.ALPHA * 3
    for r in lm.score(docs, shard_tokens=1 << 30).collect():
        assert r["n_known"] == 2
        assert r["base_score"] == pytest.approx(math.log10(((1 << 32) + lm.ALPHA) / floor) + math.log10((2 + lm.ALPHA) / floor))


def test_scores_of_no_documents(no_documents):
    assert lm.score(no_documents).count() == 0


# ---- suffixes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", min_size=6, max_size=6), max_size=12), min_size=1, max_size=9))
def test_loser_tree(lists):
    runs = [sorted({s.encode() for s in x}) for x in lists]

    def shared(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))

    def feed(run):
        last = None
        for s in run:
            yield s, 0 if last is None else shared(last, s)
            last = s

    tree = suffix.LoserTree([feed(r) for r in runs], 6)
    out = list(tree)
    assert [s for _, s, _ in out] == sorted(s for r in runs for s in r)
    assert all(k == shared(a[1], b) for a, (_, b, k) in zip(out, out[1:], strict=False))
    assert tree.compared <= 7 * (len(out) + len(runs)) * max(1, len(runs).bit_length())


def test_anchors_follow_the_window():
    rng = np.random.default_rng(0)
    shape = suffix.Shape(20, 8)
    part = rng.integers(97, 100, 60).astype(np.uint8)
    data = np.concatenate((rng.integers(97, 100, 333), part, rng.integers(97, 100, 500), part)).astype(np.uint8)
    for block in (64, 1 << 15):
        at, h = suffix.anchors(data, np.ones(len(data), bool), shape, block)
        inside = lambda s: sorted(a - s for a in at.tolist() if s <= a <= s + 60 - 8)
        one, two = inside(333), inside(893)
        core = [x for x in one if shape.back <= x <= 60 - 20]
        assert core and set(core) <= set(two)
        assert len(at) == len(h) and all(any(s <= a <= s + shape.back for a in at.tolist()) for s in range(len(data) - 20))


def test_front_coding_round_trip():
    rows = np.sort(np.random.default_rng(1).integers(97, 99, (50, 12)).astype(np.uint8).view("S12").ravel()).view(np.uint8).reshape(50, 12)
    k = np.zeros(50, np.uint8)
    for i in range(1, 50):
        d = np.flatnonzero(rows[i] != rows[i - 1])
        k[i] = d[0] if len(d) else 12
    assert list(suffix.front_decode(k, suffix.front_code(rows, k), 12)) == [r.tobytes() for r in rows]


def plain_dedup(rows, length):
    """rows: (order key, bytes); equal keys are one document."""
    seen, gone = {}, {}
    for key, text in sorted(set(rows)):
        g = np.zeros(len(text), bool)
        for p in range(len(text) - length + 1):
            if seen.setdefault(text[p : p + length], (key, p)) != (key, p):
                g[p : p + length] = True
        gone[key] = g
    return gone


def test_dedup_against_all_windows(spark):
    for seed in range(4):
        r = random.Random(seed)
        base = ["".join(r.choice("abc" if seed % 2 else "abcdefghij klmnopé") for _ in range(r.randint(5, 60))) for _ in range(8)]
        rows = [(i, "".join(r.choice(base) for _ in range(r.randint(0, 6))) + "".join(r.choice("xyz") for _ in range(r.randint(0, 4)))) for i in range(60)] + [(60, "a" * 300), (61, ""), (62, "é" * 90)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        for length, gram in ((20, 8), (30, 16)):
            want = plain_dedup([(i, t.encode()) for i, t in rows], length)
            got = {x["doc_id"]: x for x in suffix.dedup(df, length, gram, batch_bytes=500, carry=["text"], text="left").collect()}
            for i, t in rows:
                raw, g, x = np.frombuffer(t.encode(), np.uint8), want[i], got[i]
                assert (x["n_bytes"], x["n_removed"], x["n_spans"]) == (len(raw), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()))
                assert x["kept_sha256"] == hashlib.sha256(raw[~g].tobytes()).hexdigest()
                assert x["text"] == t and "�" not in x["left"]
                whole = [c for c, lost in zip(t, _characters(t, g), strict=True) if not lost]
                assert x["left"] == "".join(whole)


def _characters(text, gone):
    at = 0
    for c in text:
        n = len(c.encode())
        yield bool(gone[at : at + n].all())
        at += n


def test_dedup_of_documents(documents, odd_documents, no_documents):
    want = plain_dedup([(r["doc_id"], r["text"].encode()) for r in documents.collect()], 100)
    got = suffix.dedup(documents).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: int(g.sum()) for i, g in want.items()}
    odd = suffix.dedup(odd_documents.repartition(2), carry=["size", "label"]).collect()
    assert len(odd) == 10
    by = {r["doc_id"]: r for r in odd}
    assert by[6]["n_removed"] == by[6]["n_bytes"] and by[5]["n_removed"] < by[5]["n_bytes"] and by[None]["n_removed"] == 0 and by[1]["n_bytes"] == 0
    twins = odd_documents.filter("doc_id = 5").union(odd_documents.filter("doc_id = 5"))
    assert len({(r["n_removed"], r["kept_sha256"]) for r in suffix.dedup(twins).collect()}) == 1
    assert suffix.dedup(no_documents).count() == 0


# ---- quality


def test_quality_on_held_out_labels(spark):
    from pathlib import Path

    path = Path("/root/testdata/sf0.01")
    if not path.is_dir():
        pytest.skip("driver tables are not here")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("doc_id % 2 = 0")
    found = quality.classify(docs, seen).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in found) >= 0.97 * len(found)
    assert sum(not r["kept"] for r in found if r["quality"] == 1) <= 0.01 * len(found)
    kept = quality.keep_good(docs, seen)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in quality.classify(docs, seen).filter("kept").collect()}


def test_views_teach_each_other(spark):
    """A view that sees little learns from what one that sees all is sure of, in the whole unlabelled table."""
    rng = np.random.default_rng(0)
    n = 600
    good = rng.random(n) < 0.6
    rows = [(i, " ".join(rng.choice(["fine", "good", "well"] if g else ["BAD!!", "WORSE!!"], 8)), "en", ("a" if g else "b") if i >= 60 else "c", 100) for i, g in enumerate(good)]
    docs = spark.createDataFrame([(*map(lambda x: x.item() if hasattr(x, "item") else x, r),) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(good[i])) for i in range(60)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    sources = model.meta.raw(quality.meta_features(["a", "b"], ["en"] * 2, [100] * 2))
    assert sources[0] > sources[1]  # no labelled document has source a or b
    alone = quality.learn(docs, labels, rounds=0).meta.raw(quality.meta_features(["a", "b"], ["en"] * 2, [100] * 2))
    assert alone[0] == pytest.approx(alone[1], abs=1e-6)
    assert all(r["kept"] == good[r["doc_id"]] for r in quality.classify(docs, labels).collect())


def plain_text_features(text):
    """A text's features by plain counting."""
    words, n, out = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)], len(re.findall(r"[^\x20\x09-\x0D]+", text)), Counter()
    for w in words:
        out[zlib.crc32(w.lower()) % quality.WORDS] += 0.5 / n
        shape = re.sub(rb"(.)\1+", rb"\1", re.sub(rb"[0-9]", b"0", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", w))))
        out[quality.WORDS + zlib.crc32(shape) % quality.SHAPES] += 0.5 / n
    if n:
        step = lambda x: min(31, int(x * 32))
        out[quality.WORDS + quality.SHAPES + step(sum(x == y for x, y in zip(words, words[1:], strict=False)) / n)] += 0.25
        out[quality.WORDS + quality.SHAPES + 32 + step(len(set(words)) / n)] += 0.25
    return out


def test_scores_and_handed_rows_against_plain_loops(spark, monkeypatch):
    """Which rows the views hand each other, and all scores, by plain loops over dictionaries."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("driver tables are not here")
    documents, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in documents.collect()}
    learned, firsts, quotas = [], [], []
    plain, pupil, quota = quality.Teacher.teach, quality.Teacher.pupil, quality.Teacher.quota
    monkeypatch.setattr(quality.Teacher, "teach", lambda self, view, t, m, good: learned.append((view, good)) or plain(self, view, t, m, good))
    monkeypatch.setattr(quality.Teacher, "pupil", lambda self: firsts.append(pupil(self)) or firsts[-1])
    monkeypatch.setattr(quality.Teacher, "quota", lambda self, grow: quotas.append(quota(self, grow)) or quotas[-1])
    model = quality.learn(documents, labels, grow=300, rounds=1)
    first, handed = firsts[0], dict(learned)
    known = {r["doc_id"] for r in labels.filter("quality is not null").collect()}

    def views(m, r):
        raw = sum(m.text.weights[f] * np.sqrt(x) for f, x in plain_text_features(r["text"] or "").items()) + m.text.bias
        size = "null" if r["n_chars"] is None else str(int(2 * math.log2(max(1, r["n_chars"]))))
        facts = Counter()
        for x in (f"source {r['source']}", f"lang {r['lang']}", f"size {size}", f"both {r['source']} {r['lang']}"):
            facts[zlib.crc32(x.encode()) % quality.META] += 0.25
        other = sum(m.meta.weights[f] * np.sqrt(x) for f, x in facts.items()) + m.meta.bias
        return [m.scale[0][0] * raw + m.scale[0][1], m.scale[1][0] * other + m.scale[1][1]]

    odds = lambda x: 1 / (1 + math.exp(-max(-40, min(40, x))))
    for view in (0, 1):
        sure = [odds(views(first, r)[view]) for i, r in rows.items() if i not in known]
        good = handed.get(view, np.empty(0, bool))
        for n, most, close, far in ((good.sum(), quotas[0][1], *(sum(p >= quality.SURE + d for p in sure) for d in (1e-6, -1e-6))), ((~good).sum(), quotas[0][0], *(sum(p <= 1 - quality.SURE + d for p in sure) for d in (-1e-6, 1e-6)))):
            assert min(most, close) <= n <= min(most, far)
    assert sum(map(len, handed.values())) > 0
    got = {r["doc_id"]: r for r in quality.classify(documents, labels, grow=300, rounds=1).collect()}
    for i, r in rows.items():
        a, b = views(model, r)
        assert got[i]["text_score"] == pytest.approx(odds(a), abs=1e-4) and got[i]["meta_score"] == pytest.approx(odds(b), abs=1e-4)
        assert got[i]["score"] == pytest.approx(odds(model.joint[0] * a + model.joint[1] * b + model.joint[2]), abs=1e-4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aaB1! \té\n", max_size=20), max_size=5))
def test_text_features_by_plain_counting(texts):
    bounds, features, values = quality.text_features(texts)
    for n, t in enumerate(texts):
        mine = slice(bounds[n], bounds[n + 1])
        want = plain_text_features(t)
        assert dict(zip(features[mine].tolist(), values[mine].tolist(), strict=True)) == pytest.approx({f: math.sqrt(x) for f, x in want.items()})


def test_quality_takes_missing_and_clashing_columns(spark, odd_documents):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    odd = odd_documents.withColumnRenamed("size", "a.b").withColumn("_s", F.lit(1)).withColumn("row", F.lit(2)).drop("n_chars", "source")
    kept = quality.keep_good(odd, labels, least=0.0)
    assert kept.columns == odd.columns and kept.count() == 10


def test_quality_without_labels_keeps_all(odd_documents, no_documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(odd_documents, none).filter("kept and score = 1").count() == 10
    one = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (5, None, 0), (None, 0, 0)], none.schema)
    assert quality.classify(odd_documents, one).filter("kept").count() == 10
    assert quality.classify(no_documents, one).count() == 0


def test_quality_of_odd_documents(odd_documents, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd_documents, labels)
    assert got.count() == 10 and got.filter("score is null or score < 0 or score > 1").count() == 0
    same = got.filter("doc_id = 3").groupBy("score").count().collect()
    assert sorted(r["count"] for r in same) in ([1, 2], [3])


def test_word_features_are_shares():
    bounds, _, values = quality.text_features(["a a b", "", "C!! d 1"])
    assert bounds[1] == bounds[2]
    assert [round(float((values[bounds[i] : bounds[i + 1]] ** 2).sum()), 5) for i in (0, 2)] == [1.5, 1.5]
