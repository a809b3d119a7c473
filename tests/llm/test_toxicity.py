"""Toxicity: the kernel against plain sums, the machine and the texts against plain loops, held-out accuracy, defined cases."""

import itertools
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import toxicity
from quillon.llm.queries import QUERIES


def plain_vector(word):
    """Gap-weighted subsequences of three symbols, by their places."""
    row = toxicity.symbols([word])[0].tolist()
    out = {}
    for i, j, k in itertools.combinations(range(len(row)), 3):
        if k - i < toxicity.SPAN:
            key = row[i], row[j], row[k]
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
    return out


def plain_kernel(a, b):
    x, y = plain_vector(a), plain_vector(b)
    dot = lambda p, q: sum(v * q.get(key, 0) for key, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé1", min_size=1, max_size=9), min_size=1, max_size=5))
def test_kernel_is_the_sum_over_subsequences(words):
    found = toxicity.kernel(words, words[::-1], at_once=2)
    want = [[plain_kernel(a, b) for b in words[::-1]] for a in words]
    assert found == pytest.approx(np.array(want), abs=1e-12)


def test_an_inserted_character_leaves_words_alike():
    for word in ("idiot", "worthless", "pathetic"):
        for other in toxicity.disguised(word):
            assert toxicity.kernel([word], [other])[0, 0] > 0.5
    assert toxicity.kernel(["idiot"], ["motion"])[0, 0] < 0.3


def test_machine_is_the_kernel_expansion():
    rng = np.random.default_rng(0)
    units = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(300)]
    units = sorted(set(units)) + ["wretch", "wretched"]
    toxic, plain = np.array([0] * (len(units) - 2) + [60, 50]), np.array([9] * (len(units) - 2) + [0, 0])
    machine = toxicity.fit_machine(units, toxic, plain, 100, 400)
    margin, raw = machine.rate(units)
    assert margin[-2:].min() > 0.5 and margin[:-2].max() < 0
    norms = [math.sqrt(sum(v * v for v in plain_vector(u).values())) for u in units]
    expected = [sum(v * machine.table[a << 12 | b << 6 | c] for (a, b, c), v in plain_vector(u).items()) for u in units]
    assert raw == pytest.approx(expected) and margin == pytest.approx(np.array(expected) / norms + machine.bias)


def plain_summary(machine, text):
    """Instances one by one: words, single letters in a row, neighbours read as one."""
    rate = lambda u: machine.rate([u])[0][0]
    whole = lambda u: max(map(rate, toxicity.windows(u))) if u else toxicity._NONE
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    units = [toxicity.clean(w) for w in words]
    found = [whole(u) for u in units]
    extra = []
    for is_one, run in itertools.groupby(units, lambda u: len(u) == 1):
        run = list(run)
        if is_one and len(run) >= 3:
            joined = "".join(run)
            extra.append(max(rate(joined[i : i + n]) for i in range(len(joined)) for n in range(3, 10) if i + n <= len(joined)))
    raw = [machine.rate([u])[1][0] if 0 < len(u) <= toxicity.LONG else 0 for u in units]
    for i in range(len(units) - 1):
        both = units[i] + units[i + 1]
        if units[i] and units[i + 1] and len(both) <= toxicity.JOINED and raw[i] + raw[i + 1] >= machine.worth and max(found[i], found[i + 1]) < 0 and rate(both) >= 1:
            extra.append(rate(both))
    every = found + extra
    top = sorted((max(x, toxicity._NONE) for x in every), reverse=True)[:3]
    return [*top, *[toxicity._NONE] * (3 - len(top)), len(words), *(sum(x > s for x in every) for s in toxicity.STEPS)]


INSULTS = ["idiot", "moron", "stupid", "worthless", "pathetic", "scum"]


@pytest.fixture(scope="module")
def labelled(spark):
    """600 texts; every third holds two or three insults and is labelled toxic."""
    rng = np.random.default_rng(3)
    common = ["".join(rng.choice(list("aeiourtnslp"), rng.integers(2, 9))) for _ in range(500)]
    rows = []
    for i in range(600):
        words = list(rng.choice(common, 40))
        if i % 3 == 0:
            for w in rng.choice(INSULTS, rng.integers(2, 4), replace=False):
                words.insert(int(rng.integers(len(words))), str(w))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    return docs, labels, rows


@pytest.fixture(scope="module")
def detector(labelled):
    return toxicity.learn(*labelled[:2])


def rated(detector, *texts):
    return detector.score(toxicity.summaries(toxicity.Reader(detector.machine), list(texts)))


def test_disguised_insults_are_found(detector):
    fine = "tale sure nil a no toast"
    texts = ["you idiot and moron", "you i d i o t and m o r o n", "such an i.d.i.o.t, what a m-o-r-o-n", "an idzot idqiot and a morzon, stupzid", "IDIOT!!! MORON$$$", fine, "", None]
    score = rated(detector, *texts)
    assert (score[:5] >= 0.7).all(), score
    assert (score[5:] < 0.5).all(), score
    both = rated(detector, f"{fine} wor thless pathe tic stu pid", f"{fine} wor pathe stu")
    assert both[0] > both[1]


def test_summaries_equal_plain_loops(detector, monkeypatch):
    texts = ["you idiot and moron", "i d i o t", "wor thless id iot stu pid", None, "", "!!! ??", "x" * 100 + "idiot" + "y" * 60, "a b c d e a b c", "e\x1cf idiot\u00a0moron é ß", "idiot " * 40, "i d\ti\no t idiot"]
    want = np.array([plain_summary(detector.machine, t) for t in texts])
    assert toxicity.summaries(toxicity.Reader(detector.machine), texts) == pytest.approx(want)
    long = " ".join(["tale", "sure", "idiot", "moron", "nil"] * 2000)
    want = toxicity.summaries(toxicity.Reader(detector.machine), [long])
    monkeypatch.setattr(toxicity, "ROOM", 3)
    assert toxicity.summaries(toxicity.Reader(detector.machine), [long]) == pytest.approx(want)
    cut = [part for part in toxicity.sliced(long, 1000)]
    assert "".join(cut) == long and all(len(c) <= 1000 for c in cut)


def test_held_out_accuracy(labelled):
    docs, labels, rows = labelled
    truth = {i: t for i, _, t in rows}
    got = toxicity.classify(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_labels_of_held_out_rows_change_nothing(labelled):
    docs, labels, _ = labelled
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    some = docs.limit(40)
    assert toxicity.score(some, toxicity.learn(docs, labels)).collect() == toxicity.score(some, toxicity.learn(docs, other)).collect()


def test_query_on_the_driver_tables(spark, sf_dir):
    found = QUERIES["op11_string_kernel_toxicity"](spark, sf_dir.replace("sf0.001", "sf0.01"))
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")
    held = found.join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    toxic, plain = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    above = np.mean([(t > p) + 0.5 * (t == p) for t in toxic for p in plain])
    assert above > 0.85 and sum(r["predicted"] > r["toxic"] for r in held) <= 0.03 * len(held)


def test_defined_cases(spark, odd_documents, no_documents, labelled, detector):
    _, labels, _ = labelled
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None), (3, 1, 0), (4, 0, 1), (4, 0, 0)], labels.schema))
    got = toxicity.classify(odd_documents, odd).collect()
    assert len(got) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    twice = [r["score"] for r in got if r["doc_id"] == 3]
    assert len(twice) == 3 and len(set(twice)) <= 2
    assert toxicity.classify(no_documents, odd).count() == 0
    none = toxicity.classify(odd_documents, labels.filter("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0} and {r["predicted"] for r in none} == {0}
    long = spark.createDataFrame([(1, "ab " * 700_000 + "idiot moron scum"), (2, "q" * 2_500_000)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(long, detector).collect()}
    assert scores[1] > scores[2]
