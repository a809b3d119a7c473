"""Conversation trie: against a plain trie in dictionaries, scans over many partitions, defined cases."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import trie
from quillon.llm.queries import QUERIES

KIND = "conv_id long, turn long, role string, text string"


def digest(role, text):
    whole = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    return tuple(int.from_bytes(whole[i : i + 8], "big", signed=True) for i in (0, 8))


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    told = {c: [t[3:] for t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c in told:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = told.get(c - c % 100, [])[:h] + told[c][h:]
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[b] for b in below) if below else 1
        saved[path] = (len(nodes[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[b] for b in below)
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def check(spark, rows, parts=4):
    got = found(trie.prefix_trie(spark.createDataFrame(rows, KIND).repartition(parts)))
    assert got == plain_trie(rows)
    return got


def made(seed, convs, most, words, base=0):
    rng = np.random.default_rng(seed)
    return [(base + int(c), t, "user" if t % 2 else "assistant", str(rng.choice(words))) for c in convs for t in range(int(rng.integers(1, most)))]


def test_shared_prefixes(spark):
    check(spark, made(1, range(230), 7, ["a", "bb", "é😀"]))


def test_a_very_long_conversation_and_many_copies(spark):
    long = [(7, t, "user", f"w{t % 5}") for t in range(3000)] + [(8, t, "user", f"w{t % 5}" if t != 2500 else "other") for t in range(3000)]
    copies = [(100 * c + 3, t, "user", "same") for c in range(300) for t in range(3)]
    got = check(spark, long + copies, 7)
    assert max(r[1] for r in got) >= 2997


def test_nested_branches_take_few_rounds(spark):
    # conversation c shares all but its last c turns with the first: paths hang on one another
    rows = [(10000 - 100 * n, t, "user", "x" if t < n else f"y{n}") for n in range(6, 40) for t in range(n + 1)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "nobody's"), (5, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"),
        (0, 0, "user", "x"), (0, 1, "", "x" * 100_000), (0, 2, "u", "ser"), (101, 3, "us", "er"), (199, 0, "user", "x"), (-7, 0, "user", "z"), (-100, 0, "user", "z"), (2**53 + 1, 0, "user", "q"), (2**53 + 1, 1, "user", "q"),
    ]
    rows += [(c, 0, "user", "alone") for c in range(2000, 2030)]
    check(spark, [r for r in rows if r[0] is None or r[0] >= 0])
    negative = [r for r in rows if r[0] is not None and r[0] < 0]
    assert trie.prefix_trie(spark.createDataFrame(negative, KIND)).filter("depth = 0").first()["n_convs"] == 2
    wide = spark.createDataFrame([(*r, 1, "x", 2) for r in rows[5:9]], KIND + ", depth int, path string, part long")
    assert found(trie.prefix_trie(wide)) == plain_trie(rows[5:9])
    assert trie.prefix_trie(spark.createDataFrame([], KIND)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame(rows[:1], KIND)).count() == 0


def test_driver_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = QUERIES["op12_conversation_trie"](spark, sf_dir)
    assert {k for _, k in got.dtypes} == {"bigint", "string"}
    assert found(got) == plain_trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_merges_do_not_depend_on_partitions(spark, monkeypatch):
    rows = made(2, range(150), 6, ["a", "b"])
    want = plain_trie(rows)
    monkeypatch.setattr(trie, "FAN", 2)
    monkeypatch.setattr(trie, "ENDS", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert found(trie.prefix_trie(spark.createDataFrame(rows, KIND))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-9, 9)), max_size=30))
def test_running_values(rows):
    rows = sorted(rows, key=lambda r: r[0])
    key, x = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    for xor in (True, False):
        want, held = [], (None, 0)
        for k, v in rows:
            held = (k, v) if k != held[0] else (k, held[1] ^ v if xor else held[1] + v)
            want.append(held[1])
        assert trie.running(x, key, xor).tolist() == want


def test_scan_carries_over_partitions(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 300, F.lit(3)).otherwise(F.col("id") % 7 + 4).cast("long").alias("k"), F.col("id").alias("v"))
    scan = trie.Scan(rows.repartition(11), "k", [F.col("k"), F.col("v")], {"v": False})
    got = sorted(scan.map(lambda a, _: {**a, "sum": a["run_v"], "last": a["ends"]}, [], "k long, v long, sum long, last boolean").collect())
    held = {}
    for i, r in enumerate(got):
        held[r["k"]] = held.get(r["k"], 0) + r["v"]
        assert r["sum"] == held[r["k"]] and r["last"] == (i + 1 == len(got) or got[i + 1]["k"] != r["k"])
    assert pytest.approx(sum(r["last"] for r in got)) == 8
