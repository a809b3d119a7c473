import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import mixing, sharding


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 40))
def test_feistel_permutes(n, seed):
    perm = sharding.Feistel(n, seed)
    out = perm.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    assert perm.inverse(out).tolist() == list(range(n))


def test_feistel_of_large_ranges_and_other_seeds():
    n = 10**15 + 7
    x = np.array([0, 1, n - 1, n // 2])
    a, b = sharding.Feistel(n, 1), sharding.Feistel(n, 2)
    assert a.inverse(a.forward(x)).tolist() == x.tolist() and (a.forward(x) < n).all()
    assert a.forward(x).tolist() != b.forward(x).tolist()


def test_sharding(odd_documents, no_documents):
    got = sharding.shard_documents(odd_documents.repartition(3), shards=4).collect()
    again = sharding.shard_documents(odd_documents.repartition(5), shards=4).collect()
    key = lambda rows: Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rows)
    assert key(got) == key(again) and len(got) == 10
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    perm = sharding.Feistel(10, 20)
    for r in got:
        at = int(perm.forward([r["row_no"]])[0])
        assert (at % 4, at // 4) == (r["shard"], r["slot"])
    assert {r["doc_id"]: r["size"] for r in got}[1] == 16
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in odd_documents.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    assert sharding.shard_documents(no_documents).count() == 0


def quotas(spark, numbers):
    return spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(numbers)], "_source string, quota long")


@pytest.mark.parametrize(("numbers", "shards"), [([5, 0, 17, 100], 4), ([3], 8), ([1, 1, 1], 5), ([40, 300, 7, 9, 1], 7), ([10, 4], 1)])
def test_tree_splits_exactly(spark, numbers, shards):
    got = mixing.splitting_tree(quotas(spark, numbers), shards).collect()
    assert len(got) == shards * len(numbers)
    by = defaultdict(list)
    for r in got:
        by[r["_source"]].append((r["first"], r["past"], r["shard"]))
    for i, n in enumerate(numbers):
        spans = sorted((a, b) for a, b, _ in by[f"s{i:02}"] if b > a)
        assert sum(b - a for a, b in spans) == n
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    size = Counter()
    for r in got:
        size[r["shard"]] += r["past"] - r["first"]
    assert max(size.values()) - min(size.values() or [0]) <= (shards - 1).bit_length()


def test_tree_draws_are_hypergeometric(spark):
    """Over many seeds, the left half's share has the mean and the variance of draws without replacement."""
    base = spark.range(1).select(F.lit(1).alias("x"))
    draw = mixing._hyper("pop", "good", "n", "u")
    rows = base.crossJoin(spark.range(4000)).select(F.lit(60).cast("long").alias("pop"), F.lit(20).cast("long").alias("good"), F.lit(30).cast("long").alias("n"), ((F.col("id") + 0.5) / 4000).alias("u"))
    x = np.array([r[0] for r in rows.select(F.expr(draw)).collect()])
    assert abs(x.mean() - 10) < 0.02
    assert abs(x.var() - 30 * (1 / 3) * (2 / 3) * 30 / 59) < 0.05


def plain_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            open_.discard(s)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_plan(spark, documents):
    docs = documents.withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    got = mixing.plan(docs).select("doc_id", "size", "source_size", "target", "shards", "row.source").collect()
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += words(r["text"])
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert len(r["shards"]) <= 3
        taken[r["source"]] += r["size"] * len(r["shards"])
    for s, t in want.items():
        # a source of a few documents can't come nearer than half of one
        each = [words(r["text"]) for r in rows if r["source"] == s]
        assert abs(taken[s] - t) <= max(each) / 2 + 1, s
    again = mixing.plan(docs.repartition(5)).select("doc_id", "shards").collect()
    assert sorted((r["doc_id"], r["shards"]) for r in again) == sorted((r["doc_id"], r["shards"]) for r in got)


def test_mix_gives_a_row_for_each_copy(odd_documents, no_documents):
    planned = mixing.plan(odd_documents)
    assert planned.count() == 10
    mixed = mixing.mix(odd_documents)
    assert mixed.columns == odd_documents.columns and mixed.schema["size"].dataType == odd_documents.schema["size"].dataType
    assert mixed.count() == planned.selectExpr("sum(size(shards))").first()[0]
    assert mixing.mix(no_documents).count() == 0


def test_mix_takes_any_names_and_draws_each_place_once(spark, odd_documents, documents):
    odd = odd_documents.withColumnRenamed("size", "a.b").withColumn("row", F.lit(1)).withColumn("key", F.lit(2)).withColumn("copy", F.lit("c"))
    assert mixing.mix(odd, shards=3).columns == odd.columns
    # null ids are dealt by their texts
    nameless = documents.withColumn("doc_id", F.lit(None).cast("long"))
    assert mixing.sized(nameless, 64).select("_block").distinct().count() > 32
    # whatever the shards, their ranges cover each source's quota: the same documents are taken as often
    taken = lambda n: sorted((r["doc_id"], r["n"]) for r in mixing.plan(documents, shards=n, blocks=256).select("doc_id", F.size("shards").alias("n")).collect())
    assert taken(1) == taken(7)
    by_shard = mixing.plan(documents, shards=7, blocks=256).select(F.explode("shards").alias("s")).groupBy("s").count().collect()
    assert {r["s"] for r in by_shard} == set(range(7))


def test_given_weights(documents):
    p = mixing.plan(documents, weights={"src0": 1.0, "src1": 1.0})
    by = {r["source"]: r for r in p.groupBy("row.source").agg(F.first("target").alias("target"), F.first("source_size").alias("size")).collect()}
    assert by["src2"]["target"] == 0 and by["src1"]["target"] <= 3 * by["src1"]["size"]
