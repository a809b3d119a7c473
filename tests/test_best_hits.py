"""Best hits with pairs passed over, against all pairs."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import kernels
from quillon.operators import sequences


@settings(max_examples=150, deadline=None)
@given(st.text("acgt", max_size=40), st.text("acgt", max_size=25), st.text("ac", max_size=30))
def test_no_score_exceeds_its_bound(a, b, c):
    for x, y in ((a, b), (a, a[:20] + b), (a, c), (c + b, b + c)):
        assert kernels.local_score(x, y) <= kernels.most_local(kernels.word_counts(x), kernels.word_counts(y)) + 1e-9


def changed(rng, s, share):
    return "".join(rng.choice("acgt") if rng.random() < share else c for c in s)


def test_best_hits_equal_those_of_all_pairs_and_fewer_are_scored(spark):
    rng = random.Random(4)
    rows = []
    for node in ("m", "n"):
        origin = ["".join(rng.choice("acgt") for _ in range(120)) for _ in range(5)]
        origin[4] = origin[3]  # tied: the least cluster wins
        rows += [(node, 5 * i + c, c, changed(rng, origin[c], 0.0 if c == 4 else 0.03)) for c in range(5) for i in range(6)]
    rows += [("o", 0, 0, "a" * 9), ("o", 1, 1, "c" * 9), ("o", 2, 1, "-" * 9)]
    members = spark.createDataFrame(rows, "node string, ord int, cluster int, seq string")
    found = sequences.consensus(members, ["node", "cluster"])
    want = sequences.best_hits(sequences.search_children(members, found, ["node"]), ["node"])
    got = sequences.best_children(members, found, ["node"]).collect()
    assert sorted((r["node"], r["ord"], r["cluster"], r["score"]) for r in got) == sorted((r["node"], r["ord"], r["cluster"], r["score"]) for r in want.collect())
    assert len(got) == 62
    assert sum(r["scored"] for r in got if r["node"] != "o") < 5 * 60
