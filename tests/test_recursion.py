import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import matrix, recursion, sequences

LETTERS = "acgt"


def mutate(rng, s, rate):
    hit = rng.random(len(s)) < rate
    return "".join(LETTERS[(LETTERS.index(c) + rng.integers(1, 4)) % 4] if h else c for c, h in zip(s, hit, strict=True))


def family(spark, groups, names="f", pr=0.7, pn=0.08, noise=0.03, length=400):
    """Three groups: A; B far from it; B1 and B2 near each other."""
    rng = np.random.default_rng(7)
    a = "".join(rng.choice(list(LETTERS), length))
    b = mutate(rng, a, pr)
    bases = [a, mutate(rng, b, pn / 2), mutate(rng, b, pn / 2)]
    seqs = [mutate(rng, base, noise) for base, n in zip(bases, groups, strict=True) for _ in range(n)]
    truth = [g for g, n in zip("ABC", groups, strict=True) for _ in range(n)]
    m = np.array([np.frombuffer(s.encode(), np.uint8) for s in seqs])
    d = (m[:, None] != m[None]).mean(2)
    n = len(seqs)
    msa = spark.createDataFrame([(names, i, f"s{i}", s) for i, s in enumerate(seqs)], "family string, ord int, sequence_id string, seq string")
    edges = spark.createDataFrame([(names, i, j, f"s{i}", f"s{j}", float(d[i, j])) for i in range(n) for j in range(n)], "family string, i int, j int, src string, dst string, distance double")
    known = spark.createDataFrame([(names, i, f"s{i}", t) for i, t in enumerate(truth)], "family string, ord int, sequence_id string, known_subfamily string")
    return matrix.distance_to_affinity(edges), msa, known, truth


def test_nested_groups_are_split_in_two_levels(spark):
    a, msa, known, truth = family(spark, (24, 30, 12))
    got = recursion.run_recursive_clustering(a, msa, known)
    d = [r.asDict() for r in got["diagnostics"].collect()]
    assert list(d[0]) == [f.split(" ")[0] for f in recursion.schema.DIAGNOSTICS.split(", ")]
    won = [r for r in d if r["accepted"]]
    assert [(r["path"], r["tested_k"]) for r in won][0] == ("root", 2)
    assert len(won) == 2 and all(r["rejection_reason"] == "" for r in won)
    label = {r["sequence_id"]: r["predicted_cluster"] for r in got["membership"].collect()}
    groups = {}
    for i, t in enumerate(truth):
        groups.setdefault(label[f"s{i}"], set()).add(t)
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == 3
    root = [r for r in d if r["path"] == "root"]
    assert [r["tested_k"] for r in root] == list(range(2, 66 // 10 + 1))
    ranks = sorted((r["rank"], -r["silhouette_score"]) for r in root)
    assert [x for x, _ in ranks] == list(range(1, len(root) + 1)) and ranks == sorted(ranks, key=lambda x: x[1])
    assert {r["rejection_reason"] for r in root} <= {"", "not_evaluated_after_acceptance", "not_in_top_k_candidates", "cluster_below_minimum_size", "consensus_similarity_threshold_failed", "layer_similarity_failed", "reassignment_accuracy_failed"}
    first = won[0]
    child = [r for r in d if r["path"] == won[1]["path"]][0]
    assert child["upper_similarity"] == pytest.approx(first["maximum_child_similarity"])
    assert won[1]["minimum_child_similarity"] >= child["upper_similarity"]
    leaf = [r for r in d if r["rejection_reason"] == "too_few_sequences_to_split"]
    assert leaf and all(r["tested_k"] is None and r["accepted"] is False for r in leaf)
    binary = recursion.run_fixed_binary_recursive(a, msa, known)
    same = {r["sequence_id"]: r["predicted_cluster"] for r in binary["membership"].collect()}
    assert same == label
    assert recursion.accepted_splits(binary["diagnostics"]).first()["accepted_splits"] == 2
    counters = [(r["path"], r["recursion_counter"]) for r in binary["diagnostics"].collect()]
    assert counters[0] == ("root", 1)


def test_second_candidate_is_accepted_after_the_first_fails(spark):
    """Groups B1 and B2 are too near for k = 2 to be reassigned; k = 3 comes second and is."""
    a, msa, known, truth = family(spark, (60, 30, 30), pr=0.25, pn=0.07)
    got = recursion.run_recursive_clustering(a, msa, known)
    root = {r["rank"]: r for r in got["diagnostics"].collect() if r["path"] == "root"}
    assert (root[1]["tested_k"], root[1]["accepted"], root[1]["rejection_reason"]) == (2, False, "reassignment_accuracy_failed")
    assert root[1]["reassignment_accuracy"] == pytest.approx(0.75, abs=0.05)
    assert (root[2]["tested_k"], root[2]["accepted"], root[2]["rejection_reason"]) == (3, True, "")
    assert sorted(int(p.split(":")[1]) for p in root[2]["child_sizes"].split(";")) == [30, 30, 60]
    groups = {}
    for r in got.membership.collect():
        groups.setdefault(r["predicted_cluster"], set()).add(r["known_subfamily"])
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())


def test_empty_consensus_fails_the_similarity_gate(spark):
    """A cluster whose columns are mostly gaps has no consensus: that gate is false, the later ones null."""
    a, msa, _, _ = family(spark, (12, 12, 0), length=80)
    bare = msa.withColumn("seq", F.when(F.col("ord") < 12, F.repeat(F.lit("-"), F.length("seq"))).otherwise(F.col("seq")))
    got = recursion.run_recursive_clustering(a, bare)
    (row,) = [r for r in got["diagnostics"].collect() if r["tested_k"] == 2]
    assert row["rejection_reason"].startswith("empty_consensus:[")
    assert row["pass_minimum_size"] is True and row["pass_similarity_threshold"] is False
    assert row["pass_layer_similarity"] is None and row["pass_reassignment"] is None and row["accepted"] is False


def test_nodes_over_the_dense_size_split_as_smaller_ones(spark, monkeypatch):
    from quillon.operators import clustering, tiles

    a, msa, known, _ = family(spark, (20, 14, 0), length=200)
    want = recursion.run_recursive_clustering(a, msa, known)
    monkeypatch.setattr(clustering, "DENSE", 25)
    monkeypatch.setattr(tiles, "SIDE", 8)
    got = recursion.run_recursive_clustering(a, msa, known)
    rows = lambda r: [tuple(round(v, 8) if isinstance(v, float) else v for v in x) for x in r["diagnostics"].collect()]
    assert rows(got) == rows(want)
    assert sorted(map(tuple, got["membership"].collect())) == sorted(map(tuple, want["membership"].collect()))


def test_depth_zero_stops_at_the_root(spark):
    a, msa, _, _ = family(spark, (12, 12, 0), length=80)
    got = recursion.run_recursive_clustering(a, msa, config=recursion.RecursiveConfig(max_depth=0))
    assert [(r["path"], r["rejection_reason"]) for r in got["diagnostics"].collect()] == [("root", "maximum_depth_reached")]
    assert {r["predicted_cluster"] for r in got["membership"].collect()} == {"0"}


def test_small_family_is_not_split_and_binary_stops(spark):
    a, msa, _, _ = family(spark, (8, 8, 0), length=60)
    got = recursion.run_recursive_clustering(a, msa)
    assert [r["rejection_reason"] for r in got["diagnostics"].collect()] == ["too_few_sequences_to_split"]
    two = recursion.run_fixed_binary_recursive(a, msa, config=recursion.FixedBinaryConfig(max_recursion_counter=1))
    assert [r["rejection_reason"] for r in two["diagnostics"].collect()] == ["maximum_recursion_counter_reached"]


def test_consensus_ties_go_to_the_first_member(spark):
    rows = spark.createDataFrame([("f", 0, "g-a"), ("f", 1, "c-a"), ("f", 2, "c-t"), ("f", 3, "gat")], "family string, ord int, seq string")
    assert sequences.consensus(rows, ["family"]).first()["consensus"] == "ga"
    assert [r["seq"] for r in sequences.strip_gap_columns(rows, ["family"]).orderBy("ord").collect()] == ["ga", "ca", "ct", "gt"]
    with pytest.raises(ValueError, match="differ in length"):
        sequences.consensus(rows.union(spark.createDataFrame([("f", 4, "a")], rows.schema)), ["family"]).collect()


def test_accuracy_counts_copies_without_hits(spark):
    members = spark.createDataFrame([("f", i, i % 2) for i in range(4)], "family string, ord int, cluster int")
    hits = spark.createDataFrame([("f", 0, 0, 5.0), ("f", 0, 1, 5.0), ("f", 1, 1, 9.0), ("f", 2, 1, 9.0)], "family string, ord int, cluster int, score double")
    best = sequences.best_hits(hits, ["family"])
    assert sequences.reassignment_accuracy(members, best, ["family"]).first()["reassignment_accuracy"] == 0.5


def test_gates_pass_without_pairs(spark):
    nodes = spark.createDataFrame([("f", 0.5)], "family string, upper double")
    pairs = spark.createDataFrame([], "family string, c1 int, c2 int, similarity double")
    r = sequences.similarity_gate(nodes, pairs, ["family"]).first()
    assert (r["pass_similarity_threshold"], r["pass_layer_similarity"], r["minimum_child_similarity"]) == (True, True, None)


def test_reasons_by_precedence(spark):
    rows = spark.createDataFrame([(True, "own", None, 0.5, 1, None), (False, None, "E: x", None, None, None), (False, None, None, float("nan"), None, None), (False, None, None, 0.1, 9, 1), (False, None, None, 0.1, 2, 1), (False, None, None, 0.1, 2, None)], "e boolean, own string, err string, s double, r int, won int")
    got = rows.select(recursion.reason_code(F.col("e"), F.col("own"), F.col("err"), F.col("s"), F.col("r"), 3, F.col("won")))
    assert [r[0] for r in got.collect()] == ["own", "E: x", "invalid_silhouette", "not_in_top_k_candidates", "not_evaluated_after_acceptance", "not_evaluated"]
