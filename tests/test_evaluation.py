from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluation


def ari(spark, truth, predicted):
    df = spark.createDataFrame([("f", t, p) for t, p in zip(truth, predicted, strict=True)], "family string, t string, p string")
    return evaluation.adjusted_rand(df, "t", "p", ["family"]).first()["adjusted_rand_index"]


def by_pairs(truth, predicted):
    pairs = list(combinations(range(len(truth)), 2))
    t, p = [truth[i] == truth[j] for i, j in pairs], [predicted[i] == predicted[j] for i, j in pairs]
    both, expected, top = sum(x and y for x, y in zip(t, p, strict=True)), sum(t) * sum(p) / len(pairs), (sum(t) + sum(p)) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)


@pytest.mark.parametrize(("truth", "predicted"), [("AABB", "1100"), ("AABBCC", "112233"), ("AABBCC", "121212"), ("AAAA", "1111"), ("AAAA", "1112"), ("ABCD", "1234"), ("ABCD", "1111"), ("AABBBACC", "11223344")])
def test_index_counts_pairs(spark, truth, predicted):
    assert ari(spark, truth, predicted) == pytest.approx(by_pairs(truth, predicted))
    assert ari(spark, predicted, truth) == pytest.approx(by_pairs(truth, predicted))


def test_single_member_agrees(spark):
    assert ari(spark, "A", "1") == 1.0


def test_noise_rows_become_clusters_of_their_own(spark):
    p = spark.createDataFrame([("f", str(i), c) for i, c in enumerate([0, -1, 1, -1])], "family string, sequence_id string, predicted_cluster int")
    k = spark.createDataFrame([("f", str(i), c) for i, c in enumerate("AABB")], "family string, sequence_id string, known_subfamily string")
    r = evaluation.evaluate_dbscan_with_unique_noise(p, k).first()
    assert (r["noise_count"], r["predicted_clusters_excluding_noise"], r["noise_rate"]) == (2, 2, 0.5)
    assert [x[0] for x in evaluation.unique_noise(p, "predicted_cluster", ["family"], "sequence_id").orderBy("sequence_id").select("predicted_cluster").collect()] == [0, 2, 1, 3]


def test_all_noise_numbers_from_zero_and_has_no_score_without_it(spark):
    p = spark.createDataFrame([("f", str(i), "A", -1) for i in range(3)], "family string, sequence_id string, t string, c int")
    assert {x["c"] for x in evaluation.unique_noise(p, "c", ["family"], "sequence_id").collect()} == {0, 1, 2}
    assert evaluation.dbscan_scores(p, "t", "c", ["family"]).first()["noise_removed_ARI"] is None


def test_incomplete_predictions_raise(spark):
    p = spark.createDataFrame([("f", "a", None)], "family string, sequence_id string, predicted_cluster int")
    k = spark.createDataFrame([("f", "a", "A")], "family string, sequence_id string, known_subfamily string")
    with pytest.raises(ValueError, match="missing values"):
        evaluation.evaluate_clustering(p, k)


def test_choice_takes_least_k_of_equals_and_skips_nan(spark):
    s = spark.createDataFrame([("f", 2, float("nan"), 0.1), ("f", 3, 0.5, 0.2), ("f", 4, 0.5, 0.9), ("f", 5, None, 0.9)], "family string, k int, mean_silhouette double, adjusted_rand_index double")
    r = evaluation.candidate_choice(s, ["family"]).first()
    assert (r["silhouette_k"], r["silhouette_ari"], r["upper_k"], r["upper_ari"]) == (3, 0.2, 4, 0.9)


def test_summary_skips_missing_but_weighted_mean_does_not(spark):
    rows = spark.createDataFrame([(10, 1.0, 0.95), (30, None, 0.4), (60, 0.5, 0.1)], "n_sequences int, a double, b double")
    got = {r["method"]: r for r in evaluation.summarize_methods(rows, {"a": "A", "b": "B"}, subset_name="s").collect()}
    assert got["A"]["n_families"] == 2 and got["A"]["mean_ARI"] == 0.75 and got["A"]["sequence_weighted_mean_ARI"] is None
    assert got["B"]["sequence_weighted_mean_ARI"] == pytest.approx(0.275)
    assert (got["B"]["median_ARI"], got["B"]["Q1"], got["B"]["Q3"]) == (pytest.approx(0.4), pytest.approx(0.25), pytest.approx(0.675))
    assert (got["B"]["ARI_ge_0.9"], got["B"]["ARI_lt_0.5"]) == (1, 2)
    with pytest.raises(ValueError, match="missing columns"):
        evaluation.summarize_methods(rows, {"c": "C"}, subset_name="s")


def test_unique_noise_needs_the_same_ids(spark):
    p = spark.createDataFrame([("f", "a", 0), ("f", "b", -1), ("f", "c", 0)], "family string, sequence_id string, predicted_cluster int")
    k = spark.createDataFrame([("f", "a", "x"), ("f", "b", "x"), ("f", "d", "y")], "family string, sequence_id string, known_subfamily string")
    with pytest.raises(ValueError, match="differ"):
        evaluation.evaluate_dbscan_with_unique_noise(p, k)
    row = evaluation.evaluate_dbscan_with_unique_noise(p, k.withColumn("sequence_id", F.when(F.col("sequence_id") == "d", "c").otherwise(F.col("sequence_id")))).first()
    assert (row["n_sequences"], row["noise_count"]) == (3, 1)


def test_noise_readings_from_one_table_equal_those_from_rows(spark):
    """The closed forms against the definition: noise renumbered row by row, or removed, and scored anew."""
    import random

    rng = random.Random(4)
    rows = [(f, i, rng.choice("AB"), rng.choice([-1, -1, 0, 1])) for f in "pqr" for i in range({"p": 40, "q": 3, "r": 1}[f])] + [("s", i, "A", -1) for i in range(5)]
    df = spark.createDataFrame(rows, "family string, sequence_id int, truth string, cluster int")
    got = {r["family"]: tuple(r)[1:] for r in evaluation.dbscan_scores(df, "truth", "cluster", ["family"]).collect()}
    one = {r["family"]: r["adjusted_rand_index"] for r in evaluation.adjusted_rand(df, "truth", "cluster", ["family"]).collect()}
    two = {r["family"]: r["adjusted_rand_index"] for r in evaluation.adjusted_rand(evaluation.unique_noise(df, "cluster", ["family"], "sequence_id"), "truth", "cluster", ["family"]).collect()}
    kept = {r["family"]: r["adjusted_rand_index"] for r in evaluation.adjusted_rand(df.filter("cluster <> -1"), "truth", "cluster", ["family"]).filter("n_sequences >= 2").collect()}
    for f in "pqrs":
        assert got[f][0] == pytest.approx(one[f]) and got[f][1] == pytest.approx(two[f])
        assert got[f][2] == (pytest.approx(kept[f]) if f in kept else None)


def test_numbering_by_ranges(spark):
    from quillon.operators.numbering import numbered

    rows = [("a", (7 * i) % 100) for i in range(100)] + [("b", 3), (None, 5), (None, 4)]
    df = spark.createDataFrame(rows, "family string, x int").repartition(7)
    got = {(r["family"], r["x"]): r["ord"] for r in numbered(df.filter("family is not null"), ["family"], ["x"]).collect()}
    assert got == {("a", i): i for i in range(100)} | {("b", 3): 0}
    assert [r["n"] for r in numbered(df.filter("family = 'a'"), [], ["x"], "n").orderBy("x").collect()] == list(range(100))
    assert numbered(df.filter("false"), ["family"], ["x"]).count() == 0
