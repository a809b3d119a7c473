import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import checks, clustering, matrix
from quillon.operators.recursion import RecursiveConfig


def edges(spark, m, names="abcdef", family="f"):
    return spark.createDataFrame([(family, i, j, names[i], names[j], float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "family string, i int, j int, src string, dst string, distance double")


GOOD = [[0, 1, 4], [1, 0, 2], [4, 2, 0]]


def test_affinity_scales_and_zeroes_the_diagonal(spark):
    got = {(r["src"], r["dst"]): r["affinity"] for r in matrix.distance_to_affinity(edges(spark, GOOD)).collect()}
    assert (got["a", "b"], got["a", "c"], got["b", "c"], got["a", "a"]) == (0.75, 0.0, 0.5, 0.0)


def test_affinity_needs_a_positive_distance(spark):
    with pytest.raises(ValueError, match="greater than zero"):
        matrix.distance_to_affinity(edges(spark, [[0, 0], [0, 0]]))


@pytest.mark.parametrize(
    ("m", "options", "message"),
    [
        ([[0, 1, 4], [1, 0, 2]], {}, "square"),
        ([[0, float("nan")], [1, 0]], {}, "NaN or infinite"),
        ([[0, float("inf")], [1, 0]], {}, "NaN or infinite"),
        ([[0, -1], [-1, 0]], {"nonnegative": True}, "negative"),
        ([[0, 1], [1.001, 0]], {}, "symmetric"),
    ],
)
def test_matrix_rules(spark, m, options, message):
    with pytest.raises(ValueError, match=message):
        checks.validate_square_matrix(edges(spark, m), **options)


def test_matrix_rules_on_names(spark):
    good = edges(spark, GOOD)
    assert checks.validate_square_matrix(good).count() == 9
    with pytest.raises(ValueError, match="duplicate"):
        checks.validate_square_matrix(edges(spark, GOOD, "aab"))
    with pytest.raises(ValueError, match="empty sequence"):
        checks.validate_square_matrix(edges(spark, GOOD, "a b"))
    with pytest.raises(ValueError, match="differ"):
        checks.validate_square_matrix(good.withColumn("src", F.when(F.col("src") == "a", "z").otherwise(F.col("src"))))
    with pytest.raises(ValueError, match="no sequence"):
        checks.validate_square_matrix(good.filter("i > 9"))
    assert checks.validate_square_matrix(edges(spark, [[0, 1], [1 + 1e-11, 0]])) is not None


def ids(spark, names, family="f"):
    return spark.createDataFrame([(family, n, s) for n, s in enumerate(names)], "family string, ord int, sequence_id string")


def test_sequence_ids(spark):
    ref = ids(spark, "abc")
    checks.validate_sequence_ids(ref, ("labels", ids(spark, "abc")))
    checks.validate_sequence_ids(ref, ("labels", ids(spark, "cba")), require_same_order=False)
    with pytest.raises(ValueError, match="labels sequence ID order"):
        checks.validate_sequence_ids(ref, ("labels", ids(spark, "cba")))
    with pytest.raises(ValueError, match="labels sequence IDs differ"):
        checks.validate_sequence_ids(ref, ("labels", ids(spark, "abd")))


def test_labels(spark):
    make = lambda rows: spark.createDataFrame(rows, "family string, ord int, sequence_id string, known_subfamily string")
    good = make([("f", 0, "b", "X"), ("f", 1, "a", "Y")])
    checks.validate_labels(good)
    assert [r["known_subfamily"] for r in checks.align_labels(good, ids(spark, "ab")).orderBy("ord").collect()] == ["Y", "X"]
    with pytest.raises(ValueError, match="missing values"):
        checks.validate_labels(make([("f", 0, "a", None)]))
    with pytest.raises(ValueError, match="lacks columns"):
        checks.validate_labels(good.drop("known_subfamily"))
    with pytest.raises(ValueError, match="differ"):
        checks.align_labels(good, ids(spark, "abc"))
    with pytest.raises(ValueError, match="duplicate"):
        checks.align_labels(good.union(good), ids(spark, "ab"))


def test_alignment(spark):
    make = lambda rows: spark.createDataFrame([("f", n, *r) for n, r in enumerate(rows)], "family string, ord int, sequence_id string, seq string")
    checks.validate_alignment(make([("a", "ac"), ("b", "--")]))
    with pytest.raises(ValueError, match="differ in length"):
        checks.validate_alignment(make([("a", "ac"), ("b", "-")]))
    with pytest.raises(ValueError, match="no records"):
        checks.validate_alignment(make([("a", "a")]).filter("ord > 5"))


def test_family_sets(spark):
    fam = lambda *x: spark.createDataFrame([(f,) for f in x], "family string")
    checks.validate_family_sets(fam("1", "2"), {"tree": fam("2", "1"), "annotation": fam("1", "2", "3"), "family_metadata": fam("9")}, 2)
    with pytest.raises(ValueError, match="family sets differ"):
        checks.validate_family_sets(fam("1", "2"), {"tree": fam("1")})
    with pytest.raises(ValueError, match="expected 3"):
        checks.validate_family_sets(fam("1", "2"), {}, 3)


@pytest.mark.parametrize("bad", [{"minimum_cluster_size": 0}, {"consensus_similarity_threshold": 1.5}, {"reassignment_accuracy_threshold": -1}, {"max_depth": -1}, {"top_k_candidates": 0}, {"global_k_max": 1}, {"random_state": -1}])
def test_config_ranges(bad):
    with pytest.raises(ValueError, match=next(iter(bad))):
        RecursiveConfig(**bad)


def test_small_families_cannot_be_clustered(spark):
    with pytest.raises(ValueError, match="at least 4"):
        clustering.run_spectral_clustering(matrix.distance_to_affinity(edges(spark, GOOD)))


def test_affinities_must_be_symmetric_and_not_negative(spark):
    good = matrix.distance_to_affinity(edges(spark, [[0, 1, 2, 3], [1, 0, 2, 3], [2, 2, 0, 3], [3, 3, 3, 0]], list("abcd")))
    bend = lambda x: good.withColumn("affinity", F.when((F.col("i") == 0) & (F.col("j") == 1), x).otherwise(F.col("affinity")))
    with pytest.raises(ValueError, match="symmetric"):
        clustering.run_spectral_clustering(bend(F.col("affinity") + 0.5))
    with pytest.raises(ValueError, match="negative"):
        clustering.run_spectral_clustering(good.withColumn("affinity", F.when(F.col("i") != F.col("j"), -F.col("affinity") - 1).otherwise(0.0)))


def test_text_functions(spark):
    df = spark.createDataFrame([(True, "x|3", [1, 0]), (False, "x|y", []), (None, "7", None)], "b boolean, s string, p array<int>")
    got = df.select(text.truthy("b"), text.subject_cluster("s"), text.path_label("p"), text.truthy(F.lit(" TRUE ")), text.truthy(F.lit("1"))).collect()
    assert [tuple(r) for r in got] == [(True, 3, "1-0", True, False), (False, None, "root", True, False), (False, 7, None, True, False)]
