"""Families over the dense size: the same embedding, partitions and silhouettes as in one task, by other means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import kernels
from quillon.operators import clustering, eigen, matrix, tiles
from quillon.session import settled


def affinity_of(spark, x, family="f"):
    d = np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(2)))
    a = 1 - d / d.max()
    np.fill_diagonal(a, 0)
    i, j = (v.ravel() for v in np.indices(a.shape))
    df = spark.createDataFrame([(family, int(r), int(c), f"s{r}", f"s{c}", float(v)) for r, c, v in zip(i, j, a.ravel(), strict=True)], "family string, i int, j int, src string, dst string, affinity double")
    return settled(df), a


def groups(rng, sizes, spread=0.3, dims=3):
    return np.concatenate([rng.normal(rng.normal(0, 3, dims), spread, (n, dims)) for n in sizes])


def test_tiles_hold_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(tiles, "SIDE", 4)
    rng = np.random.default_rng(0)
    m = rng.random((11, 11))
    cells = [(n, i, j, float(m[i, j])) for n in (1, 2) for i in range(11) for j in range(11) if 5 not in (i, j) and not (n == 2 and max(i, j) > 6)]
    t = settled(tiles.tiled(spark.createDataFrame(cells, "node long, i int, j int, affinity double")))
    assert {r["node"]: r["n"] for r in tiles.extents(t).collect()} == {1: 11, 2: 7}
    np.fill_diagonal(m, 0)
    for node, n in ((1, 11), (2, 7)):
        ids, block = tiles.assembled(t.filter(F.col("node") == node).toArrow(), 4)
        assert ids.tolist() == [i for i in range(n) if i != 5] and np.array_equal(block, m[np.ix_(ids, ids)])
    for r in tiles.degrees(t).collect():
        some = [i for i in range(4 * r["b"], 4 * r["b"] + 4) if i < (11, 7)[r["node"] - 1] and i != 5]
        seen = np.frombuffer(r["seen"], bool)
        assert r["members"] == seen.sum() == len(some)
        others = [j for j in range((11, 7)[r["node"] - 1]) if j != 5]
        assert np.frombuffer(r["degree"])[seen] == pytest.approx([m[i, others].sum() for i in some])


def subspace_gap(a, b):
    """The sine of the largest angle between the spans of orthonormal columns."""
    return np.linalg.norm(a - b @ (b.T @ a), 2)


@pytest.fixture(scope="module")
def driver_vectors(spark, sf_dir):
    e = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    points = e.select(F.lit("all").alias("family"), F.col("vec_id").alias("sequence_id"), F.col("embedding").cast("array<double>").alias("vec"))
    edges = settled(matrix.distance_to_affinity(settled(matrix.pairwise_distance(matrix.number_members(points))), checked=False))
    block = np.zeros((edges.filter("i = j").count(),) * 2)
    got = edges.select("i", "j", "affinity").toArrow()
    block[got["i"].to_numpy(), got["j"].to_numpy()] = got["affinity"].to_numpy()
    return edges, block


def test_two_thousand_vectors_without_groups(spark, driver_vectors, monkeypatch):
    """The hardest case: eigenvalues lie close together. Residuals, spans of all prefixes, and the sweep for all k equal the dense ones."""
    edges, block = driver_vectors
    assert len(block) == 2000
    monkeypatch.setattr(clustering, "DENSE", 1000)
    solve, kept = eigen.leading, []
    monkeypatch.setattr(eigen, "leading", lambda *a, **b: kept.append(solve(*a, **b)) or kept[0])
    got = clustering.k_sweep(edges)
    ((blocks, facts),) = kept
    n, values, residuals = facts["all"]
    assert n == 2000 and len(values) == 21 and residuals.max() <= 1e-10
    x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, 20) for r in blocks.orderBy("b").collect()])
    want, root = kernels.spectral_embedding(block, 20), np.sqrt(block.sum(1))[:, None]
    for k in range(1, 21):
        assert subspace_gap(root * x[:, :k], root * want[:, :k]) < 1e-5
    dense = {k: (mean, label, each) for k, mean, _, label, each in clustering.sweep(block, 20, range(2, 21), 0, False)}
    table = got.toArrow().sort_by([("k", "ascending"), ("ord", "ascending")])
    k, cluster, each, mean = (table[c].to_numpy() for c in ("k", "cluster", "silhouette", "mean_silhouette"))
    for at in range(2, 21):
        assert cluster[k == at].tolist() == dense[at][1].tolist(), at
        assert each[k == at] == pytest.approx(dense[at][2], abs=1e-6) and mean[k == at][0] == pytest.approx(dense[at][0], abs=1e-8)


def test_ten_labels_on_both_sides(spark, sf_dir, monkeypatch):
    """Each label of the driver's table as a family: the same partitions for all k, the same choice."""
    e = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    points = e.select(F.col("label").cast("string").alias("family"), F.col("vec_id").alias("sequence_id"), F.col("embedding").cast("array<double>").alias("vec"))
    edges = settled(matrix.distance_to_affinity(settled(matrix.pairwise_distance(matrix.number_members(points))), checked=False))
    order = [("family", "ascending"), ("k", "ascending"), ("ord", "ascending")]
    want = clustering.k_sweep(edges).toArrow().sort_by(order)
    monkeypatch.setattr(clustering, "DENSE", 150)
    got = clustering.k_sweep(edges).toArrow().sort_by(order)
    for c in ("family", "k", "ord", "cluster"):
        assert got[c].to_pylist() == want[c].to_pylist()
    for c in ("silhouette", "mean_silhouette"):
        assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), abs=1e-6)


def test_choice_scores_and_embedding_on_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, block = affinity_of(spark, np.concatenate([rng.normal(c, 0.2, (n, 2)) for c, n in (((0, 0), 19), ((4, 0), 18), ((0, 5), 23))]))
    known = spark.createDataFrame([("f", i, f"s{i}", "ABC"[(i > 18) + (i > 36)]) for i in range(60)], "family string, ord int, sequence_id string, known_subfamily string")
    want = clustering.run_spectral_clustering(a, known)
    monkeypatch.setattr(clustering, "DENSE", 50)
    monkeypatch.setattr(tiles, "SIDE", 16)
    got = clustering.run_spectral_clustering(a, known)
    assert got.selected_k == want.selected_k == 3
    rows = lambda df, *by: [tuple(r) for r in df.orderBy(*by).collect()]
    for one, two in zip(rows(want.candidate_scores, "k"), rows(got.candidate_scores, "k"), strict=True):
        assert two == pytest.approx(one, abs=1e-8)
    pick = ("family", "ord", "sequence_id", "predicted_cluster", "selected_k", "known_subfamily")
    assert rows(got.membership.select(*pick), "ord") == rows(want.membership.select(*pick), "ord")
    vectors = np.array([r["vec"] for r in clustering.spectral_embedding(a, 3).orderBy("ord").collect()])
    assert vectors == pytest.approx(kernels.spectral_embedding(block, 3), abs=1e-8)


def test_lone_members_and_gaps_in_the_ordinals(spark, monkeypatch):
    """Members without affinities count as groups of their own in both forms; ordinals need not be dense."""
    rng = np.random.default_rng(8)
    a, block = affinity_of(spark, groups(rng, (70, 60)))
    lone = a.withColumn("affinity", F.when((F.col("i") == 9) | (F.col("j") == 9), 0.0).otherwise(F.col("affinity"))).withColumns({c: F.col(c) + (F.col(c) > 40).cast("int") * 7 for c in ("i", "j")})
    block[9], block[:, 9] = 0, 0
    monkeypatch.setattr(tiles, "SIDE", 32)
    t = settled(tiles.tiled(lone.withColumnRenamed("family", "node")))
    blocks, facts = eigen.leading(t, lambda n: 5)
    assert facts["f"][0] == 130
    x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, 5)[np.frombuffer(r["seen"], bool)] for r in blocks.orderBy("b").collect()])
    degree = block.sum(1)
    scale = np.where(degree > 0, 1 / np.sqrt(np.where(degree > 0, degree, 1)), 1)
    s = scale[:, None] * block * scale + np.diag((degree == 0).astype(float))
    value, vector = np.linalg.eigh(s)
    assert facts["f"][1] == pytest.approx(value[::-1][:6])
    # two eigenvalues are 1, so only what lies past both is the same
    assert subspace_gap(np.linalg.qr(np.column_stack((vector[:, -1], vector[:, -2], (x / scale[:, None])[:, 1:])))[0], vector[:, ::-1][:, :6]) < 1e-6


def test_no_convergence_is_an_error(spark, driver_vectors, monkeypatch):
    edges, _ = driver_vectors
    few = settled(tiles.tiled(edges.filter("i < 300 and j < 300").withColumnRenamed("family", "node")))
    monkeypatch.setattr(eigen, "CYCLES", 2)
    with pytest.raises(ValueError, match="did not converge"):
        eigen.leading(few, lambda n: 20)


def test_silhouettes_for_all_k_in_one_pass():
    rng = np.random.default_rng(2)
    x, y = rng.random((30, 5)), rng.random((20, 5))
    for k, d in kernels.distances_by_dimension(x, y):
        assert d == pytest.approx(np.sqrt(((x[:, None, :k] - y[None, :, :k]) ** 2).sum(2)))
    assert k == 5


def test_failing_candidates_of_a_large_node(spark):
    """As many clusters as members have no silhouette: the candidate says so, the others stand."""
    rng = np.random.default_rng(4)
    a, _ = affinity_of(spark, groups(rng, (40, 30)))
    t = settled(tiles.tiled(a.withColumnRenamed("family", "node")))
    got = clustering.sweep_large(t, lambda n: 5, lambda n: (2, 3, n), 0)
    assert sorted((r["k"], r["error"], r["n"]) for r in got.groupBy("k", "error").agg(F.count("ord").alias("n")).collect()) == [(2, None, 70), (3, None, 70), (70, "invalid_number_of_clusters", 0)]


@pytest.mark.parametrize("dense", [6000, 150])
def test_points_cluster_as_their_affinities_do(spark, sf_dir, monkeypatch, dense):
    """From points, no affinity is a row or a kept tile; partitions, silhouettes and embeddings are those of the matrix, on both sides of the dense size."""
    monkeypatch.setattr(tiles, "tiled", None)  # points need none
    monkeypatch.setattr(tiles, "SIDE", 64)
    monkeypatch.setattr(clustering, "DENSE", dense)
    e = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/embeddings.parquet").filter("label < 3")
    p = settled(matrix.number_members(e.select(F.col("label").cast("string").alias("family"), F.col("vec_id").alias("sequence_id"), F.col("embedding").cast("array<double>").alias("vec"))))
    known = p.select("family", "sequence_id", (F.col("sequence_id") % 3).cast("string").alias("known_subfamily"))
    found = clustering.run_spectral_clustering(p, known)
    vectors = clustering.spectral_embedding(p, 3).toArrow().to_pandas()
    chosen = {r["family"]: r["selected_k"] for r in found.selected.collect()}
    mine = found.membership.toArrow().to_pandas()
    for family, rows in p.toPandas().sort_values("ord").groupby("family"):
        x = np.stack(rows["vec"])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        a = 1 - d / d.max()
        np.fill_diagonal(a, 0)
        swept = {k: (mean, label, each) for k, mean, _, label, each in clustering.sweep(a, 20, range(2, 21), 0, False)}
        best = max(swept, key=lambda k: (swept[k][0], -k))
        own = mine[mine["family"] == family].sort_values("ord")
        assert chosen[family] == best and own["predicted_cluster"].tolist() == swept[best][1].tolist()
        assert own["silhouette"].to_numpy() == pytest.approx(swept[best][2], abs=1e-6)
        got = np.stack(vectors[vectors["family"] == family].sort_values("ord")["vec"])
        assert got == pytest.approx(kernels.spectral_embedding(a, 3), abs=1e-6)
