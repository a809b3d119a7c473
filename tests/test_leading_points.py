"""Families of points over the dense size, solved from their vectors in one task: no tile is kept, no product is a job."""

import numpy as np
import pytest

from quillon.functions import kernels
from quillon.operators import clustering, eigen, pairs, tiles


def matrix_of(x):
    a = kernels.distances(x, x)
    a = 1 - a / a.max()
    np.fill_diagonal(a, 0)
    return a


@pytest.mark.parametrize("kind", ["plain", "groups", "copies"])
def test_the_vectors_of_the_dense_form(kind):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 12))
    if kind == "groups":
        x[:300] = 0.1 * x[:300] + 4
    if kind == "copies":
        x[100:400] = x[7]
    found, values, residual, top = eigen.solve_points(x, 9)
    assert top == kernels.distances(x, x).max() and residual.max() <= eigen.TOLERANCE
    a = matrix_of(x)
    root = np.sqrt(a.sum(1))[:, None]
    want, most = np.linalg.eigh(a / root / root.T)
    assert values == pytest.approx(want[::-1][:9], abs=1e-12)
    one, two = most[:, ::-1][:, :9], found * root
    assert np.linalg.norm(one - two @ (two.T @ one), 2) < 1e-7


def test_large_families_of_points_need_no_products_as_jobs(spark, monkeypatch):
    monkeypatch.setattr(clustering, "DENSE", 100)
    monkeypatch.setattr(tiles, "SIDE", 64)
    monkeypatch.setattr(eigen, "leading", None)
    monkeypatch.setattr(pairs, "facing", None)
    rng = np.random.default_rng(3)
    sets = {"a": rng.standard_normal((230, 8)), "b": rng.standard_normal((130, 8)), "c": rng.standard_normal((60, 8))}
    p = spark.createDataFrame([(f, i, f"{f}{i}", v.tolist()) for f, x in sets.items() for i, v in enumerate(x)], "family string, ord int, sequence_id string, vec array<double>")
    got = clustering.spectral_embedding(p, 4).toArrow().to_pandas()
    swept = clustering.k_sweep(p).toArrow().to_pandas()
    for f, x in sets.items():
        a = matrix_of(x)
        assert np.stack(got[got["family"] == f].sort_values("ord")["vec"]) == pytest.approx(kernels.spectral_embedding(a, 4), abs=1e-8)
        for k, mean, _, label, each in clustering.sweep(a, 20, range(2, 21), 0, False):
            own = swept[(swept["family"] == f) & (swept["k"] == k)].sort_values("ord")
            assert own["cluster"].tolist() == label.tolist() and own["silhouette"].to_numpy() == pytest.approx(each, abs=1e-6)


def test_points_that_do_not_converge_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(eigen, "CYCLES", 1)
    x = np.random.default_rng(2).standard_normal((300, 64))
    p = spark.createDataFrame([("f", i, v.tolist()) for i, v in enumerate(x)], "node string, ord int, vec array<double>")
    with pytest.raises(Exception, match="did not converge"):
        eigen.leading_of_points(p, lambda n: 20)
