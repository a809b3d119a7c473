"""K-means block by block against the same steps in one place."""

import numpy as np
import pytest

from quillon.functions import kernels
from quillon.operators import clustering, means, tiles
from tests.test_large import affinity_of, groups


def blocks_of(spark, nodes, side):
    """Blocks of the points of each node; every seventh row is of no member."""
    rows = []
    for node, x in nodes.items():
        seen = np.zeros(len(x) * 7 // 6 + 2, bool)
        seen[np.flatnonzero(np.arange(len(seen)) % 7 != 3)[: len(x)]] = True
        held = np.full((len(seen), x.shape[1]), 99.0)
        held[seen] = x
        rows += [(node, b, seen[a : a + side].tobytes(), held[a : a + side].tobytes()) for b, a in enumerate(range(0, len(seen), side))]
    return spark.createDataFrame([(n, b, bytearray(s), bytearray(x)) for n, b, s, x in rows], "node string, b int, seen binary, x binary")


def labels_of(found, node, k):
    rows = sorted((r["b"], r["labels"]) for r in found if (r["node"], r["k"]) == (node, k))
    return np.concatenate([np.frombuffer(x, np.int32) for _, x in rows]).tolist()


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_partitions_equal_those_in_one_place(spark, monkeypatch, spread):
    monkeypatch.setattr(means, "BLOCKS", 2)
    rng = np.random.default_rng(1)
    nodes = {"a": groups(rng, (50, 40, 61), spread, 4), "b": groups(rng, (30, 20), spread, 3)}
    tried = {"a": [2, 3, 4, 6], "b": [2, 5]}
    got = means.partitions(blocks_of(spark, nodes, 16), {n: x.shape[1] for n, x in nodes.items()}, tried, 7).collect()
    for node, some in tried.items():
        for k in some:
            assert labels_of(got, node, k) == kernels.kmeans(nodes[node][:, :k], k, 7).tolist(), (node, k)


def test_fewer_places_than_clusters(spark):
    """Repeated points: all distances reach zero before all centres are drawn, and clusters stay empty."""
    x = np.repeat(np.array([[0.0, 0], [0, 5], [7, 1]]), (9, 8, 4), axis=0)
    same = np.zeros((12, 2))
    got = means.partitions(blocks_of(spark, {"x": x, "same": same}, 8), {"x": 2, "same": 2}, {"x": [2, 3, 5], "same": [2]}, 0).collect()
    for k in (2, 3, 5):
        assert labels_of(got, "x", k) == kernels.kmeans(x[:, :k], k, 0).tolist()
    assert {r["error"] for r in got if r["node"] == "same"} == {"invalid_number_of_clusters"}


def test_as_many_clusters_as_members_is_an_error(spark):
    x = np.random.default_rng(0).random((9, 3))
    got = means.partitions(blocks_of(spark, {"x": x}, 8), {"x": 3}, {"x": [2, 9]}, 0).collect()
    assert {(r["k"], r["error"]) for r in got} == {(2, None), (9, "invalid_number_of_clusters")}
    assert all(r["labels"] is None for r in got if r["k"] == 9)


def test_an_empty_cluster_takes_the_farthest_points(spark):
    """Two centres on one point: Lloyd's first round leaves a cluster empty."""
    x = np.concatenate([np.zeros((20, 1)), [[1.0]], [[3.0]], [[3.0]]])
    runs = {0: means.Run("x", 3, 0, np.zeros((2, 3)), 1, np.array([[0.0], [0.0], [1.0]]))}
    far = means._farthest(blocks_of(spark, {"x": x}, 8), {"x": 1}, runs, {0: 2})
    assert far[0].ravel().tolist() == [3.0, 3.0]


def test_no_task_and_no_partition_holds_all_points(spark, monkeypatch):
    """Blocks of a task follow BLOCKS, whatever the number of members; the sweep beyond POINTS equals the dense one."""
    rng = np.random.default_rng(3)
    a, block = affinity_of(spark, groups(rng, (40, 45, 38)))
    monkeypatch.setattr(clustering, "DENSE", 50)
    monkeypatch.setattr(clustering, "POINTS", 50)
    monkeypatch.setattr(tiles, "SIDE", 16)
    monkeypatch.setattr(means, "BLOCKS", 2)
    points, split = [], means.settled
    monkeypatch.setattr(means, "settled", lambda df: points.append(split(df)) or points[-1])
    got = clustering.k_sweep(a).toArrow().sort_by([("k", "ascending"), ("ord", "ascending")])
    assert points[0].rdd.getNumPartitions() == 4
    k, cluster, each = (got[c].to_numpy() for c in ("k", "cluster", "silhouette"))
    for at, _, _, label, values in clustering.sweep(block, 20, range(2, 21), 0, False):
        assert cluster[k == at].tolist() == label.tolist(), at
        assert each[k == at] == pytest.approx(values, abs=1e-6)
