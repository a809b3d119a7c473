"""Matrix files of many families: written by rows, read by line; no cell is shuffled or kept, and results are those of plain edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import checks, matrix, pairs
from quillon.plans.catalogue import QUERIES
from quillon.session import settled
from quillon.sources import readers, writers


def points_of(spark, sizes, name="s{f}_{n}"):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(f, n, name.format(f=f, n=n), rng.normal(size=5).tolist()) for f, size in sizes.items() for n in range(size)], "family string, ord int, sequence_id string, vec array<double>")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    """Blocks of four members, at most three rows a task, lots of two rows."""
    monkeypatch.setattr(pairs, "SIDE", 4)
    monkeypatch.setattr(pairs, "ROWS", 3)
    monkeypatch.setattr(pairs, "STRIP", 26)


def test_rows_in_order(spark, small):
    points = points_of(spark, {"a": 13, "b": 1, "c": 6})
    found = pairs.rows(pairs.packed(points)).collect()
    assert [(r["family"], r["i"]) for r in found] == sorted((f, i) for f, n in {"a": 13, "b": 1, "c": 6}.items() for i in range(n))
    assert all((r["ids"] is not None) == (r["i"] == 0) for r in found)
    assert {r["family"]: r["ids"] for r in found if r["ids"]} == {f: [f"s{f}_{n}" for n in range(k)] for f, k in {"a": 13, "b": 1, "c": 6}.items()}
    cells = {(r["family"], r["i"], j, r["src"]): d for r in found for j, d in enumerate(r["distances"])}
    assert cells == {(r["family"], r["i"], r["j"], r["src"]): r["distance"] for r in matrix.pairwise_distance(points).collect()}


def test_files_in_parts(spark, small, tmp_path):
    """A family's parts follow each other by name; ids with quotes, commas and blanks come back."""
    points = points_of(spark, {"a": 13, "b": 1, "c": 6}, 's "{n}", {f}')
    want, made = rows(matrix.pairwise_distance(points)), pairs.rows(pairs.packed(points))
    writers.write_matrix_rows(made, str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv/family=a").glob("part-*"))) > 2
    assert rows(readers.read_matrix_csv(spark, str(tmp_path / "csv"))) == want
    plain = points.withColumn("sequence_id", F.translate("sequence_id", ' ",', "_"))
    writers.write_mldist_rows(pairs.rows(pairs.packed(plain)), str(tmp_path / "mldist"))
    assert rows(readers.read_mldist(spark, str(tmp_path / "mldist"))) == rows(matrix.pairwise_distance(plain))


@pytest.mark.parametrize("query", ["scan_mldist", "matrix_csv", "published_names"])
def test_no_cell_is_kept_or_shuffled(spark, sf_dir, monkeypatch, query):
    kept, plans = [], []

    def watched(df):
        found = settled(df)
        kept.append(found.count())
        plans.append(df._jdf.queryExecution().toString())
        return found

    for module in (readers, pairs, checks):
        monkeypatch.setattr(module, "settled", watched)
    found = QUERIES[query](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and " hashpartitioning" not in plan.split("Generate")[0] and max(kept) < 1000 < found.count()


def test_lines_that_are_alike_keep_their_places(spark, tmp_path):
    (tmp_path / "f.mldist").write_text("3\na 0 0 0\na 0 0 0\nb 0 0 0\n")
    got = readers.scan_mldist(spark, str(tmp_path / "f.mldist"))
    assert [(r["i"], r["j"], r["src"], r["dst"]) for r in got.orderBy("i", "j").collect()] == [(i, j, "aab"[i], "aab"[j]) for i in range(3) for j in range(3)]


def test_changed_files_are_an_error(spark, tmp_path):
    path = tmp_path / "f.mldist"
    path.write_text("1\na 0\n")
    got = readers.scan_mldist(spark, str(path))
    path.write_text("1\nb 0\n")
    with pytest.raises(Exception, match="changed|FAILED_READ_FILE"):
        got.collect()


def test_asymmetric_cells_by_sums(spark):
    """Differences within and beyond the tolerance, infinite values, repeated cells that a parity would miss."""
    edges = matrix.pairwise_distance(points_of(spark, {"a": 9, "b": 4})).select("family", "i", "j", "distance")
    assert checks.asymmetric(edges).isEmpty()
    change = F.when(F.expr("family = 'a' and i = 2 and j = 7"), F.col("distance") + 0.5).when(F.expr("family = 'b' and i = 1 and j = 3"), F.col("distance") + 1e-12).when(F.expr("family = 'a' and i = 1 and j = 1"), float("inf"))
    bent = settled(edges.withColumn("distance", F.coalesce(change, "distance")))
    assert {(r["family"], r["i"], r["j"]) for r in checks.asymmetric(bent).collect()} == {("a", 2, 7), ("a", 7, 2), ("a", 1, 1)}
    twice = spark.createDataFrame([("f", 0, 1, 1.0)] * 2 + [("f", 1, 0, 2.0)] * 2, "family string, i int, j int, distance double")
    assert checks.asymmetric(twice).count() == 8
