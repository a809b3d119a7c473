"""Square CSVs are checked by line; their cells are looked at one by one only where that leaves a doubt."""

import numpy as np
import pytest

from quillon.sources import readers


def text_of(m, ids=None, heads=None):
    ids = ids or [f"s{n}" for n in range(len(m))]
    return "\n".join(["," + ",".join(heads or ids), *[f"{name}," + ",".join(repr(float(v)) for v in row) for name, row in zip(ids, m, strict=True)]]) + "\n"


@pytest.fixture
def square():
    m = np.random.default_rng(0).normal(size=(600, 600)).round(3)
    return m + m.T


def cells(df):
    return {(r["i"], r["j"], r["src"], r["dst"]): r["distance"] for r in df.collect()}


def test_sound_files_need_no_look_at_cells(spark, square, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "validate_square_matrix", None)
    (tmp_path / "a.csv").write_text(text_of(square[:9, :9]))
    (tmp_path / "b.csv").write_text(text_of(square, [f'"s,{n}"' for n in range(600)]))
    (tmp_path / "c.csv").write_text(text_of([[-0.0]]))
    got = readers.read_matrix_csv(spark, str(tmp_path))
    assert {r["family"]: r["count"] for r in got.groupBy("family").count().collect()} == {"a": 81, "b": 360000, "c": 1}
    assert cells(got.filter("family = 'a'")) == {(i, j, f"s{i}", f"s{j}"): square[i, j] for i in range(9) for j in range(9)}
    assert got.filter("family = 'b' and (src <> concat('s,', i) or dst <> concat('s,', j))").isEmpty()


def bent(m, i, j, by):
    m = m.copy()
    m[i, j] += by
    return m


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda m: text_of(bent(m, 3, 590, 0.5)), "symmetric"),
        (lambda m: text_of(bent(m, 7, 7, np.nan)), "NaN or infinite"),
        (lambda m: text_of(bent(m, 2, 5, np.inf)), "NaN or infinite"),
        (lambda m: text_of(m[:-1]), "square|row and column"),
        (lambda m: text_of(m[:, :-1]), "square"),
        (lambda m: text_of(m, ["a", "a", *map(str, range(598))]), "duplicate"),
        (lambda m: text_of(m, [" ", *map(str, range(599))]), "empty"),
        (lambda m: text_of(m, list(map(str, range(600))), ["1", "0", *map(str, range(2, 600))]), "differ"),
        (lambda m: text_of(m).replace("\ns5,", "\ns5,x", 1), "not a number"),
    ],
)
def test_faults_are_named(spark, square, tmp_path, change, message):
    (tmp_path / "f.csv").write_text(change(square))
    with pytest.raises(Exception, match=message):
        readers.read_matrix_csv(spark, str(tmp_path / "f.csv"))


def test_within_the_tolerance_and_in_other_forms(spark, square, tmp_path):
    """What the lines leave open, the cells decide."""
    m = bent(square[:20, :20], 3, 9, 1e-12)
    (tmp_path / "f.csv").write_text(text_of(m))
    assert cells(readers.read_matrix_csv(spark, str(tmp_path / "f.csv"))) == {(i, j, f"s{i}", f"s{j}"): m[i, j] for i in range(20) for j in range(20)}
    (tmp_path / "g.csv").write_text(",a,b\na, 0.0 ,1d\nb,1.0,0\n")
    assert sorted(cells(readers.read_matrix_csv(spark, str(tmp_path / "g.csv"))).values()) == [0, 0, 1, 1]
