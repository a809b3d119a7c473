import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import kernels as k

LETTERS = st.text(alphabet="ac", max_size=5)


def brute(a, b, local, first, more, match=5, mismatch=-4):
    """The best score over all alignments, written out as moves."""
    found = [0.0] if local else []
    spans = itertools.product(itertools.combinations(range(len(a) + 1), 2), itertools.combinations(range(len(b) + 1), 2)) if local else [((0, len(a)), (0, len(b)))]

    def walk(i, j, score, last, x, y):
        if i == len(x) and j == len(y):
            found.append(score)
            return
        if i < len(x) and j < len(y):
            walk(i + 1, j + 1, score + (match if x[i] == y[j] else mismatch), "m", x, y)
        if i < len(x):
            walk(i + 1, j, score - (more if last == "u" else first), "u", x, y)
        if j < len(y):
            walk(i, j + 1, score - (more if last == "l" else first), "l", x, y)

    for (p, q), (r, s) in spans:
        walk(0, 0, 0.0, "", a[p:q], b[r:s])
    return max(found)


@settings(max_examples=40, deadline=None)
@given(LETTERS.filter(bool), LETTERS.filter(bool))
def test_scores_are_those_of_all_alignments(a, b):
    assert k.global_score(a, b) == brute(a, b, False, 10, 0.5)
    assert k.global_score(a, b, first=2, more=1) == brute(a, b, False, 2, 1)
    assert k.local_score(a, b, first=2, more=1) == brute(a, b, True, 2, 1)
    assert k.global_score(a, b) == k.global_score(b, a)
    assert k.local_score(a, b) == k.local_score(b, a)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="acgt", min_size=1, max_size=30))
def test_identity_with_itself_is_one(s):
    assert k.global_identity(s, s) == 1.0


def test_identity_counts_gap_free_columns():
    assert k.global_identity("", "acgt") == 0.0
    assert k.global_identity("acgt", "acgg") == 0.75
    assert k.global_identity("a" * 20 + "ccccc" + "g" * 20, "a" * 20 + "g" * 20) == 1.0


def test_embedding_solves_the_eigenproblem():
    rng = np.random.default_rng(0)
    w = rng.random((30, 30))
    w = (w + w.T) / 2
    np.fill_diagonal(w, 0)
    d = w.sum(1)
    v = k.spectral_embedding(w, 5)
    lap = np.eye(30) - w / np.sqrt(np.outer(d, d))
    u = v * np.sqrt(d)[:, None]
    for c in range(5):
        value = u[:, c] @ lap @ u[:, c]
        assert np.linalg.norm(lap @ u[:, c] - value * u[:, c]) < 1e-8


def test_kmeans_finds_clear_groups_and_numbers_them_by_first_member():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.05, (20, 2)) for c in (5, 0, 9)])
    label = k.kmeans(x, 3, 0)
    assert label.tolist() == [0] * 20 + [1] * 20 + [2] * 20


def test_silhouettes_by_definition():
    rng = np.random.default_rng(2)
    x, label = rng.random((20, 3)), np.array([0] * 9 + [1] * 10 + [2])
    got = k.silhouettes(x, label)
    for i in range(20):
        gap = np.sqrt(((x - x[i]) ** 2).sum(1))
        same = [gap[j] for j in range(20) if j != i and label[j] == label[i]]
        if not same:
            assert got[i] == 0
            continue
        a, b = np.mean(same), min(gap[label == c].mean() for c in range(3) if c != label[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))
    assert (np.abs(got) <= 1).all()


@settings(max_examples=80, deadline=None)
@given(st.text("acgt", max_size=30), st.text("acgt", max_size=30), st.integers(1, 40))
def test_identity_does_not_depend_on_how_many_rows_are_made_anew(a, b, lot):
    assert k.global_identity(a, b, lot=lot) == k.global_identity(a, b, lot=1000)


def test_identity_of_long_strings_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    a = "".join(rng.choice(list("acgt"), 6000))
    b = "".join(c for c in a if rng.random() > 0.02)
    tracemalloc.start()
    found = k.global_identity(a, b)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found > 0.97 and peak < 12e6  # the table would be 36 MB


def test_letters_are_sorted_as_one_number():
    """The same order and groups as by four columns, also where their bits don't fit."""
    from quillon.operators.sequences import _counted

    rng = np.random.default_rng(6)
    columns = [rng.integers(0, m, 5000) for m in (3, 40, 5, 200)]
    order = np.lexsort(columns[::-1])
    want = np.stack(columns)[:, order]
    first = np.ones(5000, bool)
    first[1:] = (want[:3, 1:] != want[:3, :-1]).any(0)
    for scale in (1, 1 << 20):
        key, new = _counted(*[c * (scale if n != 2 else 1) for n, c in enumerate(columns)])
        assert np.array_equal(key, want * np.array([scale, scale, 1, scale])[:, None]) and np.array_equal(new, first)
