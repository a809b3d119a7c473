"""Every registered query with SQL agrees with it on the smallest tables; the others run."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

from quillon.plans.catalogue import QUERIES  # noqa: E402
from quillon.plans.oracles import ORACLES  # noqa: E402


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
        df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert normal(got).equals(normal(want))


#: Queries that SQL can't express, each held against brute force below.
BRUTE = {"global_identity", "local_score", "spectral_embedding", "one_shot", "recursive", "fixed_binary"}


def test_every_query_has_sql_or_brute_force():
    assert set(QUERIES) - set(ORACLES) == BRUTE


def passages(spark, tmp_path, texts):
    path = str(tmp_path / "tables")
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def best_score(a, b, local, first):
    """The best alignment score, cell by cell; a gap of length g costs first + (g - 1) / 2."""
    low = float("-inf")
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e, f = [[low] * (len(b) + 1) for _ in h], [[low] * (len(b) + 1) for _ in h]
    best = 0.0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i and not j:
                continue
            e[i][j] = max(h[i - 1][j] - first, e[i - 1][j] - 0.5) if i else low
            f[i][j] = max(h[i][j - 1] - first, f[i][j - 1] - 0.5) if j else low
            match = h[i - 1][j - 1] + (5 if a[i - 1] == b[j - 1] else -4) if i and j else low
            h[i][j] = max(match, e[i][j], f[i][j], *([0.0] if local else []))
            best = max(best, h[i][j])
    return best if local else h


def identity_of(a, b, h):
    """Identities of all best global alignments: the one that is found must be among them."""
    from functools import cache

    @cache
    def ways(i, j, state):
        if not i or not j:
            return frozenset([(0, 0)])
        out = set()
        if state == "h":
            if h[i][j] == h[i - 1][j - 1] + (5 if a[i - 1] == b[j - 1] else -4):
                out |= {(n + 1, s + (a[i - 1] == b[j - 1])) for n, s in ways(i - 1, j - 1, "h")}
            for g in range(1, i + 1):
                if h[i][j] == h[i - g][j] - 10 - 0.5 * (g - 1):
                    out |= ways(i - g, j, "h")
            for g in range(1, j + 1):
                if h[i][j] == h[i][j - g] - 10 - 0.5 * (g - 1):
                    out |= ways(i, j - g, "h")
        return frozenset(out)

    return {s / n if n else 0.0 for n, s in ways(len(a), len(b), "h")}


def test_alignment_queries_against_all_cells(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    texts = []
    for n in range(16):
        base = list("the quick brown fox jumps over it"[: 20 + n % 4 * 4])
        for at in rng.integers(0, len(base), 6):
            base[at] = str(rng.choice(list("abc \n")))
        texts.append("".join(base)[int(rng.integers(0, 6)) :])
    path, raw = passages(spark, tmp_path, texts), [t.replace("\n", "-").replace(" ", "-") for t in texts]
    pairs = {(i, j) for i in range(16) for j in range(i + 1, 16) if i % 4 == j % 4}
    got = {(r["c1"], r["c2"]): r["score"] for r in QUERIES["local_score"](spark, path).collect()}
    assert got == {(i, j): best_score(raw[i].replace("-", ""), raw[j].replace("-", ""), True, 10.5) for i, j in pairs}
    got = {(r["c1"], r["c2"]): r["identity"] for r in QUERIES["global_identity"](spark, path).collect()}
    assert set(got) == pairs
    for i, j in pairs:
        found = identity_of(raw[i], raw[j], best_score(raw[i], raw[j], False, 10))
        assert any(abs(got[i, j] - x) < 1e-12 for x in found), (i, j)


def test_spectral_queries_against_their_definitions(spark, sf_dir):
    """Eigenvectors of each label's Laplacian; silhouettes, choice and index of the sweep, all from the vectors."""
    import numpy as np

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    families = {}
    for r in e:
        families.setdefault(str(r["label"]), []).append((r["vec_id"], np.array(r["embedding"], float)))
    vectors = {}
    for r in QUERIES["spectral_embedding"](spark, sf_dir).collect():
        vectors.setdefault(r["family"], {})[r["ord"]] = r["vec"]
    chosen = {r["family"]: r for r in QUERIES["one_shot"](spark, sf_dir).collect()}
    assert set(vectors) == set(families) == set(chosen)
    for family, members in families.items():
        x = np.array([v for _, v in members])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        w = 1 - d / d.max()
        np.fill_diagonal(w, 0)
        degree = w.sum(1)
        v = np.array([vectors[family][n] for n in range(len(x))])
        assert v.shape == (len(x), 20)
        random_walk = np.diag(degree) - w  # (D - W) v = value * D v
        values = [(c @ random_walk @ c) / (c @ (degree * c)) for c in v.T]
        assert max(np.abs(random_walk @ c - value * degree * c).max() for c, value in zip(v.T, values, strict=True)) < 1e-8
        want = np.sort(np.linalg.eigvalsh(np.eye(len(x)) - w / np.sqrt(degree[:, None] * degree[None])))[1:21]
        assert np.allclose(values, want, atol=1e-9)
        # the choice: the largest mean silhouette of k-means at every k; the index of its labels
        from quillon.functions import kernels

        scores = {}
        for k in range(2, 21):
            label = kernels.kmeans(v[:, :k], k, 0)
            near = np.sqrt(((v[:, None, :k] - v[None, :, :k]) ** 2).sum(2))
            s = []
            for i in range(len(x)):
                mean = [near[i, (label == c) & (np.arange(len(x)) != i)] for c in range(k)]
                a, b = mean[label[i]], min(m.mean() for c, m in enumerate(mean) if c != label[i])
                s.append(0.0 if not len(a) else (b - a.mean()) / max(b, a.mean()))
            scores[k] = (np.mean(s), label)
        best = max(scores, key=lambda k: (scores[k][0], -k))
        assert chosen[family]["selected_k"] == best
        assert chosen[family]["mean_silhouette"] == pytest.approx(scores[best][0], abs=1e-9)
        label, truth = scores[best][1], np.array([i % 3 for i, _ in members])
        both = lambda m: sum(n * (n - 1) / 2 for n in np.unique(m, return_counts=True)[1])
        agree, l, t, n = both(label * 10 + truth), both(label), both(truth), len(x) * (len(x) - 1) / 2
        assert chosen[family]["adjusted_rand_index"] == pytest.approx((agree - l * t / n) / ((l + t) / 2 - l * t / n), abs=1e-9)


def test_hierarchy_queries_against_planted_groups(spark, tmp_path):
    """Whole passages of two clear groups in family 0, of one group in the others: one split, and the stated reasons."""
    import numpy as np

    rng = np.random.default_rng(6)
    bases = ["".join(rng.choice(list("abcdefgh"), 60)) for _ in range(5)]
    texts = []
    for n in range(32):
        base = list(bases[n % 4] if n % 4 or n < 16 else bases[4])
        base[int(rng.integers(60))] = "z"
        texts.append("".join(base))
    path = passages(spark, tmp_path, texts)
    for name in ("recursive", "fixed_binary"):
        rows = QUERIES[name](spark, path).collect()
        won = [r for r in rows if r["accepted"]]
        assert [(r["family"], r["path"], r["child_sizes"]) for r in won] == [("0", "root", "0:4;1:4")]
        assert {r["family"] for r in rows} == {"0", "1", "2", "3"}
        leaves = {(r["family"], r["path"]): r["rejection_reason"] for r in rows if r["family"] == "0" and r["path"] != "root"}
        assert leaves == {("0", "0"): "too_few_sequences_to_split", ("0", "1"): "too_few_sequences_to_split"}
        for f in "123":
            mine = [r for r in rows if r["family"] == f]
            assert all(r["path"] == "root" and not r["accepted"] and r["rejection_reason"] for r in mine)


def test_entry_points(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cli_parses():
    from quillon.cli import parser

    a = parser().parse_args(["recursive", "--distance", "d", "--labels", "l", "--alignment", "a", "--output", "o"])
    assert (a.command, a.alignment) == ("recursive", "a")
    with pytest.raises(SystemExit):
        parser().parse_args(["recursive", "--distance", "d"])
