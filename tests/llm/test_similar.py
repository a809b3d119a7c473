from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillon.llm import ann, graph, itq, simhash


def least_reachable(n, links):
    """The least place that each place reaches."""
    label = list(range(n))
    while True:
        new = label[:]
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=60))))
def test_forest(case):
    n, links = case
    a, b = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
    assert graph.forest(a, b, n).tolist() == least_reachable(n, links)


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, int(x)) for x in range(201, 230)] + [tuple(map(int, rng.integers(300, 340, 2))) for _ in range(25)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = least_reachable(400, links)
    assert got == {i: want[i] for i in {x for p in links if p[0] != p[1] for x in p}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_same_key_pairs():
    keys = np.sort(np.random.default_rng(1).integers(0, 5, 40))
    got = {(int(i), int(j)) for a, b in graph.same_key_pairs(keys, step=16) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if keys[i] == keys[j]}


def plain_fingerprint(text, width):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    hashes = [xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÉ \n\t.", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.shingle_hashes(text, 3)) == plain_fingerprint(text, 3)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6), st.lists(st.lists(st.floats(0, 100), min_size=1, max_size=5), min_size=1, max_size=6))
def test_allotment_is_the_cheapest(radius, costs):
    import itertools

    options = [x for x in itertools.product(*[range(len(c)) for c in costs]) if sum(x) == radius + 1]
    if not options:
        with pytest.raises(ValueError, match="no allotment"):
            simhash.allot(costs, radius)
        return
    got = simhash.allot(costs, radius)
    price = lambda x: sum(c[i] for c, i in zip(costs, x, strict=True))
    assert sum(t + 1 for t in got) == radius + 1
    assert price([t + 1 for t in got]) == pytest.approx(min(map(price, options)))


@pytest.mark.parametrize(("radius", "rows"), [(0, 10), (3, 10), (3, 10**6), (7, 10**6), (12, 10**5)])
def test_index_is_exact(radius, rows):
    """Any two within the radius share some partition within its threshold."""
    rng = np.random.default_rng(2)
    index = simhash.choose_index(rng.integers(0, 1 << 63, 500), rows, radius)
    assert sum(t + 1 for _, t in index) == radius + 1
    used = [b for bits, _ in index for b in bits]
    assert len(used) == len(set(used))


def test_groups_by_fingerprint(spark, monkeypatch):
    """Random fingerprints in chains and dense balls, hot values split into cells, against all pairs."""
    monkeypatch.setattr(simhash, "CELL", 40)
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    for _ in range(250):
        x = fps[int(rng.integers(len(fps)))]
        for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64)
    got = graph.components(simhash.similar(spark.createDataFrame([(int(x),) for x in signed], "fp long"), 3))
    label = {r["node"]: r["component"] for r in got.collect()}
    u = np.array(fps, np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None]) <= 3, 1))
    want = least_reachable(len(fps), list(zip(i.tolist(), j.tolist(), strict=True)))
    groups = {}
    for n, w in enumerate(want):
        groups.setdefault(w, set()).add(label.get(int(signed[n]), int(signed[n])))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_op7_on_documents(documents, odd_documents, no_documents):
    for docs in (documents, odd_documents):
        rows = sorted({(r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] is not None})
        fps = np.array([plain_fingerprint(t, 3) for _, t in rows], np.uint64)
        i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3, 1))
        want = least_reachable(len(rows), list(zip(i.tolist(), j.tolist(), strict=True)))
        least = {n: min(rows[m][0] for m in range(len(rows)) if want[m] == want[n]) for n in range(len(rows))}
        got = {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in simhash.group_documents(docs.filter("doc_id is not null")).collect()}
        assert got == {(rows[n][0], int(fps[n])): least[n] for n in range(len(rows))}
    assert simhash.group_documents(odd_documents).count() == odd_documents.count()
    assert simhash.group_documents(no_documents).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), max_size=8), min_size=1, max_size=12))
def test_jaccard_links(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    i, j = simhash.jaccard_links(arrays, 0.5, step=3)
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_near_groups_against_all_pairs(spark, monkeypatch, documents):
    monkeypatch.setattr(simhash, "GROUP_CELL", 5)
    base = documents.filter("n_chars > 400 and n_chars < 3000").limit(40).collect()
    rng, rows = np.random.default_rng(4), []
    for r in base:
        for _ in range(1 + int(rng.integers(0, 9))):
            words = r["text"].split()
            for at in rng.integers(0, len(words), int(len(words) * rng.choice([0, 0.005, 0.01, 0.05]))):
                words[at] = f"z{int(rng.integers(1000))}"
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    docs = spark.createDataFrame(rows, documents.schema)
    sets = [set(simhash.shingle_hashes(r[1], 5).tolist()) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = least_reachable(len(rows), links)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    right = sum(got[n] == want[n] for n in range(len(rows)))
    assert all(want[n] == want[g] for n, g in got.items())  # nothing joined that should not be
    assert right >= 0.97 * len(rows)
    kept = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    assert kept == {n for n, g in got.items() if n == g}


def test_equal_fingerprints_are_not_equal_texts(spark, no_documents):
    """A line repeated often sets all bits of a fingerprint; what else the documents hold still counts."""
    rng = np.random.default_rng(8)
    rows = [(n, "one line that is repeated " * 200 + " ".join(f"w{int(x)}" for x in rng.integers(0, 1 << 40, 200)), "en", "s", 1) for n in range(4)]
    docs = spark.createDataFrame(rows, no_documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert {r["doc_id"] for r in simhash.keep_first(docs).collect()} == {0, 1, 2, 3}


def test_near_copies_with_repeats_are_found(spark, no_documents):
    """Copies that differ in how often a line or a word is repeated have nearly one set of shingles."""
    rng, rows = np.random.default_rng(9), []
    for n in range(0, 8, 2):
        text = " ".join(f"w{int(x)}" for x in rng.integers(0, 1 << 40, 200))
        more = " one line that is repeated" * 50 if n < 4 else " junk" * 300
        rows += [(n, text, "en", "s", 1), (n + 1, text + more, "en", "s", 1)]
    docs = spark.createDataFrame(rows, no_documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert {r["doc_id"] for r in simhash.keep_first(docs).collect()} == {0, 2, 4, 6}


def test_near_groups_beyond_the_radius(spark, no_documents):
    """Pairs at similarity 0.8 whose fingerprints lie beyond NEAR_RADIUS are found too."""
    rng, rows, beyond = np.random.default_rng(10), [], 0
    while beyond < 8:
        # 20 words at the end out of 200 differ: 176 of 216 shingles are common
        words = [f"w{int(x)}" for x in rng.integers(0, 1 << 40, 220)]
        pair = [" ".join(words[:200]), " ".join(words[:180] + words[200:])]
        a, b = (simhash.shingle_hashes(t, 5) for t in pair)
        assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > simhash.NEAR_RADIUS:
            rows += [(2 * beyond + n, t, "en", "s", 1) for n, t in enumerate(pair)]
            beyond += 1
    docs = spark.createDataFrame(rows, no_documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()} == {n: n // 2 * 2 for n in range(16)}


@pytest.mark.parametrize("n", [5, 60, 1000])
def test_bands_share_as_many_values_as_similarity_says(n):
    """Sets at similarity 0.8: the mean count of common bands and of other sketch bits, within 6 standard errors."""
    rng, trials, same, other = np.random.default_rng(n), 300, [], []
    for _ in range(trials):
        u = rng.integers(0, 1 << 63, n).astype(np.uint64)
        value, sketch = simhash.bands(np.stack([simhash.minima(u), simhash.minima(u[: n * 4 // 5])]))
        same.append(int((value[0] == value[1]).sum()))
        other.append(int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()))
    p = 0.8**simhash.ROWS
    assert abs(np.mean(same) - simhash.BANDS * p) <= 6 * np.sqrt(simhash.BANDS * p * (1 - p) / trials) and min(same) > 0
    assert abs(np.mean(other) - 32) <= 6 * np.sqrt(320 * 0.1 * 0.9 / trials) and max(other) <= simhash.SKETCH_MOST


def test_keep_first_of_odd_documents(odd_documents, no_documents):
    odd = odd_documents.withColumnRenamed("size", "a.size").withColumn("first", F.lit(1)).withColumn("text_hash", F.lit("x"))
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    # null ids stay; 1 and 2 are both empty; 3 has two rows alike and another text; 4 is 3 but for case and spaces, 6 is a copy of 5
    assert ids == {None: 1, 1: 1, 3: 2, 5: 1, 7: 1}
    assert simhash.keep_first(no_documents).count() == 0


def test_texts_under_one_id_and_repeated_shingles_survive(spark, no_documents):
    """Unlike documents under one id, and unlike ones that share one shingle in over half of their places, all stay."""
    rng = np.random.default_rng(12)
    other = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 1 << 40, n))
    texts = ["spam " * 700 + other(500) for _ in range(2)] + [other(300) for _ in range(3)]
    ids = [1, 2, 3, 3, 3]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts, strict=True)], no_documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert Counter(r["text"] for r in simhash.keep_first(docs.union(docs.limit(1))).collect()) == Counter(texts)


def test_large_loose_groups_move_their_texts_few_times(spark, monkeypatch, no_documents):
    """A group of near copies with stragglers: exact clusters, and far fewer texts moved than all pairs of blocks would."""
    monkeypatch.setattr(simhash, "GROUP_CELL", 10)
    rng, base, rows = np.random.default_rng(13), [f"w{n}" for n in range(300)], []
    for n in range(300):
        words = list(base)
        for at in rng.choice(300, 3 if n % 30 else 16, replace=False):  # every thirtieth lies near 0.8 of the others or beyond
            words[at] = f"z{int(rng.integers(1 << 30))}"
        rows.append((n, " ".join(words), "en", "s", 1))
    docs = spark.createDataFrame(rows, no_documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
    sets = [simhash.shingle_hashes(r[1], 5) for r in rows]
    links = [(a, b) for a in range(300) for b in range(a + 1, 300) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    want = least_reachable(300, links)
    assert len(set(want)) > 1
    seen = spark.sparkContext.accumulator(0)
    plain = simhash._compare

    def counted(t, *rest):
        seen.add(t.num_rows)
        return plain(t, *rest)

    monkeypatch.setattr(simhash, "_compare", counted)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()} == dict(enumerate(want))
    assert seen.value < 300 * (1 + simhash.LEADERS + 300 / 10 / 3)


# ---- vectors


def vectors(spark, n=400, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(n // 2, n):  # half lie near an earlier one
        j = int(rng.integers(n // 2))
        x[i] = x[j] + rng.normal(size=dim) * np.linalg.norm(x[j]) / np.sqrt(dim) * rng.choice([0, 0.1, 0.3])
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    odd = [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [float("nan")] * dim, 0), (n + 3, [1.0] * (dim - 1) + [None], 0), (n + 4, [float("inf")] * dim, 0), (n + 20, [], 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), x.astype(np.float64)


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "DATA_BLOCK", 150)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    df, x = vectors(spark)
    got = {}
    for r in ann.search(df, every=20, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, len(x), 20))
    hits = 0
    for q, found in got.items():
        score = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        hits += len({i for i, _ in found} & set(order))
        assert all(s == pytest.approx(score[i], rel=1e-12) for i, s in found) and len(found) == 20
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits >= 0.98 * 20 * len(got)


def test_search_of_few_or_none(spark):
    df, x = vectors(spark, n=10)
    got = ann.search(df, every=20, k=20).collect()
    assert {r["query_id"] for r in got} == {0} and sorted(r["vec_id"] for r in got) == list(range(1, 10))
    assert ann.search(df.filter("vec_id = 0"), every=20).count() == 0
    assert ann.search(df.filter("false")).count() == 0


def test_estimates_and_bounds():
    for dim in (64, 100):
        rng = np.random.default_rng(5)
        x, q, turn = rng.normal(size=(3000, dim)), rng.normal(size=(5, dim)), ann.rotation(dim)
        assert np.allclose(turn @ turn.T, np.eye(dim))
        coded = ann.OneBitCodes.of(x, turn)
        assert coded.words.shape == (-(-dim // 64), 3000) and coded.words.dtype.itemsize == 8
        for query in q:
            guess, shift = coded.estimate(query, turn)
            signs = np.where(x @ turn > 0, 1.0, -1.0)
            exact = signs @ (query @ turn) / np.sqrt(dim) * coded.scale  # of the query before it is rounded
            assert (np.abs(guess - exact) <= 2.5 * shift * coded.scale + 1e-9).mean() > 0.97
            off = guess - x @ query
            assert abs(off.mean()) < 0.4
            assert (np.abs(off) > 2.5 * (np.linalg.norm(query) * coded.error + shift * coded.scale)).mean() < 0.02


def test_search_takes_lengths_repeats_ties_and_clashing_names(spark):
    v = [1.0, 0.5, 0.0], [2.0, 1.0, 0.0], [1.0, 1.0]
    rows = [(0, v[0]), (1, v[1]), (2, v[1]), (3, v[2]), (4, v[2]), (20, v[2]), (0, v[1]), (None, v[0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame([(i, x, i, "q", 1.0, 2) for i, x in rows], "vec_id long, embedding array<float>, query_id long, words string, score double, dim int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, every=20, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.5), (0, 2, 2, 2.5), (20, 1, 3, 2.0), (20, 2, 4, 2.0)]


def test_near_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(itq, "CELL", 60)
    df, x = vectors(spark, seed=6)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    want, count = least_reachable(len(x), list(zip(i.tolist(), j.tolist(), strict=True))), Counter([*i.tolist(), *j.tolist()])
    got = {r["vec_id"]: r for r in itq.near_duplicates(df).collect()}
    assert len(got) == len(x) + 6
    links = sum(r["n_links"] for r in got.values())
    assert 0.97 * sum(count.values()) <= links <= sum(count.values())
    assert sum(got[n]["component_id"] == want[n] for n in range(len(x))) >= 0.98 * len(x)
    assert all(got[n]["n_links"] == 0 and got[n]["kept"] for n in got if n >= len(x))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_vectors_of_several_lengths_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [5.0, 0.0, 0.0]), (5, [0.0, 1.0]), (None, [0.0, 2.0]), (5, [0.0, 1.0])]
    df = spark.createDataFrame([(i, x, 1, 2, 3, "x") for i, x in rows], "vec_id long, embedding array<float>, id long, n int, component long, a string")
    got = sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in itq.near_duplicates(df).collect()))
    assert got == [(-1, 2, 5), (1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 2, 5), (5, 2, 5)]


@pytest.mark.parametrize("rows", [1 << 10, 1 << 22, 1 << 30])
def test_every_shape_counts_each_link_once(rows, monkeypatch):
    """Recall of pairs at exactly 0.9, by the entries that two classes share, for the shapes of small and large tables."""
    rotations, tables, width = itq.shape(rows, 64)
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    y = 0.9001 * x + np.sqrt(1 - 0.9001**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    both = np.concatenate((x, y))
    learned = [itq.learn_rotation(rng.normal(size=(2000, 64)), width * tables, 5 + r, rounds=5) for r in range(rotations)]
    code = np.stack([itq.codes(both, *m) for m in learned], 1)
    near, step, rest = itq.small(both)
    exact = (both[:300] * both[300:]).sum(1)
    assert (np.abs((near[:300].astype(float) * near[300:]).sum(1) * step[:300] * step[300:] - exact) <= rest[:300] * (1 + rest[300:]) + rest[300:]).all()
    rows_ = []
    for t in range(rotations * tables):
        own = (code[:, t // tables] >> np.uint64(t % tables * width)) & np.uint64((1 << width) - 1)
        for flip in [0, *(1 << b for b in range(width))]:
            rows_ += [(t, int(own[i]) ^ flip, 0, 0, 0, i, 1, code[i].tobytes(), near[i].tobytes(), step[i], rest[i]) for i in range(600)]
    pdf = pd.DataFrame(rows_, columns=["tab", "value", "low", "high", "block", "id", "n", "codes", "near", "step", "rest"])
    # a bound of 0.88 decides every pair here, 0.9001 none
    sure, unsure = itq._link(pdf, width, tables, itq.RADIUS, 0.87), itq._link(pdf, width, tables, itq.RADIUS, 0.9001)
    counted = sure[sure["kind"] == itq.COUNT]["b"]
    assert (counted == 1).all() and len(counted) >= 0.95 * 600
    pairs = unsure[unsure["kind"] == itq.OPEN]
    assert len(pairs) == len(pairs.drop_duplicates()) == len(counted) // 2


def test_copies_and_empty_tables_of_vectors(spark):
    df, _ = vectors(spark, n=4)
    five = df.filter("vec_id = 2").withColumn("vec_id", F.explode(F.array([F.lit(x).cast("long") for x in (9, 8, 7, 2, 11)])))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq.near_duplicates(five).collect()}
    assert got == {v: (4, 2) for v in (9, 8, 7, 2, 11)}
    assert itq.near_duplicates(df.filter("false")).count() == 0
    assert itq.near_duplicates(df.filter("vec_id > 3")).filter("n_links > 0 or not kept").count() == 0


def test_the_search_by_similarity_is_the_same_at_any_size(spark, monkeypatch):
    """The radius handed to the search doesn't follow the number of rows, however large it is said to be."""
    seen = []
    search = simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda classes, radius=3, rows=None, *a, **b: seen.append(radius) or search(classes, radius, rows, *a, **b))
    kept = simhash.stored

    class Many:
        """A table that says it has 2 ** 40 times its rows."""

        def __init__(self, df):
            self.df = df

        def __getattr__(self, name):
            return getattr(self.df, name)

        def __getitem__(self, name):
            return self.df[name]

        def count(self):
            return self.df.count() << 40

    docs = spark.createDataFrame([(n, " ".join(f"w{n // 2}x{m}" for m in range(40))) for n in range(8)], "doc_id long, text string")
    small = sorted(tuple(r) for r in simhash.near_groups(docs).select("doc_id", "component_id").collect())
    monkeypatch.setattr(simhash, "stored", lambda df: Many(kept(df)) if "copies" in df.columns and "bands" in df.columns else kept(df))
    monkeypatch.setattr(simhash, "similar", lambda classes, radius=3, rows=None, *a, **b: seen.append(radius) or search(classes.df, radius, classes.df.count(), *a, **b))
    monkeypatch.setattr(simhash, "band_links", lambda classes, links=simhash.band_links: links(classes.df))
    simhash.near_groups(docs)
    assert small == [(n, n // 2 * 2) for n in range(8)] and seen == [simhash.NEAR_RADIUS] * 2
