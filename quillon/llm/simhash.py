"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit set where over half of the document's shingle hashes have it set. Equal
fingerprints are one class. To find all classes within `radius` bits:

1. A bounded sample of fingerprints (`SAMPLE`, the least by hash) gives the bits' correlations and,
   for any partition of the bits, the share of pairs within each distance in it.
2. Correlated bits are grouped into partitions, for several numbers of partitions.
3. A dynamic programme allots each partition a threshold, from -1 (not used) up, with
   sum(threshold + 1) = radius + 1, at the least estimated count of probes and candidates. If two
   fingerprints are within the radius, some partition holds at most its threshold of the differing
   bits; this holds for any allotment, so the sample bears on cost alone.
4. Each class is entered under its bits in each partition, and probes the values within the
   threshold. Entries meet by (partition, value); all pairs are verified on all 64 bits.

A task returns a spanning forest of its links, not the links. A value with over `CELL` entries is
split into blocks, and each pair of blocks meets in a cell of its own, so no task holds a hot value.

`near_groups` links documents by the Jaccard similarity of their word shingles instead. Candidates are
pairs of fingerprints within a radius, and pairs that share one of `BANDS` values, each made of `ROWS`
least hashes of the set, whose sketches of those hashes differ in `SKETCH_MOST` bits at most. Both rules
are the same at any size of the table: the radius is `NEAR_RADIUS`, and the bands miss a pair at similarity 0.8
with a chance below 1e-11 (1e-13 by the sketch) and fewer at higher similarity. Candidates chain documents into loose groups.
Inside one, sets are compared exactly, in two rounds: first each block of `GROUP_CELL` members within
itself and with `LEADERS` members of the group, which brings the copies of one text together and moves
each text once; then only the members outside the group's largest cluster with all members of other clusters.

Defined cases: null or empty texts have fingerprint zero and link like any other; repeated rows and
ties share a class; null doc_ids never name a component unless all of it is null; an empty table
gives no rows; other columns are ignored. By similarity, rows are told apart by (doc_id, text): the
first of its group stays, of rows alike in both one stays, and rows without a doc_id stay, as no
group can name them; texts without words are copies of one another.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import broadcast_if, lean, mix64, quoted, stored, text_or_empty, tidy
from quillon.llm.graph import cells, components, forest, join_hot, same_key_pairs
from quillon.llm.tokens import in_slices

SEED = 42
SAMPLE = 4096
CELL = 20_000
TASK_ENTRIES = 100_000
ROW_NS, PAIR_NS = 2500.0, 40.0  #: estimated work for an entry and for a comparison
BITS = 64


def shingle_hashes(text: str, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `width` words, ASCII letters lower-cased; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    return np.array([xxh64_intdigest(line[s:e], seed) for s, e in zip(starts, ends[-n:].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            fps = [fingerprint(shingle_hashes(t, width, seed)) for _, some in in_slices(texts) for t in some]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])
        tidy()

    return lean(docs).select("doc_id", text_or_empty().alias("text")).mapInArrow(scan, "doc_id long, fp long")


# ---- partitions and thresholds


def bit_groups(bits: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in groups of near-equal size, each grown from the bits most correlated with it."""
    spread = bits.astype(np.float64) - bits.mean(0)
    scale = np.sqrt((spread**2).sum(0))
    link = np.abs(spread.T @ spread) / np.maximum(np.outer(scale, scale), 1e-12)
    np.fill_diagonal(link, 0)
    free, groups = set(range(BITS)), []
    for p in range(parts):
        size = len(free) // (parts - p)
        order = sorted(free)
        group = [order[int(np.argmax(link[np.ix_(order, order)].max(1)))]]
        free.discard(group[0])
        while len(group) < size:
            order = sorted(free)
            best = order[int(np.argmax(link[np.ix_(order, group)].sum(1)))]
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allot(costs: list[list[float]], radius: int) -> list[int]:
    """Thresholds with sum(threshold + 1) = radius + 1 of least total cost; costs[i][t + 1] is partition i's at t."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * (radius + 1)
    for cost in costs:
        new: list[tuple[float, list[int]] | None] = [None] * (radius + 2)
        for used, state in enumerate(best):
            if state is None:
                continue
            for more in range(min(len(cost), radius + 2 - used)):
                total = state[0] + cost[more]
                if new[used + more] is None or total < new[used + more][0]:
                    new[used + more] = (total, [*state[1], more - 1])
        best = new
    if best[radius + 1] is None:
        raise ValueError("no allotment")
    return best[radius + 1][1]


def choose_index(sample: np.ndarray, rows: int, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use, at the least estimated work for this many rows."""
    fp = np.asarray(sample, np.int64).view(np.uint64)
    if len(fp) < 2:
        fp = np.arange(2, dtype=np.uint64)
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    left, right = fp[: len(fp) // 2], fp[len(fp) // 2 :][: len(fp) // 2]
    # pairs within the radius are results, whatever the index; only the others cost
    differ = np.concatenate([left ^ np.roll(right, s) for s in range(0, len(right), max(1, len(right) // 64))])
    differ = differ[np.bitwise_count(differ) > radius]
    found = None
    for parts in range(2, min(2 * (radius + 1), 16) + 1):
        groups, costs = bit_groups(bits, parts), []
        for g in groups:
            near = np.bincount(np.bitwise_count(differ & np.uint64(sum(1 << b for b in g))), minlength=BITS + 1)
            share = np.maximum(np.cumsum(near) / max(1, near.sum()), [sum(comb(len(g), j) for j in range(t + 1)) / 2.0 ** len(g) for t in range(BITS + 1)])
            costs.append([0.0] + [rows * ROW_NS * sum(comb(len(g), j) for j in range(t + 1)) + rows * rows / 2 * float(share[t]) * PAIR_NS for t in range(min(radius, 3, len(g)) + 1)])
        try:
            t = allot(costs, radius)
        except ValueError:
            continue
        total = sum(c[x + 1] for c, x in zip(costs, t, strict=True))
        if found is None or total < found[0]:
            found = (total, [(g, x) for g, x in zip(groups, t, strict=True) if x >= 0])
    return found[1]


@lru_cache(maxsize=64)
def _masks(bits: tuple[int, ...], threshold: int) -> np.ndarray:
    """All ways to flip 1 to threshold of these bits."""
    out = [sum(1 << b for b in some) for k in range(1, threshold + 1) for some in combinations(bits, k)]
    return np.array(out, np.uint64)


# ---- candidates and verification


def fingerprint_sample(classes: DataFrame) -> np.ndarray:
    return np.array([r[0] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)


def similar(classes: DataFrame, radius: int = 3, rows: int | None = None, link=None, columns: list[str] | None = None) -> DataFrame:
    """Links (a, b) that span every group of fingerprints `fp` chained by steps of at most radius bits.

    link turns a task's entries into links, columns are what entries carry; both for other rules.
    """
    rows = classes.count() if rows is None else rows
    link, columns = link or (lambda pdf: _forest_of(pdf, radius, ["fp"], "fp")), columns or ["fp"]
    index = choose_index(fingerprint_sample(classes), rows, radius)
    at = columns.index("fp")

    def enter(batches):
        for batch in batches:
            fp = batch.column(at).to_numpy().view(np.uint64)
            for part, (bits, threshold) in enumerate(index):
                own = fp & np.uint64(sum(1 << b for b in bits))
                masks = np.concatenate((np.zeros(1, np.uint64), _masks(tuple(bits), threshold)))
                for probe, mask in enumerate(masks):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array((own ^ mask).view(np.int64)), pa.array(np.full(len(fp), probe > 0)), *batch.columns], names=["part", "value", "probe", *columns])

    entries = classes.select(*columns).mapInArrow(enter, "part int, value long, probe boolean, " + ", ".join(f"{c} long" for c in columns))
    met = cells(entries, ["part", "value"], columns[0], CELL)
    each = sum(1 + len(_masks(tuple(bits), threshold)) for bits, threshold in index)
    tasks = max(64, min(rows * each // TASK_ENTRIES, 1 << 20))
    keyed = met.withColumn("task", F.pmod(F.xxhash64("part", "value", "low", "high"), tasks))
    return keyed.groupBy("task").applyInPandas(link, "a long, b long")


def _forest_of(pdf: pd.DataFrame, radius: int, words: list[str], ident: str, most: int | None = None) -> pd.DataFrame:
    """A forest of the links between entries within the radius by the first word and, by all, within `most` bits."""
    pdf = pdf.sort_values(["part", "value", "low", "high", "probe"], kind="stable")
    key = pdf[["part", "value", "low", "high"]].to_numpy()
    group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(1)))) if len(key) else np.empty(0, np.int64)
    block, diagonal = pdf["block"].to_numpy(), key[:, 2] == key[:, 3]
    values = [pdf[w].to_numpy().view(np.uint64) for w in words]
    names, place = np.unique(pdf[ident].to_numpy(), return_inverse=True)
    label = np.arange(len(names))
    # entries under their own value come first in a group, and each pair needs one of them
    for i, j in same_key_pairs(group, first=~pdf["probe"].to_numpy()):
        near = np.bitwise_count(values[0][i] ^ values[0][j]) <= radius
        i, j = i[near], j[near]
        fits = diagonal[i] | (block[i] != block[j])
        if most is not None:
            fits &= sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int32) for w in values) <= most
        a, b = label[place[i[fits]]], label[place[j[fits]]]
        label = forest(a, b, len(names))[label]
    child = np.flatnonzero(label != np.arange(len(names)))
    del pdf, key, values
    tidy()
    return pd.DataFrame({"a": names[child], "b": names[label[child]]})


def group_documents(docs: DataFrame, width: int = 3, radius: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id within reach by steps of at most radius bits."""
    fps = stored(fingerprints(docs, width, seed))
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    reach = components(similar(classes, radius))
    named = classes.join(reach, classes["fp"] == reach["node"], "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = join_hot(named, lowest, "component", "n", classes.count()).select("fp", "component_id", "copies")
    return join_hot(fps, named, "fp", "copies", fps.count()).select("doc_id", "fp", "component_id")


# ---- by similarity

NEAR_RADIUS = 3
EXTRA = 2  #: further fingerprint words
EXTRA_SHARE = 0.26  #: of all bits, that may differ in a loose link: 4 deviations over the mean at similarity 0.8
GROUP_CELL, LEADERS = 128, 4
BANDS, ROWS = 64, 5  #: a pair at 0.8 shares no band with a chance of (1 - 0.8 ** ROWS) ** BANDS = 9e-12
SKETCH_MOST = 78  #: of BANDS * ROWS bits, each of which differs with a chance of 0.1 at similarity 0.8: more with one of 3e-14
SKETCH = [f"k{n}" for n in range(BANDS * ROWS // BITS)]
TURNS = (mix64(np.arange(BANDS * ROWS, dtype=np.uint64), 900) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of all hashes under each of TURNS; the greatest number for none."""
    x = (mix64(hashes, 901) >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(TURNS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(out, (x[i : i + 256, None] * TURNS).min(0), out=out)
    return out


def bands(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of minima: the values of the bands, and the sketch, a bit of each minimum."""
    each = least.astype(np.uint64) + (np.arange(len(TURNS), dtype=np.uint64) << np.uint64(32))
    parts, value = each.reshape(-1, BANDS, ROWS), np.zeros((len(least), BANDS), np.uint64)
    for n in range(ROWS):
        value = mix64(value ^ parts[:, :, n], 903 + n)
    bits = (mix64(each, 902) & np.uint64(1)).astype(np.uint8)
    return value, np.packbits(bits, axis=1, bitorder="little").view("<u8")


def wide_fingerprints(docs: DataFrame, width: int, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, s0, s1, fp, e0, ...): 128 bits that name the set of shingles, its fingerprint and further ones from remixed hashes, sketch, bands; repeats don't count."""
    from xxhash import xxh64_intdigest

    def scan(batches):
        tidy()
        for batch in batches:
            texts, words = batch.column(2).to_pylist(), [[] for _ in range(3 + EXTRA)]
            least, some_words = [], []
            for _, some in in_slices(texts):
                for t in some:
                    h = np.unique(shingle_hashes(t, width, seed))
                    raw = h.tobytes()
                    own = [xxh64_intdigest(raw, n) for n in range(2)] + [fingerprint(mix64(h, 100 + n) if n else h) for n in range(1 + EXTRA)]
                    for column, word in zip(words, own, strict=True):
                        column.append(word)
                    least.append(minima(h))
                    some_words.append(len(h) > 0)
            value, sketch = bands(np.array(least, np.uint32).reshape(-1, len(TURNS)))
            columns = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in [*words, *sketch.T]]
            columns.append(pa.array([v.tobytes() if any_ else None for v, any_ in zip(value, some_words, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_hash", "s0", "s1", "fp", *(f"e{n}" for n in range(EXTRA)), *SKETCH, "bands"])
        tidy()

    extra = ", ".join(f"{c} long" for c in (*(f"e{n}" for n in range(EXTRA)), *SKETCH))
    return lean(docs).select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text")).mapInArrow(scan, f"doc_id long, text_hash long, s0 long, s1 long, fp long, {extra}, bands binary")


def band_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that span every group of classes (id, sketch, bands) chained by a common band and near sketches."""

    def enter(batches):
        for batch in batches:
            value = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["value", "id"])

    entries = classes.filter("bands is not null").select("id", "bands").mapInArrow(enter, "value long, id long")
    # most values are one class's own
    shared = stored(entries.withColumn("n", F.count("*").over(Window.partitionBy("value"))).filter("n > 1").drop("n"))
    tasks = max(64, min(shared.count() // TASK_ENTRIES, 1 << 20))
    met = cells(shared, ["value"], "id", CELL).join(classes.select("id", *SKETCH), "id")
    keyed = met.withColumns({"part": F.lit(0), "probe": F.lit(False), "task": F.pmod(F.xxhash64("value", "low", "high"), tasks)})
    return keyed.groupBy("task").applyInPandas(lambda pdf: _forest_of(pdf, BITS, SKETCH, "id", SKETCH_MOST), "a long, b long")


def jaccard_links(sets: list[np.ndarray], least: float, blocks: np.ndarray | None = None, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sorted sets of hashes whose Jaccard similarity is at least `least`; only across blocks if given."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(place, minlength=len(names)) > 1
    new = np.cumsum(shared) - 1
    keep = shared[place]
    owner, column = owner[keep], new[place[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    for start in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, (start, start + step))
        block = np.zeros((n, step), np.float32)
        block[owner[lo:hi], column[lo:hi] - start] = 1
        both += block @ block.T
    i, j = np.nonzero(np.triu(both >= least * (sizes[:, None] + sizes[None, :] - both), 1) & (sizes[:, None] > 0) & (sizes[None, :] > 0))
    if blocks is not None:
        across = blocks[i] != blocks[j]
        i, j = i[across], j[across]
    return i, j


def _compare(t: pa.Table, key: list[str], width: int, seed: int, least: float) -> pa.Table:
    """A forest of the exact links among rows (id, side, text) of one key; rows of side 0 and 1 are compared across alone."""
    keys = np.stack([t[c].to_numpy() for c in key], 1)
    ids, side, texts = t["id"].to_numpy(), t["side"].to_numpy(), t["text"].to_pylist()
    order = np.lexsort((ids, *keys.T[::-1]))
    edge = np.flatnonzero(np.concatenate(([True], (keys[order][1:] != keys[order][:-1]).any(1), [True])))
    a, b = [], []
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        mine = order[lo:hi]
        sets = [np.unique(shingle_hashes(texts[i], width, seed)) for i in mine]
        i, j = jaccard_links(sets, least, None if (side[mine] < 0).all() else side[mine])
        label = forest(i, j, len(mine))
        child = np.flatnonzero((label != np.arange(len(mine))) & (ids[mine] != ids[mine[label]]))
        a.append(ids[mine[child]])
        b.append(ids[mine[label[child]]])
    tidy()
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _spread(rows: DataFrame, name: str, size: int) -> DataFrame:
    """rows with `name`: one of the group's blocks of about GROUP_CELL rows, of which there are ceil(size / GROUP_CELL)."""
    return rows.withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.ceil(F.col(size) / GROUP_CELL)).cast("int"))


def exact_clusters(docs: DataFrame, members: DataFrame, width: int, least: float, seed: int) -> DataFrame:
    """(node, component) of the clusters of exact similarity in each loose group; members: (id, component, doc_id, text_hash), stored."""
    keyed = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))

    def texts_of(rows: DataFrame, count: int) -> DataFrame:
        return keyed.join(broadcast_if(rows, count, 64), ["doc_id", "text_hash"]).dropDuplicates(["id"])

    def by_cell(cells_: DataFrame, key: list[str], count: int) -> DataFrame:
        tasks = max(64, min(count // 200, 1 << 20))
        task = F.pmod(F.xxhash64(*key), F.lit(tasks))
        return cells_.withColumn("task", task).groupBy("task").applyInArrow(lambda t: _compare(t, key, width, seed, least), "a long, b long")

    count = members.count()
    # the leaders of a group of several blocks: the least of its ids by several hashes
    chosen = F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(n)), "id"))["id"] for n in range(LEADERS)])
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), chosen.alias("leaders")).filter(F.col("size") > GROUP_CELL)
    large = broadcast_if(sizes, count // GROUP_CELL, 24 + 8 * LEADERS)
    sized = members.join(large, "component", "left").withColumn("size", F.coalesce("size", F.lit(1)))  # smaller groups are one block
    placed = _spread(sized.withColumn("leads", F.array_contains("leaders", F.col("id"))).drop("leaders"), "block", "size").withColumn("side", F.lit(-1))
    texts = texts_of(placed, count)
    everywhere = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / GROUP_CELL).cast("int") - 1))
    guests = texts.filter("leads").withColumn("home", F.col("block")).withColumn("block", everywhere).filter("block <> home").drop("home")
    columns = ["id", "component", "block", "side", "text"]
    first_links = stored(by_cell(texts.select(*columns).union(guests.select(*columns)), ["component", "block"], count))
    # the second round: those outside their group's largest cluster, with all of other clusters and blocks
    reach = components(first_links)
    clustered = placed.drop("leads", "side").join(reach.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    by_cluster = clustered.filter(F.col("size") > GROUP_CELL).groupBy("component", "cluster").agg(F.count("*").alias("n"))
    largest = by_cluster.groupBy("component").agg(F.max(F.struct("n", "cluster")).alias("top"), F.sum("n").alias("all"))
    rest = largest.select("component", F.col("top.cluster").alias("main"), (F.col("all") - F.col("top.n")).alias("others")).filter("others > 0")
    open_ = stored(clustered.join(broadcast_if(rest, count // GROUP_CELL, 32), "component"))
    left = open_.count()
    if not left:
        return reach
    again = texts_of(open_, left)
    per = lambda size: F.explode(F.sequence(F.lit(0), F.ceil(F.col(size) / GROUP_CELL).cast("int") - 1))
    base = again.withColumn("probe", per("others")).withColumn("side", F.lit(0))
    probes = _spread(again.filter("cluster <> main"), "probe", "others").withColumn("block", per("size")).withColumn("side", F.lit(1))
    columns = ["id", "component", "block", "probe", "side", "text"]
    return components(first_links.union(by_cell(base.select(*columns).union(probes.select(*columns)), ["component", "block", "probe"], left)))


def near_groups(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = NEAR_RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, component_id, first): documents chained by similarity `least`; no null doc_ids.

    component_id is the least doc_id of the group, first whether the row's (doc_id, text_hash) is the group's least.
    Documents with equal sets of shingles are one class, for which the least of them stands.
    """
    own, words = ["s0", "s1"], ["fp", *(f"e{n}" for n in range(EXTRA))]
    fps = stored(wide_fingerprints(docs.filter("doc_id is not null"), width, seed))
    classes = stored(fps.groupBy(*own, *words).agg(F.min(F.struct("doc_id", "text_hash", *SKETCH, "bands")).alias("first"), F.count("*").alias("copies")).select(*own, *words, "copies", "first.*").withColumn("id", F.monotonically_increasing_id()))
    rows = classes.count()
    most = int(EXTRA_SHARE * BITS * len(words))
    entries = similar(classes, radius, rows, lambda pdf: _forest_of(pdf, radius, words, "id", most), ["id", *words])
    loose = components(entries.union(band_links(classes)))
    members = stored(classes.join(loose, classes["id"] == loose["node"]).select("id", "component", "doc_id", "text_hash"))
    reach = exact_clusters(docs, members, width, least, seed)
    named = classes.join(reach, classes["id"] == reach["node"], "left").select(*own, "copies", "doc_id", "text_hash", F.coalesce("component", "id").alias("component"))
    lowest = named.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count("*").alias("n"))
    named = join_hot(named, lowest, "component", "n", rows).select(*own, "least", "copies")
    return join_hot(fps, named, own, "copies", fps.count()).select("doc_id", "text_hash", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "text_hash") == F.col("least")).alias("first"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows that are the first of their group, with their columns; of rows alike in doc_id and text, one.

    Rows without a doc_id can't be named and stay.
    """
    groups = near_groups(docs, **options).groupBy("doc_id", "text_hash").agg(F.first("first").alias("first"), F.count("*").alias("n"))
    fate = stored(groups.filter("not first or n > 1"))
    columns = quoted(docs)
    plain = docs.select(F.struct(*columns).alias("row"), "doc_id", F.xxhash64(text_or_empty()).alias("text_hash"))
    kept = plain.join(broadcast_if(fate, fate.count(), 32), ["doc_id", "text_hash"], "left")
    alone, twice = kept.filter("first is null"), kept.filter("first and n > 1")
    if fate.filter("first").isEmpty():
        return alone.select("row.*")
    # of rows alike in both, one
    return alone.select("row.*").union(twice.groupBy("doc_id", "text_hash").agg(F.first("row").alias("row")).select("row.*"))
