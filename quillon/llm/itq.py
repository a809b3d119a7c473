"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Equal vectors are one class. A rotation for balanced binary codes is learned from a bounded sample
(`SAMPLE` classes, the least by hash); `shape` chooses how many rotations, and how wide the substrings
their codes are cut into, from the number of classes, so that a substring's values stay about as many
as the classes. Each class is entered in each table under its substring and under each value one bit
away, so two classes meet in a table if their substrings differ in two bits at most, and they count as
a pair in the first table and under the least value where they do. That is the one lossy step; its
recall is measured against brute force (README).

An entry carries the class's unit vector in 8 bits a component with the length of what that leaves
out, which bounds how far a cosine of two such vectors can be off. A pair within `RADIUS` of its code's bits
whose bound decides is decided where it meets; all others are reranked by the cosine of the original vectors in double
precision. So a task returns a count of links for each class, a spanning forest of them, and the
pairs to rerank, never all links. A value with over `CELL` entries is split into blocks whose pairs
meet in cells of their own.

Defined cases: null, empty, zero and non-finite vectors link with nothing and are their own
components; vectors of several lengths link within their length; rows with one vec_id count as
separate vectors; a null vec_id is kept and counts as a link, but names no component others share; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stored
from quillon.llm.graph import cells, components, forest, join_hot, same_key_pairs
from quillon.llm.vectors import is_sound, matrix, row_dots, sound

SAMPLE = 4096
RADIUS = 20
CELL = 4000
ROUNDS = 50
ENTRIES = 40_000  #: entries of a task
EDGE, COUNT, OPEN = 0, 1, 2  #: kinds of a task's results


def shape(rows: int, dim: int) -> tuple[int, int, int]:
    """(rotations, tables of each, bits of a table's substring) for this many classes.

    At a cosine of 0.9 a sign differs with a chance of 0.14, so two substrings of w bits differ in two at most with one of
    0.60, 0.42, 0.14 for w = 16, 21, 32. The number of tables keeps the chance of meeting in some above 0.97.
    """
    bits = min(64, dim)
    if bits < 64:
        tables = 4 if bits >= 4 else 1
        return 1, tables, bits // tables
    if rows <= 1 << 20:
        return 1, 4, 16
    return (3, 3, 21) if rows <= 1 << 26 else (12, 2, 32)


def learn_rotation(x: np.ndarray, bits: int, seed: int = 5, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions turned so that signs lose least."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=True)
    flat = (x - mean) @ axes[:bits].T
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ w).T
    return mean, axes[:bits].T @ turn


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    bit = (x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ projection > 0
    full = np.zeros((len(x), 64), bool)
    full[:, : bit.shape[1]] = bit
    return np.packbits(full, axis=1, bitorder="little").view("<u8").ravel()


def small(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components as int8, their step, length of the rest) of the unit vectors."""
    x = np.asarray(x, np.float64)
    unit = x / np.sqrt(row_dots(x, x))[:, None]
    step = np.abs(unit).max(1) / 127
    near = np.rint(unit / step[:, None]).astype(np.int8)
    return near, step, np.sqrt(((unit - near * step[:, None]) ** 2).sum(1)) + 1e-9


def _link(pdf: pd.DataFrame, width: int, tables: int, radius: int, least: float) -> pd.DataFrame:
    """(kind, a, b): forest edges and link counts of the pairs that are decided here, and the open pairs."""
    pdf = pdf.sort_values(["tab", "value", "low", "high"], kind="stable")
    key = pdf[["tab", "value", "low", "high"]].to_numpy(np.int64)
    group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(1)))) if len(key) else np.empty(0, np.int64)
    ident, block, n = pdf["id"].to_numpy(), pdf["block"].to_numpy(), pdf["n"].to_numpy()
    code = np.frombuffer(b"".join(pdf["codes"]), "<u8").reshape(len(pdf), -1)
    near, step, rest = np.frombuffer(b"".join(pdf["near"]), np.int8).reshape(len(pdf), -1), pdf["step"].to_numpy(), pdf["rest"].to_numpy()
    diagonal, tab, value = key[:, 2] == key[:, 3], key[:, 0], key[:, 1].astype(np.uint64)
    names, place = np.unique(ident, return_inverse=True)
    label, links = np.arange(len(names)), np.zeros(len(names), np.int64)
    low, open_ = np.uint64((1 << width) - 1), []
    for i, j in same_key_pairs(group):
        rotation = tab[i] // tables
        differ = code[i, rotation] ^ code[j, rotation]
        keep = (np.bitwise_count(differ) <= radius) & (ident[i] != ident[j]) & (diagonal[i] | (block[i] != block[j]))
        i, j = i[keep], j[keep]
        differ = code[i] ^ code[j]
        first = np.full(len(i), np.iinfo(np.int64).max)
        for t in range(tables * code.shape[1] - 1, -1, -1):
            word = differ[:, t // tables]
            first[(np.bitwise_count((word >> np.uint64(t % tables * width)) & low) <= 2) & (np.bitwise_count(word) <= radius)] = t
        rotation, shift = tab[i] // tables, (tab[i] % tables * width).astype(np.uint64)
        x, y = (code[i, rotation] >> shift) & low, (code[j, rotation] >> shift) & low
        d = x ^ y
        one = d & (~d + np.uint64(1))
        count = np.bitwise_count(d)
        # the values both are entered under: their own if equal; either's if one bit differs; both midways if two do
        lowest = np.where(count == 0, x, np.where(count == 1, np.minimum(x, y), np.minimum(x ^ one, x ^ d ^ one)))
        once = (first == tab[i]) & (lowest == value[i])
        i, j = i[once], j[once]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            cosine = np.einsum("ij,ij->i", near[a].astype(np.float32), near[b].astype(np.float32)) * step[a] * step[b]
            off = rest[a] * (1 + rest[b]) + rest[b] + 1e-6
            sure, maybe = cosine - off >= least, np.abs(cosine - least) < off
            open_.append(np.stack((ident[a[maybe]], ident[b[maybe]]), 1))
            a, b = a[sure], b[sure]
            np.add.at(links, place[a], n[b])
            np.add.at(links, place[b], n[a])
            label = forest(label[place[a]], label[place[b]], len(names))[label]
    child, counted = np.flatnonzero(label != np.arange(len(names))), np.flatnonzero(links)
    pairs = np.concatenate(open_) if open_ else np.empty((0, 2), np.int64)
    kind = np.repeat(np.array([EDGE, COUNT, OPEN], np.int32), [len(child), len(counted), len(pairs)])
    return pd.DataFrame({"kind": kind, "a": np.concatenate((names[child], names[counted], pairs[:, 0])), "b": np.concatenate((names[label[child]], links[counted], pairs[:, 1]))})


def linked(classes: DataFrame, dim: int, least: float, rows: int, radius: int = RADIUS) -> DataFrame:
    """(kind, a, b) of all classes (id, n, embedding) of one length, by `_link`, stored."""
    sample = [r[0] for r in classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).collect()]
    rotations, tables, width = shape(rows, dim)
    learned = [learn_rotation(np.array(sample, np.float64), width * tables, 5 + r) for r in range(rotations)]

    def enter(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2), dim)
            code = np.stack([codes(x, *m) for m in learned], 1)
            near, step, rest = small(x)
            fixed = [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([v.tobytes() for v in near], pa.binary()), pa.array(step), pa.array(rest)]
            for t in range(rotations * tables):
                own = (code[:, t // tables] >> np.uint64(t % tables * width)) & np.uint64((1 << width) - 1)
                for flip in [0, *(1 << b for b in range(width))]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array((own ^ np.uint64(flip)).astype(np.int64)), *fixed], names=["tab", "value", "id", "n", "codes", "near", "step", "rest"])

    entries = classes.select("id", "n", "embedding").mapInArrow(enter, "tab int, value long, id long, n long, codes binary, near binary, step double, rest double")
    met = cells(entries, ["tab", "value"], "id", CELL)
    tasks = max(64, min(rows * rotations * tables * (1 + width) // ENTRIES, 1 << 20))
    return stored(met.withColumn("task", F.pmod(F.xxhash64("tab", "value", "low", "high"), F.lit(tasks))).groupBy("task").applyInPandas(lambda pdf: _link(pdf, width, tables, radius, least), "kind int, a long, b long"))


def rerank(pairs: DataFrame, classes: DataFrame, dim: int, least: float) -> DataFrame:
    """Pairs whose cosine, in double precision on the original vectors, is at least `least`."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("embedding").alias(f"{c}_vec"))

    def check(batches):
        for batch in batches:
            x, y = matrix(batch.column(2), dim).astype(np.float64), matrix(batch.column(3), dim).astype(np.float64)
            near = row_dots(x, y) / np.sqrt(row_dots(x, x)) / np.sqrt(row_dots(y, y)) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_vec", "b_vec").mapInArrow(check, "a long, b long")


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    good = sound(vectors.select("vec_id", "embedding")).withColumn("dim", F.size("embedding"))
    classes = stored(good.groupBy("dim", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    sizes = sorted((r[0], r[1]) for r in classes.groupBy("dim").count().collect())  # a row for each length
    edges = vectors.sparkSession.createDataFrame([], "a long, b long")
    counts = vectors.sparkSession.createDataFrame([], "a long, others long")
    for dim, rows in sizes:
        mine = classes.filter(F.col("dim") == dim)
        found = linked(mine, dim, least, rows)
        close = stored(rerank(found.filter(F.col("kind") == OPEN).select("a", "b"), mine, dim, least))
        weight = mine.select(F.col("id").alias("b"), F.col("n").alias("others"))
        both = close.union(close.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(weight, "b").select("a", "others")
        counts = counts.union(found.filter(F.col("kind") == COUNT).select("a", "b")).union(both)
        edges = edges.union(found.filter(F.col("kind") == EDGE).select("a", "b")).union(close)
    reach = components(edges)
    named = classes.join(counts.groupBy("a").agg(F.sum("others").alias("others")), classes["id"] == F.col("a"), "left").join(reach, classes["id"] == reach["node"], "left")
    named = named.select("id", "least", "embedding", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = stored(join_hot(named, lowest, "component", "members", sum(n for _, n in sizes)).select("embedding", "n", "n_links", "component_id"))
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = join_hot(good.select("vec_id", "embedding"), named, "embedding", "n", total, 64 + 8 * max((d for d, _ in sizes), default=0))
    apart = vectors.filter(~is_sound()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = rows.select("vec_id", "n_links", "component_id").unionByName(apart)
    return every.select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
