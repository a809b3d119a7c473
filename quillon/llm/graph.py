"""Connected components by alternating large-star and small-star steps, all in joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_BYTES, broadcast_if, release, stored


HOT = 1000  #: rows of one key beyond which its value is broadcast
TASK_EDGES = 50_000  #: edges of a task


def join_hot(rows: DataFrame, values: DataFrame, key: str | list[str], count: str, total: int, row_bytes: int = 64) -> DataFrame:
    """rows with the columns of values, which has one row for each key and the key's number of rows in `count`.

    Keys with over HOT rows are broadcast, but no more than BROADCAST_BYTES hold at row_bytes each: of `total` rows, so
    many keys can't have more than the number that is asked for then. The others are shuffled; so are all where the rows of
    all keys would make one task.
    """
    if total <= TASK_EDGES:
        return rows.join(values, key).drop(count)
    most = max(HOT, total * row_bytes // BROADCAST_BYTES)
    hot = F.broadcast(values.filter(F.col(count) > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(values.filter(F.col(count) <= most), key)
    return rows.join(hot, key).unionByName(rest).drop(count)


def _large_star(edges: DataFrame, total: int, tasks: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    moved = join_hot(both.filter("b > a"), least, "a", "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): component is the least node it reaches.

    Every round is stored in the shared folder; the driver sees a count and a checksum. Rounds grow
    with the logarithm of the longest chain. Tasks are as many as the edges need, so that few edges make few files.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = max(1, edges.count() // TASK_EDGES)
    edges, last = edges.coalesce(tasks), None
    while True:
        sign = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == last or not sign[0]:
            release(edges.sparkSession)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        last = sign
        edges = stored(_small_star(_large_star(edges, sign[0], tasks), tasks).coalesce(tasks))


def cells(entries: DataFrame, keys: list[str], ident: str, most: int) -> DataFrame:
    """entries with low, high, block: where two of one key meet, and no place holds more than 2 * most by far.

    A key with over `most` entries is split into blocks by a hash of `ident`; each pair of blocks has
    a cell (low, high). Two entries are compared in the cell of their blocks: everywhere if low = high,
    else only across blocks. The hot keys, at most a `most`-th of the entries, are broadcast if they fit the bound.
    """
    hot = stored(entries.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_blocks")))
    split = entries.join(broadcast_if(hot, hot.count(), 32), keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int"))
    each = split.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return each.withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop("_other", "_blocks")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least linked place of each of n places, for links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def same_key_pairs(group: np.ndarray, step: int = 1 << 19, first: np.ndarray | None = None):
    """Index pairs (i, j), i < j, of equal values in a sorted array, some at a time; none is kept.

    first: which i take part.
    """
    n = len(group)
    if not n:
        return
    ends = np.searchsorted(group, group, side="right")
    active, k = np.arange(n) if first is None else np.flatnonzero(first), 1
    held_i, held_j, held = [], [], 0
    while True:
        active = active[active + k < ends[active]]
        if not len(active):
            break
        held_i.append(active)
        held_j.append(active + k)
        held += len(active)
        if held >= step:
            yield np.concatenate(held_i), np.concatenate(held_j)
            held_i, held_j, held = [], [], 0
        k += 1
    if held:
        yield np.concatenate(held_i), np.concatenate(held_j)
