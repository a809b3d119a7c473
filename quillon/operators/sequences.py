"""Consensus, alignment identity and reassignment, for many nodes at once.

A node is whatever `keys` name; its clusters are in `cluster`, its members in (ord, seq).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import kernels
from quillon.operators.checks import fail_on

GAP = "-"
LETTERS = 1 << 20  #: letters that a task counts at once


def _counted(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of whole numbers from 0 in rising order, and which places are the first of their values in all but the last column.

    They are sorted as one number where their bits fit into it.
    """
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) < 64:
        packed = np.zeros(len(columns[0]), np.int64)
        for c, n in zip(columns, bits, strict=True):
            packed = (packed << n) | c.astype(np.int64)
        packed.sort()
        key = np.empty((len(columns), len(packed)), np.int64)
        left = packed
        for n in range(len(columns) - 1, -1, -1):
            key[n] = left & ((1 << bits[n]) - 1)
            left = left >> bits[n]
        group = packed >> bits[-1]
        new = np.ones(len(packed), bool)
        new[1:] = group[1:] != group[:-1]
        return key, new
    key = np.stack([c.astype(np.int64) for c in columns])
    key = key[:, np.lexsort(key[::-1])]
    new = np.ones(key.shape[1], bool)
    new[1:] = (key[:-1, 1:] != key[:-1, :-1]).any(0)
    return key, new


def column_counts(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, base, n, first): how many members have each letter in each column, and the least ord of these.

    Tasks count `LETTERS` letters at a time in arrays, so the shuffle sees a row for each column and letter of such a
    lot, not one for each letter of each member. A member without seq has none.
    """
    def count(batches):
        for batch in batches:
            node = batch.column("_node").dictionary_encode()
            codes, ords = node.indices.to_numpy(), batch.column("ord").to_numpy(zero_copy_only=False)
            _, of_node = np.unique(codes, return_index=True)  # a row of each node
            by_rank, ranks = np.unique(ords, return_inverse=True)
            texts = batch.column("seq").to_pylist()
            lots, size = [[]], 0
            for row, text in enumerate(texts):
                for start in range(0, len(text or ""), LETTERS):
                    piece = text[start : start + LETTERS]
                    if size and size + len(piece) > LETTERS:
                        lots.append([])
                        size = 0
                    lots[-1].append((row, start, piece))
                    size += len(piece)
            for lot in filter(None, lots):
                rows, starts, sizes = np.array([x[0] for x in lot]), np.array([x[1] for x in lot]), np.array([len(x[2]) for x in lot])
                letter = np.frombuffer("".join(x[2] for x in lot).encode("utf-32-le", "surrogatepass"), np.uint32)
                row = np.repeat(rows, sizes)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
                key, first = _counted(codes[row], pos, letter, ranks[row])
                at = np.flatnonzero(first)
                one = pa.array(of_node[key[0, at]])
                columns = [batch.column(k).take(one) for k in keys]
                columns += [pa.array(key[1, at].astype(np.int32)), pa.array([chr(c) for c in key[2, at]]), pa.array(np.diff(at, append=len(first))), pa.array(by_rank[key[3, at]], batch.column("ord").type)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "pos", "base", "n", "first"])

    schema = T.StructType([*[T.StructField(k, members.schema[k].dataType) for k in keys], T.StructField("pos", T.IntegerType()), T.StructField("base", T.StringType()), T.StructField("n", T.LongType()), T.StructField("first", members.schema["ord"].dataType)])
    named = members.select(*keys, "ord", "seq", F.to_json(F.struct(*keys)).alias("_node"))
    return named.mapInArrow(count, schema).groupBy(*keys, "pos", "base").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def column_votes(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, base): the commonest character of each column; of equal ones the first in member order."""
    fail_on(members.groupBy(*keys).agg(F.count_distinct(F.length("seq")).alias("n")).filter("n > 1").select(*keys), "aligned sequences differ in length")
    votes = column_counts(members, keys)
    return votes.groupBy(*keys, "pos").agg(F.max_by("base", F.struct("n", -F.col("first"))).alias("base"))


def consensus(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, consensus, kept): the consensus without its gap columns, and the places of the columns kept."""
    by_place = F.array_sort(F.collect_list(F.struct("pos", "base")))
    solid = F.filter(by_place, lambda e: e["base"] != GAP)
    out = column_votes(members, keys).groupBy(*keys).agg(solid.alias("solid"))
    return out.select(*keys, F.array_join(F.transform("solid", lambda e: e["base"]), "").alias("consensus"), F.transform("solid", lambda e: e["pos"]).alias("kept"))


def strip_gap_columns(members: DataFrame, keys: list[str], found: DataFrame | None = None) -> DataFrame:
    """members with seq cut to the columns their consensus keeps; gaps of their own may stay."""
    found = consensus(members, keys) if found is None else found
    cut = F.array_join(F.transform("kept", lambda p: F.substring("seq", p + 1, F.lit(1))), "")
    return members.join(found.select(*keys, "kept"), keys).withColumn("seq", cut).drop("kept")


def aligned_identity(a: str | Column, b: str | Column) -> Column:
    """Equal letters over columns without a gap, of two strings already aligned; 0 without such columns."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    pairs = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: (p["x"] != GAP) & (p["y"] != GAP))
    both = F.size(pairs)
    return F.when(both > 0, F.size(F.filter(pairs, lambda p: p["x"] == p["y"])) / both).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def global_identity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([kernels.global_identity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def local_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gaps left in a cleaned copy are no letters; they are dropped before scoring."""
    return pd.Series([kernels.local_score((x or "").replace(GAP, ""), (y or "").replace(GAP, "")) for x, y in zip(a, b, strict=True)], dtype=float)


def cluster_pairs(clusters: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Each two clusters of a node once: (keys, c1, c2) with c1 < c2, and the values of both."""
    one = clusters.select(*keys, F.col("cluster").alias("c1"), *[F.col(v).alias(f"{v}_1") for v in values])
    two = clusters.select(*keys, F.col("cluster").alias("c2"), *[F.col(v).alias(f"{v}_2") for v in values])
    return one.join(two, keys).filter("c1 < c2")


def pairwise_similarity(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, c1, c2, similarity) of the consensuses of a node."""
    return cluster_pairs(found, keys, "consensus").select(*keys, "c1", "c2", global_identity("consensus_1", "consensus_2").alias("similarity"))


def similarity_gate(nodes: DataFrame, pairs: DataFrame, keys: list[str], most: float = 0.95, upper: str = "upper") -> DataFrame:
    """nodes with least and largest similarity, all below `most`, all at or above the node's bound; no pairs pass both."""
    stats = pairs.join(nodes.select(*keys, upper), keys).groupBy(*keys).agg(F.min("similarity").alias("minimum_child_similarity"), F.max("similarity").alias("maximum_child_similarity"), F.bool_and(F.col("similarity") < most).alias("_below"), F.bool_and(F.col("similarity") >= F.col(upper)).alias("_above"))
    return nodes.join(stats, keys, "left").withColumn("pass_similarity_threshold", F.coalesce("_below", F.lit(True))).withColumn("pass_layer_similarity", F.coalesce("_above", F.lit(True))).drop("_below", "_above")


def sibling_maximum(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster, upper): each cluster's largest similarity to a sibling."""
    ends = pairs.select(*keys, F.explode(F.array("c1", "c2")).alias("cluster"), "similarity")
    return ends.groupBy(*keys, "cluster").agg(F.max("similarity").alias("upper"))


def best_hits(hits: DataFrame, keys: list[str], query: str = "ord", subject: str = "cluster", score: str = "score") -> DataFrame:
    """Each query's subject of the largest score; of equal ones the least."""
    order = Window.partitionBy(*keys, query).orderBy(F.desc(score), subject)
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def reassignment_accuracy(members: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reassignment_accuracy): the share of all members whose best hit is their own cluster."""
    hit = best.select(*keys, "ord", F.col("cluster").alias("_hit"))
    own = members.join(hit, [*keys, "ord"], "left")
    return own.groupBy(*keys).agg((F.count_if(F.col("_hit") == F.col("cluster")) / F.count("*")).alias("reassignment_accuracy"))


def search_children(members: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, cluster, score): every cleaned member against every consensus of its node."""
    copies = strip_gap_columns(members, [*keys, "cluster"], found).select(*keys, "ord", "seq")
    subjects = found.select(*keys, "cluster", "consensus")
    scored = copies.join(subjects, keys).select(*keys, "ord", "cluster", local_score("seq", "consensus").alias("score"))
    return scored.filter("score > 0")


def best_children(members: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, cluster, score, scored): the best hit of each cleaned member among its node's consensuses, as `best_hits` of `search_children`.

    A node's consensuses, one for each child, go with its members; those that cannot be the best by their letters and words are not aligned.
    Members without a hit have no row. scored: how many pairs were aligned.
    """
    @F.pandas_udf("cluster int, score double, scored int")
    def search(seqs: pd.Series, subjects: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple] = {}
        rows = []
        for seq, some in zip(seqs, subjects, strict=True):
            listed = [(s["cluster"], (s["consensus"] or "").replace(GAP, "")) for s in some]
            for _, text in listed:
                if text not in known:
                    known[text] = kernels.word_counts(text)
            rows.append(kernels.best_local((seq or "").replace(GAP, ""), [(c, text, known[text]) for c, text in listed]))
        return pd.DataFrame(rows, columns=["cluster", "score", "scored"]).astype({"cluster": "Int32", "score": float, "scored": "int32"})

    copies = strip_gap_columns(members, [*keys, "cluster"], found).select(*keys, "ord", "seq")
    subjects = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "consensus"))).alias("subjects"))
    hit = copies.join(subjects, keys).select(*keys, "ord", search("seq", "subjects").alias("hit"))
    return hit.select(*keys, "ord", "hit.*").filter("score > 0")
