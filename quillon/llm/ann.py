"""Nearest neighbours by randomly rotated one-bit codes.

Each vector is rotated by one random orthonormal matrix and kept as the signs of its coordinates,
packed, with two scalars: its norm, and the inner product f of the rotated unit vector with its sign
vector. Codes are made once and stored beside their vectors. A rotated query is quantised to
`QUERY_BITS` bits a coordinate, so its inner product with the signs is a few counts of common bits
(and, popcount) on the packed codes. Over f this estimates the inner product without bias, and
differs from it by over `BOUND` * sqrt((1 - f^2) / (f^2 (d - 1))) * |o||q|, plus the query's own
rounding, only rarely. A block's first estimates are computed exactly; all others whose estimate plus
its bound reaches the k-th best exact product so far are computed exactly too.

Query blocks meet data blocks in cells, each a task of bounded size; queries are all rows whose id
is divisible by `every`. Each cell returns its k best for each query, and a window keeps the k best
of all cells.

Defined cases: null, empty, zero and non-finite vectors take no part, nor do null ids; vectors of
several lengths are searched within their length; equal scores go to the smaller id; fewer
candidates than k are all returned; an empty table gives no rows; rows that repeat a query's id are
its own row, and a query that stands in several rows asks once, by its least vector; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import stored
from quillon.llm.vectors import matrix, row_dots, sound

BOUND = 2.5
QUERY_BITS = 6
FIRST = 4  #: times k estimates are computed exactly before the bounds decide
QUERY_BLOCK, DATA_BLOCK, LEAST_BLOCKS = 16384, 65536, 24


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class OneBitCodes:
    """Packed sign bits, in words of 64, and correction scalars of a block of vectors."""

    def __init__(self, words: np.ndarray, dim: int, scale: np.ndarray, error: np.ndarray):
        self.words, self.dim, self.scale, self.error = words, dim, scale, error

    @classmethod
    def of(cls, x: np.ndarray, turn: np.ndarray) -> OneBitCodes:
        x = np.asarray(x, np.float64)
        dim = x.shape[1]
        norm = np.sqrt((x**2).sum(1))
        turned = x @ turn / norm[:, None]
        f = np.abs(turned).sum(1) / np.sqrt(dim)
        return cls(cls.pack(turned > 0), dim, norm / f, norm * np.sqrt(np.maximum(0, 1 - f**2) / (f**2 * max(1, dim - 1))))

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        """Rows of bits as 64-bit words, one array for each word of a row."""
        wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
        wide[:, : bits.shape[1]] = bits
        return np.ascontiguousarray(np.packbits(wide, axis=1, bitorder="little").view("<u8").T)

    def estimate(self, query: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, float]:
        """(estimated inner products with a query, deviation that the query's rounding adds before scaling)."""
        turned = query @ turn / np.sqrt(self.dim)
        low, step = turned.min(), max(np.ptp(turned) / ((1 << QUERY_BITS) - 1), 1e-300)
        levels = np.rint((turned - low) / step).astype(np.int64)
        planes = self.pack((levels >> np.arange(QUERY_BITS)[:, None]) & 1 == 1)
        held, ones = np.zeros(self.words.shape[1], np.int64), np.zeros(self.words.shape[1], np.int64)
        for n, word in enumerate(self.words):
            ones += np.bitwise_count(word)
            for j in range(QUERY_BITS):
                held += np.bitwise_count(word & planes[n, j]).astype(np.int64) << j
        # sum of sign * (low + step * level), where sign = 2 * bit - 1
        product = step * (2 * held - levels.sum()) + low * (2 * ones - self.dim)
        return product * self.scale, step * np.sqrt(self.dim / 12)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: OneBitCodes, k: int, turn: np.ndarray, bound: float = BOUND) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k best of a block, best first."""
    for ident, query in zip(q_ids, np.asarray(q, np.float64), strict=True):
        guess, shift = codes.estimate(query, turn)
        own = np.flatnonzero(ids == ident)
        guess[own] = -np.inf
        there = len(ids) - len(own)
        pick = np.argpartition(-guess, FIRST * k - 1)[: FIRST * k] if len(guess) > FIRST * k else np.arange(len(guess))
        pick = pick[guess[pick] > -np.inf]
        score = row_dots(x[pick], query)
        if there > len(pick):
            best = np.partition(score, -k)[-k]
            more = guess + bound * (np.sqrt(row_dots(query, query)) * codes.error + shift * codes.scale) >= best
            more[pick] = False
            more = np.flatnonzero(more)
            pick, score = np.concatenate((pick, more)), np.concatenate((score, row_dots(x[more], query)))
        order = np.lexsort((ids[pick], -score))[:k]
        yield ident, ids[pick[order]], score[order]


def index(vectors: DataFrame, seed: int = 7) -> DataFrame:
    """(dim, vec_id, embedding, words, scale, error): every usable row with its code, stored once."""

    def code(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                made = OneBitCodes.of(matrix(some.column(2), dim), turns.setdefault(dim, rotation(dim, seed)))
                words = [w.tobytes() for w in np.ascontiguousarray(made.words.T)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(words, pa.binary()), pa.array(made.scale), pa.array(made.error)], names=["dim", "vec_id", "embedding", "words", "scale", "error"])

    good = sound(vectors.select("vec_id", "embedding").filter("vec_id is not null")).select(F.size("embedding").alias("dim"), "vec_id", F.col("embedding").cast("array<double>"))
    return stored(good.mapInArrow(code, "dim int, vec_id long, embedding array<double>, words binary, scale double, error double"))


def search(vectors: DataFrame, every: int = 20, k: int = 20, seed: int = 7, bound: float = BOUND) -> DataFrame:
    """(query_id, rank, vec_id, score)"""
    coded = index(vectors, seed)
    asks = coded.filter(F.col("vec_id") % every == 0)
    n, m = coded.count(), asks.count()
    data_blocks, query_blocks = max(-(-n // DATA_BLOCK), min(LEAST_BLOCKS, -(-n // 256)), 1), max(-(-m // QUERY_BLOCK), 1)
    block = lambda c, count: F.pmod(F.xxhash64("vec_id", F.lit(c)), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    none = F.lit(None)
    data = coded.select("dim", block("data", data_blocks).alias("db"), each(query_blocks).alias("qb"), F.lit(False).alias("ask"), "vec_id", "embedding", "words", "scale", "error")
    once = asks.groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("q")).select("q.dim", "vec_id", "q.embedding")
    ask = once.select("dim", each(data_blocks).alias("db"), block("ask", query_blocks).alias("qb"), F.lit(True).alias("ask"), "vec_id", "embedding", none.cast("binary").alias("words"), none.cast("double").alias("scale"), none.cast("double").alias("error"))

    def cell(t: pa.Table) -> pa.Table:
        rows = []
        if t.num_rows:
            dim, is_ask = t["dim"][0].as_py(), t["ask"].to_numpy()
            asked, data = t.filter(pa.array(is_ask)), t.filter(pa.array(~is_ask))
            if asked.num_rows and data.num_rows:
                words = np.frombuffer(b"".join(data["words"].to_pylist()), "<u8").reshape(data.num_rows, -1).T
                codes = OneBitCodes(np.ascontiguousarray(words), dim, data["scale"].to_numpy(), data["error"].to_numpy())
                rows = list(search_block(asked["vec_id"].to_numpy(), matrix(asked["embedding"], dim), data["vec_id"].to_numpy(), matrix(data["embedding"], dim), codes, k, rotation(dim, seed), bound))
        sizes = [len(r[1]) for r in rows]
        return pa.table({"query_id": pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), sizes)), "vec_id": pa.array(np.concatenate([r[1] for r in rows]) if rows else np.empty(0, np.int64)), "score": pa.array(np.concatenate([r[2] for r in rows]) if rows else np.empty(0))})

    found = data.union(ask).groupBy("dim", "qb", "db").applyInArrow(cell, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
