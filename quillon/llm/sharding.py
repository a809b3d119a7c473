"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in doc_id order. A keyed Feistel network permutes [0, 4^k), the least such
range that holds all row numbers; numbers that fall outside [0, n) are encrypted again until they
fall inside, which makes it a permutation of [0, n). Shard and slot are remainder and quotient of
the permuted number by the shard count, so anyone with the seed, n and a row number can compute
both, and can invert them.

Law `rows`: shard sizes differ by at most one row. Copies of a text are not kept together, as no
law on row counts could hold if they were.

Defined cases: null doc_ids come first in the numbering; a null text has no bytes; rows alike in
doc_id, size and checksum are interchangeable; an empty table gives no rows; other columns are kept
only by `shard_documents`, never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import mix64, number_rows, text_or_empty

ROUNDS = 4


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [(seed * 1_000_003 + r) & 0xFFFFFFFFFFFFFFFF for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, key: int) -> np.ndarray:
        return mix64(x, key + 1) & self.mask

    def _walk(self, x, step) -> np.ndarray:
        x = step(np.asarray(x, dtype=np.uint64))
        while (out := x >= self.n).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def _encrypt(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._round(right, key)
        return (left << np.uint64(self.half)) | right

    def _decrypt(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self._round(left, key), left
        return (left << np.uint64(self.half)) | right

    def forward(self, rows) -> np.ndarray:
        return self._walk(rows, self._encrypt)

    def inverse(self, places) -> np.ndarray:
        return self._walk(places, self._decrypt)


def place(numbered: DataFrame, n: int, shards: int, seed: int, row: str = "row_no") -> DataFrame:
    """Adds shard int and slot long, computed from the row number alone."""
    if shards < 1:
        raise ValueError("shards must be positive")
    perm = Feistel(n, seed)

    @F.pandas_udf(T.LongType())
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(perm.forward(x.to_numpy()))

    return numbered.withColumn("_at", permuted(row)).withColumn("shard", (F.col("_at") % shards).cast("int")).withColumn("slot", F.expr(f"_at div {int(shards)}")).drop("_at")


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """(doc_id, size, text_crc32, row_no, shard, slot): 28 bytes a row are shuffled, no text."""
    text = text_or_empty()
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(slim, "doc_id", "size", "text_crc32")
    return place(numbered, n, shards, seed)
