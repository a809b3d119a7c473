"""Embedding tables: which rows take part, and their values as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_sound(column: str = "embedding") -> Column:
    """Whether a row's vector is whole, finite and not zero, whatever its length."""
    v = F.col(column)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def sound(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.filter(is_sound(column))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def row_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed from the first component to the last, so equal rows give equal sums."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for n in range(a.shape[-1]):
        out += a[..., n] * b[..., n]
    return out
