"""Numpy arrays in compressed byte strings, for rows that carry many small values at once."""

from __future__ import annotations

import json
import struct

import numpy as np


def _planes(a: np.ndarray) -> bytes:
    """The bytes of all values, first bytes first: the high bytes of small numbers compress to nothing."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.itemsize > 1 and a.size else a.tobytes()


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    body = zstandard.ZstdCompressor(level=level).compress(b"".join(_planes(a) for a in arrays))
    return struct.pack("<i", len(head)) + head + body


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    (size,) = struct.unpack_from("<i", data)
    raw, at, out = zstandard.ZstdDecompressor().decompress(data[4 + size :]), 0, []
    for kind, n in json.loads(data[4 : 4 + size]):
        dtype = np.dtype(kind)
        part = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at)
        at += n * dtype.itemsize
        out.append(np.ascontiguousarray(part.reshape(dtype.itemsize, n).T).view(dtype).ravel() if n else np.empty(0, dtype))
    return out
