"""Matrices as square tiles: rows (node, bi, bj, rows, cols, tile, seen_i, seen_j) instead of one row for each cell.

A tile holds the cells of `SIDE` rows and columns as doubles, 2 MB at most; the matrix of a small node is one tile of its own size. seen_i and
seen_j say which ordinals the edges name. Vectors over the members come in blocks of the same side, so sums and
products go tile by tile: no task holds more of a large matrix than a few tiles.

Where members are points, a tile is made from its two blocks of vectors whenever it is needed (`pairs.facing`), and serves on both
sides of the diagonal: what is kept grows with the blocks that each block meets, not with the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import kernels

SIDE = 512
BROADCAST_BYTES = 64 << 20  #: vectors up to this size are sent to the tiles, else the tiles are shuffled to them
HELD = 64  #: blocks that a task sums up at once

_TILE = "bi int, bj int, rows int, cols int, tile binary, seen_i binary, seen_j binary"


def node_kind(df: DataFrame) -> str:
    return df.schema["node"].dataType.simpleString()


def tiled(edges: DataFrame, value: str = "affinity") -> DataFrame:
    """Tiles of (node, i, j, value), with a diagonal of zeros; a cell without an edge is 0."""

    def build(table: pa.Table) -> pa.Table:
        i, j, x = (table.column(c).to_numpy() for c in ("i", "j", "x"))
        bi, bj, r, c = int(i[0]) // SIDE, int(j[0]) // SIDE, i % SIDE, j % SIDE
        cells = np.zeros((int(r.max()) + 1, int(c.max()) + 1))
        cells[r, c] = x
        if bi == bj:
            np.fill_diagonal(cells, 0)
        seen = [np.zeros(n, bool) for n in cells.shape]
        seen[0][r] = seen[1][c] = True
        row = {"bi": bi, "bj": bj, "rows": cells.shape[0], "cols": cells.shape[1], "tile": cells.tobytes(), "seen_i": seen[0].tobytes(), "seen_j": seen[1].tobytes()}
        kinds = {"bi": pa.int32(), "bj": pa.int32(), "rows": pa.int32(), "cols": pa.int32()}
        return pa.table({"node": table.column("node").slice(0, 1), **{c: pa.array([v], kinds.get(c, pa.binary())) for c, v in row.items()}})

    block = lambda c: F.floor(F.col(c) / SIDE).cast("int")
    cells = edges.select("node", "i", "j", F.col(value).cast("double").alias("x"), block("i").alias("bi"), block("j").alias("bj"))
    return cells.groupBy("node", "bi", "bj").applyInArrow(build, f"node {node_kind(edges)}, {_TILE}")


def extents(tiles: DataFrame) -> DataFrame:
    """(node, n): one more than the largest ordinal."""
    return tiles.groupBy("node").agg(F.max(F.greatest(F.col("bi") * SIDE + F.col("rows"), F.col("bj") * SIDE + F.col("cols"))).alias("n"))


def cells_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["tile"]).reshape(row["rows"], row["cols"])


def affinities_of(rows: int, cols: int, p: pa.Buffer | bytes, q: pa.Buffer | bytes, top: float, diagonal: bool) -> np.ndarray:
    """The tile of two blocks of vectors: 1 - distance / top, with a diagonal of zeros."""
    a = kernels.near_distances(np.frombuffer(p).reshape(rows, -1), np.frombuffer(q).reshape(cols, -1))
    a /= -top
    a += 1
    if diagonal:
        np.fill_diagonal(a, 0)
    return a


def assembled(table: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(ordinals, matrix) of one node's tiles of that side."""
    some = [{c: table.column(c)[n].as_py() if c != "tile" else table.column(c)[n].as_buffer() for c in table.column_names if c != "node"} for n in range(table.num_rows)]
    n = max(max(t["bi"] * side + t["rows"], t["bj"] * side + t["cols"]) for t in some)
    block, seen = np.zeros((n, n)), np.zeros(n, bool)
    for t in some:
        i, j = t["bi"] * side, t["bj"] * side
        block[i : i + t["rows"], j : j + t["cols"]] = cells_of(t)
        seen[i : i + t["rows"]] |= np.frombuffer(t["seen_i"], bool)
        seen[j : j + t["cols"]] |= np.frombuffer(t["seen_j"], bool)
    ids = np.flatnonzero(seen)
    return (ids, block) if len(ids) == n else (ids, block[np.ix_(ids, ids)])


def _packed(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """Rows of (node, b, bytes ...)."""
    columns = list(zip(*rows, strict=True)) or [() for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[2:]]], names=names)


def _padded_sum(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """The sum of arrays that may differ in length."""
    if a is None:
        return b
    if len(a) < len(b):
        a, b = b, a
    out = a.copy()
    out[: len(b)] += b
    return out


def degrees(tiles: DataFrame) -> DataFrame:
    """(node, b, degree, seen, members): row sums by block, doubles; flags of the block's ordinals, and how many there are."""

    def sums(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                rows.append((t["node"], t["bi"], cells_of(t).sum(1).tobytes(), t["seen_i"]))
                rows.append((t["node"], t["bj"], b"", t["seen_j"]))
            yield _packed(rows, ["node", "b", "degree", "seen"], batch.schema.field("node").type)

    def faced(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                a, diagonal = affinities_of(t["rows"], t["cols"], t["p"], t["q"], t["top"], t["bi"] == t["bj"]), t["bi"] == t["bj"]
                for b, axis in (("bi", 1), ("bj", 0))[: 2 - diagonal]:
                    rows.append((t["node"], t[b], a.sum(axis).tobytes(), np.ones(a.shape[1 - axis], bool).tobytes()))
            yield _packed(rows, ["node", "b", "degree", "seen"], batch.schema.field("node").type)

    def combine(table: pa.Table) -> pa.Table:
        total, seen = None, None
        for d, s in zip(table.column("degree").to_pylist(), table.column("seen").to_pylist(), strict=True):
            total, seen = _padded_sum(total, np.frombuffer(d)), _padded_sum(seen, np.frombuffer(s, np.int8).astype(np.int64))
        degree = _padded_sum(total, np.zeros(len(seen)))
        return pa.table({"node": table.column("node").slice(0, 1), "b": table.column("b").slice(0, 1), "degree": pa.array([degree.tobytes()], pa.binary()), "seen": pa.array([(seen > 0).tobytes()], pa.binary()), "members": pa.array([int((seen > 0).sum())], pa.int32())})

    schema = f"node {node_kind(tiles)}, b int, degree binary, seen binary"
    parts = tiles.mapInArrow(faced, schema) if "p" in tiles.columns else tiles.select("node", "bi", "bj", "rows", "cols", "tile", "seen_i", "seen_j").mapInArrow(sums, schema)
    return parts.groupBy("node", "b").applyInArrow(combine, f"{schema}, members int")


def beside(tiles: DataFrame, blocks: DataFrame, column: str, size: int) -> DataFrame:
    """tiles with the block of `column` that belongs to their columns, as x; size: the bytes of all blocks."""
    side = blocks.select("node", F.col("b").alias("bj"), F.col(column).alias("x"))
    return tiles.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, ["node", "bj"])


def product(tiles: DataFrame, blocks: DataFrame, column: str, widths: dict, size: int, squared: bool = False) -> DataFrame:
    """(node, b, part): parts of the matrix's product with the vectors in column; they add up by (node, b).

    widths: how many vectors a node has; squared: the product with the squares of the matrix's cells.
    """

    def multiply(batches) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def drain(kind: pa.DataType) -> pa.RecordBatch:
            rows = [(*k, v.tobytes()) for k, v in held.items()]
            held.clear()
            return _packed(rows, ["node", "b", "part"], kind)

        for batch in batches:
            tile, x = batch.column("tile"), batch.column("x")
            for n, t in enumerate(batch.select(["node", "bi", "rows", "cols"]).to_pylist()):
                cells = np.frombuffer(tile[n].as_buffer()).reshape(t["rows"], t["cols"])
                vectors = np.frombuffer(x[n].as_buffer()).reshape(-1, widths[t["node"]])
                key = (t["node"], t["bi"])
                held[key] = _padded_sum(held.get(key), (cells * cells if squared else cells) @ vectors[: t["cols"]])
            if len(held) > HELD:
                yield drain(batch.schema.field("node").type)
        if held:
            yield drain(batch.schema.field("node").type)

    def multiply_faced(batches) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("node").type
            p, q, x, w = (batch.column(c) for c in ("p", "q", "x", "w"))
            for n, t in enumerate(batch.select(["node", "bi", "bj", "rows", "cols", "top"]).to_pylist()):
                a = affinities_of(t["rows"], t["cols"], p[n].as_buffer(), q[n].as_buffer(), t["top"], t["bi"] == t["bj"])
                a = a * a if squared else a
                right, left = (np.frombuffer(v[n].as_buffer()).reshape(-1, widths[t["node"]]) for v in (x, w))
                for b, part in ((t["bi"], lambda: a @ right), (t["bj"], lambda: a.T @ left))[: 1 + (t["bi"] != t["bj"])]:
                    held[t["node"], b] = _padded_sum(held.get((t["node"], b)), part())
            if len(held) > HELD:
                yield _packed([(*k, v.tobytes()) for k, v in held.items()], ["node", "b", "part"], kind)
                held.clear()
        if held:
            yield _packed([(*k, v.tobytes()) for k, v in held.items()], ["node", "b", "part"], kind)

    schema = f"node {node_kind(tiles)}, b int, part binary"
    if "p" in tiles.columns:
        near = blocks.select("node", F.col("b").alias("bi"), F.col(column).alias("w"))
        both = beside(tiles, blocks, column, size).join(F.broadcast(near) if size <= BROADCAST_BYTES else near, ["node", "bi"])
        return both.mapInArrow(multiply_faced, schema)
    return beside(tiles, blocks, column, size).select("node", "bi", "rows", "cols", "tile", "x").mapInArrow(multiply, schema)
