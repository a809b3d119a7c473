"""K-means of points that stand in blocks, for all k and starts of many nodes at once.

It is `kernels.kmeans` step by step, with the same draws: greedy k-means++ starts (Arthur and Vassilvitskii 2007), then Lloyd 1982. A pass over
the blocks serves every run (a node, a k and a start). Tasks see one block at a time and send sums, which are merged by run in
a shuffle; the driver holds the centres, and a number for each block and draw while the starts are drawn. No task holds a node's points.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillon.functions import kernels
from quillon.operators import tiles
from quillon.session import settled

BLOCKS = 16  #: blocks of a partition, about 1.3 MB at 20 columns


@dataclass
class Run:
    node: object
    k: int
    first: int
    shares: np.ndarray  #: a row for each further centre: where its options lie in the sum of squared distances
    dims: int
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    options: np.ndarray | None = None

    def near(self, x: np.ndarray) -> np.ndarray:
        return kernels.squared(x, self.centres).min(1) if len(self.centres) else np.full(len(x), np.inf)


def _read(batches, widths: dict) -> Iterator[tuple[object, int, np.ndarray]]:
    for batch in batches:
        for node, b, seen, x in zip(*(batch.column(c).to_pylist() for c in ("node", "b", "seen", "x")), strict=True):
            yield node, b, np.frombuffer(x).reshape(-1, widths[node])[np.frombuffer(seen, bool)]


def _per_block(points: DataFrame, widths: dict, work: Callable) -> list[tuple[int, int, np.ndarray]]:
    """What work(node, b, x) yields as (number, array), with b."""

    def go(batches):
        for node, b, x in _read(batches, widths):
            rows = [(n, b, np.asarray(v, np.float64).tobytes()) for n, v in work(node, b, x)]
            if rows:
                ns, bs, vs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int32()), pa.array(bs, pa.int32()), pa.array(vs, pa.binary())], names=["n", "b", "v"])

    return sorted(((r["n"], r["b"], np.frombuffer(r["v"])) for r in points.mapInArrow(go, "n int, b int, v binary").collect()), key=lambda r: r[:2])


def _per_run(points: DataFrame, widths: dict, work: Callable) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums and least values of what work(node, b, x) yields as (run, to sum, to take the least of), over all blocks in one order."""

    def go(batches):
        held: dict[int, list[np.ndarray]] = {}
        for node, b, x in _read(batches, widths):
            for n, total, least in work(node, b, x):
                old = held.get(n)
                held[n] = [total, least] if old is None else [old[0] + total, np.minimum(old[1], least)]
        part, ns = TaskContext.get().partitionId(), list(held)
        yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int32()), pa.array([part] * len(ns), pa.int32()), *[pa.array([np.asarray(held[n][c], np.float64).tobytes() for n in ns], pa.binary()) for c in (0, 1)]], names=["n", "part", "total", "least"])

    def merge(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        total, least = np.frombuffer(rows[0]["total"]).copy(), np.frombuffer(rows[0]["least"])
        for r in rows[1:]:
            total += np.frombuffer(r["total"])
            least = np.minimum(least, np.frombuffer(r["least"]))
        return pa.table({"n": pa.array([rows[0]["n"]], pa.int32()), "total": pa.array([total.tobytes()], pa.binary()), "least": pa.array([least.tobytes()], pa.binary())})

    merged = points.mapInArrow(go, "n int, part int, total binary, least binary").groupBy("n").applyInArrow(merge, "n int, total binary, least binary")
    return {r["n"]: (np.frombuffer(r["total"]), np.frombuffer(r["least"])) for r in merged.collect()}


def _by_node(runs: dict[int, Run]) -> dict[object, list[tuple[int, Run]]]:
    found = defaultdict(list)
    for n, run in runs.items():
        found[run.node].append((n, run))
    return dict(found)


def _fetch(points: DataFrame, widths: dict, runs: dict[int, Run], wanted: dict[tuple[object, int], list[tuple[int, int, int | None, float]]]) -> dict[int, np.ndarray]:
    """Points by run and draw: the one at a place of a block, or where the squared distances of a block add up to a sum."""

    def work(node, b, x):
        sums: dict[int, np.ndarray] = {}
        for n, draw, place, target in wanted.get((node, b), ()):
            y = x[:, : runs[n].dims]
            if place is None:
                if n not in sums:
                    sums[n] = np.cumsum(runs[n].near(y))
                place = min(int(np.searchsorted(sums[n], target, side="right")), len(y) - 1)
            yield n, np.concatenate([[draw], y[place]])

    found = defaultdict(dict)
    for n, _, v in _per_block(points, widths, work):
        found[n][int(v[0])] = v[1:]
    return {n: np.stack([some[d] for d in sorted(some)]) for n, some in found.items()}


def _take_best(points: DataFrame, widths: dict, runs: dict[int, Run]) -> dict[int, np.ndarray]:
    """Each run takes the option that leaves the least squared distance; gives what it leaves in each block."""
    of = _by_node(runs)

    def work(node, b, x):
        for n, run in of.get(node, ()):
            y = x[:, : run.dims]
            yield n, np.minimum(run.near(y)[:, None], kernels.squared(y, run.options)).sum(0)

    sums = defaultdict(list)
    for n, _, v in _per_block(points, widths, work):
        sums[n].append(v)
    left = {}
    for n, run in runs.items():
        table = np.stack(sums[n])
        best = int(table.sum(0).argmin())
        run.centres = np.concatenate([run.centres.reshape(-1, run.dims), run.options[best : best + 1]])
        run.options, left[n] = None, table[:, best]
    return left


def _start(points: DataFrame, widths: dict, runs: dict[int, Run], blocks: dict, starts: dict) -> None:
    def at(node, place: int) -> tuple[int, int]:
        n = int(np.searchsorted(starts[node], place, side="right")) - 1
        return blocks[node][n], place - int(starts[node][n])

    going, left, step = runs, {}, 0
    while going:
        wanted = defaultdict(list)
        for n, run in going.items():
            if step == 0:
                b, place = at(run.node, run.first)
                wanted[run.node, b].append((n, 0, place, 0.0))
                continue
            rising = np.cumsum(left[n])
            for draw, share in enumerate(run.shares[step - 1]):
                if rising[-1] == 0:
                    b, place = at(run.node, int(share * starts[run.node][-1]))
                    wanted[run.node, b].append((n, draw, place, 0.0))
                    continue
                target = share * rising[-1]
                block = min(int(np.searchsorted(rising, target, side="right")), int(np.flatnonzero(left[n])[-1]))
                wanted[run.node, blocks[run.node][block]].append((n, draw, None, target - (rising[block - 1] if block else 0.0)))
        for n, options in _fetch(points, widths, going, dict(wanted)).items():
            going[n].options = options
        left, step = _take_best(points, widths, going), step + 1
        going = {n: run for n, run in going.items() if run.k > step}


def _farthest(points: DataFrame, widths: dict, runs: dict[int, Run], empty: dict[int, int]) -> dict[int, np.ndarray]:
    """The points farthest from their centres, as many as a run has empty clusters; of equal ones the first."""
    of = _by_node({n: runs[n] for n in empty})

    def work(node, b, x):
        for n, run in of.get(node, ()):
            y = x[:, : run.dims]
            gap = ((y - run.centres[kernels.squared(y, run.centres).argmin(1)]) ** 2).sum(1)
            for place in np.argsort(-gap, kind="stable")[: empty[n]]:
                yield n, np.concatenate([[gap[place]], y[place]])

    found = defaultdict(list)
    for n, _, v in _per_block(points, widths, work):
        found[n].append(v)
    return {n: np.stack(sorted(rows, key=lambda v: -v[0])[: empty[n]])[:, 1:] for n, rows in found.items()}


def _lloyd(points: DataFrame, widths: dict, runs: dict[int, Run], limits: dict[int, float], rounds: int) -> None:
    going = dict(runs)
    for _ in range(rounds):
        if not going:
            return
        of = _by_node(going)

        def work(node, b, x, of=of):
            for n, run in of.get(node, ()):
                y = x[:, : run.dims]
                label = kernels.squared(y, run.centres).argmin(1)
                sums = [np.bincount(label, minlength=run.k), *[np.bincount(label, y[:, d], run.k) for d in range(run.dims)]]
                yield n, np.stack(sums).astype(np.float64).ravel(), np.zeros(0)

        found = {n: total.reshape(-1, going[n].k) for n, (total, _) in _per_run(points, widths, work).items()}
        empty = {n: int((t[0] == 0).sum()) for n, t in found.items() if (t[0] == 0).any()}
        far = _farthest(points, widths, runs, empty) if empty else {}
        for n, table in found.items():
            new = (table[1:] / np.maximum(table[0], 1)).T.copy()
            if n in far:
                new[table[0] == 0] = far[n]
            moved, going[n].centres = ((new - going[n].centres) ** 2).sum(), new
            if moved <= limits[n]:  # unchanged members leave the centres as they are
                del going[n]


def partitions(blocks: DataFrame, widths: dict, tried: dict[object, list[int]], seed: int, starts: int = 10, rounds: int = 300, tolerance: float = 1e-4) -> DataFrame:
    """(node, k, b, labels, error) of blocks (node, b, seen, x); tried: the k of each node.

    Clusters are numbered by their first member. A k whose clusters have no silhouette has its error and no labels.
    """
    kind = tiles.node_kind(blocks)
    plain = blocks.select("node", "b", "seen", "x")
    count = plain.count()
    points = settled(plain.repartition(max(1, -(-count // BLOCKS)), "node", "b").sortWithinPartitions("node", "b"))
    names = list(tried)
    number = {node: n for n, node in enumerate(names)}

    def spread(node, b, x):
        if node in number:
            yield number[node], np.concatenate([[len(x)], x.sum(0), ((x - x.mean(0)) ** 2).sum(0) if len(x) else np.zeros(x.shape[1])])

    seen = defaultdict(list)
    for n, b, v in _per_block(points, widths, spread):
        seen[names[n]].append((b, v))
    at = {node: [b for b, _ in rows] for node, rows in seen.items()}
    places = {node: np.concatenate([[0], np.cumsum([int(v[0]) for _, v in rows])]) for node, rows in seen.items()}
    runs, limits = {}, {}
    for node in names:
        facts, width = np.stack([v for _, v in seen[node]]), widths[node]
        sizes, sums, inner = facts[:, 0], facts[:, 1 : 1 + width], facts[:, 1 + width :]
        mean = sums.sum(0) / sizes.sum()
        variance = (inner + sizes[:, None] * (sums / np.maximum(sizes, 1)[:, None] - mean) ** 2).sum(0) / sizes.sum()
        for k in tried[node]:
            rng = np.random.default_rng(seed)
            for _ in range(starts):
                limits[len(runs)] = tolerance * variance[: min(k, width)].mean()
                runs[len(runs)] = Run(node, k, *kernels.draws(int(sizes.sum()), k, rng), dims=min(k, width))
    _start(points, widths, runs, at, places)
    _lloyd(points, widths, runs, limits, rounds)

    of, begin = _by_node(runs), {(node, b): int(p) for node, some in at.items() for b, p in zip(some, places[node], strict=False)}

    def weigh(node, b, x):
        for n, run in of.get(node, ()):
            away = kernels.squared(x[:, : run.dims], run.centres)
            label, first = away.argmin(1), np.full(run.k, np.inf)
            present, place = np.unique(label, return_index=True)
            first[present] = place + begin[node, b]
            yield n, np.array([away[np.arange(len(x)), label].sum()]), first

    weighed = _per_run(points, widths, weigh)
    best: dict[tuple[object, int], tuple[float, int]] = {}
    for n, run in runs.items():
        inertia = weighed[n][0][0]
        if (run.node, run.k) not in best or inertia < best[run.node, run.k][0] * (1 - 1e-12):
            best[run.node, run.k] = inertia, n
    chosen = defaultdict(list)
    for (node, k), (_, n) in best.items():
        first = weighed[n][1]
        rank = np.argsort(np.argsort(first, kind="stable"), kind="stable").astype(np.int32)
        good = 2 <= np.isfinite(first).sum() < places[node][-1]
        chosen[node].append((k, runs[n].centres, runs[n].dims, rank, None if good else "invalid_number_of_clusters"))
    chosen = dict(chosen)

    def label(batches):
        for batch in batches:
            out = []
            for node, b, x in _read([batch], widths):
                for k, centres, dims, rank, error in chosen.get(node, ()):
                    out.append((node, k, b, None if error else rank[kernels.squared(x[:, :dims], centres).argmin(1)].tobytes(), error))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (batch.schema.field("node").type, pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["node", "k", "b", "labels", "error"])

    return points.mapInArrow(label, f"node {kind}, k int, b int, labels binary, error string")
