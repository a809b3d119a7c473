"""Leading eigenvectors of large affinity matrices in tiles, with a residual test.

The vectors wanted are those of S = D^-1/2 W D^-1/2 with the largest eigenvalues (isolated members count as eigenvalue 1, as in
the dense form). Chebyshev-filtered subspace iteration (Zhou, Saad, Tiago and Chelikowsky 2006) on `WIDTH` columns, far more than are
wanted, so that the gap that convergence hangs on is that to the last of them. Each cycle: filter, orthonormalise by
Cholesky factors of the Gram matrix, Rayleigh-Ritz, residuals. Leading columns with residual norms within `TOLERANCE` are
locked: filters leave them alone, so they no longer limit a filter's degree. It ends when all that are wanted are locked, and fails
after `CYCLES` cycles; there is no other end.

Products go tile by tile, other steps block by block; the driver sees Gram matrices of WIDTH columns of each node.

Of points, a node of up to `WHOLE` members is solved by the same steps in one task (`leading_of_points`), from its vectors alone: a tile of
affinities lives for one product, so a task holds the vectors and a few times WIDTH columns, and the driver a row for each node.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.functions import kernels
from quillon.operators import tiles as square
from quillon.operators.pairs import vectors_of
from quillon.operators.tiles import SIDE, degrees, node_kind, product
from quillon.session import settled

WIDTH, DEGREE, CYCLES = 96, 24, 80
WHOLE, STEP, WARM = 1 << 16, 512, 3  #: members of the largest node of points solved in one task and of a tile there; its first steps
TOLERANCE = 1e-10
GROWTH = 1e6, 1e11  #: most that a filter may enlarge a column that is not locked, and one that is, over the last

Turns = dict[object, np.ndarray]


def _matrix(data: bytes | pa.Buffer, width: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, width)


def _one(node: pa.Array, b: pa.Array, kind: dict[str, bytes]) -> pa.Table:
    return pa.table({"node": node.slice(0, 1), "b": b.slice(0, 1), **{c: pa.array([v], pa.binary()) for c, v in kind.items()}})


def _joined(parts: DataFrame, state: DataFrame, step: Callable[[object, dict, np.ndarray], dict[str, np.ndarray]], out: list[str], width: Callable) -> DataFrame:
    """state's blocks with what step makes of them and of the sum of their parts, as columns out."""
    columns = [c for c in state.columns if c not in ("node", "b")]

    def combine(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["s"] is not None)
        m = width(own["node"])
        total = np.zeros((len(own["s"]) // 8, m))
        for r in rows:
            if r["part"] is not None:
                x = _matrix(r["part"], m)
                total[: len(x)] += x
        made = {k: np.ascontiguousarray(v).tobytes() for k, v in step(own["node"], own, total).items()}
        return _one(table.column("node"), table.column("b"), {c: made.get(c, own.get(c)) for c in out})

    both = state.unionByName(parts, allowMissingColumns=True).select("node", "b", "part", *columns)
    return both.groupBy("node", "b").applyInArrow(combine, f"node {node_kind(state)}, b int, " + ", ".join(f"{c} binary" for c in out))


def _mapped(state: DataFrame, step: Callable[[object, dict], dict[str, np.ndarray]]) -> DataFrame:
    """state with some of its columns made anew, block by block."""
    names = [c for c in state.columns if c not in ("node", "b")]

    def each(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_buffer() if batch.column(c)[n].is_valid else None for c in names}
                made = {k: np.ascontiguousarray(v).tobytes() for k, v in step(batch.column("node")[n].as_py(), row).items()}
                node, b = batch.column("node").slice(n, 1), batch.column("b").slice(n, 1)
                yield pa.RecordBatch.from_arrays([node, b, *[pa.array([made[c]], pa.binary()) if c in made else batch.column(c).slice(n, 1) for c in names]], names=["node", "b", *names])

    return state.mapInArrow(each, state.schema)


def _sums(state: DataFrame, term: Callable[[object, dict], np.ndarray], shape: Callable[[object], tuple]) -> Turns:
    """By node, the sum over blocks of term; tasks sum up, then nodes."""
    names = [c for c in state.columns if c not in ("node", "b")]
    kind = node_kind(state)

    def partial(batches):
        held: Turns = {}
        node_type = None
        for batch in batches:
            node_type = batch.schema.field("node").type
            for n in range(batch.num_rows):
                node = batch.column("node")[n].as_py()
                row = {c: batch.column(c)[n].as_buffer() if batch.column(c)[n].is_valid else None for c in names}
                x = term(node, row)
                held[node] = held[node] + x if node in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), node_type), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["node", "m"])

    def total(table: pa.Table) -> pa.Table:
        return pa.table({"node": table.column("node").slice(0, 1), "m": pa.array([np.sum([np.frombuffer(m) for m in table.column("m").to_pylist()], 0).tobytes()], pa.binary())})

    found = state.mapInArrow(partial, f"node {kind}, m binary").groupBy("node").applyInArrow(total, f"node {kind}, m binary").collect()
    return {r["node"]: np.frombuffer(r["m"]).reshape(shape(r["node"])) for r in found}


def _orthonormaliser(gram: np.ndarray) -> np.ndarray:
    """Turns columns of this Gram matrix into orthonormal ones, each within the span of those up to it."""
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    unit = gram * scale[:, None] * scale[None, :]
    shift = 0.0
    while True:
        try:
            factor = np.linalg.cholesky((unit + unit.T) / 2 + shift * np.eye(len(unit)))
            return scale[:, None] * np.linalg.inv(factor).T
        except np.linalg.LinAlgError:
            shift = max(1e-15, 10 * shift)


def chebyshev_growth(x: float, degree: int) -> float:
    return float(np.cosh(degree * np.arccosh(max(1.0, x))))


def interval(values: np.ndarray, goal: int, least: float | None, bound: float) -> tuple[float, float]:
    """The interval that a filter damps: from a little under the least value seen so far up to the least on the near side of the wanted ones.

    The lower end need not hold for all that is unwanted: what lies below it then grows into the columns, and
    the least value seen goes down to it. Before anything was seen it is the bound, which holds for all.
    """
    if least is None:
        return bound, float(values[-1])
    wanted = float(values[goal - 1])
    near = values[values > (wanted + least) / 2]
    low = max(bound, least - 0.1 * (wanted - least))
    # three quarters of the columns suffice: what lies between them and the wanted ones then stays in the span, and hinders none
    spare = max(0.0, float(values[max(goal, 3 * len(values) // 4) - 1]))
    high = float(near[-1]) if len(near) else wanted
    return low, spare if low < spare < high else high


def filter_degree(values: np.ndarray, locked: int, low: float, high: float) -> int:
    """The largest degree at which a filter of [low, high] enlarges no column too much."""
    middle, half = (high + low) / 2, max((high - low) / 2, 1e-12)
    most = DEGREE
    for value, limit in ((values[0], GROWTH[1]), (values[min(locked, len(values) - 1)], GROWTH[0])):
        while most > 1 and chebyshev_growth((value - middle) / half, most) > limit:
            most -= 1
    return most


def leading(tiles: DataFrame, wanted: Callable[[int], int], seed: int = 1) -> tuple[DataFrame, dict[object, tuple[int, np.ndarray, np.ndarray]]]:
    """(blocks, facts): node, b, seen, x = D^-1/2 times the wanted eigenvectors after the first, doubles, by falling eigenvalue;
    facts by node: members, eigenvalues (the first too) and residual norms.

    wanted: how many after the first, by the number of members.
    """
    known = settled(degrees(tiles))
    members = {r["node"]: r["n"] for r in known.groupBy("node").agg({"members": "sum"}).withColumnRenamed("sum(members)", "n").collect()}
    widths = {node: min(WIDTH, n) for node, n in members.items()}
    goals = {node: min(n, wanted(n) + 1) for node, n in members.items()}
    size = sum(8 * widths[node] * (n + SIDE) for node, n in members.items())
    width = widths.__getitem__
    kind = node_kind(tiles)

    def start(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                node, b = batch.column("node")[n].as_py(), batch.column("b")[n].as_py()
                degree, seen = np.frombuffer(batch.column("degree")[n].as_buffer()), np.frombuffer(batch.column("seen")[n].as_buffer(), bool)
                some = seen & (degree > 0)
                s = np.where(some, 1 / np.sqrt(np.where(some, degree, 1)), 0.0)
                alone = seen & ~some
                v = np.random.default_rng([seed, b]).standard_normal((len(s), widths[node])) * seen[:, None]
                x = [s.tobytes(), alone.astype(float).tobytes(), v.tobytes(), (s * s).tobytes(), None]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(n, 1), batch.column("b").slice(n, 1), *[pa.array([y], pa.binary()) for y in x]], names=["node", "b", "s", "alone", "v", "last", "sv"])

    state = settled(known.mapInArrow(start, f"node {kind}, b int, s binary, alone binary, v binary, last binary, sv binary"))
    # no eigenvalue lies further out than what the columns' Ritz values leave of the sum of squares of all cells
    squares = _joined(product(tiles, state, "last", dict.fromkeys(widths, 1), size, squared=True), state, lambda node, own, total: {"last": np.frombuffer(own["last"]) * total[:, 0]}, ["s", "alone", "v", "last", "sv"], lambda node: 1)
    energy = _sums(squares, lambda node, own: np.array([np.frombuffer(own["last"]).sum() + np.frombuffer(own["alone"]).sum()]), lambda node: (1,))

    def pulled(rows: DataFrame, step, ready: bool = False) -> DataFrame:
        """rows with what step makes of own columns v, last and of u = S v; ready: they are kept, and their sv is that of their v."""
        held = rows if ready else settled(_mapped(rows, lambda node, own: {"sv": np.frombuffer(own["s"])[:, None] * _matrix(own["v"], width(node))}))

        def make(node, own, total):
            v, s = _matrix(own["v"], width(node)), np.frombuffer(own["s"])[:, None]
            made = step(node, v, own["last"], s * total + np.frombuffer(own["alone"])[:, None] * v)
            return made | {"sv": s * made["v"]}

        return settled(_joined(product(tiles, held, "sv", widths, size), held.drop("sv"), make, ["s", "alone", "v", "last", "sv"], width))

    def turned(rows: DataFrame, turns: Turns, *columns: str) -> DataFrame:
        return _mapped(rows, lambda node, own: {c: _matrix(own[c], width(node)) @ turns[node] for c in columns})

    square = lambda node: (width(node), width(node))
    gram = lambda rows, a, b: _sums(rows, lambda node, own: _matrix(own[a], width(node)).T @ _matrix(own[b], width(node)), square)

    def orthonormal(rows: DataFrame) -> DataFrame:
        for _ in range(2):  # the second time for what rounding left
            rows = turned(rows, {f: _orthonormaliser(g) for f, g in gram(rows, "v", "v").items()}, "v")
        return rows

    residual: Turns = {}
    values: Turns = {}
    least: dict[object, float] = {}
    for _ in range(CYCLES):
        rows = pulled(orthonormal(state), lambda node, v, last, u: {"v": v, "last": u})  # u goes where the last vectors stood
        found = {f: np.linalg.eigh((m + m.T) / 2) for f, m in gram(rows, "v", "last").items()}
        values = {f: value[::-1] for f, (value, _) in found.items()}
        state = settled(turned(rows, {f: vector[:, ::-1] for f, (_, vector) in found.items()}, "v", "last"))
        gaps = _sums(state, lambda node, own, values=values: ((_matrix(own["last"], width(node)) - _matrix(own["v"], width(node)) * values[node]) ** 2).sum(0), lambda node: (width(node),))
        residual = {f: np.sqrt(g) for f, g in gaps.items()}
        locked = {f: int(np.argmax(np.append(r > TOLERANCE, True))) for f, r in residual.items()}
        if all(locked[f] >= goals[f] for f in members):
            break
        bound = {f: max(-1.0, -float(np.sqrt(max(0.0, energy[f][0] - (x**2).sum()) + 1e-12))) for f, x in values.items()}
        ends = {f: interval(x, goals[f], least.get(f), bound[f]) for f, x in values.items()}
        least = {f: min(least.get(f, 1.0), float(x[-1])) for f, x in values.items()}
        degree = min(filter_degree(x, locked[f], *ends[f]) for f, x in values.items() if locked[f] < goals[f])
        middle = {f: (high + low) / 2 for f, (low, high) in ends.items()}
        half = {f: max((high - low) / 2, 1e-12) for f, (low, high) in ends.items()}

        def first(node, own, locked=locked, middle=middle, half=half):
            v, u = _matrix(own["v"], width(node)), _matrix(own["last"], width(node))
            new = (u - middle[node] * v) / half[node]
            new[:, : locked[node]] = v[:, : locked[node]]
            return {"v": new, "last": v}

        def more(node, v, last, u, locked=locked, middle=middle, half=half):
            new = 2 * (u - middle[node] * v) / half[node] - _matrix(last, width(node))
            new[:, : locked[node]] = v[:, : locked[node]]
            return {"v": new, "last": v}

        state = _mapped(state, first)
        for n in range(degree - 1):
            state = pulled(state, more, ready=n > 0)
    else:
        worst = {f: float(r[: goals[f]].max()) for f, r in residual.items() if (r[: goals[f]] > TOLERANCE).any()}
        raise ValueError(f"eigenvectors did not converge within {CYCLES} cycles; largest residuals {worst}")

    def embedded(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                node = batch.column("node")[n].as_py()
                x = np.frombuffer(batch.column("s")[n].as_buffer()) + np.frombuffer(batch.column("alone")[n].as_buffer())
                v = _matrix(batch.column("v")[n].as_buffer(), widths[node])[:, 1 : goals[node]] * x[:, None]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(n, 1), batch.column("b").slice(n, 1), pa.array([v.tobytes()], pa.binary())], names=["node", "b", "x"])

    blocks = state.mapInArrow(embedded, f"node {kind}, b int, x binary").join(known.select("node", "b", "seen"), ["node", "b"])
    return settled(blocks), {f: (members[f], values[f][: goals[f]], residual[f][: goals[f]]) for f in members}


# ---- nodes of points in one task


class _Tiles:
    """Distances of points by tiles on the diagonal and above: within 1e-10 of their size, what a product would blur is measured anew."""

    def __init__(self, x: np.ndarray):
        self.x, norms, one = x, (x * x).sum(1)[:, None], np.ones((len(x), 1))
        self.plain = bool(norms.max(initial=0) < 1e200)
        self.left, self.right = np.hstack((-2 * x, norms, one)), np.ascontiguousarray(np.hstack((x, one, norms)).T)
        self.close = 1e-3 * float(norms.max(initial=0))
        self.room = np.empty(STEP * STEP)

    def __iter__(self):
        """(rows, columns, distances); the last live until the next."""
        for i in range(0, len(self.x), STEP):
            for j in range(i, len(self.x), STEP):
                rows, columns = slice(i, i + STEP), slice(j, j + STEP)
                if not self.plain:
                    yield rows, columns, kernels.distances(self.x[rows], self.x[columns])
                    continue
                p, q = self.left[rows], self.right[:, columns]
                d = np.matmul(p, q, out=self.room[: len(p) * q.shape[1]].reshape(len(p), -1))
                if i == j:
                    np.fill_diagonal(d, np.inf)
                if d.min() < self.close:
                    a, b = np.nonzero(d < self.close)
                    for at in range(0, len(a), 1 << 14):
                        m, n = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                        d[m, n] = ((self.x[i + m] - self.x[j + n]) ** 2).sum(1)
                if i == j:
                    np.fill_diagonal(d, 0)
                yield rows, columns, np.sqrt(d, out=d)

    def longest(self) -> float:
        """The largest distance; all that may be it are measured exactly."""
        top = 0.0
        for rows, columns, d in self:
            most = float(d.max())
            if not most >= top * (1 - 1e-9):
                continue
            i, j = np.nonzero(d >= max(top, most) * (1 - 1e-9))
            for a in np.unique(i):
                top = max(top, float(kernels.distances(self.x[rows][a : a + 1], self.x[columns][j[i == a]]).max()))
        return top

    def times(self, top: float, v: np.ndarray) -> np.ndarray:
        """The product of the affinities, 1 - d / top and a diagonal of zeros, with v."""
        out = np.zeros_like(v)
        for rows, columns, d in self:
            out[rows] += d @ v[columns]
            if rows != columns:
                out[columns] += d.T @ v[rows]
        return v.sum(0) - v - out / top

    def energy(self, top: float, s: np.ndarray) -> float:
        """The sum of squares of the affinities scaled by s on both sides."""
        total = 0.0
        for rows, columns, d in self:
            a = 1 - d / top
            if rows == columns:
                np.fill_diagonal(a, 0)
            total += (1 + (rows != columns)) * float(s[rows] ** 2 @ (a * a @ s[columns] ** 2))
        return total


def solve_points(x: np.ndarray, goal: int, seed: int = 1, cycles: int = CYCLES) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(D^-1/2 times the eigenvectors, eigenvalues, residual norms, largest distance) of the goal first, by the steps of `leading`."""
    n, some = len(x), _Tiles(x)
    top = some.longest()
    if not 0 < top < np.inf:
        return np.zeros((n, 0)), np.zeros(0), np.zeros(0), top
    width = min(WIDTH, n)
    degree = some.times(top, np.ones((n, 1)))[:, 0]
    tied = degree > 1e-13 * n  # sums of zeros are zero but for rounding
    s, alone = np.where(tied, 1 / np.sqrt(np.where(tied, degree, 1)), 0.0)[:, None], (~tied)[:, None].astype(float)
    pulled = lambda v: s * some.times(top, s * v) + alone * v
    energy = some.energy(top, s[:, 0]) + float(alone.sum())
    v, least = np.random.default_rng(seed).standard_normal((n, width)), 1.0

    def orthonormal(v):
        for _ in range(2):  # the second time for what rounding left
            v = v @ _orthonormaliser(v.T @ v)
        return v

    for _ in range(WARM):  # plain steps show where the values lie
        v = pulled(orthonormal(v))
    for _ in range(cycles):
        v = orthonormal(v)
        u = pulled(v)
        m = v.T @ u
        values, turn = np.linalg.eigh((m + m.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        v, u = v @ turn, u @ turn
        residual = np.sqrt(((u - v * values) ** 2).sum(0))
        locked = int(np.argmax(np.append(residual > TOLERANCE, True)))
        if locked >= goal:
            return v[:, :goal] * (s + alone), values[:goal], residual[:goal], top
        bound = max(-1.0, -float(np.sqrt(max(0.0, energy - (values**2).sum()) + 1e-12)))
        least = min(least, float(values[-1]))
        low, high = interval(values, goal, least, bound)
        middle, half = (high + low) / 2, max((high - low) / 2, 1e-12)
        # locked columns stay as they are
        last, new = v[:, locked:], (u[:, locked:] - middle * v[:, locked:]) / half
        for _ in range(filter_degree(values, locked, low, high) - 1):
            last, new = new, 2 * (pulled(new) - middle * new) / half - last
        new = np.hstack((v[:, :locked], new))
        v = new
    return v[:, :0], values[:goal], residual[:goal], top


def leading_of_points(points: DataFrame, wanted: Callable[[int], int], seed: int = 1) -> tuple[DataFrame, dict[object, tuple[int, np.ndarray, np.ndarray]]]:
    """`leading` of nodes of points (node, ord, vec), ord from 0, a task for each node."""
    side, cycles = square.SIDE, CYCLES

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord").combine_chunks()
        n = table.num_rows
        x, size = vectors_of(pa.concat_arrays(table.column("vec").chunks))
        if (size != x.shape[1]).any() or not np.isfinite(x).all() or (table.column("ord").to_numpy() != np.arange(n)).any():
            raise ValueError(f"members need finite vectors of one length, numbered from 0: {table.column('node')[0].as_py()}")
        goal = min(n, wanted(n) + 1)
        found, values, residual, top = solve_points(np.asarray(x, np.float64), goal, seed, cycles)
        if not 0 < top < np.inf:
            raise ValueError(f"members need finite vectors of one length, and a distance greater than zero: {table.column('node')[0].as_py()}")
        if not found.shape[1]:
            raise ValueError(f"eigenvectors did not converge within {cycles} cycles; largest residual of {table.column('node')[0].as_py()}: {residual.max()}")
        starts = range(0, n, side)
        x = [np.ascontiguousarray(found[at : at + side, 1:]).tobytes() for at in starts]
        one = pa.array(np.zeros(len(x), np.int32))
        return pa.table({"node": table.column("node").take(one), "b": pa.array(range(len(x)), pa.int32()), "x": pa.array(x, pa.binary()), "seen": pa.array([np.ones(min(side, n - at), bool).tobytes() for at in starts], pa.binary()), "n": pa.array([n] * len(x), pa.int32()), "facts": pa.array([np.stack((values, residual)).tobytes()] * len(x), pa.binary())})

    blocks = settled(points.select("node", "ord", "vec").groupBy("node").applyInArrow(solve, f"node {node_kind(points)}, b int, x binary, seen binary, n int, facts binary"))
    facts = {r["node"]: (r["n"], *np.frombuffer(r["facts"]).reshape(2, -1)) for r in blocks.filter("b = 0").select("node", "n", "facts").collect()}
    return blocks.drop("n", "facts"), facts
