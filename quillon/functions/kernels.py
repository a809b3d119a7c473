"""Dense numerics for one node of one family, from the published definitions.

Embedding: normalised Laplacian (Shi and Malik 2000; von Luxburg 2007). K-means: Lloyd 1982 with
k-means++ starts (Arthur and Vassilvitskii 2007). Silhouette: Rousseeuw 1987. Alignment with affine
gaps: Gotoh 1982, local: Smith and Waterman 1981.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def spectral_embedding(affinity: np.ndarray, components: int) -> np.ndarray:
    """Eigenvectors of I - D^-1/2 W D^-1/2 by rising eigenvalue, without the first, scaled by D^-1/2."""
    w = np.array(affinity, np.float64)
    np.fill_diagonal(w, 0)
    degree = w.sum(1)
    scale = np.where(degree > 0, 1 / np.sqrt(np.where(degree > 0, degree, 1)), 1.0)
    laplacian = np.eye(len(w)) * (degree > 0) - scale[:, None] * w * scale[None, :]
    _, vectors = np.linalg.eigh((laplacian + laplacian.T) / 2)
    found = vectors[:, 1 : components + 1] * scale[:, None]
    largest = np.abs(found).argmax(0)
    return found * np.where(found[largest, np.arange(found.shape[1])] < 0, -1.0, 1.0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T)


def draws(n: int, k: int, rng: np.random.Generator) -> tuple[int, np.ndarray]:
    """Of one start: the first centre's place, and for each further centre a few shares between 0 and 1."""
    return int(rng.integers(n)), rng.random((k - 1, 2 + int(np.log(k))))


def _start(x: np.ndarray, first: int, shares: np.ndarray) -> np.ndarray:
    """Greedy k-means++: each centre is the best of a few drawn by squared distance."""
    centres = [first]
    near = squared(x, x[centres])[:, 0]
    for some in shares:
        rising = np.cumsum(near)
        # where all distances are zero, places are drawn evenly
        places = np.minimum(np.searchsorted(rising / rising[-1], some, side="right"), len(x) - 1) if rising[-1] > 0 else (some * len(x)).astype(np.int64)
        options = np.minimum(near[:, None], squared(x, x[places]))
        best = int(options.sum(0).argmin())
        centres.append(int(places[best]))
        near = options[:, best]
    return x[centres].copy()


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 10, rounds: int = 300, tolerance: float = 1e-4) -> np.ndarray:
    """Labels of the least inertia over the starts, numbered by each cluster's first member."""
    rng, limit, found = np.random.default_rng(seed), tolerance * x.var(0).mean(), None
    for _ in range(starts):
        centres, last = _start(x, *draws(len(x), k, rng)), None
        for _ in range(rounds):
            label = squared(x, centres).argmin(1)
            sizes = np.bincount(label, minlength=k)
            new = np.stack([np.bincount(label, x[:, d], k) for d in range(x.shape[1])], 1) / np.maximum(sizes, 1)[:, None]
            if (sizes == 0).any():  # an empty cluster takes the points farthest from theirs
                far = np.argsort(-((x - centres[label]) ** 2).sum(1), kind="stable")
                new[sizes == 0] = x[far[: int((sizes == 0).sum())]]
            moved, centres = ((new - centres) ** 2).sum(), new
            if (last is not None and np.array_equal(label, last)) or moved <= limit:
                break
            last = label
        away = squared(x, centres)
        label = away.argmin(1)
        inertia = away[np.arange(len(x)), label].sum()
        if found is None or inertia < found[0] * (1 - 1e-12):
            found = (inertia, label)
    return canonical(found[1])


def canonical(label: np.ndarray) -> np.ndarray:
    """Clusters numbered in order of their first member."""
    names, first, place = np.unique(label, return_index=True, return_inverse=True)
    order = np.empty(len(names), np.int64)
    order[np.argsort(first)] = np.arange(len(names))
    return order[place]


def silhouettes(x: np.ndarray, label: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    k, n = int(label.max()) + 1 if len(label) else 0, len(x)
    member = np.zeros((n, k))
    member[np.arange(n), label] = 1
    sizes, points, own = member.sum(0), x, label
    # differences, not a product form: the values must hold to the last digits
    at = max(1, step // max(1, x.size))
    total = np.concatenate([np.zeros((0, k)), *[np.sqrt(((points[i : i + at, None] - x[None]) ** 2).sum(2)) @ member for i in range(0, len(points), at)]])
    return silhouettes_of(total, own, sizes)


def silhouettes_of(total: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Silhouettes from each point's distances to the members of each cluster, summed; its own cluster; and the clusters' sizes."""
    mine = np.arange(len(total))
    a = total[mine, own] / np.maximum(sizes[own] - 1, 1)
    other = total / np.maximum(sizes, 1)
    other[:, sizes == 0] = np.inf
    other[mine, own] = np.inf
    b = other.min(1) if total.shape[1] else np.zeros(0)
    top = np.maximum(a, b)
    return np.where((sizes[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)


def distances_by_dimension(x: np.ndarray, y: np.ndarray):
    """Distances of x's rows and y's over the first coordinate, the first two, and so on: squares are added up one coordinate at a time."""
    squares = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        squares += (x[:, d, None] - y[None, :, d]) ** 2
        yield d + 1, np.sqrt(squares)


def distances(x: np.ndarray, y: np.ndarray, strip: int = 32) -> np.ndarray:
    """Euclidean distances of x's rows and y's, squares added up one coordinate at a time: symmetric to the last bit."""
    out, across = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T)
    gap = np.empty((strip, len(y)))
    with np.errstate(all="ignore"):
        for at in range(0, len(x), strip):
            some, total = x[at : at + strip], out[at : at + strip]
            t = gap[: len(some)]
            for d in range(x.shape[1]):
                np.subtract(some[:, d, None], across[d], out=t)
                np.multiply(t, t, out=t)
                np.add(total, t, out=total)
        return np.sqrt(out, out=out)


def near_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """distances by a matrix product, for sums and bounds: within 1e-10 of their size; what the product would blur is measured anew."""
    if not x.size or not y.size or not max(np.abs(x).max(), np.abs(y).max()) < 1e100:
        return distances(x, y)
    a, b = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    found = x @ y.T
    found *= -2
    found += a[:, None]
    found += b
    close = found < 1e-3 * np.maximum(a[:, None], b)
    some = int(np.count_nonzero(close))
    if some > found.size // 10:
        return distances(x, y)
    np.sqrt(np.maximum(found, 0, out=found), out=found)
    if some:
        i, j = np.nonzero(close)
        for at in range(0, some, 1 << 14):
            p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            found[p, q] = np.sqrt(((x[p] - y[q]) ** 2).sum(1))
    return found


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def _sweep(a: str, b: str, match: float, mismatch: float, first: float, more: float, local: bool, start: tuple[int, np.ndarray, np.ndarray] | None = None):
    """(scores, scores that end in a gap along a, in a gap along b, letters of b equal to a's) of each row of the alignment table.

    first: cost of a gap's first place; more: of each further one. A gap along the row is a running
    maximum, as reopening a gap never beats extending it. Two rows are held at a time. start: a row's number and its first two
    results, to go on from; that row itself is not given again.
    """
    x, y = _codes(a), _codes(b)
    m = len(y)
    ramp = more * np.arange(m + 1)
    h, up = np.zeros(m + 1), np.full(m + 1, -np.inf)
    left = np.full(m + 1, -np.inf)
    if not local:
        left[1:] = -first - more * np.arange(m)
        h[1:] = left[1:]
    begin = 0
    if start is None:
        yield h, up, left, None
    else:
        begin, h, up = start
    for i, letter in enumerate(x[begin:], begin):
        same = y == letter
        new_up = np.maximum(h - first, up - more)
        new_up[0] = -np.inf if local else -first - more * i
        row = np.empty(m + 1)
        row[0] = 0 if local else new_up[0]
        row[1:] = np.maximum(h[:-1] + np.where(same, match, mismatch), new_up[1:])
        if local:
            row[1:] = np.maximum(row[1:], 0)
        new_left = np.full(m + 1, -np.inf)
        new_left[1:] = np.maximum.accumulate(row + ramp)[:-1] - first - ramp[:-1]
        yield (new := np.maximum(row, new_left)), new_up, new_left, (same, h, up, left)
        h, up, left = new, new_up, new_left


def _ways(a: str, b: str, costs: tuple[float, float, float, float], start: tuple[int, np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    """What the way back needs of `rows` rows after a start: diagonal, or which gap, and whether each gap opens there."""
    match, mismatch, first, more = costs
    ways = np.zeros((rows, len(b) + 1), np.uint8)
    for n, (h, up, left, (same, last, _, _)) in zip(range(rows), _sweep(a, b, match, mismatch, first, more, False, start)):
        diagonal = h[1:] == last[:-1] + np.where(same, match, mismatch)
        ways[n, 1:] = diagonal | (h[1:] == up[1:]).astype(np.uint8) << 1 | (up[1:] == last[1:] - first).astype(np.uint8) << 2 | (left[1:] == h[:-1] - first).astype(np.uint8) << 3
    return ways


def global_identity(a: str, b: str, match: float = 5, mismatch: float = -4, first: float = 10, more: float = 0.5, lot: int | None = None) -> float:
    """Share of equal letters among the gap-free columns of one best global alignment; 0 if there are none.

    A gap of length g costs first + more * (g - 1), at the ends too. Of equal ways the diagonal comes first. The table is never
    held: one row of each `lot` is, and on the way back a lot's rows are made anew, so two strings of 50,000 letters need 100 MB.
    """
    if not a or not b:
        return 0.0
    lot = lot or max(64, int(4 * len(a) ** 0.5))
    costs = match, mismatch, first, more
    held = [(i, h.copy(), up.copy()) for i, (h, up, _, _) in enumerate(_sweep(a, b, *costs, False)) if i % lot == 0]
    i, j, state, same, both = len(a), len(b), "h", 0, 0
    while i and j:
        begin = (i - 1) // lot * lot
        ways = _ways(a, b, costs, held[begin // lot], i - begin)
        del held[begin // lot + 1 :]
        while i > begin and j:
            way = int(ways[i - begin - 1, j])
            if state == "h":
                if way & 1:
                    i, j = i - 1, j - 1
                    both += 1
                    same += a[i] == b[j]
                else:
                    state = "up" if way & 2 else "left"
            elif state == "up":
                state = "h" if way & 4 else "up"
                i -= 1
            else:
                state = "h" if way & 8 else "left"
                j -= 1
    return same / both if both else 0.0


def global_score(a: str, b: str, match: float = 5, mismatch: float = -4, first: float = 10, more: float = 0.5) -> float:
    for h, *_ in _sweep(a, b, match, mismatch, first, more, False):
        last = h
    return float(last[-1])


def local_score(a: str, b: str, match: float = 5, mismatch: float = -4, first: float = 10.5, more: float = 0.5) -> float:
    """Best local alignment score; a gap of length g costs first + more * (g - 1)."""
    if not a or not b:
        return 0.0
    return max(float(h.max()) for h, *_ in _sweep(a, b, match, mismatch, first, more, True))


WORD = 6  #: letters of the words whose counts bound a local score


def word_counts(s: str) -> tuple[Counter, Counter]:
    """How often each letter and each word of `WORD` letters stands in s."""
    return Counter(s), Counter(s[i : i + WORD] for i in range(len(s) - WORD + 1))


def most_local(a: tuple[Counter, Counter], b: tuple[Counter, Counter], match: float = 5, mismatch: float = -4) -> float:
    """No local alignment of two strings of these counts scores more.

    Of m matches in r unbroken runs, at least m - r (WORD - 1) begin a word that both strings have at their own places, and each break costs
    a mismatch at least, as a gap costs more. That bound rises with m, which the shared letters limit.
    """
    letters, words = (a[0] & b[0]).total(), (a[1] & b[1]).total()
    return match * letters + mismatch * max(0.0, (letters - words) / (WORD - 1) - 1)


def best_local(a: str, subjects: list[tuple[int, str, tuple[Counter, Counter]]]) -> tuple[int | None, float, int]:
    """(subject, score, pairs scored): the subject of the largest local score, of equal ones the least; None where all are 0.

    Subjects go by falling bound, and those that cannot be the best are not scored.
    """
    counts, best, scored = word_counts(a), (0.0, None), 0
    for most, name, text in sorted(((most_local(counts, c), name, text) for name, text, c in subjects), key=lambda s: (-s[0], s[1])):
        if most + 1e-6 < best[0] or most <= 0:
            break
        score, scored = local_score(a, text), scored + 1
        if score > best[0] or (score == best[0] and best[1] is not None and name < best[1]):
            best = score, name
    return best[1], best[0], scored
