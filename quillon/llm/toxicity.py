"""Toxicity of texts by a subsequence string kernel, a support vector machine and Nyström landmarks.

The kernel of two words is the cosine of their gap-weighted subsequences of three symbols: those within `SPAN` symbols of
each other, weighted by `DECAY` for each symbol that they skip; a word's two ends are symbols too. So an inserted or
dropped character costs a word only the subsequences that cross it. Beside single words, a sentence has as instances its runs of
single letters read as words ("i d i o t") and two neighbours read as one ("idi ot").

Labels are of whole texts, so sentences are labelled by multiple-instance learning: all words of clean sentences are
negative; of toxic ones those that stand out by their document counts, and, from the second of `ROUNDS` rounds on,
those the machine finds. Landmarks are words of both kinds; the machine is linear in their Nyström coordinates, so it
is the same as one table of weights of subsequences, and rating a word is one lookup for each of its subsequences.

A text's score is a logistic model of its three largest margins and of how many instances are on the toxic side, fitted on texts
that the machine behind those margins did not learn from.

What is learned from is bounded: `TOXIC` and `CLEAN` documents of the labels (the least by a hash of the id), `UNITS` words
of theirs (those in most documents first). All texts are scored, whole, in slices of bounded size.

Defined cases: a null or empty text has no word and scores as such; a document with several labels is toxic if any says so;
null labels and null ids are not learned from (a null id is not held out); repeated rows get the same score; without
labels of both kinds all score 0; an empty table gives no rows; ties in choosing what to learn from go by hash, then by name; other columns, whatever their
names, are ignored; a word longer than `LONG` characters is read in overlapping windows, a text of any length slice by slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import broadcast_if, memory, stored, text_or_empty, tidy
from quillon.llm.tokens import as_list

TOXIC, CLEAN = 2000, 4000  #: labelled documents that are learned from, at most
UNITS = 120_000  #: their words that are learned from, at most
LANDMARKS, ROUNDS, NEGATIVES = 160, 3, 16_000
DISGUISED = 60  #: words that stand out most, which are also learned with a character put in
SPAN, DECAY = 5, 0.6
LONG, STEP = 32, 16  #: longest word that is read at once, and how far its windows lie apart
JOINED = 12  #: longest word that is read out of two
SLICE = 1_000_000  #: characters of texts that are cut into words at once
ROOM = 250_000  #: words in each generation of what a worker remembers
FOLDS = 4  #: parts of what is learned from; the machine that rates one for the logistic model learns from the others
LEAST = 0.7

_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_WEIGHT = np.array([DECAY ** (b - 2) for _, b in _GAPS])
_NOT_WORD = re.compile(r"[\W_]+")
_START, _END, _SYMBOLS = 37, 38, 64
_NONE = -2.0  #: the margin of what isn't there


def _symbol_table(size: int = 0x250) -> np.ndarray:
    """Symbols of characters: letters 1 to 26, digits 27 to 36, all others 39 to 63 by their code."""
    code = np.arange(size)
    table = 39 + code % 25
    table[97:123] = np.arange(1, 27)
    table[48:58] = np.arange(27, 37)
    return table.astype(np.uint8)


_SYMBOL = _symbol_table()


def clean(word: str) -> str:
    """Its letters and digits, in lower case."""
    return _NOT_WORD.sub("", word).lower()


def windows(unit: str) -> list[str]:
    return [unit] if len(unit) <= LONG else [unit[i : i + LONG] for i in range(0, len(unit) - STEP, STEP)]


def symbols(units: list[str]) -> np.ndarray:
    """A row of symbols for each unit of up to LONG characters, with its ends, filled with 0."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    coded = np.where(flat < len(_SYMBOL), _SYMBOL[np.minimum(flat, len(_SYMBOL) - 1)], 39 + flat % 25).astype(np.uint8)
    out = np.zeros((len(units), int(sizes.max(initial=0)) + 2), np.uint8)
    rows = np.repeat(np.arange(len(units)), sizes)
    out[rows, 1 + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = coded
    out[:, 0] = _START
    out[np.arange(len(units)), sizes + 1] = _END
    return out


def subsequences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, norms): each unit's subsequences as key * 8 + gap pattern, ascending, 0 where there is none; and its norm."""
    n, width = rows.shape
    wide, keys = rows.astype(np.int32), []
    for g, (a, b) in enumerate(_GAPS):
        if width > b:
            last = wide[:, b:]
            key = (wide[:, : width - b] << 12 | wide[:, a : width - b + a] << 6 | last) << 3 | g
            keys.append(np.where(last > 0, key, 0))
    found = np.sort(np.concatenate(keys, 1), 1)
    flat = (found >> 3).ravel()
    weight = np.where(flat > 0, _WEIGHT[(found & 7).ravel()], 0.0)
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[:: found.shape[1]] = True
    start = np.flatnonzero(new)
    square = np.add.reduceat(weight, start) ** 2
    return found, np.sqrt(np.bincount(start // found.shape[1], square, n))


def kernel(a: list[str], b: list[str], at_once: int = 256) -> np.ndarray:
    """The kernel of each of a with each of b."""
    if not a or not b:
        return np.zeros((len(a), len(b)))
    keys, norms = subsequences(symbols(b))
    known, place = np.unique(keys >> 3, return_inverse=True)
    weight = np.where(keys > 0, _WEIGHT[keys & 7], 0.0) / norms[:, None]
    table = np.zeros((len(known), len(b)))
    np.add.at(table, (place.reshape(keys.shape).ravel(), np.repeat(np.arange(len(b)), keys.shape[1])), weight.ravel())
    at = np.full(_SYMBOLS**3, -1, np.int64)
    at[known] = np.arange(len(known))
    at[0] = -1
    out = np.zeros((len(a), len(b)))
    for lo in range(0, len(a), at_once):
        mine, size = subsequences(symbols(a[lo : lo + at_once]))
        column = at[mine >> 3]
        row, some = np.nonzero(column >= 0)
        dense = np.bincount(row * len(known) + column[row, some], _WEIGHT[mine[row, some] & 7], len(mine) * len(known)).reshape(len(mine), -1)
        out[lo : lo + at_once] = dense @ table / size[:, None]
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, share: np.ndarray, cost: float = 10.0, steps: int = 30) -> np.ndarray:
    """Weights, the last a bias: squared hinge loss, each row weighing its share, by Newton's method on the rows within the margin."""
    x = np.column_stack((x, np.ones(len(x))))
    ridge = np.append(np.ones(x.shape[1] - 1), 1e-3)
    cost_of = lambda w: 0.5 * (ridge * w * w).sum() + cost * (share * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        inside = y * (x @ w) < 1
        xs, s = x[inside], share[inside]
        slope = ridge * w - 2 * cost * xs.T @ (s * (y[inside] - xs @ w))
        move, now, step = np.linalg.solve(2 * cost * (xs * s[:, None]).T @ xs + np.diag(ridge), slope), cost_of(w), 1.0
        while cost_of(w - step * move) > now and step > 1e-6:
            step /= 2
        w = w - step * move
        if step <= 1e-6 or np.abs(step * move).max() < 1e-8:
            break
    return w


def fit_logit(x: np.ndarray, good: np.ndarray, steps: int = 50, ridge: float = 0.002) -> np.ndarray:
    """Weights of a logistic model, none below 0 but the last, a constant: more of anything toxic never lowers a score.

    By Newton's method; the column with the least weight below 0 is left out until there is none.
    """
    full, kept = np.column_stack((x, np.ones(len(x)))), np.arange(x.shape[1] + 1)
    while True:
        some, w = full[:, kept], np.zeros(len(kept))
        hold = np.where(kept < x.shape[1], ridge, 1e-6)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(some @ w, -30, 30)))
            w = w - np.linalg.solve((some * (p * (1 - p) + 1e-9)[:, None]).T @ some + np.diag(hold), some.T @ (p - good) + hold * w)
        if w[:-1].min(initial=0) >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[kept] = w
            return out
        kept = np.delete(kept, np.argmin(w[:-1]))


@dataclass
class Machine:
    """A support vector machine on words: weights of subsequences, a bias, and the least raw sums of two halves worth joining."""

    table: np.ndarray
    bias: float
    worth: float = 0.0

    def rate(self, units: list[str], at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(margins, raw sums) of units of up to LONG characters."""
        margin, raw = np.zeros(len(units)), np.zeros(len(units))
        order = np.argsort(np.fromiter(map(len, units), np.int64, len(units)), kind="stable")
        for lo in range(0, len(units), at_once):
            some = order[lo : lo + at_once]
            keys, norms = subsequences(symbols([units[i] for i in some]))
            raw[some] = (self.table[keys >> 3] * _WEIGHT[np.minimum(keys & 7, len(_WEIGHT) - 1)]).sum(1)
            margin[some] = raw[some] / norms + self.bias
        return margin, raw


def landmarks(positive: list[str], negative: list[str], most: int, alike: float = 0.92) -> list[str]:
    """Words of both kinds in turn, none too much like one before it."""
    half = most // 2
    out: list[str] = []
    for names in (positive[: 4 * half], negative[: 4 * half]):
        near, kept = kernel(names, names), np.empty(0, np.int64)
        for i in range(len(names)):
            if len(kept) < half and not (len(kept) and near[i, kept].max() > alike):
                kept = np.append(kept, i)
        out += [names[i] for i in kept]
    return out


def disguised(unit: str) -> list[str]:
    """unit with a character put in at each of its inner places: an x, which stands for any."""
    return [f"{unit[:i]}x{unit[i:]}" for i in range(1, len(unit))] if 4 <= len(unit) < LONG else []


def fit_machine(units: list[str], toxic: np.ndarray, plain: np.ndarray, n_toxic: int, n_plain: int) -> Machine:
    """From distinct words and the numbers of toxic and of plain documents that hold each."""
    rate_t, rate_p = toxic / max(1, n_toxic), plain / max(1, n_plain)
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((plain + 0.5) / (n_plain + 1))
    rank = np.lexsort((units, -odds * toxic))
    sure = np.log(max(2, len(units))) + 3  # beyond what the best of so many words reaches by chance
    chosen = np.flatnonzero((toxic >= 2) & (rate_t >= 6 * rate_p) & (odds * toxic >= sure))
    if len(chosen) < 5:
        chosen = rank[: min(5, len(units))]
    names = np.array(units, object)
    clean_ones = np.flatnonzero((plain > 0) & (rate_t < 3 * rate_p))
    hard = clean_ones[np.lexsort((names[clean_ones], -plain[clean_ones]))][: NEGATIVES // 2]
    machine = Machine(np.zeros(_SYMBOLS**3), 0.0)
    for turn in range(ROUNDS):
        chosen = chosen[np.lexsort((names[chosen], -(odds * toxic)[chosen]))]
        marks = landmarks([units[i] for i in chosen], [units[i] for i in hard], LANDMARKS)
        mutual = kernel(marks, marks)
        value, vector = np.linalg.eigh((mutual + mutual.T) / 2)
        fine = value > 1e-8 * value.max()
        root = vector[:, fine] / np.sqrt(value[fine])
        best = [(v, toxic[i]) for i in chosen[:DISGUISED] for v in disguised(units[i])]
        rows = np.concatenate((chosen, hard))
        x = kernel([*(units[i] for i in rows), *(v for v, _ in best)], marks) @ root
        y = np.concatenate((np.ones(len(chosen)), -np.ones(len(hard)), np.ones(len(best))))
        share = np.concatenate((toxic[chosen], np.sqrt(plain[hard]), [0.03 * n for _, n in best])).astype(float)
        for side in (1.0, -1.0):
            share[y == side] /= max(share[y == side].sum(), 1e-9)
        w = fit_svm(x, y, 50 * share)
        keys, norms = subsequences(symbols(marks))
        each = _WEIGHT[np.minimum(keys & 7, len(_WEIGHT) - 1)] * (keys > 0) * ((root @ w[:-1]) / norms)[:, None]
        machine = Machine(np.bincount((keys >> 3).ravel(), each.ravel(), _SYMBOLS**3), float(w[-1]))
        margin, raw = machine.rate(units)
        machine.worth = 0.5 * float(np.median(raw[chosen]))
        found = np.flatnonzero((margin > 0.5) & (toxic > 0) & (rate_t >= 6 * rate_p))
        chosen = np.union1d(chosen[margin[chosen] > -0.5], found) if turn + 1 < ROUNDS else chosen
        near = clean_ones[np.argsort(-margin[clean_ones], kind="stable")][: NEGATIVES // 4]
        hard = np.unique(np.concatenate((near, hard[: NEGATIVES // 4])))
        hard = hard[np.argsort(-margin[hard], kind="stable")] if turn % 2 == 0 else hard
        if not len(chosen) or not len(hard):
            break
    return machine


# ---- texts


def sliced(text: str, size: int = SLICE) -> Iterator[str]:
    """text in slices that end between words; a longer word is cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text) and (space := max(text.rfind(" ", at, end), text.rfind("\n", at, end))) > at:
            end = space
        yield text[at:end]
        at = end


def parcels(texts: Iterable[str | None], size: int = SLICE) -> Iterator[tuple[list[int], list[str]]]:
    """(text numbers, texts or slices of them), of about `size` characters together."""
    numbers, some, total = [], [], 0
    for n, t in enumerate(texts):
        for part in sliced(t or "", size):
            numbers.append(n)
            some.append(part)
            total += len(part)
            if total >= size:
                yield numbers, some
                numbers, some, total = [], [], 0
    if numbers:
        yield numbers, some


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, word) of each word in order, and the distinct words."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    words = lists.flatten()
    there = np.asarray(pc.binary_length(words)) > 0
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[there]
    coded = words.filter(pa.array(there)).dictionary_encode()
    return owner, coded.indices.to_numpy().astype(np.int64), as_list(coded.dictionary)


@dataclass
class Reader:
    """Margins of words by a machine, with what it saw of late: word -> (margin, raw sum, length)."""

    machine: Machine
    new: dict[str, tuple[float, float, int]] = field(default_factory=dict)
    old: dict[str, tuple[float, float, int]] = field(default_factory=dict)

    def learn(self, words: list[str]) -> None:
        if len(self.new) > ROOM:
            self.new, self.old = {}, self.new
        self.new.update([(w, self.old[w]) for w in words if w not in self.new and w in self.old])
        fresh = [w for w in words if w not in self.new]
        units = [clean(w) for w in fresh]
        pieces = [windows(u) if u else [] for u in units]
        margin, raw = self.machine.rate([p for some in pieces for p in some])
        at = 0
        for w, u, some in zip(fresh, units, pieces, strict=True):
            if len(some) == 1:
                self.new[w] = margin[at], raw[at], len(u)
            else:
                self.new[w] = max(margin[at : at + len(some)], default=_NONE), 0.0, len(u)
            at += len(some)

    def best(self, units: list[str]) -> float:
        self.learn(units)
        return max((self.new[u][0] for u in units), default=_NONE)

    def facts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, margin) of all instances of the texts, and the number of words of each text."""
        owner, token, names = cut(texts)
        self.learn(names)
        seen = np.array([self.new[w] for w in names], float).reshape(-1, 3)
        margin, raw, size = seen[:, 0][token], seen[:, 1][token], seen[:, 2][token]
        more_owner, more = [], []
        # single letters in a row
        one = np.concatenate(([False], size == 1, [False]))
        same = np.concatenate(([False], owner[1:] == owner[:-1], [False])) if len(owner) else np.zeros(1, bool)
        start = np.flatnonzero(one[1:-1] & ~(one[:-2] & same[:-1])) if len(owner) else []
        if len(start):
            ends = np.flatnonzero(one[1:-1] & ~(one[2:] & same[1:])) + 1
            for a, b in zip(start[ends - start >= 3], ends[ends - start >= 3], strict=True):
                word = "".join(clean(names[t]) for t in token[a:b])
                some = list(dict.fromkeys(word[i : i + n] for i in range(len(word) - 2) for n in range(3, 10) if i + n <= len(word)))
                more_owner.append(owner[a])
                more.append(max(self.best(some[i : i + ROOM]) for i in range(0, len(some), ROOM)))
        # two neighbours that may be one
        if len(owner) > 1:
            both = np.flatnonzero((owner[1:] == owner[:-1]) & (size[1:] > 0) & (size[:-1] > 0) & (size[1:] + size[:-1] <= JOINED) & (raw[1:] + raw[:-1] >= self.machine.worth) & (np.maximum(margin[1:], margin[:-1]) < 0))
            pairs = [clean(names[token[i]]) + clean(names[token[i + 1]]) for i in both]
            for lo in range(0, len(pairs), ROOM):
                self.learn(list(dict.fromkeys(pairs[lo : lo + ROOM])))
                for i, p in zip(both[lo : lo + ROOM], pairs[lo : lo + ROOM], strict=True):
                    if self.new[p][0] >= 1:
                        more_owner.append(owner[i])
                        more.append(self.new[p][0])
        return np.concatenate((owner, np.array(more_owner, np.int64))), np.concatenate((margin, np.array(more, float))), np.bincount(owner, minlength=len(texts))


STEPS = (0.0, 0.4, 0.8, 1.2)  #: margins that instances are counted beyond
WIDTH = 4 + len(STEPS)  #: of a text: its three largest margins, words, instances beyond each step


def summaries(reader: Reader, texts: list[str | None]) -> np.ndarray:
    """(texts, WIDTH); slices of one text add up."""
    out = np.column_stack((np.full((len(texts), 3), _NONE), np.zeros((len(texts), WIDTH - 3))))
    for numbers, some in parcels(texts):
        owner, margin, words = reader.facts(some)
        at = np.array(numbers)
        np.add.at(out[:, 3], at, words)
        for n, least in enumerate(STEPS):
            np.add.at(out[:, 4 + n], at[owner], margin > least)
        order = np.lexsort((-margin, owner))
        own = owner[order]
        nth = np.arange(len(own)) - np.searchsorted(own, own)
        for i in order[nth < 3]:
            row = out[at[owner[i]]]
            row[:3] = np.sort(np.append(row[:3], max(margin[i], _NONE)))[:0:-1]
    return out


def inputs(rows: np.ndarray) -> np.ndarray:
    """What the logistic model sees of a summary."""
    counts = np.log1p(rows[:, 4:])
    return np.column_stack((np.clip(rows[:, :3], -0.5, 1.2), counts[:, :1], counts[:, :1] - 0.5 * np.log1p(rows[:, 3:4]), counts[:, 2:]))


@dataclass
class Detector:
    machine: Machine
    logit: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(rows) @ self.logit[:-1] + self.logit[-1], -30, 30)))


def held_out(doc_id: str = "doc_id", remainder: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == remainder, F.lit(False))


def _samples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, np.ndarray]:
    """(doc_id, label, fold, text) of what is learned from, stored; and how many documents of each label each fold has."""
    known = stored(labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label")))
    there = docs.select("doc_id").filter("doc_id is not null").join(broadcast_if(known, known.count(), 32), "doc_id").distinct()
    order = F.xxhash64("doc_id")
    picked = [there.filter(F.col("label") == label).orderBy(order, "doc_id").limit(most) for label, most in ((1, TOXIC), (0, CLEAN))]
    few = stored(picked[0].unionByName(picked[1]).select("doc_id", "label", F.pmod(F.shiftright(order, 7), F.lit(FOLDS)).cast("int").alias("fold")))
    counts = np.zeros((2, FOLDS), np.int64)
    for r in few.groupBy("label", "fold").count().collect():
        counts[r["label"], r["fold"]] = r["count"]
    if not counts.sum(1).all():
        return None, counts
    return stored(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few), "doc_id")), counts


def _words(sample: DataFrame) -> DataFrame:
    """(unit, n00, n01, ...): by label and fold, how many documents hold each word; tasks sum up before the shuffle."""

    def count(batches):
        sums: dict[tuple[str, int, int], int] = {}

        def drain():
            rows = list(sums.items())
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([k[2] for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.int64())], names=["unit", "label", "fold", "n"])

        for batch in batches:
            for label, fold, text in zip(*(batch.column(c).to_pylist() for c in ("label", "fold", "text")), strict=True):
                own: set[str] = set()
                for part in sliced(text):
                    own.update(u for w in set(part.split()) if (c := clean(w)) for u in windows(c))
                for u in own:
                    sums[u, label, fold] = sums.get((u, label, fold), 0) + 1
                if len(sums) > ROOM:
                    yield drain()
        yield drain()

    each = sample.select("label", "fold", "text").mapInArrow(count, "unit string, label int, fold int, n long")
    return each.groupBy("unit").agg(*[F.coalesce(F.sum(F.when((F.col("label") == x) & (F.col("fold") == f), F.col("n"))), F.lit(0)).alias(f"n{x}{f}") for x in (0, 1) for f in range(FOLDS)])


def learn(docs: DataFrame, labels: DataFrame) -> Detector | None:
    """Fits on a bounded sample of the labelled documents that are not held out; its words' counts reach the driver."""
    sample, sizes = _samples(docs, labels)
    if sample is None:
        return None
    toxic, plain = (sum(F.col(f"n{x}{f}") for f in range(FOLDS)) for x in (1, 0))
    rows = _words(sample).orderBy(F.desc(F.least(toxic, F.lit(2))), F.desc(toxic + plain), F.xxhash64("unit"), "unit").limit(UNITS).toArrow()
    units = np.array(rows["unit"].to_pylist(), object)
    n = np.array([[rows[f"n{x}{f}"].to_numpy() for f in range(FOLDS)] for x in (0, 1)])
    del rows

    def fitted(folds: list[int]) -> Machine | None:
        of, size = n[:, folds].sum(1), sizes[:, folds].sum(1)
        some = np.flatnonzero(of.any(0))
        return fit_machine(units[some].tolist(), of[1, some], of[0, some], size[1], size[0]) if size.all() and len(some) else None

    whole = fitted(list(range(FOLDS))) or Machine(np.zeros(_SYMBOLS**3), 0.0)
    judges = [fitted([g for g in range(FOLDS) if g != f]) or whole for f in range(FOLDS)]
    del units, n

    def measure(batches):
        readers = [Reader(m) for m in judges]
        for batch in batches:
            fold = np.array(batch.column("fold").to_pylist(), np.int64)
            texts, found = batch.column("text").to_pylist(), np.zeros((batch.num_rows, WIDTH))
            for f, reader in enumerate(readers):
                mine = np.flatnonzero(fold == f)
                found[mine] = summaries(reader, [texts[i] for i in mine])
            yield pa.RecordBatch.from_arrays([batch.column("label"), *[pa.array(found[:, c]) for c in range(WIDTH)]], names=["label", *[f"s{c}" for c in range(WIDTH)]])
        tidy("toxicity")

    seen = sample.select("label", "fold", "text").mapInArrow(measure, "label int, " + ", ".join(f"s{c} double" for c in range(WIDTH))).toArrow()
    facts = np.column_stack([seen[f"s{c}"].to_numpy() for c in range(WIDTH)])
    logit = fit_logit(inputs(facts), seen["label"].to_numpy().astype(float))
    tidy()
    return Detector(whole, logit)


def score(docs: DataFrame, detector: Detector | None) -> DataFrame:
    """(doc_id, score) of every row of docs, whole texts."""
    plain = docs.select("doc_id", text_or_empty().alias("text"))
    if detector is None:
        return plain.select("doc_id", F.lit(0.0).alias("score"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def rate(batches):
        reader = memory("toxicity").setdefault("reader", Reader(detector.machine))
        if not np.array_equal(reader.machine.table, detector.machine.table):
            reader = memory("toxicity")["reader"] = Reader(detector.machine)
        for batch in batches:
            found = detector.score(summaries(reader, batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])
        tidy("toxicity")

    return plain.mapInArrow(rate, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; learned from rows that are not held out."""
    return score(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
