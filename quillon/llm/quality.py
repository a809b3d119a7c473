"""Document quality by co-training two views.

The text view sees hashed words, word shapes and repetition; the metadata view sees source,
language and length. Both are logistic classifiers. They start from a bounded sample of labelled documents
(`LABELLED`, the least by a hash of the id). In each of `ROUNDS` rounds each view is calibrated on labelled
documents that it does not train on, and both score all documents without a label. Those that a view
is sure of (`SURE`) are pseudo-labelled for the other view, which trains on a bounded sample of them (`GROW` of
each label by rarity, the least by a hash of the id). At the end both are calibrated again, a logistic model of the two
calibrated views is fitted on labelled documents that neither was trained nor calibrated on, and all documents are
scored by it in one pass.

Defined cases: a null text is empty; null sources, languages and lengths are values of their own, and
so are missing columns; a document with several labels is good if any says so; null labels are ignored; repeated rows
get the same score, and one row for each doc_id is learned from, the least by a hash of its text; without labels of both kinds every document
scores 1 and is kept; an empty table gives no rows; other columns are ignored or passed through, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import broadcast_if, lean, memory, quoted, stored, text_or_empty, tidy
from quillon.llm.tokens import as_list, in_slices

LABELLED = 4000  #: labelled documents that are learned from, at most
ROUNDS = 2
SURE = 0.97
GROW = 400  #: pseudo-labelled documents that a view hands over in a round, at most
WORDS, SHAPES, REPEATS, META = 1 << 15, 1 << 13, 32, 1 << 10
TEXT_SIZE = WORDS + SHAPES + 2 * REPEATS
ROOM = 300_000  #: words in each generation of what a worker remembers

_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_LOWER, _TITLE = (WORDS + zlib.crc32(x) % SHAPES << 20 for x in (b"a", b"Aa"))

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sparse(doc: np.ndarray, feature: np.ndarray, weight: np.ndarray, n: int) -> Rows:
    """(bounds, features, values) by document; equal features are added, then square roots taken."""
    key, inverse = np.unique(doc.astype(np.int64) << 20 | feature, return_inverse=True)
    total = np.bincount(inverse, weight, len(key))
    return np.searchsorted(key >> 20, np.arange(n + 1)), (key & ((1 << 20) - 1)).astype(np.int32), np.sqrt(total).astype(np.float32)


def word_features(word: str) -> int:
    """Its hash's feature, and its shape's 20 bits higher."""
    raw = word.encode()
    if word.isascii() and word.isalpha() and word[1:].islower():  # nearly all words have one of two shapes
        if word[0].islower():
            return zlib.crc32(raw) % WORDS | _LOWER
        return zlib.crc32(raw.lower()) % WORDS | _TITLE
    return zlib.crc32(raw.lower()) % WORDS | (WORDS + zlib.crc32(_RUN.sub(rb"\1", raw.translate(_SHAPE))) % SHAPES) << 20


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x in order, and how often each stands there."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
    return x[at], np.diff(at, append=len(x))


def text_features(texts: list[str]) -> Rows:
    """Square roots of the shares of words and of shapes; steps of how many words are new and how many repeat the last."""
    n = len(texts)
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    words = lists.flatten()
    there = np.asarray(pc.binary_length(words)) > 0
    doc = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))[there]
    sizes = np.bincount(doc, minlength=n)
    coded = words.filter(pa.array(there)).dictionary_encode()
    token, names = coded.indices.to_numpy().astype(np.int64), as_list(coded.dictionary)
    # features of words seen of late, by word; when full it becomes the old one, and the old one goes
    known = memory("quality")
    if len(known.setdefault("seen", {})) > ROOM:
        known["seen"], known["old"] = {}, known["seen"]
    seen, old = known["seen"], known.get("old", {})
    seen.update([(w, old[w] if w in old else word_features(w)) for w in names if w not in seen])
    both = np.fromiter(map(seen.__getitem__, names), np.int64, len(names))
    same = np.zeros(len(token), bool)
    same[1:] = (token[1:] == token[:-1]) & (doc[1:] == doc[:-1])
    again = np.bincount(doc[same], minlength=n) / np.maximum(1, sizes)
    fresh = np.bincount(_runs(doc << 32 | token)[0] >> 32, minlength=n) / np.maximum(1, sizes)
    step = lambda x, base: base + np.minimum(REPEATS - 1, (x * REPEATS).astype(np.int64))
    some, high = np.flatnonzero(sizes), doc << 20
    low = (1 << 20) - 1
    key, count = _runs(np.concatenate((high | (both & low)[token], high | (both >> 20)[token], some << 20 | step(again, WORDS + SHAPES)[some], some << 20 | step(fresh, WORDS + SHAPES + REPEATS)[some])))
    feature, owner = key & low, key >> 20
    values = np.sqrt(np.where(feature < WORDS + SHAPES, 0.5 * count / np.maximum(1, sizes)[owner], 0.25))
    return np.searchsorted(owner, np.arange(n + 1)), feature.astype(np.int32), values.astype(np.float32)


def meta_features(source: list, lang: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(source)
    size = ["null" if c is None or c != c else str(int(2 * np.log2(max(1, c)))) for c in n_chars]
    columns = [[f"source {s}" for s in source], [f"lang {s}" for s in lang], [f"size {s}" for s in size], [f"both {s} {t}" for s, t in zip(source, lang, strict=True)]]
    feature = np.array([zlib.crc32(x.encode("utf-8", "replace")) % META for c in columns for x in c], np.int64)
    return _sparse(np.tile(np.arange(n), len(columns)), feature, np.full(n * len(columns), 0.25), n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Linear:
    """A logistic classifier of sparse rows."""

    weights: np.ndarray
    bias: float = 0.0

    def raw(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        bounds, features, values = rows
        run = np.concatenate(([0.0], np.cumsum(self.weights[features] * values, dtype=np.float64)))
        return run[bounds[1:]] - run[bounds[:-1]] + self.bias


def take(rows, index: np.ndarray):
    bounds, features, values = rows
    sizes = bounds[index + 1] - bounds[index]
    new = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(bounds[index] - new[:-1], sizes) + np.arange(new[-1])
    return new, features[at], values[at]


def fit(rows, good: np.ndarray, size: int, steps: int = 60, rate: float = 1.0, decay: float = 1e-5) -> Linear:
    """Adagrad on all rows, both classes weighing the same."""
    bounds, features, values = rows
    doc = np.repeat(np.arange(len(good)), np.diff(bounds))
    share = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    model, seen, seen_bias = Linear(np.zeros(size)), np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        slope = (sigmoid(model.raw(rows)) - good) * share
        grad = np.bincount(features, slope[doc] * values, size) + decay * model.weights
        seen += grad**2
        model.weights -= rate * grad / np.sqrt(seen)
        step = slope.sum()
        seen_bias += step**2
        model.bias -= rate * step / np.sqrt(seen_bias)
    return model


def fit_logit(x: np.ndarray, good: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic model of few columns (the last a constant), by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - good) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


@dataclass
class CoTrained:
    """Two views, their calibrations, and the model that joins them."""

    text: Linear
    meta: Linear
    scale: list[np.ndarray] = field(default_factory=list)
    joint: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def views(self, text_rows, meta_rows) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of both views."""
        return tuple(s[0] * m.raw(r) + s[1] for m, r, s in ((self.text, text_rows, self.scale[0]), (self.meta, meta_rows, self.scale[1])))

    def score(self, text_rows, meta_rows) -> np.ndarray:
        a, b = self.views(text_rows, meta_rows)
        return sigmoid(self.joint[0] * a + self.joint[1] * b + self.joint[2])


class Teacher:
    """Two views that train on labelled rows and on what the other is sure of.

    label: 1 good, 0 not. While views teach each other, every fourth labelled row of each label is kept for their calibration.
    """

    def __init__(self, text_rows: Rows, meta_rows: Rows, label: np.ndarray):
        self.rows, self.good, self.n = (text_rows, meta_rows), label == 1, np.arange(len(label))
        self.turn = np.where(self.good, np.cumsum(self.good), np.cumsum(~self.good)) - 1  # its number among rows of its label
        self.train, self.held = self.n[self.turn % 4 != 0], self.n[self.turn % 4 == 0]
        self.able = self._both(self.train) and self._both(self.held)
        self.taught: list[list[tuple[Rows, np.ndarray]]] = [[], []]

    def _both(self, rows: np.ndarray) -> bool:
        return len(set(self.good[rows].tolist())) == 2

    def _views(self, train: np.ndarray) -> list[Linear]:
        out = []
        for v, size in ((0, TEXT_SIZE), (1, META)):
            parts = [(take(self.rows[v], train), self.good[train]), *self.taught[v]]
            out.append(fit(_join_rows([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), size))
        return out

    def _raw(self, models: list[Linear], rows: np.ndarray) -> np.ndarray:
        return np.column_stack([m.raw(take(r, rows)) for m, r in zip(models, self.rows, strict=True)])

    def pupil(self) -> CoTrained:
        """Views for the next round, calibrated on rows that neither trains on."""
        models = self._views(self.train)
        raw = self._raw(models, self.held)
        return CoTrained(*models, [fit_logit(raw[:, [v]], self.good[self.held]) for v in (0, 1)])

    def graduate(self) -> CoTrained:
        """Views of all labelled rows. Calibration and joint model see scores of views that did not train on the row.

        Each half of the rows is scored by views of the other half; half of each calibrates, the rest fits the joint model.
        """
        half, last = self.turn % 2 == 0, self.turn % 4 >= 2
        calibrate, joint = self.n[~last], self.n[last]
        if all(self._both(r) for r in (self.n[half], self.n[~half], calibrate, joint)):
            raw = np.zeros((len(self.n), 2))
            for part in (half, ~half):
                raw[part] = self._raw(self._views(self.n[~part]), self.n[part])
            models = self._views(self.n)
        else:  # too few rows to divide
            models, calibrate, joint = self._views(self.train), self.held, self.held
            raw = self._raw(models, self.n)
        scale = [fit_logit(raw[calibrate][:, [v]], self.good[calibrate]) for v in (0, 1)]
        views = np.column_stack([s[0] * raw[joint, v] + s[1] for v, s in enumerate(scale)])
        return CoTrained(*models, scale, fit_logit(views, self.good[joint]))

    def quota(self, grow: int = GROW) -> tuple[int, int]:
        """How many sure rows of each label, bad and good, a view hands over: by the labels' shares."""
        share = self.good[self.held].mean()
        return max(1, int(grow * (1 - share))), max(1, int(grow * share))

    def teach(self, view: int, text_rows: Rows, meta_rows: Rows, good: np.ndarray) -> None:
        """Hands rows that `view` is sure of to the other view."""
        self.taught[1 - view].append(((text_rows, meta_rows)[1 - view], good))


def sure_rows(model: CoTrained, text_rows: Rows, meta_rows: Rows) -> np.ndarray:
    """(2, rows): 1 where a view is sure that a row is good, 0 where it is sure that it is not, else -1."""
    p = np.stack([sigmoid(x) for x in model.views(text_rows, meta_rows)])
    return np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1))


# ---- on tables


def _join_rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    sizes = np.concatenate([np.diff(p[0]) for p in parts])
    return np.concatenate(([0], np.cumsum(sizes))), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _facts(docs: DataFrame) -> list[Column]:
    """text, source, lang, n_chars of a row, null where docs lack the column."""
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    return [text_or_empty().alias("text"), *[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]]


FEATURES = "doc_id long, order long, label int, source string, lang string, n_chars long, features binary, weights binary"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]


def _unpacked(got: list) -> tuple[Rows, Rows]:
    features = [np.frombuffer(r["features"], np.int32) for r in got]
    empty = np.empty(0, np.int32)
    text_rows = (np.concatenate(([0], np.cumsum([len(f) for f in features]))).astype(np.int64), np.concatenate([empty, *features]), np.concatenate([np.empty(0, np.float32), *[np.frombuffer(r["weights"], np.float32) for r in got]]))
    return text_rows, meta_features(*([r[c] for r in got] for c in ("source", "lang", "n_chars")))


def _featured(plain: DataFrame, picked: list[tuple[int, int]]) -> list:
    """FEATURES of the picked documents (doc_id, label), a bounded number; of rows with one doc_id the least by hash."""
    spark = plain.sparkSession
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "source", "lang", "n_chars"))
    found = plain.join(F.broadcast(spark.createDataFrame(picked, "doc_id long, label int")), "doc_id").withColumn("n", F.row_number().over(one)).filter("n = 1")

    def extract(batches):
        for batch in batches:
            d = batch.to_pydict()
            for at, some in in_slices(d["text"]):
                bounds, features, values = text_features(some)
                cut = lambda a, b=bounds: [a[x:y].tobytes() for x, y in zip(b[:-1], b[1:], strict=True)]
                columns = [*(d[c][at : at + len(some)] for c in ("doc_id", "order", "label", "source", "lang", "n_chars")), cut(features), cut(values)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[f.split(" ")[0] for f in FEATURES.split(", ")])

    got = found.select("doc_id", "order", "label", "text", "source", "lang", "n_chars").mapInArrow(extract, FEATURES).collect()
    return sorted(got, key=lambda r: (r["order"], r["doc_id"]))


def _sure_ids(others: DataFrame, model: CoTrained, quota: tuple[int, int], gone: list[np.ndarray]) -> DataFrame:
    """(view, label, order, doc_id) of the rows that a view is sure of; of a task those of least order, as many as may be taken of all."""

    def scan(batches):
        kept = {(v, x): (np.empty(0, np.int64), np.empty(0, np.int64)) for v in (0, 1) for x in (0, 1)}
        for batch in batches:
            d = {c: batch.column(c) for c in batch.schema.names}
            ids, order, texts = d["doc_id"].to_numpy(zero_copy_only=False), d["order"].to_numpy(zero_copy_only=False), d["text"].to_pylist()
            meta = {c: d[c].to_pylist() for c in ("source", "lang", "n_chars")}
            for at, some in in_slices(texts):
                part = slice(at, at + len(some))
                found = sure_rows(model, text_features(some), meta_features(*(meta[c][part] for c in meta)))
                for view, label in kept:
                    new = np.flatnonzero((found[view] == label) & ~np.isin(ids[part], gone[view])) + at
                    both = np.concatenate((kept[view, label][0], order[new])), np.concatenate((kept[view, label][1], ids[new]))
                    _, first = np.unique(both[1], return_index=True)
                    first = first[np.lexsort((both[1][first], both[0][first]))][: quota[label]]
                    kept[view, label] = both[0][first], both[1][first]
        tidy("quality")
        for (view, label), (order, ids) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), view, np.int32)), pa.array(np.full(len(ids), label, np.int32)), pa.array(order), pa.array(ids)], names=["view", "label", "order", "doc_id"])

    return others.select("doc_id", "order", "text", "source", "lang", "n_chars").mapInArrow(scan, "view int, label int, order long, doc_id long")


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, grow: int = GROW, rounds: int = ROUNDS) -> CoTrained | None:
    """Fits on at most `labelled` labelled documents, and on at most 2 * rounds * grow others; their features reach the driver."""
    known = stored(labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")))
    order = F.xxhash64("doc_id").alias("order")
    count = known.count()
    small = broadcast_if(known, count, 32)
    ids = docs.select("doc_id").filter("doc_id is not null").join(small, "doc_id").distinct().select("doc_id", "label", order)
    picked = [(r["doc_id"], r["label"]) for r in ids.orderBy("order", "doc_id").limit(labelled).collect()]
    if not picked:
        return None
    plain = lean(docs).select(F.col("doc_id").cast("long"), order, *_facts(docs))
    got = _featured(plain, picked)
    teacher = Teacher(*_unpacked(got), np.array([r["label"] for r in got]))
    if not teacher.able:
        return None
    quota, taken = teacher.quota(grow), [[], []]
    others = plain.filter("doc_id is not null").join(small.select("doc_id"), "doc_id", "left_anti")  # all documents without a label
    for _ in range(rounds):
        sure = stored(_sure_ids(others, teacher.pupil(), quota, [np.array(sorted(t), np.int64) for t in taken]))
        handed = {(v, x): sure.filter((F.col("view") == v) & (F.col("label") == x)).select("order", "doc_id").distinct().orderBy("order", "doc_id").limit(quota[x]).collect() for v in (0, 1) for x in (0, 1)}
        if not any(handed.values()):
            break
        rows = {r["doc_id"]: r for r in _featured(plain, sorted({(r["doc_id"], 0) for some in handed.values() for r in some}))}
        for view in (0, 1):
            mine = sorted([(r["order"], r["doc_id"], label) for label in (0, 1) for r in handed[view, label]])
            taken[view] += [i for _, i, _ in mine]
            if mine:
                teacher.teach(view, *_unpacked([rows[i] for _, i, _ in mine]), np.array([label == 1 for *_, label in mine]))
    model = teacher.graduate()
    del teacher, got
    tidy()
    return model


def scored(model: CoTrained | None) -> Column:
    """score, text_score, meta_score of a row of documents."""
    kind = T.StructType([T.StructField(c, T.DoubleType()) for c in ("score", "text_score", "meta_score")])
    if model is None:
        return F.struct(*[F.lit(1.0).alias(c) for c in kind.names])

    @F.pandas_udf(kind)
    def rate(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        out = []
        for at, some in in_slices(text.tolist()):
            part = slice(at, at + len(some))
            t, m = text_features(some), meta_features(source[part].tolist(), lang[part].tolist(), n_chars[part].tolist())
            a, b = model.views(t, m)
            out.append(np.column_stack((model.score(t, m), sigmoid(a), sigmoid(b))))
        tidy("quality")
        return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 3)), columns=kind.names)

    return rate(F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars").cast("double"))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """docs' doc_id with score, text_score, meta_score and kept."""
    found = docs.select("doc_id", *_facts(docs)).withColumn("_s", scored(learn(docs, labels, **options)))
    return found.select("doc_id", "_s.score", "_s.text_score", "_s.meta_score", (F.col("_s.score") >= least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents that score `least` or more, with their columns."""
    rated = docs.select(F.struct(*quoted(docs)).alias("row"), *_facts(docs)).withColumn("_s", scored(learn(docs, labels, **options)))
    return rated.filter(F.col("_s.score") >= least).select("row.*")
