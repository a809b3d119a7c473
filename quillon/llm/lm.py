"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a Dirichlet-smoothed trigram model, each order backing off to the one below:
P1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)), P2(w|v) = (c(vw) + MU * P1(w)) / (c(v) + MU) and
P3(w|uv) = (c(uvw) + MU3 * P2(w|v)) / (c(uv) + MU3). It learns from the documents whose crc32 of the
id as text is not 0 mod 10, and scores all. Flow:

1. Scan: documents become batches of at most `BATCH` tokens, each with its distinct words (64-bit
   hashes) and its tokens as places in that list; longer documents go on in the next batch. The
   batches are stored once in the shared folder, bucketed, and everything later reads them from there.
2. Exchange: each batch sends each shard the words that hash to it, with the batch's training counts,
   the distinct followers of each word, and the distinct followers of each of those pairs. A word so common
   that its followers would overfill a shard has them spread over all shards, and so has a pair (of
   each there are fewer than 2 * shards, whatever the corpus).
3. Each shard adds up, builds its trie and looks up what the batches sent. Level one holds the sorted
   words, level two the followers of each word, level three those of each pair; all are Elias-Fano
   sequences, as are the pointers from each level to the next. A follower is found by successor search
   in the range that its context's pointers give, for many lookups at once. Values are counts, and
   16-bit quantised log probabilities c(vw) / (c(v) + MU) and c(uvw) / (c(uv) + MU3) and back-off weights
   MU3 / (c(uv) + MU3). The levels lie in one memory-mapped file while the shard's lookups run.
4. Each batch collects its answers and scores its documents.

The first word of a document follows a start mark, which is no token but is counted as a context, and
has no third order; the end is a token. Within one context followers are told apart by `PAIR_BITS` and
`TRIPLE_BITS` bits of their hash, so an unseen one is taken for a seen one with a chance of the
context's followers in the shard over 2^32 and 2^24.

Defined cases: a null or empty text is its end token; a null doc_id counts as empty text and is
held out; repeated rows are scored and counted once each; an empty table gives no rows; without
training tokens every word is unknown; other columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blobs import pack, unpack
from quillon.llm.common import bucketed, lean, mix64, text_or_empty, tidy

MU, MU3 = 16.0, 4.0
ALPHA = 0.1
BATCH = 2_000_000
SHARD_TOKENS = 1_000_000
LEAST_SHARDS = 64
PAIR_BITS, TRIPLE_BITS = 32, 24
STEP = 1024  #: codes for each factor of two of a probability

#: The place of the k-th set bit of byte b, at 8 * b + k.
_IN_BYTE = np.array([next((p for p in range(8) if b >> p & 1 and (b & ((1 << p) - 1)).bit_count() == k), 0) for b in range(256) for k in range(8)], np.uint8)
_1, _2, _3, _4, _8, _FF = (np.uint64(n) for n in (1, 2, 3, 4, 8, 255))
_55, _33, _0F, _01, _80 = (np.uint64(int(h * 8, 16)) for h in ("55", "33", "0f", "01", "80"))


class EliasFano:
    """A non-decreasing sequence of numbers below `universe`, in about 2 + log2(universe / n) bits each.

    All methods take and give arrays.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        counts = np.bitwise_count(high.view(np.uint64))
        self.ones = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = min(63, max(0, (universe // max(1, n)).bit_length() - 1))
        bits = np.zeros(-(-(n + (universe >> width) + 2) // 64) * 64, bool)
        bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = True
        return cls(n, width, cls._pack_low(values, width), np.packbits(bits, bitorder="little"))

    @staticmethod
    def _pack_low(values: np.ndarray, width: int) -> np.ndarray:
        words = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
        if width and len(values):
            low, at = values & np.uint64((1 << width) - 1), np.arange(len(values), dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(words, word, low << shift)
            over = shift + np.uint64(width) > 64
            np.bitwise_or.at(words, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        return words

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The places of the k-th ones or zeros, from 0."""
        directory, words = self.ones if one else self.zeros, self.high.view(np.uint64)
        block = np.searchsorted(directory, k, side="right") - 1
        x = words[block]
        if not one:
            np.invert(x, out=x)
        left = (k - directory[block]).astype(np.uint64)
        # counts of the bits up to each byte, side by side in a word (broadword selection, Vigna 2008)
        s = x - ((x >> _1) & _55)
        s = (s & _33) + ((s >> _2) & _33)
        s = ((s + (s >> _4)) & _0F) * _01
        byte = np.bitwise_count((((left * _01) | _80) - s) & _80).astype(np.uint64) << _3
        left -= (s << _8 >> byte) & _FF
        return block * 64 + byte.astype(np.int64) + _IN_BYTE[(((x >> byte) & _FF) << _3 | left).astype(np.int64)]

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """The least places in [first, past) whose values are x or more; past where there is none."""
        x = np.asarray(x, np.uint64)
        top = (x >> np.uint64(self.width)).astype(np.int64)
        bucket = np.where(top > 0, self._select(np.maximum(top - 1, 0), False) - top + 1, 0)
        lo, hi = np.maximum(first, bucket), np.minimum(past, self._select(top, False) - top)
        low, open_ = x & np.uint64((1 << self.width) - 1), np.flatnonzero(lo < hi)
        while len(open_):  # all values between lo and hi share x's high bits
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return np.minimum(np.maximum(lo, first), past)

    def find(self, x: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """The places in [first, past) that hold x, -1 where none does."""
        at = self.successor(x, first, past)
        out, some = np.full(len(at), -1), np.flatnonzero(at < past)
        same = some[self.get(at[some]) == np.asarray(x, np.uint64)[some]]
        out[same] = at[same]
        return out


def quantise(p: np.ndarray) -> np.ndarray:
    """0 for none, else 1 for a probability of one and STEP more for each halving."""
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log2(p) * STEP) + 1
    return np.where(p > 0, np.minimum(code, 65535), 0).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.exp2((1.0 - code) / STEP), 0.0)


class ShardModel:
    """A shard's trie, in a memory-mapped file of its own while it lives."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, ...], triples: tuple[np.ndarray, ...]):
        """words sorted; pairs (place of the word, key, probability, back-off weight) and triples (place of the pair, key, probability) sorted by the first two."""
        word, pair_key, pair_p, weight = pairs
        pair, triple_key, triple_p = triples
        fan = lambda context, n: np.concatenate(([0], np.cumsum(np.bincount(context, minlength=n))))
        under = lambda context, key, bits: (context.astype(np.uint64) << np.uint64(bits)) | key.astype(np.uint64)
        levels = [
            EliasFano.build(words, 1 << 64),
            EliasFano.build(fan(word, len(words)), len(word) + 1),
            EliasFano.build(under(word, pair_key, PAIR_BITS), (len(words) + 1) << PAIR_BITS),
            EliasFano.build(fan(pair, len(word)), len(pair) + 1),
            EliasFano.build(under(pair, triple_key, TRIPLE_BITS), (len(word) + 1) << TRIPLE_BITS),
        ]
        arrays = [x for e in levels for x in (e.low, e.high)] + [counts.astype(np.uint64), quantise(pair_p), quantise(weight), quantise(triple_p)]
        spans, at = [], 0
        with tempfile.NamedTemporaryFile(prefix="trie-", delete=False) as f:
            for a in arrays:
                raw = a.tobytes()
                spans.append((at, len(a), a.dtype))
                f.write(raw + b"\0" * (-len(raw) % 8))
                at += len(raw) + -len(raw) % 8
            path = f.name
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        os.unlink(path)  # the mapping outlives the name
        self.bytes = at
        views = [np.frombuffer(self.map, kind, n, start) for start, n, kind in spans]
        self.words, *self.rest = (EliasFano(e.n, e.width, views[2 * i], views[2 * i + 1]) for i, e in enumerate(levels))
        self.counts, self.pair_codes, self.weight_codes, self.triple_codes = views[10:]

    def find_words(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words, -1 for those not held."""
        zero = np.zeros(len(hashes), np.int64)
        return self.words.find(hashes, zero, zero + self.words.n)

    def find_followers(self, order: int, context: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places at level `order` of keys under contexts' places; -1 for what is not held, and under contexts of -1."""
        pointers, level = self.rest[2 * order - 4 : 2 * order - 2]
        out, some = np.full(len(context), -1), np.flatnonzero(context >= 0)
        at = context[some]
        x = (at.astype(np.uint64) << np.uint64(PAIR_BITS if order == 2 else TRIPLE_BITS)) | keys[some].astype(np.uint64)
        out[some] = level.find(x, pointers.get(at).astype(np.int64), pointers.get(at + 1).astype(np.int64))
        return out


def _held(values: np.ndarray, at: np.ndarray, none: int = 0) -> np.ndarray:
    out = np.full(len(at), none, values.dtype)
    out[at >= 0] = values[at[at >= 0]]
    return out


# ---- batches


def _hash_words(words) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w, 0) for w in words], np.uint64)


#: No word is empty or holds a space, so these stand for the end and the start.
END, START = b"", b" "


def make_batches(docs: DataFrame, limit: int = BATCH) -> DataFrame:
    """(batch, train_tokens, words, body)"""

    def scan(rows):
        part, seq, row = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        words: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, held, words
            names = list(dict.fromkeys([END, START, *[w for h in held for w in h[4:] if w is not None], *words]))
            place = dict(zip(names, range(len(names)), strict=True))
            tokens = np.fromiter(map(place.__getitem__, words), np.int32, len(words))
            sizes = np.array([h[3] for h in held], np.int64)
            out, before = np.array([h[2] for h in held], np.uint8), np.array([place[h[4]] for h in held], np.int32)
            second = np.array([-1 if h[5] is None else place[h[5]] for h in held], np.int32)
            train = np.repeat(out == 0, sizes)
            counts = np.bincount(tokens[train], minlength=len(names)).astype(np.uint32)
            counts[1] = ((second < 0) & (out == 0)).sum()
            segments = (np.array([h[0] for h in held], np.int64), np.array([h[1] or 0 for h in held], np.int64), np.array([h[1] is None for h in held], np.uint8), out, sizes, before, second)
            row_batch = pa.RecordBatch.from_pydict({"batch": pa.array([part << 32 | seq]), "train_tokens": pa.array([int(train.sum())]), "words": pa.array([pack(_hash_words(names), counts)], pa.binary()), "body": pa.array([pack(tokens, *segments)], pa.binary())})
            seq, held, words = seq + 1, [], []
            return row_batch

        for r in rows:
            for doc_id, text in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True):
                mine = text.encode("utf-8", "surrogatepass").lower().split()
                mine.append(END)
                out = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0
                last, second, at = START, None, 0
                while at < len(mine):
                    some = mine[at : at + limit - len(words)]
                    held.append((part << 40 | row, doc_id, out, len(some), last, second))
                    words += some
                    last, second, at = some[-1], some[-2] if len(some) > 1 else last, at + len(some)
                    if len(words) >= limit:
                        yield close()
                row += 1
        if held:
            yield close()
        tidy()

    return lean(docs).select("doc_id", text_or_empty().alias("text")).mapInArrow(scan, "batch long, train_tokens long, words binary, body binary")


def pair_names(left: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix64(left, 5) ^ mix64(key, 6)


class Text:
    """A stored batch's tokens with their contexts: previous words, pairs of words and pairs' places as contexts."""

    def __init__(self, words: bytes, body: bytes):
        self.words, self.counts = unpack(words)
        self.tokens, self.rows, ids, null, self.out, self.sizes, before, second = unpack(body)
        self.ids = [None if gone else int(i) for i, gone in zip(ids, null, strict=True)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.previous = np.empty_like(self.tokens)
        self.previous[1:] = self.tokens[:-1]
        self.previous[self.starts] = before
        self.train = np.repeat(self.out == 0, self.sizes)
        self.before, self.second = before, second

    def pair_ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Hashes that name pairs of words across batches."""
        return pair_names(self.words[left], self.words[right] >> np.uint64(64 - PAIR_BITS))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _home_places(names: np.ndarray, home: np.ndarray, n: int) -> np.ndarray:
    """Where each of n names stands at its home."""
    out = np.empty(n, np.int64)
    out[names[home]] = np.flatnonzero(home)
    return out


class Batch(Text):
    """A batch with its distinct pairs and triples in the order in which shards are asked for them."""

    def __init__(self, words: bytes, body: bytes, shards: int, common: np.ndarray, hot: np.ndarray):
        super().__init__(words, body)
        n, count = np.int64(len(self.words)), len(self.tokens)
        later = np.flatnonzero(self.second >= 0)  # segments that go on from an earlier batch: their first context is a pair too
        keys = np.concatenate((self.previous.astype(np.int64) * n + self.tokens, self.second[later].astype(np.int64) * n + self.before[later]))
        pair, place = np.unique(keys, return_inverse=True)
        del keys
        self.pair_of = place[:count].astype(np.int32)
        context = np.empty(count, np.int32)
        context[1:] = self.pair_of[:-1]
        context[self.starts] = -1
        context[self.starts[later]] = place[count:]
        del place
        self.context, self.with_context = context, np.flatnonzero(context >= 0)
        left, right = (pair // n).astype(np.int32), (pair % n).astype(np.int32)
        self.pairs = len(pair)
        triple, place = np.unique(context[self.with_context].astype(np.int64) * n + self.tokens[self.with_context], return_inverse=True)
        self.triple_of = place.astype(np.int32)
        del pair, place
        under, last = (triple // n).astype(np.int32), (triple % n).astype(np.int32)
        del triple
        home = (mix64(self.words, 1) % np.uint64(shards)).astype(np.int64)
        follower = (mix64(self.words, 2) % np.uint64(shards)).astype(np.int64)
        spread = np.isin(self.words, common)
        pair_shard = np.where(spread[left], follower[right], home[left])
        both = np.flatnonzero(spread[left] & spread[right])
        is_hot = np.zeros(len(left), bool)
        is_hot[both[np.isin(self.pair_ids(left[both], right[both]), hot)]] = True
        triple_shard = np.where(is_hot[under], follower[last], pair_shard[under])
        # pairs of a shard: those at home there, and hot ones with followers there; words likewise
        size = np.int64(len(left))
        far = np.flatnonzero(is_hot[under])
        at = _distinct(np.concatenate((pair_shard * size + np.arange(size), _distinct(triple_shard[far] * size + under[far]))))
        shard = at // size
        self.pair = (at - shard * size).astype(np.int32)
        self.pair_home = pair_shard[self.pair] == shard
        lefts = left[self.pair]
        out = np.flatnonzero(spread[lefts])
        words_at = _distinct(np.concatenate((home * n + np.arange(n), _distinct(shard[out] * n + lefts[out]))))
        self.word_shard = words_at // n
        self.word = (words_at - self.word_shard * n).astype(np.int32)
        self.word_home = home[self.word] == self.word_shard
        self.pair_slot = _home_places(self.word, self.word_home, n)[lefts]
        self.pair_slot[out] = np.searchsorted(words_at, shard[out] * n + lefts[out])
        self.pair_shard, self.pair_key = shard, (self.words >> np.uint64(32)).astype(np.uint32)[right[self.pair]]
        slot = _home_places(self.pair, self.pair_home, size)[under]
        slot[far] = np.searchsorted(at, triple_shard[far] * size + under[far])
        self.order = np.argsort(slot, kind="stable").astype(np.int32)
        self.triple_slot = slot[self.order]
        self.triple_shard = triple_shard[self.order]
        self.last = last

    def triple_keys(self) -> np.ndarray:
        """Three bytes of each triple's last word, in order."""
        return np.ascontiguousarray(self.words.view(np.uint8).reshape(-1, 8)[:, :3][self.last[self.order]]).ravel()

    def slices(self, shards: int):
        """(shard, slices of words, pairs and triples) of each shard with any."""
        ends = [np.searchsorted(x, np.arange(shards + 1)) for x in (self.word_shard, self.pair_shard, self.triple_shard)]
        for s in np.flatnonzero(np.diff(ends[0])).tolist():
            yield s, *(slice(int(e[s]), int(e[s + 1])) for e in ends)


def _emit(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[] for _ in names], kinds, strict=True)], names=names)


def _sums(batches: DataFrame, read, columns: tuple[str, ...]) -> DataFrame:
    """(key, n): sums over all batches of what read returns for each, a pair of arrays."""

    def each(rows):
        for r in rows:
            for data in zip(*(r.column(c).to_pylist() for c in columns), strict=True):
                keys, counts = read(*data)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "n"])

    return batches.select(*columns).mapInArrow(each, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _heavy(batches: DataFrame, read, columns: tuple[str, ...], shards: int, total: int) -> dict[int, int]:
    """Keys with over 1 / (2 * shards) of the total, with their exact sums: fewer than 2 * shards.

    A key with that share of all has half of it in some batch, or is over it by the rest.
    """
    some = lambda keys, counts, size: (keys[counts > size / (4 * shards)], counts[counts > size / (4 * shards)])
    top = _sums(batches, lambda *d: some(*read(*d)), columns).filter(F.col("n") > total / (4 * shards))
    found = np.sort(np.array([r[0] for r in top.select("key").collect()], np.int64).view(np.uint64))
    if not len(found):
        return {}
    picked = lambda keys, counts, _: (keys[np.isin(keys, found)], counts[np.isin(keys, found)])
    exact = _sums(batches, lambda *d: picked(*read(*d)), columns).filter(F.col("n") > total / (2 * shards))
    return {int(np.int64(r[0]).view(np.uint64)): r[1] for r in exact.collect()}


def common_words(batches: DataFrame, shards: int, total: int) -> dict[int, int]:
    def read(words):
        hashes, counts = unpack(words)
        return hashes, counts, int(counts.sum())

    return _heavy(batches, read, ("words",), shards, total)


def hot_pairs(batches: DataFrame, shards: int, total: int, common: np.ndarray) -> dict[int, int]:
    """Pairs, by `Text.pair_ids`, as `common_words` finds words; both of their words are common."""

    def read(words, body):
        t = Text(words, body)
        spread = np.isin(t.words, common)
        both = np.flatnonzero(spread[t.previous] & spread[t.tokens] & t.train)
        names, counts = np.unique(t.pair_ids(t.previous[both], t.tokens[both]), return_counts=True)
        return names, counts, int(t.train.sum())

    return _heavy(batches, read, ("words", "body"), shards, total) if len(common) else {}


# ---- shards


def _index(names: np.ndarray, wanted: dict[int, int], values: np.ndarray) -> None:
    """Puts the wanted names' sums into values."""
    for name, n in wanted.items():
        i = np.searchsorted(names, np.uint64(name))
        if i < len(names) and names[i] == name:
            values[i] = n


def answer(asked: list[tuple[np.ndarray, ...]], common: dict[int, int], hot: dict[int, int], mu: float, mu3: float) -> list[bytes]:
    """Adds up what the batches sent a shard, builds its trie, and looks all of it up: a reply to each batch.

    asked: (words, counts, followers of each word, their keys and counts, followers of each pair, their keys and counts, the pairs' names if any is hot).
    """
    together = lambda i: np.concatenate([a[i] for a in asked])
    words, of_word = np.unique(together(0), return_inverse=True)
    counts = np.bincount(of_word, together(1), len(words)).astype(np.int64)
    pair, of_pair = np.unique((np.repeat(of_word, together(2)).astype(np.uint64) << np.uint64(PAIR_BITS)) | together(3), return_inverse=True)
    seen = np.bincount(of_pair, together(4), len(pair)).astype(np.int64)
    triple, of_triple = np.unique((np.repeat(of_pair, together(5)).astype(np.uint64) << np.uint64(TRIPLE_BITS)) | together(6), return_inverse=True)
    times = np.bincount(of_triple, together(7), len(triple)).astype(np.int64)
    # a context's count is its word's or pair's own, as all but the end have a follower; common ones bring theirs along
    whole, whole_pair = counts.copy(), seen.copy()
    _index(words, common, whole)
    if hot:
        names = np.zeros(len(pair), np.uint64)
        names[of_pair] = together(8)
        order = np.argsort(names, kind="stable")
        known = whole_pair[order]
        _index(names[order], hot, known)
        whole_pair[order] = known
    word_of, key_of = (pair >> np.uint64(PAIR_BITS)).astype(np.int64), pair & np.uint64((1 << PAIR_BITS) - 1)
    pair_of, last_of = (triple >> np.uint64(TRIPLE_BITS)).astype(np.int64), triple & np.uint64((1 << TRIPLE_BITS) - 1)
    keep, keep_pair, keep_triple = whole > 0, whole_pair > 0, times > 0
    place, place_pair = np.cumsum(keep) - 1, np.cumsum(keep_pair) - 1
    p, q = keep_pair, keep_triple
    model = ShardModel(
        words[keep],
        counts[keep],
        (place[word_of[p]], key_of[p], seen[p] / (whole[word_of[p]] + mu), mu3 / (whole_pair[p] + mu3)),
        (place_pair[pair_of[q]], last_of[q], times[q] / (whole_pair[pair_of[q]] + mu3)),
    )
    at = model.find_words(words)
    counts = _held(model.counts, at)
    at = model.find_followers(2, at[word_of], key_of)
    codes, weights = _held(model.pair_codes, at), _held(model.weight_codes, at, 1)
    thirds = _held(model.triple_codes, model.find_followers(3, at[pair_of], last_of))
    replies, n = [], np.zeros(3, np.int64)
    for a in asked:
        m = n + (len(a[0]), len(a[3]), len(a[6]))
        replies.append(pack(counts[of_word[n[0] : m[0]]], codes[of_pair[n[1] : m[1]]], weights[of_pair[n[1] : m[1]]], thirds[of_triple[n[2] : m[2]]]))
        n = m
    return replies


def _wide(raw: np.ndarray, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = raw.reshape(-1, width)
    return wide.view(np.uint64).ravel()


def score(docs: DataFrame, mu: float = MU, mu3: float = MU3, batch_tokens: int = BATCH, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)"""
    batches = bucketed(make_batches(docs, batch_tokens), "batch")
    total = batches.agg(F.coalesce(F.sum("train_tokens"), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, -(-total // shard_tokens))
    common = common_words(batches, shards, total)
    common_hash = np.sort(np.array(list(common), np.uint64))
    hot = hot_pairs(batches, shards, total, common_hash)
    hot_hash = np.sort(np.array(list(hot), np.uint64))
    start = _hash_words([START])[0]

    def known(words):
        hashes, counts = unpack(words)
        some = hashes[(counts > 0) & (hashes != start)]
        return some, np.ones(len(some), np.int64)

    floor = total + ALPHA * (_sums(batches, known, ("words",)).count() + 1)

    def ask(rows):
        for r in rows:
            for batch, words, body in zip(*(r.column(c).to_pylist() for c in ("batch", "words", "body")), strict=True):
                b, records = Batch(words, body, shards, common_hash, hot_hash), []
                c2 = np.bincount(b.pair_of[b.train], minlength=b.pairs)[b.pair]
                c3 = np.bincount(b.triple_of[b.train[b.with_context]], minlength=len(b.last))[b.order].astype(np.uint32)
                c1, c2 = np.where(b.word_home, b.counts[b.word], 0).astype(np.uint32), np.where(b.pair_home, c2, 0).astype(np.uint32)
                thirds = b.triple_keys()
                for s, w, p, t in b.slices(shards):
                    fan = np.bincount(b.pair_slot[p] - w.start, minlength=w.stop - w.start).astype(np.uint32)
                    fan3 = np.bincount(b.triple_slot[t] - p.start, minlength=p.stop - p.start).astype(np.uint32)
                    records.append((s, batch, pack(b.words[b.word[w]], c1[w], fan, b.pair_key[p], c2[p], fan3, thirds[3 * t.start : 3 * t.stop], c3[t])))
                yield _emit(records, ["shard", "batch", "body"], [pa.int32(), pa.int64(), pa.binary()])
                del b, records, c1, c2, c3, thirds
        tidy()

    def shard_task(t: pa.Table) -> pa.Table:
        asked = []
        for data in t["body"].to_pylist():
            words, c1, fan, key, c2, fan3, third, c3 = unpack(data)
            fan, key = fan.astype(np.int64), key.astype(np.uint64)
            names = pair_names(np.repeat(words, fan), key) if hot else None
            asked.append((words, c1, fan, key, c2, fan3.astype(np.int64), _wide(third, 3), c3, names))
        replies = answer(asked, common, hot, mu, mu3)
        tidy()
        return pa.table({"batch": t["batch"], "shard": t["shard"], "body": pa.array(replies, pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        (words,), (body,) = left["words"].to_pylist(), left["body"].to_pylist()
        by = dict(zip(right["shard"].to_pylist(), right["body"].to_pylist(), strict=True))
        b = Batch(words, body, shards, common_hash, hot_hash)
        counts, code, weight, third = np.zeros(len(b.words), np.int64), np.zeros(b.pairs, np.uint16), np.ones(b.pairs, np.uint16), np.zeros(len(b.last), np.uint16)
        for s, w, p, t in b.slices(shards):
            c, k, v, x = unpack(by.pop(s))
            home = b.word_home[w]
            counts[b.word[w][home]] = c[home]
            home = b.pair_home[p]
            code[b.pair[p][home]], weight[b.pair[p][home]] = k[home], v[home]
            third[b.order[t]] = x
        first = (counts + ALPHA) / floor
        p = dequantise(code)[b.pair_of] + mu / (counts[b.previous] + mu) * first[b.tokens]
        p[b.with_context] = dequantise(third)[b.triple_of] + dequantise(weight)[b.context[b.with_context]] * p[b.with_context]
        sums = lambda x: np.add.reduceat(x, b.starts) if len(x) else x
        out = pa.table({"row": b.rows, "doc_id": pa.array(b.ids, pa.int64()), "held_out": b.out == 1, "n_tokens": b.sizes, "n_known": sums((counts[b.tokens] > 0).astype(np.int64)), "base_score": sums(np.log10(first)[b.tokens]), "score": sums(np.log10(p))})
        del b, p
        tidy()
        return out

    asked = batches.select("batch", "words", "body").mapInArrow(ask, "shard int, batch long, body binary")
    answers = asked.groupBy("shard").applyInArrow(shard_task, "batch long, shard int, body binary")
    parts = batches.select("batch", "words", "body").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score")).drop("row")
