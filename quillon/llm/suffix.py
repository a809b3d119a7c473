"""Exact substring dedup by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if it lies in a `length`-byte string (100) that also starts earlier: in a smaller doc_id,
or earlier in its document. Flow:

1. Scan: documents become batches, stored once in the shared folder; everything later reads them.
2. Anchors: of the `GRAM`-byte strings inside each 100-byte window the one with the least hash is an
   anchor, the leftmost of equals. Equal windows have their anchors at the same place, so only
   suffixes that start at anchors need sorting. Shards count the anchors' hashes, and anchors that
   stand alone in the corpus go; a hash that meets another by chance only keeps a suffix too many.
3. Runs: each batch takes for each anchor left the suffix from it, 100 bytes, then the 68 bytes before
   it backwards: all that any window around it can hold. Equal ones become one entry, with its least
   place. The sorted run is dealt to shards by its first `GRAM` bytes and sent front-coded: the
   length of the prefix shared with the entry before, then the rest.
4. Merge: a shard merges its runs with a loser tree whose nodes hold common prefix lengths with the
   last output, so a prefix once known is never compared again. The lengths that come out show which
   entries are equal (all 168 bytes), which share their first 100 - o bytes, and where gram groups end.
5. Marks: an entry equal to an earlier one loses all its windows. For the first of its kind, each
   window that starts o bytes before the anchor is the earliest of its kind, or not, by the merge's
   prefix lengths (right of the anchor) and a running hash (left of it).
6. Each batch collects its marks, removes the bytes and returns what is left.

Copies within a batch travel once, so no shard holds more than one entry of a kind for each batch.

Defined cases: a null text has no bytes; null doc_ids come before all others; rows with one doc_id
and different texts are ordered by a hash of the text, and rows alike in both are one document: each
keeps what the first keeps; matches never cross documents; texts under 100 bytes are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blobs import pack, unpack
from quillon.llm.common import lean, mix64, stored, text_or_empty, tidy

LENGTH = 100
GRAM = 32
BATCH_BYTES = 8 << 20
SHARD_BYTES = 12 << 20
LEAST_SHARDS = 64
PAD = 0xFF  #: stands in no UTF-8 text
NONE = np.iinfo(np.int64).min

_TABLE = mix64(np.arange(256, dtype=np.uint64), 11)
_STEPS = [np.uint64(int(k) | 1) for k in mix64(np.arange(8, dtype=np.uint64), 12)]


class Shape:
    """Lengths that follow from the window and the gram: offsets of a window's start before its anchor are 0..back."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        if gram & (gram - 1) or not gram < length:
            raise ValueError("gram must be a power of two below length")
        self.length, self.gram, self.back = length, gram, length - gram
        self.row = length + self.back


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    h, width, level = _TABLE[data], 1, 0
    while width < gram:
        h = h[:-width] * _STEPS[level] + h[width:]
        width, level = 2 * width, level + 1
    h ^= h >> np.uint64(29)
    return h * _STEPS[7]


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(data: np.ndarray, valid: np.ndarray, shape: Shape, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors of all windows whose start is marked valid."""
    places, hashes, low = [], [], np.uint64((1 << 17) - 1)
    starts = len(data) - shape.length + 1
    for s in range(0, max(0, starts), block):
        some = valid[s : min(s + block, starts)]
        if not some.any():
            continue
        h = _gram_hashes(data[s : s + len(some) + shape.length - 1], shape.gram)
        least = _window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), shape.back + 1)[: len(some)][some]
        at = np.unique((least[np.concatenate(([True], least[1:] != least[:-1]))] & low).astype(np.int64))
        places.append(at + s)
        hashes.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    places, first = np.unique(places, return_index=True)
    return places, hashes[first]


class Text:
    """A batch's documents in one buffer, with more padding between them than a suffix reaches."""

    def __init__(self, blob: bytes, shape: Shape):
        raw, self.sizes, self.ids, self.null, self.hash = unpack(blob)
        gap = shape.row
        self.starts = np.cumsum(self.sizes + gap) - self.sizes
        self.data = np.full(int((self.sizes + gap).sum()) + gap, PAD, np.uint8)
        at = 0
        for start, size in zip(self.starts.tolist(), self.sizes.tolist(), strict=True):
            self.data[start : start + size] = raw[at : at + size]
            at += size
        whole = self.sizes >= shape.length
        mark = np.zeros(len(self.data) + 1, np.int8)
        mark[self.starts[whole]] += 1
        mark[self.starts[whole] + self.sizes[whole] - shape.length + 1] -= 1
        self.valid = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)

    def place(self, at: np.ndarray) -> np.ndarray:
        """(id, text hash, place in the document) of places in the buffer."""
        d = np.searchsorted(self.starts, at, side="right") - 1
        return np.stack((np.where(self.null[d] == 1, NONE, self.ids[d]), self.hash[d].view(np.int64), at - self.starts[d]), 1)


def make_batches(docs: DataFrame, limit: int, carry: list[str]) -> DataFrame:
    """(batch, body, rest): the documents, and their carried columns as an Arrow stream."""

    def scan(rows):
        tidy()
        from xxhash import xxh64_intdigest

        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        rest: list[pa.RecordBatch] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, ids, texts, rest, held
            raw = np.frombuffer(b"".join(texts), np.uint8)
            body = pack(raw, np.array([len(t) for t in texts], np.int64), np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.array([xxh64_intdigest(t, 1) >> 1 for t in texts], np.uint64), level=3)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest[0].schema) as stream:
                for some in rest:
                    stream.write_batch(some)
            out = pa.RecordBatch.from_pydict({"batch": pa.array([part << 32 | seq]), "body": pa.array([body], pa.binary()), "rest": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
            seq, ids, texts, rest, held = seq + 1, [], [], [], 0
            return out

        for r in rows:
            carried, first = r.select(range(2, r.num_columns)), 0
            for n, (i, t) in enumerate(zip(r.column(0).to_pylist(), r.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                if ids and held + len(t) > limit:
                    rest.append(carried.slice(first, n - first))
                    first = n
                    yield close()
                ids.append(i)
                texts.append(t)
                held += len(t)
            rest.append(carried.slice(first))
        if ids:
            yield close()

    kept = [F.col(c).alias(f"c{n}") for n, c in enumerate(carry)]
    return lean(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), *kept).mapInArrow(scan, "batch long, body binary, rest binary")


def _by_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(hashes, 3) % np.uint64(shards)).astype(np.int64)


# ---- step 2: which anchors stand alone


def _ask_hashes(text: Text, shape: Shape, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes by shard, then value; whether the batch repeats them; bounds of the shards)"""
    _, h = anchors(text.data, text.valid, shape)
    names, counts = np.unique(h >> np.uint64(16), return_counts=True)
    shard = _by_shard(names, shards)
    order = np.argsort(shard, kind="stable")
    return names[order], counts[order] > 1, np.searchsorted(shard[order], np.arange(shards + 1))


def repeated_anchors(batches: DataFrame, shape: Shape, shards: int) -> DataFrame:
    """(batch, shard, body): a bit for each hash that the batch asked about, in its order."""

    def ask(rows):
        for r in rows:
            for batch, body in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True):
                names, twice, bound = _ask_hashes(Text(body, shape), shape, shards)
                six = names.view(np.uint8).reshape(-1, 8)[:, :6]
                some = np.flatnonzero(np.diff(bound)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([batch] * len(some), pa.int64()), pa.array([pack(np.ascontiguousarray(six[bound[s] : bound[s + 1]]).ravel(), np.packbits(twice[bound[s] : bound[s + 1]])) for s in some], pa.binary())], names=["shard", "batch", "body"])

    def count(t: pa.Table) -> pa.Table:
        asked = []
        for data in t["body"].to_pylist():
            six, twice = unpack(data)
            wide = np.zeros((len(six) // 6, 8), np.uint8)
            wide[:, :6] = six.reshape(-1, 6)
            asked.append((wide.view(np.uint64).ravel(), np.unpackbits(twice, count=len(wide))))
        names, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        seen = np.bincount(inverse, 1 + np.concatenate([a[1] for a in asked]), len(names)) > 1
        hit = np.split(seen[inverse], np.cumsum([len(a[0]) for a in asked])[:-1])
        return pa.table({"batch": t["batch"], "shard": t["shard"], "body": pa.array([np.packbits(x).tobytes() for x in hit], pa.binary())})

    return batches.mapInArrow(ask, "shard int, batch long, body binary").groupBy("shard").applyInArrow(count, "batch long, shard int, body binary")


# ---- step 3: sorted runs


class Run:
    """A batch's sorted entries, by shard, and the members behind each."""

    def __init__(self, text: Text, shape: Shape, shards: int, replies: dict[int, bytes]):
        at, h = anchors(text.data, text.valid, shape)
        if len(at):
            names, counts = np.unique(h >> np.uint64(16), return_counts=True)
            shard = _by_shard(names, shards)
            order, keep = np.argsort(shard, kind="stable"), np.zeros(len(names), bool)
            bound = np.searchsorted(shard[order], np.arange(shards + 1))
            for s, bits in replies.items():
                if s >= 0:
                    keep[order[bound[s] : bound[s + 1]]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=bound[s + 1] - bound[s])
            stay = keep[np.searchsorted(names, h >> np.uint64(16))]
            at, h = at[stay], h[stay]
        n = len(at)
        rows = np.empty((n, shape.row), np.uint8)
        for i in range(0, n, 1 << 14):
            some = at[i : i + (1 << 14), None]
            rows[i : i + (1 << 14), : shape.length] = text.data[some + np.arange(shape.length)]
            rows[i : i + (1 << 14), shape.length :] = text.data[some - 1 - np.arange(shape.back)]
        shard = _by_shard(h, shards)
        keys = rows.view(f"S{shape.row}").ravel()
        order = np.argsort(keys, kind="stable")
        order = order[np.argsort(shard[order], kind="stable")]
        rows, self.shard, self.at = rows[order], shard[order], at[order]
        new = np.ones(n, bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1) | (self.shard[1:] != self.shard[:-1])
        self.entry = np.cumsum(new) - 1
        self.rows, self.entry_shard = rows[new], self.shard[new]
        where = text.place(self.at)
        least = np.lexsort((where[:, 2], where[:, 1], where[:, 0], self.entry))
        head = least[np.concatenate(([True], self.entry[least][1:] != self.entry[least][:-1]))] if n else least
        self.where, self.least = where, where[head]
        self.is_least = (where == self.least[self.entry]).all(1) if n else np.empty(0, bool)
        self.bound = np.searchsorted(self.entry_shard, np.arange(shards + 1))

    def prefix_lengths(self) -> np.ndarray:
        out = np.zeros(len(self.rows), np.uint8)
        if len(out) > 1:
            differ = self.rows[1:] != self.rows[:-1]
            out[1:] = np.where(differ.any(1), differ.argmax(1), self.rows.shape[1])
            out[self.bound[:-1][self.bound[:-1] < self.bound[1:]]] = 0
        return out


def front_code(rows: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The bytes of each row after its shared prefix, in a row."""
    return rows[np.arange(rows.shape[1]) >= shared[:, None]]


def front_decode(shared: np.ndarray, rest: np.ndarray, width: int):
    """The rows as byte strings, one after another."""
    raw, at, last = rest.tobytes(), 0, b""
    for k in shared.tolist():
        last = last[:k] + raw[at : at + width - k]
        at += width - k
        yield last


# ---- step 4: merge


class LoserTree:
    """Merges sorted runs of equally long byte strings, with their prefix lengths.

    Each waiting string is held with the length of its common prefix with the last winner of its
    match. Of two strings the one with the longer such prefix is smaller; only if both lengths are
    equal are bytes compared, from that length on.
    """

    def __init__(self, runs: list, width: int):
        """runs: iterators of (string, prefix length with the string before)."""
        self.runs, self.width = runs, width
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.head: list = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.loser = [0] * self.size
        self.compared = 0
        self.winner = self._play(1)

    def _less(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two leaves; sets the loser's prefix length with the winner."""
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.shared[a], self.shared[b]
        if p > q:
            return a, b
        if p < q:
            return b, a
        u, v = x[0][p:], y[0][p:]  # the known prefix is not looked at again
        if u == v:
            self.shared[b] = self.width
            return a, b
        k = 0
        while u[k : k + 16] == v[k : k + 16]:
            k += 16
        diff = int.from_bytes(some := u[k : k + 16]) ^ int.from_bytes(v[k : k + 16])
        k += len(some) - (diff.bit_length() + 7) // 8
        less, k = u[k] < v[k], k + p
        self.compared += k - p + 1
        if less:
            self.shared[b] = k
            return a, b
        self.shared[a] = k
        return b, a

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, lose = self._less(self._play(2 * node), self._play(2 * node + 1))
        self.loser[node] = lose
        return win

    def __iter__(self):
        """(run, string, prefix length with the last string) in order."""
        head, shared, loser, less, size, runs = self.head, self.shared, self.loser, self._less, self.size, self.runs
        win = self.winner
        while head[win] is not None:
            yield win, head[win][0], shared[win]
            head[win] = new = next(runs[win], None)
            if new is not None:
                shared[win] = new[1]
            node = (win + size) >> 1
            while node:
                other = loser[node]
                # the common cases in line; _less compares bytes
                if new is None or head[other] is None or shared[win] == shared[other]:
                    win, loser[node] = less(win, other)
                    new = head[win]
                elif shared[win] < shared[other]:
                    loser[node], win = win, other
                    new = head[win]
                node >>= 1


# ---- step 5: marks


def _first_marks(rows: np.ndarray, shared: np.ndarray, least: np.ndarray, shape: Shape) -> np.ndarray:
    """For sorted distinct rows with their first places, whether each window start o bytes back was seen earlier.

    shared: prefix lengths with the row before. Rows of different grams have shared < gram.
    """
    n, out = len(rows), np.zeros((len(rows), shape.back + 1), bool)
    if not n:
        return out
    rank = np.empty(n, np.int64)
    rank[np.lexsort((least[:, 2], least[:, 1], least[:, 0]))] = np.arange(n)
    left = np.zeros(n, np.uint64)
    for o in range(shape.back + 1):
        right = shape.length - o
        if o:
            left = (left + _TABLE[rows[:, shape.length + o - 1]]) * _STEPS[6]
            left ^= left >> np.uint64(31)
        fits = rows[:, right - 1] != PAD
        if o:
            fits &= rows[:, shape.length + o - 1] != PAD
        block = np.cumsum(shared < right)
        size = np.bincount(block, minlength=block[-1] + 1)
        i = np.flatnonzero(fits & (size[block] > 1))
        if not len(i):
            continue
        order = i[np.lexsort((rank[i], left[i], block[i]))]
        same = np.zeros(len(order), bool)
        same[1:] = (block[order][1:] == block[order][:-1]) & (left[order][1:] == left[order][:-1])
        if o and same.any():  # the hash only brings them together
            at = np.flatnonzero(same)
            side = slice(shape.length, shape.length + o)
            same[at] = (rows[order[at], side] == rows[order[at - 1], side]).all(1)
        out[order[same], o] = True
    return out


def merge_shard(t: pa.Table, shape: Shape) -> pa.Table:
    ids, opened = t["batch"].to_pylist(), []
    for data in t["body"].to_pylist():
        shared, rest, a, b, c = unpack(data)
        opened.append((shared, rest, np.stack((a, b, c), 1)))
    runs = [zip(front_decode(shared, rest, shape.row), shared.tolist(), strict=True) for shared, rest, _ in opened]
    strings, lengths, kind, source = [], [], [], []
    for run, string, k in LoserTree(runs, shape.row):
        if k < shape.row or not strings:
            strings.append(string)
            lengths.append(k)
        kind.append(len(strings) - 1)
        source.append(run)
    kind, source = np.array(kind, np.int64), np.array(source, np.int64)
    order = np.argsort(source, kind="stable")  # back to run by run, each in its own order
    kind = kind[order]
    places = np.concatenate([o[2] for o in opened])
    by = np.lexsort((places[:, 2], places[:, 1], places[:, 0], kind))
    head = by[np.concatenate(([True], kind[by][1:] != kind[by][:-1]))]
    least, shared = places[head], np.array(lengths, np.int64)
    first = (places == least[kind]).all(1)
    # grams with one kind of entry need no look at their windows
    gram = np.cumsum(shared < shape.gram)
    many = np.flatnonzero(np.bincount(gram)[gram] > 1)
    rows = np.frombuffer(b"".join([strings[i] for i in many]), np.uint8).reshape(-1, shape.row)
    marks = np.zeros((len(strings), shape.back + 1), bool)
    marks[many] = _first_marks(rows, shared[many], least[many], shape)
    bodies, at = [], 0
    for _, _, p in opened:
        mine, own = slice(at, at + len(p)), first[at : at + len(p)]
        lost = marks[kind[mine]] & own[:, None]
        some = np.flatnonzero(lost.any(1))
        bodies.append(pack(np.packbits(own), some.astype(np.uint32), np.packbits(lost[some], axis=1).ravel()))
        at += len(p)
    return pa.table({"batch": pa.array(ids, pa.int64()), "shard": t["shard"], "body": pa.array(bodies, pa.binary())})


# ---- all together


def find_spans(text: Text, run: Run, replies: dict[int, bytes], shape: Shape) -> np.ndarray:
    """Which bytes of the buffer go."""
    change = np.zeros(len(text.data) + 1, np.int32)
    entry_first = np.zeros(len(run.rows), bool)
    lost = np.zeros((len(run.rows), shape.back + 1), bool)
    for s, data in replies.items():
        if s < 0:
            continue
        own, some, bits = unpack(data)
        lo, hi = run.bound[s], run.bound[s + 1]
        entry_first[lo:hi] = np.unpackbits(own, count=hi - lo)
        if len(some):
            lost[lo + some] = np.unpackbits(bits.reshape(len(some), -1), axis=1, count=shape.back + 1)
    d = np.searchsorted(text.starts, run.at, side="right") - 1
    start, end = text.starts[d], text.starts[d] + text.sizes[d]
    least_back, most_back = np.maximum(0, shape.length - (end - run.at)), np.minimum(shape.back, run.at - start)
    whole = ~(entry_first[run.entry] & run.is_least) & (least_back <= most_back)
    np.add.at(change, (run.at - most_back)[whole], 1)
    np.add.at(change, (run.at - least_back)[whole] + shape.length, -1)
    single = np.flatnonzero(~whole & lost[run.entry].any(1))
    i, o = np.nonzero(lost[run.entry[single]])
    np.add.at(change, run.at[single[i]] - o, 1)
    np.add.at(change, run.at[single[i]] - o + shape.length, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone without the characters that it holds only in part."""
    lead = (data & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    stays = np.zeros(int(char[-1]) + 1 if len(char) else 0, bool)
    stays[char[~gone]] = True
    return gone & ~stays[char]


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, carry: list[str] | None = None, text: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row, then the columns in `carry`.

    text: the name of a last column for what is left as text. Characters that are removed only in part stay in it whole.
    """
    shape, carry = Shape(length, gram), carry or []
    batches = stored(make_batches(docs, batch_bytes, carry))
    total = batches.select(F.octet_length("body").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    alone = stored(repeated_anchors(batches.select("batch", "body"), shape, shards))
    own = batches.select("batch", F.lit(-1).alias("shard"), "body")
    whole = batches.select("batch", F.lit(-1).alias("shard"), "body", "rest")

    def send(t: pa.Table) -> pa.Table:
        by = dict(zip(t["shard"].to_pylist(), t["body"].to_pylist(), strict=True))
        run = Run(Text(by.pop(-1), shape), shape, shards, by)
        shared, some, bodies = run.prefix_lengths(), [], []
        for s in np.flatnonzero(np.diff(run.bound)).tolist():
            lo, hi = run.bound[s], run.bound[s + 1]
            some.append(s)
            bodies.append(pack(shared[lo:hi], front_code(run.rows[lo:hi], shared[lo:hi]), *run.least[lo:hi].T.copy()))
        tidy()
        return pa.table({"shard": pa.array(some, pa.int32()), "batch": pa.array([t["batch"][0].as_py()] * len(some), pa.int64()), "body": pa.array(bodies, pa.binary())})

    runs = own.union(alone).groupBy("batch").applyInArrow(send, "shard int, batch long, body binary")
    def merge(t: pa.Table) -> pa.Table:
        out = merge_shard(t, shape)
        tidy()
        return out

    marks = runs.groupBy("shard").applyInArrow(merge, "batch long, shard int, body binary")
    none = F.lit(None).cast("binary").alias("rest")
    answers = alone.withColumn("shard", F.col("shard") * 2).union(marks.withColumn("shard", F.col("shard") * 2 + 1)).select("batch", "shard", "body", none)

    def finish(t: pa.Table) -> pa.Table:
        by = dict(zip(t["shard"].to_pylist(), t["body"].to_pylist(), strict=True))
        rest = pa.ipc.open_stream(next(x for x in t["rest"].to_pylist() if x is not None)).read_all()
        texts = Text(by.pop(-1), shape)
        run = Run(texts, shape, shards, {s // 2: v for s, v in by.items() if s % 2 == 0})
        gone = find_spans(texts, run, {s // 2: v for s, v in by.items() if s % 2}, shape)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * (text is not None)
        out: dict[str, list] = {k: [] for k in names}
        del run, by
        edges = np.diff(gone.astype(np.int8), prepend=0) == 1
        for i, null, start, size in zip(texts.ids.tolist(), texts.null.tolist(), texts.starts.tolist(), texts.sizes.tolist(), strict=True):
            data, g = texts.data[start : start + size], gone[start : start + size]
            removed = int(np.count_nonzero(g))
            row = [None if null else i, size, removed, int(np.count_nonzero(edges[start : start + size])), hashlib.sha256(data[~g]).hexdigest()]
            if text is not None:
                row.append((data[~whole_characters(data, g)] if removed else data).tobytes().decode("utf-8", "replace"))
            for k, v in zip(names, row, strict=True):
                out[k].append(v)
        del texts, gone, edges
        tidy()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        columns = [pa.array(out[k], kind) for k, kind in zip(names, kinds, strict=False)]
        return pa.table([*columns[:5], *rest.columns, *columns[5:]], names=[f"o{n}" for n in range(len(columns) + rest.num_columns)])

    kinds = ["long", "long", "long", "long", "string", *(docs.schema[c].dataType.simpleString() for c in carry), *["string"] * (text is not None)]
    found = whole.union(answers).groupBy("batch").applyInArrow(finish, ", ".join(f"o{n} {k}" for n, k in enumerate(kinds)))
    return found.toDF("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *carry, *([text] if text is not None else []))
