"""Token-id output: one wavelet matrix per shard file.

Documents are range-partitioned by doc_id and sorted, encoded, and written as shard files, each a
row of a Parquet table in the shared folder: the shard's place (part, seq), its first token's place
within the part, and the file's bytes. A file has fixed places for its parts: a head, an entry for each
chunk of each bit-plane (where it lies, ones before it), rank directories (ones before each `BLOCK` bits of
a chunk), the chunks, each compressed by itself, and the doc ids, token counts and alphabet. Token access,
counting and occurrence lookup read the entries and the one or two chunks a level that they pass
through; nothing else is unpacked. There are as many
bit-planes as the shard's alphabet needs.

Defined cases: a null or empty text holds the end id alone; null doc_ids come first; rows with one
doc_id are in a fixed order by a hash of the text, and are divided among tasks like any others; an
empty table gives no files; other columns are ignored. A document is never divided between files, so
a file holds `file_tokens` ids or one longer document.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import tokens
from quillon.llm.common import broadcast_if, lean, partition_offsets, text_or_empty, tidy

MAGIC = b"QWM2"
END_ID = 2
BLOCK = 512  #: bits for each entry of a rank directory
CHUNK = 1 << 15  #: bits of a plane that are compressed together
ROOM = 600_000  #: units in each generation of a worker's cache
SLICE = 12_000_000  #: characters encoded in one call, but for longer texts
FILE_TOKENS = 1 << 18  #: its levels fit a core's cache


def _sections(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(plane padded to whole chunks, ones before each chunk, ones in the chunk before each block) of a row of bits."""
    plane = np.zeros(-(-max(len(bits), 1) // CHUNK) * (CHUNK // 8), np.uint8)
    packed = np.packbits(bits, bitorder="little")
    plane[: len(packed)] = packed
    counts = np.bitwise_count(plane.view(np.uint64)).reshape(-1, CHUNK // BLOCK, BLOCK // 64).sum(2, dtype=np.int64)
    upto = np.cumsum(counts, axis=1)
    chunk = np.cumsum(upto[:, -1])
    return plane, chunk - upto[:, -1], (upto - counts).astype("<u2")


class WaveletMatrix:
    """Rank, select and access over ids held as bit-planes, most significant bit first.

    chunk(level, c) gives the bytes of a plane's chunk; before[level, c] the ones before it; ranks[level, c] those inside it before each block.
    """

    def __init__(self, n: int, alphabet: np.ndarray, chunk, before: np.ndarray, ranks: np.ndarray, zeros: list[int]):
        self.n, self.alphabet, self.chunk, self.before, self.ranks, self.zeros = n, alphabet, chunk, before, ranks, zeros
        self.levels = len(zeros)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.zeros(1 << 16, bool)
        seen[ids] = True
        alphabet = np.flatnonzero(seen).astype(np.uint16)
        code = np.zeros(1 << 16, np.uint16)
        code[alphabet] = np.arange(len(alphabet), dtype=np.uint16)
        x, made, zeros = code[ids], [], []
        for level in range(max(1, (max(len(alphabet), 1) - 1).bit_length()) - 1, -1, -1):
            bit = (x & np.uint16(1 << level)) != 0
            made.append(_sections(bit))
            ones, rest = np.flatnonzero(bit), np.flatnonzero(~bit)
            zeros.append(len(rest))
            x = np.concatenate((x[rest], x[ones]))
        planes = [m[0].reshape(-1, CHUNK // 8) for m in made]
        return cls(len(ids), alphabet, lambda level, c: planes[level][c], np.stack([m[1] for m in made]), np.stack([m[2] for m in made]), zeros)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i."""
        c, at = divmod(i, CHUNK)
        if c == self.before.shape[1]:
            return self.n - self.zeros[level]
        block, out = at // BLOCK, int(self.before[level, c])
        out += int(self.ranks[level, c, block])
        if at % BLOCK:
            chunk = self.chunk(level, c)
            out += int(np.bitwise_count(chunk[block * (BLOCK // 8) : at // 8]).sum())
            if at % 8:
                out += int(chunk[at // 8] & ((1 << (at % 8)) - 1)).bit_count()
        return out

    def _bit(self, level: int, i: int) -> int:
        return int(self.chunk(level, i // CHUNK)[i % CHUNK // 8] >> (i % 8)) & 1

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            code = code << 1 | bit
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[code])

    def _range(self, code: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if code >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often the token stands before place i."""
        if (code := self._code(token)) is None:
            return 0
        lo, hi = self._range(code, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _find(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of this kind."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        if (code := self._code(token)) is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(code, 0)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = code >> (self.levels - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids: each level's stable split is undone, last level first."""
        y = np.zeros(self.n, np.uint16)
        for level in range(self.levels - 1, -1, -1):
            plane = np.concatenate([self.chunk(level, c) for c in range(self.before.shape[1])])
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            z, out = self.zeros[level], np.empty(self.n, np.uint16)
            out[np.flatnonzero(~bit)] = y[:z]
            out[np.flatnonzero(bit)] = y[z:] | np.uint16(1 << (self.levels - 1 - level))
            y = out
        return self.alphabet[y] if self.n else y


_HEAD = struct.Struct("<4sqqiiqqqH")


def pack_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, end_id: int = END_ID) -> bytes:
    import zstandard

    matrix, zstd = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1)
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    docs, alphabet = zstd.compress(null.tobytes() + known.tobytes() + lengths.astype("<i8").tobytes()), zstd.compress(matrix.alphabet.astype("<u2").tobytes())
    count = matrix.before.shape[1]
    chunks = [zstd.compress(matrix.chunk(level, c).tobytes()) for level in range(matrix.levels) for c in range(count)]
    places = np.concatenate(([0], np.cumsum([len(x) for x in chunks]))).astype("<u4")
    body = np.array(matrix.zeros, "<i8").tobytes() + matrix.before.astype("<i8").tobytes() + places.tobytes() + matrix.ranks.astype("<u2").tobytes()
    return _HEAD.pack(MAGIC, len(doc_ids), matrix.n, matrix.levels, count, len(body), int(places[-1]), len(docs), end_id) + body + b"".join(chunks) + docs + alphabet


class ShardFile:
    """A shard file in memory or mapped: its parts are found by place and unpacked when they are asked for."""

    def __init__(self, data: bytes):
        import zstandard

        magic, self.count, n, levels, chunks, body, planes, docs, self.end_id = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard file")
        self.unpacked, self.cache = 0, {}
        unpack, view = zstandard.ZstdDecompressor().decompress, memoryview(data)
        at = _HEAD.size
        zeros = np.frombuffer(data, "<i8", levels, at).tolist()
        before = np.frombuffer(data, "<i8", levels * chunks, at + 8 * levels).reshape(levels, chunks)
        at += 8 * levels * (1 + chunks)
        places = np.frombuffer(data, "<u4", levels * chunks + 1, at)
        ranks = np.frombuffer(data, "<u2", levels * chunks * (CHUNK // BLOCK), at + 4 * len(places)).reshape(levels, chunks, -1)
        start = _HEAD.size + body
        self._docs, self._alphabet = view[start + planes : start + planes + docs], view[start + planes + docs :]
        self._unpack = unpack

        def chunk(level: int, c: int) -> np.ndarray:
            key = level * chunks + c
            if key not in self.cache:
                self.unpacked += 1
                self.cache[key] = np.frombuffer(unpack(view[start + int(places[key]) : start + int(places[key + 1])]), np.uint8)
            return self.cache[key]

        self._matrix = n, chunk, before, ranks, zeros

    @cached_property
    def matrix(self) -> WaveletMatrix:
        n, *rest = self._matrix
        return WaveletMatrix(n, np.frombuffer(self._unpack(self._alphabet), "<u2"), *rest)

    @cached_property
    def _both(self) -> tuple[list, np.ndarray]:
        raw = self._unpack(self._docs)
        null, known = np.frombuffer(raw, np.uint8, self.count), np.frombuffer(raw, "<i8", self.count, self.count)
        return [None if gone else int(d) for gone, d in zip(null, known, strict=True)], np.frombuffer(raw, "<i8", self.count, 9 * self.count)

    @property
    def doc_ids(self) -> list:
        return self._both[0]

    @property
    def lengths(self) -> np.ndarray:
        return self._both[1]


def write_shards(docs: DataFrame, path: str, vocabulary: str = tokens.BYTE_BPE, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> None:
    """Writes shard files in ascending doc_id order under path."""

    def encode(batches):
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        enc = tokens.encoder(vocabulary, "byte", ROOM)
        doc_ids: list = []
        parts: list[np.ndarray] = []
        held = 0

        def file() -> pa.RecordBatch:
            nonlocal doc_ids, parts, held, seq, start
            blob = pack_file(doc_ids, np.array([len(p) for p in parts], np.int64), np.concatenate(parts), end_id)
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "start_in_part": [start], "n_tokens": [held], "file": [blob]}, pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())]))
            seq, start, doc_ids, parts, held = seq + 1, start + held, [], [], 0
            return row

        for ids, texts in tokens.gathered(batches, SLICE):
            for at, some in tokens.in_slices(texts, SLICE):
                every, counts = enc.encode(some, end_id)
                for i, code in enumerate(np.split(every, np.cumsum(counts)[:-1])):
                    doc_ids.append(ids[at + i])
                    parts.append(code)
                    held += len(code)
                    if held >= file_tokens:
                        yield file()
        if parts:
            yield file()
        tidy("tokens")

    # rows with one doc_id go to several tasks: the hash, then the place they come from, tells them apart
    order = ["doc_id", "_hash", "_place"]
    rows = lean(docs).select("doc_id", text_or_empty().alias("text")).withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(encode, "part long, seq long, start_in_part long, n_tokens long, file binary").write.option("compression", "none").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document, decoded from the shard files.

    Each file's last document is checked to end in the end id, by access through the wavelet matrix.
    """
    files = spark.read.parquet(path)
    parts = files.select("part").agg(F.count_distinct("part")).first()[0]
    offsets, _ = partition_offsets(files.select("part", "n_tokens"), "part", F.sum("n_tokens"))

    def decode(batches):
        for batch in batches:
            for part, start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = ShardFile(data.as_py())
                if shard.matrix.n and shard.matrix.access(shard.matrix.n - 1) != shard.end_id:
                    raise ValueError(f"shard file {part}, {start} does not end in the end id")
                ends = np.cumsum(shard.lengths)
                ids = shard.matrix.decode().astype("<u4")
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), shard.lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ends), pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(start + ends - shard.lengths), pa.array(shard.lengths), pa.array(crc, pa.int64())], names=["part", "doc_id", "in_part", "n_tokens", "ids_crc32"])

    decoded = files.select("part", "start_in_part", "file").mapInArrow(decode, "part long, doc_id long, in_part long, n_tokens long, ids_crc32 long")
    return decoded.join(broadcast_if(offsets, parts, 16), "part").select("doc_id", (F.col("in_part") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32")
