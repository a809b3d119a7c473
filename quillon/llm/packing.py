"""Best-fit decreasing packing of documents into sequences, with a segment tree.

Best-fit decreasing takes pieces in order of falling length and puts each where it fits tightest.
Which pieces of one length come first makes no difference to the bins, so the histogram of lengths
fixes the whole packing, and it has at most `capacity` entries whatever the corpus holds. The driver
packs that histogram: bins of equal remaining capacity are runs, a segment tree over remaining
capacities finds the tightest in logarithmic time, and runs of pieces fill runs of bins at once.
The result is a list of segments (length, first rank, count, first bin, pieces a bin, offset), whose
number depends on the distinct lengths alone. Executors then rank the pieces within each length and look up
their segment: the packing is the global one, and no task holds more than its own pieces.

Defined cases: a null or empty text is its end id alone; repeated rows are packed once each; null
doc_ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import tokens
from quillon.llm.common import lean, stored, text_or_empty, tidy

CAPACITY = 4096
END_ID = 1
ROOM = 500_000  #: units in each generation of a worker's cache
SLICE = 4_000_000  #: characters encoded in one call, but for longer texts


class SegmentTree:
    """Counts at places 0..size-1; finds the least place at or above a bound that holds any."""

    def __init__(self, size: int):
        self.width = 1 << max(1, (size - 1).bit_length())
        self.sums = [0] * (2 * self.width)

    def add(self, place: int, n: int) -> None:
        at = place + self.width
        while at:
            self.sums[at] += n
            at >>= 1

    def least_from(self, place: int) -> int | None:
        at = place + self.width
        if at >= 2 * self.width:
            return None
        if self.sums[at]:
            return place
        while at > 1:  # up to the first ancestor with something to its right
            if not at & 1 and self.sums[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.width:
            at = 2 * at if self.sums[2 * at] else 2 * at + 1
        return at - self.width


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(segments, bins). A segment: length, first rank, count, first bin, pieces in each bin, offset."""
    tree, runs = SegmentTree(capacity + 1), [[] for _ in range(capacity + 1)]
    segments, bins = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if runs[room] and runs[room][-1][0] + runs[room][-1][1] == first:
                runs[room][-1][1] += n
            else:
                runs[room].append([first, n])
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.least_from(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                segments.append((length, rank, full * each, first, each, capacity - room))
                leave(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                segments.append((length, rank, left, first + full, left, capacity - room))
                leave(room - left * length, first + full, 1)
                left, full = 0, full + 1
            leave(room, first + full, n - full)
    return np.array(segments, np.int64).reshape(-1, 6), bins


def token_pieces(docs: DataFrame, vocabulary: str = tokens.WORD_BPE, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]), ids as little-endian unsigned 16-bit numbers."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        fields, schema = [*fields, ("ids", pa.binary())], f"{schema}, ids binary"

    def cut(batches):
        enc = tokens.encoder(vocabulary, "word", room)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in tokens.in_slices(texts, SLICE):
                rows: list[list] = [[] for _ in fields]
                every, counts = enc.encode(some, end_id)
                for i, ids in enumerate(np.split(every, np.cumsum(counts)[:-1])):
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        row = (doc_ids[at + i], piece, start, len(part), zlib.crc32(part.astype("<u4")), part.tobytes())
                        for column, value in zip(rows, row, strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(rows, fields, strict=True)], names=[n for n, _ in fields])
        tidy("tokens")

    return lean(docs).select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: the best-fit decreasing packing of all of them."""
    pieces = stored(pieces.withColumn("_batch", F.spark_partition_id()))
    by_batch = pieces.groupBy("length", "_batch").agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in by_batch.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    segments, _ = pack_histogram(counts, capacity)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    plan = pieces.sparkSession.sparkContext.broadcast(segments)

    before = Window.partitionBy("length").orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_batch.select("length", "_batch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_batch").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_batch"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_batch")
    kept = [c for c in ranked.columns if c != "_rank"]

    def assign(batches):
        table = plan.value
        keys = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            s = table[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
            i = rank - s[:, 1]
            columns = [*(batch.column(c) for c in kept), pa.array(s[:, 3] + i // s[:, 4]), pa.array(s[:, 5] + i % s[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    return ranked.mapInArrow(assign, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = tokens.WORD_BPE, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, room: int = ROOM) -> DataFrame:
    return pack(token_pieces(docs, vocabulary, end_id, capacity, with_ids, room), capacity)
