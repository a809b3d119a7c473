import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import packing, tokens, wavelet
from quillon.llm.common import scratch

KINDS = [(tokens.BYTE_BPE, "byte"), (tokens.WORD_BPE, "word")]
TEXTS = ["", " ", "  a  b", "a\n b \n\nc  ", "x\x1cy z", "it's  <|endoftext|> x", "Σας ΟΔΟΣ a b é ́x", " lead", "trail ", "\t\ta b", "日本 語 text 😀 x", "end. of; it!? 3.14 ... !!", "don't we'll 'tis", "a.\nB c,\nd\n", "a\nb\n\nc\n\n\nd e", "$$ a$$$ b\n$$$ c&&\nd", "a\u00a0b\x85c\u2003d", "İstanbul DŽ ǅ", "x\ny\nz"]


def split(enc, texts):
    ids, counts = enc.encode(texts)
    with_end, more = enc.encode(texts, end=7)
    assert (more == counts + 1).all()
    ends = np.cumsum(more)
    assert (with_end[ends - 1] == 7).all() and np.delete(with_end, ends - 1).tolist() == ids.tolist()
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


@pytest.mark.parametrize(("name", "kind"), KINDS)
def test_encoding_is_the_librarys(documents, name, kind):
    enc = tokens.UnitEncoder(name, kind, 10**6)
    texts = TEXTS + [r["text"] for r in documents.collect()]
    for again in range(2):  # from the library, then from the cache
        for text, ids in zip(texts, split(enc, texts), strict=True):
            assert ids == enc.tokenizer.encode(text, add_special_tokens=False).ids, (again, text[:60])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB.,!'\n \té3_|<日$-\u00a0\x85", max_size=25), max_size=4))
def test_any_text_encodes_alike(texts):
    for name, kind in KINDS:
        enc = tokens.encoder(name, kind)
        for text, ids in zip(texts, split(enc, texts), strict=True):
            assert ids == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_starts_afresh():
    enc = tokens.UnitEncoder(tokens.WORD_BPE, "word", room=3)
    for t in ("a b c d e", "f g h", "a"):
        assert split(enc, [t])[0] == enc.tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=1500).flatmap(lambda x: st.just(np.array(x, np.uint16))))
def test_wavelet_matrix(ids):
    shard = wavelet.ShardFile(wavelet.pack_file([None, 5], np.array([0, len(ids)]), ids))
    m = shard.matrix
    assert shard.doc_ids == [None, 5] and shard.lengths.tolist() == [0, len(ids)] and shard.end_id == 2
    assert m.decode().tolist() == ids.tolist()
    for i in range(0, len(ids), max(1, len(ids) // 20)):
        token = int(ids[i])
        assert m.access(i) == token
        k = m.rank(token, i)
        assert k == int((ids[:i] == token).sum()) and m.select(token, k) == i
        assert m.count(token) == int((ids == token).sum())
    assert m.count(70000) == 0
    with pytest.raises(IndexError):
        m.access(len(ids))


def test_access_unpacks_one_chunk_a_level():
    ids = np.random.default_rng(1).zipf(1.3, 300_000).clip(0, 50_000).astype(np.uint16)
    data = wavelet.pack_file([1], np.array([len(ids)]), ids)
    assert len(data) < 2 * len(ids)
    shard = wavelet.ShardFile(data)
    m = shard.matrix
    assert shard.unpacked == 0 and m.access(123_456) == ids[123_456]
    assert shard.unpacked <= 2 * m.levels < m.levels * m.before.shape[1] / 2
    shard = wavelet.ShardFile(data)
    token = int(ids[200_000])
    assert shard.matrix.count(token) == int((ids == token).sum()) and shard.unpacked <= 2 * m.levels
    for i in (0, 32_767, 32_768, 200_000, 299_999):
        k = int((ids[:i] == ids[i]).sum())
        assert m.rank(int(ids[i]), i) == k and m.select(int(ids[i]), k) == i
    assert m.decode().tolist() == ids.tolist()


def first_fit_free(lengths, capacity):
    """Room left in each bin by best-fit decreasing, done plainly."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= n]
        if fits:
            best = min(fits, key=lambda b: bins[b])
            bins[best] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=150))))
def test_histogram_packs_as_best_fit_decreasing(case):
    capacity, lengths = case
    segments, n = packing.pack_histogram(Counter(lengths), capacity)
    bins, ranks = {}, {}
    for length, rank, count, first, each, offset in segments.tolist():
        for i in range(count):
            bins.setdefault(first + i // each, []).append((offset + i % each * length, length))
            ranks.setdefault(length, []).append(rank + i)
    assert all(sorted(r) == list(range(Counter(lengths)[k])) for k, r in ranks.items()) and sum(map(len, ranks.values())) == len(lengths)
    for pieces in bins.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
    assert len(bins) == n and sorted(capacity - sum(x for _, x in b) for b in bins.values()) == first_fit_free(lengths, capacity)


def test_segment_tree():
    tree = packing.SegmentTree(11)
    assert tree.least_from(0) is None
    for p in (3, 7, 10):
        tree.add(p, 2)
    assert [tree.least_from(p) for p in range(12)] == [3, 3, 3, 3, 7, 7, 7, 7, 10, 10, 10, None]
    tree.add(7, -2)
    assert tree.least_from(4) == 10


def test_length_outside_the_sequence_is_refused():
    with pytest.raises(ValueError, match="not in 1"):
        packing.pack_histogram({5: 1}, 4)


def check_packing(rows, capacity):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in seqs.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= capacity
    assert len(seqs) == len(first_fit_free([r["length"] for r in rows], capacity))


def test_packing_of_documents(spark, odd_documents, no_documents):
    got = packing.pack_documents(odd_documents.repartition(3), capacity=64, with_ids=True).collect()
    check_packing(got, 64)
    enc = tokens.encoder(tokens.WORD_BPE, "word")
    want = Counter((r["doc_id"], tuple(enc.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)) for r in odd_documents.collect())
    by = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == r["length"] and zlib.crc32(ids.astype("<u4")) == r["ids_crc32"]
        by.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], ids))
    for (doc, piece), parts in by.items():
        assert all(start == piece * 64 for start, _ in parts)
    total = sum(n * len(ids) for (_, ids), n in want.items())
    assert sum(r["length"] for r in got) == total
    assert packing.pack_documents(no_documents).count() == 0


def test_wavelet_files(spark, odd_documents, no_documents):
    path = scratch(spark, "test-op4")
    wavelet.write_shards(odd_documents.repartition(3), path, file_tokens=40)
    got = sorted(wavelet.read_shards(spark, path).collect(), key=lambda r: r["start"])
    enc = tokens.encoder(tokens.BYTE_BPE, "byte")
    order = {(r["doc_id"], r["text"] or ""): r["h"] for r in odd_documents.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as h").collect()}
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd_documents.collect()), key=lambda r: (r[0], r[1], order[(r[1] if r[0] else None, r[2])]))
    assert len(got) == len(rows)
    start = 0
    for r, (known, doc, text) in zip(got, rows, strict=True):
        ids = np.array([*enc.tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc if known else None, start, len(ids), zlib.crc32(ids))
        start += len(ids)
    empty = scratch(spark, "test-op4")
    wavelet.write_shards(no_documents, empty)
    assert wavelet.read_shards(spark, empty).count() == 0
