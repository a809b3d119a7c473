"""Exact, cached encoding with public tokenizers.

A text is cut only where neither vocabulary can join what stands on the two sides, so the ids of a
text are the ids of its units in a row. Arrow cuts the texts and numbers their distinct units, so Python
sees each unit of a call once. Most are words seen before; the others are encoded by the tokenizers
library, thousands in one call.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.llm.common import memory

#: Files of the public_tokenizers package.
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
SEPARATOR = "<|endoftext|>"

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space but for space and line feed.
_RARE = ["\t", "\r", "\x0b", "\x0c", *map(chr, range(0x1C, 0x20))], [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Outside these, normal forms and letter case need the whole text; so do the controls that some call white space.
_FAR = re.compile(r"[^\x00-\x1b\x20-\u024f]")
#: Marks that stand apart, as one run, from the letter or digit before them in both vocabularies.
STOPS = '.,;:!?$%&*#@()[]{}"_+=/|~^-'
#: What the word vocabulary's file cuts at (a fixed value of that file).
_WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name_or_path: str) -> str:
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def as_list(strings: pa.Array) -> list[str]:
    """As to_pylist(), without a scalar object for each."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class UnitEncoder:
    """Encodes texts to little-endian unsigned 16-bit ids, without special tokens of its own.

    kind "byte": a unit starts at each single space between two other characters; in the ids of units
    in a row, a token that starts with a space starts a unit. kind "word": units lie between white
    space; each part of a unit ends in one word-end token. The cache has two generations of about
    `room` units: when the new one is full it becomes the old one, and the old one goes.
    """

    def __init__(self, name_or_path: str, kind: str, room: int, call: int = 4096):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name_or_path))
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids over 65535 don't fit 16 bits")
        self.kind, self.room, self.call = kind, room, call
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.mark = np.array([n.startswith("\u0120") if kind == "byte" else n.endswith("</w>") for n in names])
        self.mark_line = np.array([n.startswith("\u010a") for n in names])
        self.tails: dict[str, bytes] = {"": b""}
        self.parts = regex.compile(_WORD_PARTS)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _lists(self, texts: list[str]) -> tuple[pa.ListArray, list[int]]:
        """The units of each text, and the texts that go to the library whole, which have none here."""
        whole = [i for i, t in enumerate(texts) if SEPARATOR[:2] in t or self.kind == "word" and _FAR.search(t)]
        gone = set(whole)
        if self.kind == "word":
            lists = pc.utf8_split_whitespace(pa.array(["" if i in gone else t.lower() for i, t in enumerate(texts)], pa.string()))
            some = lists.flatten()
            there = np.asarray(pc.binary_length(some)) > 0
            sizes = np.bincount(np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[there], minlength=len(texts))
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), some.filter(pa.array(there))), whole
        plain, odd = [], []
        for i, t in enumerate(texts):
            if i in gone or not t:
                odd.append(i)
            elif "  " in t or " \n" in t or "\n " in t or t[0] in " \n" or t[-1] in " \n" or any(c in t for c in _RARE[0]) or not (t.isascii() or not any(c in t for c in _RARE[1])):
                odd.append(i)
            else:
                plain.append(i)
        # a line feed between two words is a piece of its own
        lined = [t if "\n" not in t or "\n\n" in t else t.replace("\n", " \n") for t in (texts[i] for i in plain)]
        lists = [pc.split_pattern(pa.array(lined, pa.string()), " ")]
        if not odd:
            return lists[0], whole
        lists.append(pa.array([[] if i in gone else _CUT.split(texts[i]) for i in odd], pa.list_(pa.string())))
        order = np.empty(len(texts), np.int64)
        order[plain + odd] = np.arange(len(texts))
        return pa.concat_arrays(lists).take(pa.array(order)), whole

    def _ends(self, some: list[str], ids: np.ndarray, lead: str, alone: bool) -> list[int] | None:
        """Where each unit's ids end, if the marks agree with the number of units; alone: each is one run of letters."""
        marks = np.flatnonzero((self.mark if lead == " " else self.mark_line)[ids])
        if self.kind == "byte":
            return [*marks[1:].tolist(), len(ids)] if len(marks) == len(some) and marks[0] == 0 else None
        parts = np.arange(1, len(some) + 1) if alone else np.cumsum([len(self.parts.findall(u)) for u in some])
        return (marks[parts - 1] + 1).tolist() if len(marks) == parts[-1] else None

    def _encode_row(self, units: list[str], lead: str, alone: bool = False) -> None:
        """Learns units that hold no white space, each with this lead before it, under unit or line feed and unit."""
        key = "" if lead == " " or self.kind == "word" else lead
        for i in range(0, len(units), self.call):
            some = units[i : i + self.call]
            ids = np.array(self.tokenizer.encode_batch_fast([lead + lead.join(some)], add_special_tokens=False)[0].ids, "<u2")
            ends = self._ends(some, ids, lead, alone)
            if ends is None:
                self.cache.update((key + u, self._plain(lead + u)) for u in some)
                continue
            raw, last = ids.tobytes(), [2 * e for e in ends]
            names = [key + u for u in some] if key else some
            self.cache.update(zip(names, [raw[x:y] for x, y in zip([0, *last[:-1]], last, strict=True)], strict=True))

    def _recall(self, units) -> list[str]:
        """The units that are not known, after those of the older generation have moved to the new one."""
        new = [u for u in units if u not in self.cache]
        if self.old:
            self.cache.update((u, self.old[u]) for u in new if u in self.old)
            new = [u for u in new if u not in self.old]
        return new

    def _learn(self, units: list[str]) -> None:
        """Learns units from their parts: a run of letters and the stops after it, or else lines within a unit."""
        known, odd = self.cache, []
        lined = [u for u in units if u[:1] == "\n"]
        for lead, some in ((" ", units if not lined else [u for u in units if u[:1] != "\n"]), ("\n", lined)):
            skip = lead == "\n"
            bases = [u.rstrip(STOPS) for u in some]
            fine = [b[skip:].isalpha() for b in bases] if skip else list(map(str.isalpha, bases))
            rows = [u for u, b, ok in zip(some, bases, fine, strict=True) if ok and len(b) == len(u)]
            self._encode_row([u[1:] for u in rows] if skip else rows, lead, True)
            ended = [(u, b) for u, b, ok in zip(some, bases, fine, strict=True) if ok and len(b) < len(u)]
            rows = self._recall(dict.fromkeys([b for _, b in ended]))
            self._encode_row([u[1:] for u in rows] if skip else rows, lead, True)
            known.update([(u, known[b] + self._stops(u[len(b) :])) for u, b in ended])
            odd += [u for u, ok in zip(some, fine, strict=True) if not ok]
        rows, built = {" ": {}, "\n": {}}, []
        for u in odd:
            lines = u.split("\n") if "\n" in u else (u,)
            parts = []
            for n, line in enumerate(lines):
                base = line.rstrip(STOPS)
                if n == 0 and not line and len(lines) > 1:
                    continue  # the unit starts with a line feed
                if not base or not base[-1].isalnum() or len(line.split()) != 1 or line[0].isspace():
                    parts = None
                    break
                parts.append((base if not n else "\n" + base, line[len(base) :]))
                rows["\n" if n else " "][base] = None
            if parts:
                built.append((u, parts))
            elif len(u.split()) == 1 and not u[0].isspace() and not u[-1].isspace():
                rows[" "][u] = None
            else:
                known[u] = self._plain(u if self.kind == "word" or u.startswith("\n") else " " + u)
        self._encode_row(self._recall(rows[" "]), " ")
        self._encode_row([u[1:] for u in self._recall("\n" + u for u in rows["\n"])], "\n")
        for u, parts in built:
            known[u] = b"".join([x for base, stops in parts for x in (known[base], self._stops(stops))])

    def _stops(self, stops: str) -> bytes:
        if stops not in self.tails:
            if len(self.tails) > self.room:
                self.tails = {"": b""}
            self.tails[stops] = self._plain(stops)
        return self.tails[stops]

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row, how many each has); each text's ids are followed by end, if given."""
        if len(self.cache) > self.room:
            self.old, self.cache = self.cache, {}
        lists, whole = self._lists(texts)
        sizes, units = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten()
        first = np.zeros(len(units), bool)
        if self.kind == "byte":  # no space stands before a text's first unit
            first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        coded = units.filter(pa.array(~first)).dictionary_encode()
        names = as_list(coded.dictionary)
        codes = list(map(self.cache.get, names))
        holes = [i for i, c in enumerate(codes) if c is None]
        self._learn(self._recall([names[i] for i in holes]))
        for i in holes:
            codes[i] = self.cache[names[i]]
        heads = as_list(units.filter(pa.array(first)))
        codes += [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)] if heads else []
        codes += [self._plain(texts[i]) for i in whole]
        codes.append(b"" if end is None else np.array([end], "<u2").tobytes())
        # each text's slots: its units, or itself whole, then the end
        last = np.ones(len(texts), np.int64)
        last[whole] += 1
        ends = np.cumsum(sizes + last)
        slot = np.full(int(ends[-1]) if len(ends) else 0, len(codes) - 1)
        at = np.arange(len(units)) + np.repeat(np.cumsum(last) - last, sizes)
        slot[at[~first]] = coded.indices.to_numpy()
        slot[at[first]] = len(names) + np.arange(len(heads))
        slot[ends[whole] - 2] = len(names) + len(heads) + np.arange(len(whole))
        flat = np.frombuffer(b"".join(codes), "<u2")
        length = np.fromiter(map(len, codes), np.int64, len(codes)) // 2
        start = np.cumsum(length) - length
        each = length[slot]
        upto = np.concatenate(([0], np.cumsum(each)))
        kind = np.int32 if max(upto[-1], len(flat)) < 1 << 31 else np.int64
        at = np.repeat((start[slot] - upto[:-1]).astype(kind), each)
        at += np.arange(upto[-1], dtype=kind)
        ids = flat[at]
        return ids, upto[ends] - upto[ends - sizes - last]


def encoder(name_or_path: str, kind: str, room: int = 250_000) -> UnitEncoder:
    """One encoder for each Python worker, with what it has learned from earlier tasks; a unit takes about 250 bytes."""
    key = (name_or_path, kind)
    known = memory("tokens")
    if key not in known:
        known[key] = UnitEncoder(name_or_path, kind, room)
    return known[key]


def in_slices(texts: list[str | None], chars: int = 1_500_000):
    """(start, texts) slices of bounded total length, nulls as empty texts; a longer text comes alone."""
    start, some, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if some and size + len(t) > chars:
            yield start, some
            start, some, size = i, [], 0
        some.append(t)
        size += len(t)
    if some:
        yield start, some


def gathered(batches, chars: int):
    """(ids, texts) of Arrow batches (id, text), some batches together, of about `chars` characters: fewer calls see a unit twice."""
    ids, texts, size = [], [], 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        texts += (some := batch.column(1).to_pylist())
        size += sum(map(len, some))
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
