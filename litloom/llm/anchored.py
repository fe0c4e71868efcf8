"""Fixed-length windows over unit sequences (words or bytes), cut at content-defined anchors.

The anchor of a window is its first m-gram of least rank; rank is a hash, with m-grams known
to be frequent ranked last so that no common phrase draws a large part of all windows to it.
Neighbouring windows with one anchor travel as one packed string. Equal windows have equal
anchors at equal offsets, so they always meet in one bucket.

A map task packs the strings of many documents into one compressed block a bucket. Strings
that repeat among them are sent once; their verdict is given on the spot. The strings met most
often stay with the task, so that what many documents share is sent once a task, not once
a block: a bucket of one common anchor gets few copies of it. What a bucket does
with its strings is up to the user: ``superkmer`` (words, hash buckets) sorts window hashes,
``suffix_dedup`` (bytes, range buckets) sorts suffixes. Everything is vectorised numpy.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.common import dealt, id_key, shuffle_width, text_of, written

U = np.uint64
#: Odd multiplier of the rolling polynomial and its inverse modulo 2**64.
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
#: Bytes of text handled at once, and of packed strings held before they are sent.
SLICE = 1 << 19
HELD = 24 << 20
#: Bytes of those that may stay for the rest of the task, as strings met again and again.
STAYING = 6 << 20
#: Bytes of packed strings aimed at in one bucket, and packed bytes a byte of text at most, as a rule.
BUCKET_BYTES = 32 << 20
PACKED = 5
#: Buckets at most: their splitters are broadcast.
MOST_BUCKETS = 1 << 20
#: Buckets a partition decides at most, as a rule: about 75 MB of packed blocks, whatever the input.
PARTITION_BUCKETS = 8
#: Share of the text looked at for frequent anchors, besides a least number of bytes, and how many are told to all tasks at most (8 bytes each).
SAMPLE_SHARE = 1 / 4096
MOST_FREQUENT = 1 << 21
_POS_BITS = 25
#: ASCII white space of the word contracts.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base & ((1 << 64) - 1), U)
    p[0] = 1
    return np.multiply.accumulate(p)


class Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            self.up, self.down = _powers(_R, n), _powers(_RINV, n)
        return self.up, self.down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def byte_values() -> np.ndarray:
    """A pseudo-random 64-bit value for each byte, by rule."""
    return mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))


_BYTE = byte_values()


class Sequence:
    """Units of a concatenation of documents with what rolling hashes need."""

    def __init__(self, buf: np.ndarray, first: np.ndarray, words: bool, powers: Powers) -> None:
        """``buf``: bytes of all documents; ``first``: begin of each document and the end."""
        self.buf, self.powers = buf, powers
        n = len(buf)
        if words:
            up, down = powers.get(n)
            white = _WHITE[buf]
            inner = ~white
            begins = inner.copy()
            begins[1:] &= white[:-1]
            edge = first[(first > 0) & (first < n)]
            begins[edge] = inner[edge]
            ends = inner.copy()
            ends[:-1] &= white[1:]
            if len(edge):
                ends[edge - 1] = inner[edge - 1]
            self.at = np.flatnonzero(begins)
            self.end = np.flatnonzero(ends) + 1
            run = np.zeros(n + 1, U)
            np.cumsum(_BYTE[buf] * up[:n], out=run[1:])
            self.value = mix((run[self.end] - run[self.at]) * down[self.at] + (self.end - self.at).astype(U))
            self.first = np.searchsorted(self.at, first).astype(np.int64)
        else:
            self.at = None
            self.value = _BYTE[buf]
            self.first = first
        m = len(self.value)
        self.up, self.down = powers.get(m)
        self.run = np.zeros(m + 1, U)
        np.cumsum(self.value * self.up[:m], out=self.run[1:])

    def __len__(self) -> int:
        return len(self.value)

    def grams(self, m: int) -> np.ndarray:
        """Hash of the m units from each position (as many as fit)."""
        n = len(self) - m + 1
        return mix((self.run[m:] - self.run[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)

    def span_hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.run[stop] - self.run[start]) * self.down[start] + (stop - start).astype(U))

    def byte_span(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte range of units start..stop (not empty)."""
        return (start, stop) if self.at is None else (self.at[start], self.end[stop - 1])


class FrequentSet:
    """Hashes of frequent m-grams with a small bit table in front."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes.astype(U))
        self.front = np.zeros(1 << 20, bool)
        self.front[(self.hashes & U((1 << 20) - 1)).astype(np.int64)] = True

    def mask(self, h: np.ndarray) -> np.ndarray:
        out = self.front[(h & U((1 << 20) - 1)).astype(np.int32)] if len(self.hashes) else np.zeros(len(h), bool)
        at = np.flatnonzero(out)
        if len(at):
            pos = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            out[at] = self.hashes[pos] == h[at]
        return out


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` consecutive values, by doubling."""
    have, out = 1, v
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchored_runs(seq: Sequence, k: int, m: int, frequent: FrequentSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed strings: (first window, number of windows, anchor position, anchor hash)."""
    none = np.zeros(0, np.int64)
    if len(seq) < k:
        return none, none, none, np.zeros(0, U)
    g = seq.grams(m)
    rank = (g >> U(_POS_BITS + 1)) << U(_POS_BITS)
    rank[frequent.mask(g)] |= U(1 << 63)
    rank |= np.arange(len(g), dtype=U)
    anchor = (sliding_min(rank, k - m + 1) & U((1 << _POS_BITS) - 1)).astype(np.int64)
    # Windows of one document only.
    size = np.diff(seq.first)
    whole = np.zeros(len(seq) + 1, np.int32)
    fits = size >= k
    np.add.at(whole, seq.first[:-1][fits], 1)
    np.add.at(whole, seq.first[1:][fits] - k + 1, -1)
    ok = np.cumsum(whole[: len(anchor)]) > 0
    start = np.flatnonzero(ok)
    if not len(start):
        return none, none, none, np.zeros(0, U)
    a = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return start[at], np.diff(np.append(at, len(start))), a[at], g[a[at]]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start+1, .. of each range, one after another."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    keep = size > 0
    start, size = start[keep], size[keep]
    if not len(start):
        return np.zeros(0, np.int64)
    out[0] = start[0]
    at = np.cumsum(size)[:-1]
    out[at] = start[1:] - (start[:-1] + size[:-1]) + 1
    return np.cumsum(out)


def equal_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``size`` bytes at a and b agree, in pieces of bounded size."""
    out = np.ones(len(a), bool)
    ahead = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ahead, ahead[i] + SLICE, "right")) - 1)
        if ahead[j] > ahead[i]:
            same = buf[ranges(a[i:j], size[i:j])] == buf[ranges(b[i:j], size[i:j])]
            bad = np.flatnonzero(~same)
            if len(bad):
                out[i + np.searchsorted(ahead[i : j + 1] - ahead[i], bad, "right") - 1] = False
        i = j
    return out


def classes(buf: np.ndarray, h: np.ndarray, a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A class number for each byte range: equal numbers exactly where the bytes are equal.

    Sorts by hash, then compares each range with the first of its run; a range that
    differs in spite of an equal hash is classed by its bytes.
    """
    order = np.argsort(h, kind="stable")
    hs = h[order]
    new = np.ones(len(h), bool)
    new[1:] = hs[1:] != hs[:-1]
    run = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)][run]
    twin = np.flatnonzero(head != order)
    cls = np.empty(len(h), np.int64)
    cls[order] = run
    i, j = order[twin], head[twin]
    same = size[i] == size[j]
    same[same] = equal_bytes(buf, a[i][same], a[j][same], size[i][same])
    if not same.all():
        extra: dict[bytes, int] = {}
        for x in i[~same].tolist():
            cls[x] = extra.setdefault(buf[a[x] : a[x] + size[x]].tobytes(), int(run[-1]) + 1 + len(extra))
    return cls


#: Columns of a packed block, in order: bytes, windows, anchor (first byte within the string, bytes), flag, document, text key, unit position.
_COLUMNS = ("<i4", "<i4", "<i4", "<i4", "u1", "<i8", "<i8", "<i8")
#: Bytes of the strings, columns, and the hash of each string (not sent).
Piece = tuple[bytes, list[np.ndarray], np.ndarray]
#: One document or a part of a long one: id, text key, bytes, number of units before it.
Doc = tuple[int, int, bytes, int]


def pack(pieces: list[Piece]) -> bytes:
    cols = [np.concatenate([p[1][i] for p in pieces]).astype(t, copy=False) for i, t in enumerate(_COLUMNS)]
    raw = b"".join([struct.pack("<q", len(cols[0])), *(c.tobytes() for c in cols), *(p[0] for p in pieces)])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(block: bytes) -> tuple[bytes, list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, cols = struct.unpack_from("<q", raw)[0], 8, []
    for t in _COLUMNS:
        cols.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return raw[at:], cols


def parts_of(doc: int, key: int, text: bytes, k: int, words: bool, limit: int) -> Iterator[Doc]:
    """The document, or parts of a long one overlapping by k - 1 units, so each window is in one part."""
    if len(text) <= 4 * limit:
        yield doc, key, text, 0
    elif words:
        w = text.split()
        step = max(k, limit // 8)
        for at in range(0, max(1, len(w) - k + 1), step):
            yield doc, key, b" ".join(w[at : at + step + k - 1]), at
    else:
        for at in range(0, len(text) - k + 1, limit):
            yield doc, key, text[at : at + limit + k - 1], at


def slices(rows: Iterator[Doc], limit: int) -> Iterator[list[Doc]]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2]) + 1
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def concatenated(docs: list[Doc], words: bool, powers: Powers) -> Sequence:
    first = np.concatenate([[0], np.cumsum([len(r[2]) for r in docs])]).astype(np.int64)
    return Sequence(np.frombuffer(b"".join(r[2] for r in docs), np.uint8), first, words, powers)


def joined_form(seq: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Words one space apart, and where each begins: equal word sequences have equal bytes."""
    lens = seq.end - seq.at
    put = np.concatenate([[0], np.cumsum(lens + 1)])
    joined = np.full(int(put[-1]), 32, np.uint8)
    joined[ranges(put[:-1], lens)] = seq.buf[ranges(seq.at, lens)]
    return joined, put


def map_slice(docs: list[Doc], k: int, m: int, words: bool, frequent: FrequentSet, bucket: Callable, keep_first: bool, powers: Powers) -> tuple[list[tuple[int, Piece]], tuple[np.ndarray, ...]]:
    """Pieces for buckets, and verdicts given on the spot (doc, text key, first unit, units).

    ``bucket(buf, byte position of anchor, anchor hash)`` gives bucket numbers. ``keep_first``:
    the earliest occurrence of a repeated string stays open, the others are covered;
    otherwise all are covered and one copy travels marked as repeated.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    docs = sorted(docs, key=lambda r: (r[0], r[1], r[3]))
    seq = concatenated(docs, words, powers)
    s, n, a, g = anchored_runs(seq, k, m, frequent)
    if not len(s):
        return [], none
    e = s + n - 1 + k
    if words:
        buf, put = joined_form(seq)
        ba, be, aa, ae = put[s], put[e] - 1, put[a], put[a + m] - 1
    else:
        buf, ba, be, aa, ae = seq.buf, s, e, a, a + m
    size = be - ba
    string_hash = seq.span_hash(s, e)
    cls = classes(buf, string_hash, ba, size)
    ids, keys, base = (np.array([r[i] for r in docs], np.int64) for i in (0, 1, 3))
    d = np.searchsorted(seq.first, s, "right") - 1
    pos = s - seq.first[d] + base[d]
    # Documents are sorted by id, so the first of a class is its earliest occurrence.
    _, lead, inverse = np.unique(cls, return_index=True, return_inverse=True)
    own = lead[inverse]
    twin = own != np.arange(len(s))
    same_place = (ids[d] == ids[d[own]]) & (keys[d] == keys[d[own]]) & (pos == pos[own])  # a repeated row shares its leader's verdict
    again = twin & ~same_place
    marked = np.zeros(len(s), bool)
    marked[own[again]] = True
    covered = again if keep_first else again | marked
    out = merged_runs(d[covered], pos[covered], (n + k - 1)[covered])
    out = (ids[out[0]], keys[out[0]], out[1], out[2])
    send = np.flatnonzero(~twin)
    b = bucket(buf, aa[send], g[send])
    order = np.argsort(b, kind="stable")
    send, b = send[order], b[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
    pieces = []
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        x = send[i:j]
        flag = marked[x] & (not keep_first)
        cols = [size[x], n[x], aa[x] - ba[x], ae[x] - aa[x], flag, ids[d[x]], keys[d[x]], pos[x]]
        pieces.append((int(b[i]), (buf[ranges(ba[x], size[x])].tobytes(), [c.astype(t) for c, t in zip(cols, _COLUMNS, strict=True)], string_hash[x])))
    return pieces, out


def chosen(piece: Piece, which: np.ndarray) -> Piece:
    """Some strings of a piece, by number."""
    raw, cols, h = piece
    size = cols[0].astype(np.int64)
    begin = np.cumsum(size) - size
    return np.frombuffer(raw, np.uint8)[ranges(begin[which], size[which])].tobytes(), [c[which] for c in cols], h[which]


def weight_of(piece: Piece) -> int:
    return len(piece[0]) + 45 * len(piece[1][0])


def combined(pieces: list[Piece], k: int, keep_first: bool) -> tuple[Piece, np.ndarray, tuple[np.ndarray, ...] | None]:
    """The pieces of one bucket as one, strings that repeat among them once; how often each was met; and the verdicts on the others, as ``map_slice`` gives them."""
    raw = b"".join(p[0] for p in pieces)
    cols = [np.concatenate([p[1][i] for p in pieces]) for i in range(len(_COLUMNS))]
    h = np.concatenate([p[2] for p in pieces])
    if len(pieces) == 1 or len(np.unique(h)) == len(h):
        return (raw, cols, h), np.ones(len(h), np.int64), None
    size, n, _, _, flag, ids, keys, pos = (c.astype(np.int64) for c in cols)
    begin = np.cumsum(size) - size
    order = np.lexsort((pos, keys, ids))
    buf = np.frombuffer(raw, np.uint8)
    _, lead, inverse = np.unique(classes(buf, h[order], begin[order], size[order]), return_index=True, return_inverse=True)
    own = np.empty(len(h), np.int64)
    own[order] = order[lead[inverse]]
    twin = own != np.arange(len(h))
    again = twin & ((ids != ids[own]) | (keys != keys[own]) | (pos != pos[own]))
    if keep_first:
        covered = again
    else:
        # One copy goes on, marked; marked ones have had their verdict.
        marked = np.zeros(len(h), bool)
        marked[own[again | (twin & (flag > 0))]] = True
        covered = (again | marked) & (flag == 0)
        cols[4] = (marked | (flag > 0)).astype("u1")
    v = np.flatnonzero(covered)
    v = v[np.lexsort((pos[v], keys[v], ids[v]))]
    stay = np.flatnonzero(~twin)
    return chosen((raw, cols, h), stay), np.bincount(own, minlength=len(h))[stay], (ids[v], keys[v], pos[v], (n + k - 1)[v])


def met_most(sizes: list[np.ndarray], times: list[np.ndarray], room: int) -> list[np.ndarray]:
    """For the strings of each bucket, which of them stay: those met most often, of those met twice at least, within ``room`` bytes."""
    size, many = (np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for v in (sizes, times))
    order = np.argsort(-many, kind="stable")
    fit = order[(np.cumsum(size[order] + 45) <= room) & (many[order] > 1)]
    stay = np.zeros(len(size), bool)
    stay[fit] = True
    return np.split(stay, np.cumsum([len(t) for t in times], dtype=np.int64))[:-1]


def merged_runs(owner: np.ndarray, first: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins runs that touch; given by owner and position, both ends ascending within an owner."""
    if not len(owner):
        return owner, first, units
    end = first + units
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (first[1:] > end[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(owner)) - 1
    return owner[at], first[at], end[last] - first[at]


def by_gram(raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Group numbers by the exact bytes of the anchor."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(raw[i:j], len(number)) for i, j in zip(at.tolist(), (at + size).tolist(), strict=True)), np.int64, len(at))


def columns_of(blocks: list[bytes], pad: int = 0) -> tuple[bytes, list[np.ndarray]]:
    """All strings of a bucket between ``pad`` zeros, and their columns. The blocks are given up."""
    texts, columns = [], []
    while blocks:
        text, cols = unpack(blocks.pop())
        texts.append(text)
        columns.append(cols)
    return b"".join([bytes(pad), *texts, bytes(pad)]), [np.concatenate(c).astype(np.int64) for c in zip(*columns, strict=True)]


def repeated_windows(blocks: list[bytes], k: int, words: bool, powers: Powers, limit: int = SLICE) -> Iterator[tuple[np.ndarray, ...]]:
    """Covered unit runs (doc, text key, first unit, units): windows that start more than once in a bucket, a few groups of one anchor at a time.

    Strings whose anchor occurs once are dropped; the windows of the rest are hashed and sorted, and equal hashes compared byte for byte.
    """
    raw, (size, n, anchor, gram, flag, ids, keys, pos) = columns_of(blocks)
    begin = np.cumsum(size) - size
    group = by_gram(raw, begin + anchor, gram)
    times = np.bincount(group)
    many = np.flatnonzero((times[group] > 1) | (flag > 0))
    many = many[np.argsort(group[many], kind="stable")]
    buf = np.frombuffer(raw, np.uint8)
    i = 0
    ahead = np.concatenate([[0], np.cumsum(size[many])])
    while i < len(many):
        j = max(i + 1, int(np.searchsorted(ahead, ahead[i] + limit, "right")) - 1)
        while j < len(many) and group[many[j]] == group[many[j - 1]]:
            j += 1
        x = many[i:j]
        i = j
        flag_x = flag[x] > 0
        seq = Sequence(buf[ranges(begin[x], size[x])], np.concatenate([[0], np.cumsum(size[x])]).astype(np.int64), words, powers)
        first = seq.first[:-1]
        owner = np.repeat(np.arange(len(x)), n[x])
        w = ranges(first, n[x])
        ba, be = seq.byte_span(w, w + k)
        cls = classes(seq.buf, seq.span_hash(w, w + k), ba, be - ba)
        doc, key, where = ids[x][owner], keys[x][owner], pos[x][owner] + w - first[owner]
        order = np.argsort(cls, kind="stable")
        c = cls[order]
        head = np.ones(len(c), bool)
        head[1:] = c[1:] != c[:-1]
        lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        apart = np.zeros(len(c), bool)
        apart[order] = (doc[order] != doc[lead]) | (key[order] != key[lead]) | (where[order] != where[lead])
        repeated = np.zeros(int(cls.max()) + 1, bool)
        repeated[cls[apart | flag_x[owner]]] = True
        at = np.flatnonzero(repeated[cls] & ~flag_x[owner])
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (at[1:] != at[:-1] + 1)
            b = np.flatnonzero(new)
            yield doc[at[b]], key[at[b]], where[at[b]], np.diff(np.append(b, len(at))) + k - 1


def cover(runs: list[int] | None, n: int) -> tuple[np.ndarray, int]:
    """(mask of units kept, maximal runs removed) from packed runs ``first << 24 | units``."""
    keep = np.ones(n, bool)
    if not runs:
        return keep, 0
    r = np.array(runs, np.int64)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, r >> RUN_BITS, 1)
    np.add.at(step, (r >> RUN_BITS) + (r & ((1 << RUN_BITS) - 1)), -1)
    keep = np.cumsum(step[:-1]) == 0
    gone = ~keep
    return keep, int(gone[0]) + int((gone[1:] & keep[:-1]).sum())


RUN_BITS = 24


def packed_runs(first: np.ndarray, units: np.ndarray) -> np.ndarray:
    """first << 24 | units; longer runs never arise, as a slice holds fewer units."""
    return (first << RUN_BITS) | units


_NAMES = ["to", "bucket", "block", "doc", "key", "run"]


def _verdicts(cols: tuple[np.ndarray, ...], code: np.ndarray) -> pa.RecordBatch:
    """Rows of bucket -1, dealt out by document."""
    doc, key, first, units = cols
    to = code[np.abs(doc % len(code))]
    return pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.full(len(doc), -1, np.int32)), pa.nulls(len(doc), pa.binary()), pa.array(doc), pa.array(key), pa.array(packed_runs(first, units))], _NAMES)


def _blocks(held: dict[int, list[Piece]], k: int, keep_first: bool, code: np.ndarray, room: int) -> Generator[pa.RecordBatch, None, dict[int, list[Piece]]]:
    """Gives up what is held, but for the strings met most often (``room`` bytes), which are returned."""
    numbers, found, stay_on = list(held), [], {}
    for b in numbers:
        piece, times, now = combined(held.pop(b), k, keep_first)
        found.append((piece, times))
        if now is not None and len(now[0]):
            yield _verdicts(now, code)
    stays = met_most([piece[1][0] for piece, _ in found], [times for _, times in found], room)
    sent, blocks = [], []
    for b, stay in zip(numbers[::-1], stays[::-1], strict=True):
        piece, _ = found.pop()
        if stay.any():
            stay_on[b] = [chosen(piece, np.flatnonzero(stay))]
            piece = chosen(piece, np.flatnonzero(~stay))
        if not stay.all():
            sent.append(b)
            blocks.append(pack([piece]))
    if sent:
        none = pa.nulls(len(sent), pa.int64())
        to = code[np.array(sent) % len(code)]
        yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(sent, pa.int32()), pa.array(blocks, pa.binary()), none, none, none], _NAMES)
    return stay_on


#: Decides a bucket: its number and blocks -> (doc, key, first unit, units) covered, and (doc, key, first, units, window) still open or None.
Decide = Callable[[int, list[bytes]], Iterator[tuple[tuple[np.ndarray, ...], list[bytes] | None]]]


def covered_runs(
    rows: DataFrame, k: int, m: int, words: bool, keep_first: bool, bucket: Callable, decide: Decide, frequent: np.ndarray, width: int, slice_bytes: int = SLICE
) -> DataFrame:
    """``rows(doc, key, text binary)`` -> ``(doc, key, run long, window binary)``: covered runs, and open ones with their window.

    ``bucket`` numbers the buckets from zero; ``width`` partitions share them evenly. One shuffle
    carries the packed blocks and the verdicts already given.
    """
    code = np.array(dealt(width), np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, often = Powers(), FrequentSet(frequent)
        held: dict[int, list[Piece]] = {}
        weight = 0
        docs = (part for b in batches for d, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) for part in parts_of(d, key, t.as_py(), k, words, slice_bytes))
        for part in slices(docs, slice_bytes):
            pieces, now = map_slice(part, k, m, words, often, bucket, keep_first, powers)
            if len(now[0]):
                yield _verdicts(now, code)
            for b, p in pieces:
                held.setdefault(b, []).append(p)
                weight += weight_of(p)
            if weight >= HELD:
                held = yield from _blocks(held, k, keep_first, code, STAYING)
                weight = sum(weight_of(p) for ps in held.values() for p in ps)
        if held:
            yield from _blocks(held, k, keep_first, code, 0)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reads rows sorted by bucket: verdicts pass, blocks are held until their bucket is complete."""
        held: list[bytes] = []
        now = None
        names = ["doc", "key", "run", "window"]

        def decided() -> Iterator[pa.RecordBatch]:
            blocks = held.copy()
            held.clear()
            for (doc, key, first, units), window in decide(now, blocks):
                open_windows = pa.nulls(len(doc), pa.binary()) if window is None else pa.array(window, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(packed_runs(first, units)), open_windows], names)

        for b in batches:
            number = b.column(0).to_numpy()
            given = int(np.searchsorted(number, 0))
            if given:
                part = b.slice(0, given)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), pa.nulls(given, pa.binary())], names)
            for i in range(given, len(number)):
                if number[i] != now and held:
                    yield from decided()
                now = int(number[i])
                held.append(b.column(1)[i].as_py())
        if held:
            yield from decided()

    mapped = rows.mapInArrow(spread, "to int, bucket int, block binary, doc long, key long, run long")
    dealt_out = mapped.repartition(width, "to").sortWithinPartitions("bucket").drop("to")
    return dealt_out.mapInArrow(gather, "doc long, key long, run long, window binary")


def by_document(runs: DataFrame) -> DataFrame:
    """``(doc, key, runs array<long>)``, one row for each row with covered units."""
    return runs.groupBy("doc", "key").agg(F.collect_list("run").alias("runs"))


def bucket_count(total: int, width: int) -> int:
    """Buckets of about ``BUCKET_BYTES`` for ``total`` bytes of text, two for each partition at least."""
    return min(MOST_BUCKETS, max(2 * width, -(-total * PACKED // BUCKET_BYTES)))


def partition_count(buckets: int, width: int) -> int:
    """Partitions that share the buckets: the session's number, or more where buckets are many, so that no task grows with the input."""
    return max(width, -(-buckets // PARTITION_BUCKETS))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, key, text``: a row is known by id, and by the hash of its text too where ids repeat."""
    ids = docs.groupBy(id_key(id_col)).count()
    key = F.lit(0).cast("long") if ids.where("count > 1").isEmpty() else F.xxhash64(text_of(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), id_key(id_col).alias("doc"), key.alias("key"), text_of(text_col).cast("binary").alias("text"))


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]


def sampled_anchors(rows: DataFrame, total: int, k: int, m: int, words: bool, least_bytes: int, share: int, depth: int, splitters: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequent m-gram hashes, about ``splitters`` quantiles of the leading ``depth`` bytes of anchors, sorted) from a sample of documents.

    The sample only steers work: which anchors are avoided and where ranges are cut. Documents are drawn by
    hash with a chance that keeps their bytes near ``least_bytes``, or near ``SAMPLE_SHARE`` of a large input, so that
    an anchor it does not see often enough has few strings at any input size; an m-gram met ``share`` times or more is frequent.
    """
    chance = min(1.0, max(least_bytes / max(1, total), SAMPLE_SHARE))
    drawn = rows.where(F.pmod(F.xxhash64("key", "doc", F.lit(7)), F.lit(1 << 20)) < int(chance * (1 << 20)) + 1)
    # About 64 anchors a splitter are ordered.
    one_in = max(1, int(chance * total / 40 / max(1, 64 * splitters)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, none = Powers(), FrequentSet(np.zeros(0, U))
        docs = (part for b in batches for t in b.column(2) for part in parts_of(0, 0, t.as_py(), k, words, SLICE))
        for part in slices(docs, SLICE):
            seq = concatenated(part, words, powers)
            _, _, a, g = anchored_runs(seq, k, m, none)
            if len(a):
                lead = [None] * len(a) if words else prefixes(seq.buf, a, depth).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(lead, pa.binary())], ["g", "lead"])

    def quantiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every ``stride``-th of the sorted rows of a partition, from the middle of the first stride."""
        ahead = stride // 2
        for b in batches:
            yield b.take(pa.array(np.arange(ahead, b.num_rows, stride)))
            ahead = (ahead - b.num_rows) % stride if ahead < b.num_rows else ahead - b.num_rows

    # Written: one pass over the texts serves the counts and the splitters.
    seen = written(drawn.select("doc", "key", "text").mapInArrow(look, "g long, lead binary"), "anchors")
    counted = seen.groupBy("g").count().where(F.col("count") >= share).orderBy(F.desc("count"), "g").limit(MOST_FREQUENT).toArrow()
    frequent = counted.column("g").to_numpy().astype(np.int64).view(U)
    if words:
        return frequent, np.zeros(0, "S1")
    lead = seen.where(F.pmod(F.xxhash64("lead", "g"), F.lit(one_in)) == 0).select("lead")
    n = lead.count()
    stride = max(1, -(-n // splitters))
    # Ordered by Spark, so that the driver gets a value a splitter.
    parts = min(shuffle_width(rows.sparkSession), 1 + n // 100_000)
    cuts = lead.repartitionByRange(parts, "lead").sortWithinPartitions("lead").mapInArrow(quantiles, "lead binary").toArrow().column("lead")
    return frequent, np.sort(np.array(cuts.to_pylist(), f"S{depth}"))


def prefixes(buf: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` bytes from each position, as fixed strings; zeros beyond the end."""
    padded = np.concatenate([buf, np.zeros(depth, np.uint8)])
    return padded[at[:, None] + np.arange(depth)].view(f"S{depth}")[:, 0]


def leading(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as big-endian numbers: numeric order is byte order. Positions need eight bytes after them."""
    out = np.zeros(len(at), U)
    for i in range(8):
        out = (out << U(8)) | buf[at + i].astype(U)
    return out
