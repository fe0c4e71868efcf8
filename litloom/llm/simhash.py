"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the
perfect binary Golay code [23, 12, 7] (unused bits zero). The codeword indices met within one
flipped bit of a word are its fuzzy keys (one or six as a rule): two words at most two bits
apart have a midpoint in both neighbourhoods, hence a common key.

At most four differing bits over three segments leave, by pigeonhole, one of two patterns:

* a segment without error and another with at most two: key = (exact segment, fuzzy key);
* no segment free of error, so at least two segments with exactly one error each:
  key = (one-error key, one-error key). Words one bit apart differ in parity, so the even
  one sends all its fuzzy keys and the odd one only its own codeword index.

Each distinct fingerprint gives about 60 keys of 25 to 37 bits; random pairs meet in a bucket
with a chance near 1e-6. Members of a bucket are verified by bit count, and a bucket
yields a spanning forest, never all its pairs.

Four of 64 bits is a narrow radius (about 0.95 similarity). ``similar_documents`` takes the links found this way as
first candidates and goes on from them to exactly the components of all pairs at a given shingle similarity t,
0.8 as a rule, whatever the sizes.
Shingles have one fixed order, rare ones first. Two sets of similarity t or more share one of the
first n - ceil(t n) + 1 shingles of each (the prefix filter of set joins); these are the keys. The
sizes and the places in the order bound the overlap without loss, and what remains is compared
by whole sets. So that a large family gives no square of rows, members of a bucket are first compared
with ``LEADERS`` of them; then, in buckets that still hold several components, every pair across them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.common import NULL_ID, given, id_key, renamed, shuffle_width, text_of, written
from litloom.llm.components import components

#: Generator polynomial of the binary Golay code, its length and check bits.
GOLAY_GENERATOR = 0b101011100011
GOLAY_BITS = 23
CHECK_BITS = 11
#: (shift, width) of the three fingerprint segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
MAX_BITS = 4
#: Members of one bucket compared within one task; larger buckets are dealt out in pairs of blocks.
BLOCK = 20_000
_SHINGLE_SLICE = 1 << 16


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles (repeats count). No words: 0."""
    w = text.lower().split()
    if not w:
        return 0
    line = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = ends - np.array([len(x) + 1 for x in w])
    n = max(1, len(w) - words + 1)
    starts, ends = starts[:n].tolist(), (ends[min(words, len(w)) - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _SHINGLE_SLICE):
        part = [digest(line[a:b], seed) for a, b in zip(starts[at : at + _SHINGLE_SLICE], ends[at : at + _SHINGLE_SLICE], strict=True)]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


#: Members up to which all close pairs of a bucket become links.
_SMALL_RUN = 16
#: Members of a bucket that all others are compared with first.
LEADERS = 4
#: Documents sampled for the order of shingles (that many, and a tenth at least, so that buckets of unranked shingles
#: do not grow with the table), and ranked shingles at most. Results do not depend on them.
SAMPLE, SHARE, RANKED = 4_000, 0.1, 100_000
#: Bits of the bitmap that tells which texts are read again (1 MB).
CLASSES = 1 << 23


def shingle_set(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted. No words: none."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.int64)
    line = b" ".join(w)
    size = np.array([len(x) + 1 for x in w])
    ends = np.cumsum(size)
    n = max(1, len(w) - words + 1)
    starts, ends = (ends - size)[:n].tolist(), (ends[min(words, len(w)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, text_key, fp)`` for every row; ``text_key`` is the XXH64 of the text, to find the row again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py() or b"", words, seed) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"), text_of(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 4,096 messages and, for each syndrome, the error of weight three or less."""
    rem = np.zeros(1 << 12, np.int64)
    for m in range(1 << 12):
        v = m << CHECK_BITS
        for bit in range(GOLAY_BITS - 1, CHECK_BITS - 1, -1):
            if v >> bit & 1:
                v ^= GOLAY_GENERATOR << (bit - CHECK_BITS)
        rem[m] = v
    error = np.zeros(1 << CHECK_BITS, np.int64)
    one = [1 << i for i in range(GOLAY_BITS)]
    patterns = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    for e in patterns:
        error[rem[e >> CHECK_BITS] ^ (e & ((1 << CHECK_BITS) - 1))] = e
    return rem, error


class Golay:
    """Decoder of 23-bit words to codeword indices (12 bits)."""

    def __init__(self) -> None:
        self.rem, self.error = _tables()

    def decode(self, v: np.ndarray) -> np.ndarray:
        syndrome = self.rem[v >> CHECK_BITS] ^ (v & ((1 << CHECK_BITS) - 1))
        return (v ^ self.error[syndrome]) >> CHECK_BITS

    def fuzzy(self, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices met within one flipped bit, sorted by row, and a mask of their first mentions."""
        near = np.sort(self.decode(np.stack([v, *(v ^ (1 << i) for i in range(width))], axis=1)), axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        return near, first

    def keys(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row number, key): all bucket keys of each fingerprint (unsigned 64-bit)."""
        rows, keys = [], []
        seg = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
        sets, single, odd = [], [], []
        for v, (_, w) in zip(seg, SEGMENTS, strict=True):
            near, first = self.fuzzy(v, w)
            r, c = np.nonzero(first)
            sets.append((r, near[r, c]))
            own = self.decode(v)
            p = np.bitwise_count(v.astype(np.uint64)).astype(np.int64) & 1
            odd.append(p)
            keep = p[r] == 0
            o = np.flatnonzero(p)
            rr, kk = np.concatenate([r[keep], o]), np.concatenate([near[r, c][keep], own[o]])
            order = np.argsort(rr, kind="stable")
            single.append((rr[order], kk[order]))
        kind = 0
        for x in range(3):
            for y in range(3):
                if x != y:
                    r, k = sets[y]
                    rows.append(r)
                    keys.append((np.int64(kind) << 34) | (seg[x][r] << 12) | k)
                    kind += 1
        n = len(fps)
        for x, y in ((0, 1), (0, 2), (1, 2)):
            (rx, kx), (ry, ky) = single[x], single[y]
            ny = np.bincount(ry, minlength=n)
            reps = ny[rx]
            at = np.repeat(np.concatenate([[0], np.cumsum(ny)])[rx], reps) + _within(reps)
            r = np.repeat(rx, reps)
            keys.append((np.int64(kind) << 34) | ((odd[x] ^ odd[y])[r] << 24) | (np.repeat(kx, reps) << 12) | ky[at])
            rows.append(r)
            kind += 1
        return np.concatenate(rows), np.concatenate(keys)


def _within(reps: np.ndarray) -> np.ndarray:
    """0..r-1 for each r of ``reps``, one after another."""
    total = int(reps.sum())
    return np.arange(total) - np.repeat(np.cumsum(reps) - reps, reps)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def forest(rows: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges (by first word) of a spanning forest of the link graph on distinct ``rows`` of words."""
    left, right = [], []
    todo = np.arange(len(rows))
    while len(todo) > 1:
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            at, front = front[0], front[1:]
            hit = _apart(rows[todo], rows[at]) <= max_bits
            if hit.any():
                new, todo = todo[hit], todo[~hit]
                left.append(np.full(len(new), rows[at, 0]))
                right.append(rows[new, 0])
                front = np.concatenate([front, new])
    return left, right


def _run_edges(key: np.ndarray, rows: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: in small runs all pairs that are close enough, in large ones a spanning forest."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(cut)
    left, right = [], []
    some = (size > 1) & (size <= _SMALL_RUN)
    k, f = key[np.repeat(some, size)], rows[np.repeat(some, size)]
    for d in range(1, int(size[some].max(initial=1))):
        same = np.flatnonzero(k[d:] == k[:-d])
        hit = same[_apart(f[same + d], f[same]) <= max_bits]
        left.append(f[hit, 0])
        right.append(f[hit + d, 0])
    for i in np.flatnonzero(size > _SMALL_RUN):
        a, b = forest(np.unique(rows[cut[i] : cut[i + 1]], axis=0), max_bits)
        left += a
        right += b
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _bucket_stage(max_bits: int, block: int):
    """Reads rows (key, fp) sorted by key; gives edges (kind 0) and, of buckets above ``block``, their members (kind 1)."""
    names = ["kind", "key", "a", "b"]

    def edges_out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)

    def members_out(key: int, rows: np.ndarray, first: int) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(np.full(n, key, np.int64)), pa.array(rows[:, 0].view(np.int64)), pa.array(np.arange(first, first + n) // block)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held = np.zeros(0, np.int64), np.zeros((0, 1), np.uint64)
        spilling, number = None, 0
        for b in batches:
            k = np.concatenate([held_k, b.column(0).to_numpy()])
            f = np.concatenate([held, b.column(1).to_numpy().view(np.uint64)[:, None]])
            if spilling is not None and len(k):
                own = int(np.searchsorted(k, spilling, "right"))
                if own:
                    yield members_out(spilling, f[:own], number)
                    number += own
                k, f = k[own:], f[own:]
                if len(k):
                    spilling = None
            if not len(k):
                held_k, held = k, f
                continue
            last = int(np.searchsorted(k, k[-1], "left"))
            if last:
                x, y = _run_edges(k[:last], f[:last], max_bits)
                if len(x):
                    yield edges_out(x, y)
            held_k, held = k[last:], f[last:]
            if len(held_k) > block:
                spilling, number = int(held_k[0]), len(held_k)
                yield members_out(spilling, held, 0)
                held_k, held = held_k[:0], held[:0]
        if len(held_k):
            x, y = _run_edges(held_k, held, max_bits)
            if len(x):
                yield edges_out(x, y)

    return run


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``(fp)`` distinct -> ``(a, b)`` fingerprints at most ``max_bits`` apart; same components as all such pairs.

    ``max_bits`` above four is refused: the keys promise no more. Buckets above ``block``
    members are compared in pairs of blocks, spread over tasks.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    width = shuffle_width(distinct_fps.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                rows, keys = golay.keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], ["key", "fp"])

    # Sixty keys a row: spread the few bytes of fingerprints over all tasks first.
    return _bucketed(distinct_fps.select("fp").repartition(width, "fp").mapInArrow(spread, "key long, fp long"), max_bits, block)


def _bucketed(keyed: DataFrame, max_bits: int, block: int) -> DataFrame:
    """``(key, fp)`` -> distinct ``(a, b)`` of fingerprints that meet in a bucket and are close enough."""
    width = shuffle_width(keyed.sparkSession)
    schema = "kind int, key long, a long, b long"
    found = written(keyed.repartition(width, "key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_stage(max_bits, block), schema), "links")
    edges = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1").select("key", F.col("a").alias("fp"), F.col("b").alias("blk"))
    count = large.groupBy("key").agg((F.max("blk") + 1).alias("n"))
    pairs = large.join(count, "key").select("key", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"), "blk")
    pairs = pairs.select(F.xxhash64("key", F.least("blk", "other"), F.greatest("blk", "other")).alias("key"), "fp")
    rest = pairs.repartition(width, "key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_stage(max_bits, 1 << 40), schema)
    return edges.unionByName(rest.select("a", "b")).distinct()


def shingle_ranks(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in a sample, sorted, and their places in the order (from 1; all others count as 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), words))], ["shingle"])

    some = docs.select(text_of(text_col).cast("binary").alias("t"))
    some = some.sample(min(1.0, max(SHARE, SAMPLE / max(1, some.count()))), 7).mapInArrow(run, "shingle long")
    top = some.groupBy("shingle").count().where("count >= 3").orderBy(F.desc("count"), "shingle").limit(RANKED).toArrow()
    known = top.column("shingle").to_numpy().astype(np.int64)
    order = np.argsort(known)
    return known[order], (len(known) - np.arange(len(known)))[order]


def prefix_length(n: int, similarity: float) -> int:
    """First shingles of a set of ``n``, of which one is shared with every set of the similarity."""
    return min(n, n - math.ceil(similarity * n - 1e-9) + 1)


def prefix(shingles: np.ndarray, ranks: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a sorted set in the order of ``ranks``, then of hashes."""
    known, rank = ranks
    own = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        own = np.where(known[at] == shingles, rank[at], 0)
    return shingles[np.argsort(own, kind="stable")[: prefix_length(len(shingles), similarity)]]


def _may_link(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` that share the shingles at places ``at`` and ``to``, and none before, can have the similarity."""
    need = similarity / (1 + similarity) * (n + m) - 1e-6
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6) & (np.minimum(n - at, m - to) >= need)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Distinct pairs, the smaller first, as rows of two."""
    x, y = (np.concatenate([*v, np.zeros(0, np.int64)]) for v in (a, b))
    both = np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)
    return np.unique(both[x != y], axis=0)


def _leader_stage(similarity: float, leaders: int = LEADERS):
    """Reads rows (key, fp, n, at) sorted by key, at, fp; gives pairs with the first ``leaders`` of each bucket (kind 0) and the rows of buckets
    in which other pairs remain (kind 1)."""
    names = ["kind", "a", "b", "n", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last bucket's first rows and their count go on into the next batch: no bucket is held whole.
        key, fp, n, at = (np.zeros(0, np.int64) for _ in range(4))
        open_key, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(key)
            key, fp, n, at = (np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip((key, fp, n, at), batch.columns, strict=True))
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([start, [len(key)]]))
            left, right = [], []
            place = _within(size)
            for d in range(leaders):
                lead = np.repeat(np.minimum(start + d, len(key) - 1), size)
                row = np.flatnonzero((place > d) & (np.arange(len(key)) >= old))
                lead = lead[row]
                hit = _may_link(n[row], at[row], n[lead], at[lead], similarity)
                left.append(fp[row[hit]])
                right.append(fp[lead[hit]])
            pairs = _pairs(left, right)
            total = size.copy()
            if old and open_key == key[0]:
                total[0] += seen - old
            # The last bucket's rows are given in any case where it may go on; a bucket of one row more or less does not matter.
            more = np.repeat(total > leaders + 1, size)
            more[start[-1] :] = True
            if old and open_key == key[0]:
                more[:old] = False
            at_end = slice(start[-1], min(start[-1] + leaders, len(key)))
            open_key, seen = int(key[-1]), int(total[-1])
            rows = np.flatnonzero(more)
            k, m = len(pairs), len(rows)
            if k + m:
                kind = np.repeat(np.array([0, 1], np.int32), [k, m])
                blank = np.zeros(k, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind), pa.array(np.concatenate([pairs[:, 0], key[rows]])), pa.array(np.concatenate([pairs[:, 1], fp[rows]])),
                     pa.array(np.concatenate([blank, n[rows]])), pa.array(np.concatenate([blank, at[rows]]))], names)
            key, fp, n, at = key[at_end], fp[at_end], n[at_end], at[at_end]

    return run


def _across_stage(similarity: float, screen: type | None = None):
    """Reads rows (key, fp, n, at, comp) sorted by key; gives the pairs (a, b) of a bucket that are in different components and may link.

    ``screen`` (as ``minmax_hash.Parities``): rows also have a sketch of their sets, which rules out more."""
    share = (1 - similarity) / (1 + similarity)

    def across(fp: np.ndarray, n: np.ndarray, at: np.ndarray, comp: np.ndarray, counts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        which, times = np.unique(comp, return_counts=True)
        # Members of the largest component meet the others only.
        few = np.flatnonzero(comp != which[times.argmax()])
        if not len(few):
            return
        known = screen(counts) if screen else None
        step = max(1, (1 << 20) // len(fp))
        for i in range(0, len(few), step):
            f = few[i : i + step]
            x, y = np.nonzero((comp[f, None] != comp) & _may_link(n[f, None], at[f, None], n, at, similarity))
            x = f[x]
            if known:
                stay = known.apart(x, y) <= share * (n[x] + n[y]) + 1e-6
                x, y = x[stay], y[stay]
            yield fp[x], fp[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_counts = [np.zeros(0, np.int64)] * 5, []

        def out(cols: list[np.ndarray], counts: list[bytes]) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1], [True]]))
            left, right, many = [], [], 0
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                for a, b in across(*(c[i:j] for c in cols[1:]), counts[i:j]) if j - i > 1 else ():
                    left.append(a)
                    right.append(b)
                    many += len(a)
                    if many > 1 << 20:
                        yield given(_pairs(left, right))
                        left, right, many = [], [], 0
            yield given(_pairs(left, right))

        def given(p: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

        for b in batches:
            cols = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, b.columns[:5], strict=True)]
            counts = held_counts + (b.column(5).to_pylist() if screen else [])
            last = int(np.searchsorted(cols[0], cols[0][-1], "left")) if len(cols[0]) else 0
            if last:
                yield from out([c[:last] for c in cols], counts[:last])
            held, held_counts = [c[last:] for c in cols], counts[last:]
        if len(held[0]):
            yield from out(held, held_counts)

    return run


def _across(rows: DataFrame, edges: DataFrame, similarity: float, block: int, counts: DataFrame | None = None, screen: type | None = None) -> DataFrame:
    """``rows(key, fp, n, at)`` of buckets, links found -> distinct ``(a, b)`` that meet in a bucket, may link and are not linked yet.

    ``counts(fp, counts)``: sketches for ``screen``, by which pairs are ruled out before they leave their bucket."""
    width = shuffle_width(rows.sparkSession)
    roots = components(edges).withColumnRenamed("node", "fp")
    rows = written(rows.join(roots, "fp", "left").select("key", "fp", "n", "at", F.coalesce("root", "fp").alias("comp")), "buckets")
    mixed = rows.groupBy("key").agg(F.count("*").alias("times"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    blocks = F.ceil(F.col("times") / F.lit(block)).cast("long")
    rows = rows.join(mixed.select("key", blocks.alias("blocks")), "key").withColumn("blk", F.pmod(F.xxhash64("fp"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("blk", "other"), F.greatest("blk", "other")).alias("key"), "fp", "n", "at", "comp")
    if counts is not None:
        rows = rows.join(counts, "fp").select("key", "fp", "n", "at", "comp", "counts")
    return rows.repartition(width, "key").sortWithinPartitions("key", "fp").mapInArrow(_across_stage(similarity, screen), "a long, b long").distinct()


def majority(shingles: np.ndarray) -> int:
    """Majority bits of a set of shingle hashes: its 64-bit fingerprint. No shingles: 0."""
    bits = np.unpackbits(shingles.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(shingles)).tobytes(), "big")


def _golay_pairs(nodes: DataFrame, block: int) -> DataFrame:
    """``nodes(fp, sim)`` -> pairs ``(a, b)`` of nodes whose fingerprints ``sim`` link: one node for each fingerprint, and the others of it with that one."""
    one = written(nodes.groupBy("sim").agg(F.min("fp").alias("fp")), "sims")
    found = links(one.select(F.col("sim").alias("fp")), MAX_BITS, block)
    left, right = (one.select(F.col("sim").alias(c), F.col("fp").alias(f"fp{c}")) for c in "ab")
    between = found.join(left, "a").join(right, "b").select(F.col("fpa").alias("a"), F.col("fpb").alias("b"))
    within = nodes.select("sim", F.col("fp").alias("b")).join(one.select("sim", F.col("fp").alias("a")), "sim").where("a <> b").select("a", "b")
    return between.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def class_counts(shingles: np.ndarray) -> np.ndarray:
    """Shingles by hash class, a quarter to a half as many classes as shingles (a power of two), 255 at most."""
    classes = 1 << max(3, (len(shingles) // 2).bit_length() - 1)
    return np.minimum(np.bincount(shingles & (classes - 1), minlength=classes), 255).astype(np.uint8)


def least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles that two sets of these class counts do not share, at the least."""
    classes = min(len(x), len(y))
    a, b = (v.astype(np.int64).reshape(-1, classes).sum(axis=0) for v in (x, y))
    return int(np.abs(a - b).sum())


def _screened(nodes: DataFrame, near: DataFrame, similarity: float, screen: type | None = None) -> DataFrame:
    """``near(a, b)`` without pairs whose class counts (or the sketches of ``screen``) rule the similarity out."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = share * (b.column(2).to_numpy() + b.column(3).to_numpy()) + 1e-6
            if screen:
                apart = screen(b.column(4).to_pylist() + b.column(5).to_pylist()).apart(np.arange(b.num_rows), np.arange(b.num_rows) + b.num_rows) if b.num_rows else []
            else:
                apart = [least_apart(*(np.frombuffer(v.as_py(), np.uint8) for v in both)) for both in zip(b.column(4), b.column(5), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(np.array(apart) <= most))

    left, right = (nodes.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}")) for c in "ab")
    return near.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long")


def _known_texts(texts: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose ``__key`` is in ``named`` and, by equal hash classes, some others: fewer texts to shuffle. A bitmap of 1 MB."""
    place = F.pmod("__key", F.lit(CLASSES))
    words = named.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(__key, {CLASSES}) % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(CLASSES // 64, np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(1).to_numpy() % CLASSES
            yield b.filter(pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return texts.select("__id", "__key", "t").mapInArrow(run, "__id long, __key long, t binary")


def _linked(docs: DataFrame, nodes: DataFrame, near: DataFrame, id_col: str, text_col: str, words: int, similarity: float, screen: type | None = None) -> DataFrame:
    """``near(a, b)`` whose whole shingle sets, of one text a node, have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                sets = [shingle_set(t.as_py(), words) for t in part.column(1)]
                first = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate(sets)))], ["fp", "shingles"])

    near = written(_screened(nodes, near, similarity, screen), "screened")
    asked = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    named = written(nodes.join(asked, "fp").select("fp", F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), F.col("text_key").alias("__key")), "named")
    texts = docs.select(id_key(id_col).alias("__id"), F.xxhash64(text_of(text_col)).alias("__key"), text_of(text_col).cast("binary").alias("t"))
    # Rows repeated with their id and text count once.
    texts = _known_texts(texts, named).dropDuplicates(["__id", "__key"])
    # Written: read for both ends.
    sets = written(texts.join(named, ["__id", "__key"]).select("fp", "t").mapInArrow(run, "fp long, shingles array<long>"), "shingles")
    left, right = (sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    shared = F.size(F.array_intersect("sa", "sb"))
    return written(near.join(left, "a").join(right, "b").where(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "linked")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """As ``near_duplicates``, for shingle sets of ``similarity`` or more, all of them; ``fp`` is the XXH64 of the set."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    width = shuffle_width(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(shingle_ranks(docs, text_col, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [shingle_set(t.as_py() or b"", words) for t in part.column(2)]
                fps = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                first = [prefix(x, ranks.value, similarity).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps), pa.array([len(x) for x in sets], pa.int64()), pa.array(first, pa.binary()), pa.array([class_counts(x).tobytes() for x in sets], pa.binary()), pa.array(np.array([majority(x) for x in sets], np.uint64).view(np.int64))], ["doc_id", "text_key", "fp", "n", "first", "counts", "sim"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys = [np.frombuffer(x.as_py(), np.int64) for x in part.column(2)]
                size = np.array([len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *[pa.array(np.repeat(part.column(i).to_numpy(), size)) for i in (0, 1)], pa.array(_within(size))], ["key", "fp", "n", "at"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"), text_of(text_col).cast("binary").alias("t"))
    rows = written(rows.mapInArrow(run, "doc_id long, text_key long, fp long, n long, first binary, counts binary, sim long"), "prefixes")
    # Equal shingle sets stand as one node.
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_key")).alias("one"), *[F.first(c).alias(c) for c in ("n", "first", "counts", "sim")])
    nodes = written(nodes.select("fp", "least_id", "one.*", "n", "first", "counts", "sim"), "nodes")
    keyed = nodes.select("fp", "n", "first").mapInArrow(spread, "key long, fp long, n long, at long")
    # Least place first: members with the fewest rare shingles of their own are nearest to the rest of a family, so they lead.
    met = keyed.repartition(width, "key").sortWithinPartitions("key", "at", "fp").mapInArrow(_leader_stage(similarity), "kind int, a long, b long, n long, at long")
    met = written(met, "met")
    near = met.where("kind = 0").select("a", "b").unionByName(_golay_pairs(nodes.select("fp", "sim"), block))
    near = written(near.distinct(), "near")
    rest = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), "n", "at")
    edges = _linked(docs, nodes, near, id_col, text_col, words, similarity)
    near = written(_across(rest, edges, similarity, block), "across")
    return _labelled(rows, nodes, edges.unionByName(_linked(docs, nodes, near, id_col, text_col, words, similarity)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``doc_id, text_key, fp, root, fingerprint, component_id``; ``root`` tells components apart.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows and
    ids each keep their row. ``component_id`` is the smallest id of the component (null only
    where all its ids are null). An empty table gives no rows; other columns are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    # Written: else the sixty keys a node would fan out in the one or two tasks that hold the small table of nodes.
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    return _labelled(rows, nodes, links(nodes.select("fp"), max_bits))


def _labelled(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges)
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    # Written, so that the join below shuffles both sides and a large component can be split.
    owner = written(member.groupBy("root").agg(F.min("least_id").alias("component_id")), "owners")
    of_fp = member.join(owner, "root").select("fp", "root", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "text_key", "fp", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay: of each component of ``found`` the row with the smallest id. Columns as given, values too.

    Components are told apart by ``root``, so unrelated texts under one id, or without id, stay each. Null ids come
    last; equal ids are ordered by text key; of rows repeated with their id and text one stays. Null and empty texts are one component.
    """
    times = found.groupBy("root", id_key("doc_id").alias("id"), "text_key").agg(F.count("*").alias("times"))
    one = times.groupBy("root").agg(F.min(F.struct("id", "text_key", "times")).alias("one"))
    stay = written(one.select(F.col("one.id").alias("stay_id"), F.col("one.text_key").alias("stay_key"), "one.times"), "stay")
    kept = docs.select(*renamed(docs.columns), id_key(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_key"))
    kept = kept.join(stay, (F.col("id") == F.col("stay_id")) & (F.col("text_key") == F.col("stay_key")))
    if not stay.where("times > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "text_key"])
    return kept.select(*given(docs.columns))
