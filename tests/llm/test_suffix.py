"""Suffix order, buckets and boundaries against plain loops."""

import random

import numpy as np
import pytest

from litloom.llm import anchored, suffix_dedup, superkmer

LETTERS = {0: "ab", 1: "abcdefgh", 2: "a"}


def passages(seed):
    """Documents that share three passages, which begin and end within different other text."""
    rng = random.Random(seed)
    letters = LETTERS[seed % 3]
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [some(130) for _ in range(3)]
    return [f"{some(rng.randrange(150))}{rng.choice(shared)[rng.randrange(20) :]}{some(rng.randrange(150))}" for _ in range(120)]


def covered(texts, k=100):
    seen, out = set(), []
    for t in texts:
        mine = set()
        for i in range(len(t) - k + 1):
            if t[i : i + k] in seen:
                mine |= set(range(i, i + k))
            seen.add(t[i : i + k])
        out.append(mine)
    return out


def test_suffix_order():
    rng = np.random.default_rng(0)
    for t in range(200):
        texts = [rng.choice([0, 97, 98], size=int(rng.integers(0, 40))).astype(np.uint8).tobytes() for _ in range(int(rng.integers(1, 60)))]
        if t % 3 == 0:
            texts = [x[: int(rng.integers(0, 4))] + b"a" * int(rng.integers(0, 30)) for x in texts]
        size = np.array([len(x) for x in texts])
        buf = np.concatenate([np.frombuffer(b"".join(texts), np.uint8), np.zeros(60, np.uint8)])
        order, lcp = suffix_dedup.suffix_order(buf, np.cumsum(size) - size, size, 40)
        assert [(texts[i].ljust(40, b"\0"), len(texts[i])) for i in order] == sorted((x.ljust(40, b"\0"), len(x)) for x in texts)
        for i in range(1, len(texts)):
            a, b = texts[order[i - 1]], texts[order[i]]
            assert lcp[i] == next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def decided(texts, boundaries):
    """Covered bytes of each text, through about sixty range buckets, with or without comparison across boundaries."""
    docs, powers = [(i, 0, t.encode(), 0) for i, t in enumerate(texts)], anchored.Powers()
    none = anchored.FrequentSet(np.zeros(0, np.uint64))
    seq = anchored.concatenated(docs, False, powers)
    lead = np.sort(suffix_dedup.prefixes(seq.buf, anchored.anchored_runs(seq, 100, 16, none)[2], suffix_dedup.DEPTH))
    splitters = np.unique(lead[:: max(1, len(lead) // 80)])
    held, rows, still = {}, [], {}
    for part in anchored.slices(iter(docs), 3000):
        pieces, now = anchored.map_slice(part, 100, 16, False, none, lambda buf, at, _: np.searchsorted(splitters, suffix_dedup.prefixes(buf, at, suffix_dedup.DEPTH), "right"), True, powers)
        rows += zip(*(c.tolist() for c in now), strict=True)
        for b, p in pieces:
            held.setdefault(b, []).append(p)
    for b, pieces in held.items():
        piece, _, now = anchored.combined(pieces, 100, True)
        rows += zip(*(c.tolist() for c in now), strict=True) if now else []
        ends = bytes(splitters[b - 1]) if b else None, bytes(splitters[b]) if b < len(splitters) else None
        for cols, windows in suffix_dedup.decide_bucket([anchored.pack([piece])], 100, 16, *ends):
            found = list(zip(*(c.tolist() for c in cols), strict=True))
            if windows is None:
                rows += found
            else:
                for x, w in zip(found, windows, strict=True):
                    still.setdefault(w, set()).add(x)
    if boundaries:
        rows += [x for v in still.values() for x in sorted(v)[1:]]
    out = [set() for _ in texts]
    for d, _, first, units in rows:
        out[d] |= set(range(first, first + units))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_buckets_and_boundaries(seed):
    texts = passages(seed)
    assert decided(texts, True) == covered(texts)


def test_boundaries_are_needed():
    texts = passages(0)
    assert decided(texts, False) != covered(texts)


def test_boundaries_in_spark(spark, monkeypatch):
    texts = passages(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    def removed():
        return {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs, slice_bytes=3000, buckets=400).collect()}

    want = {i: len(c) for i, c in enumerate(covered(texts))}
    assert removed() == want
    true = suffix_dedup.across_boundaries
    monkeypatch.setattr(suffix_dedup, "across_boundaries", lambda found: true(found).limit(0))
    assert removed() != want


def test_strings_met_most_often_stay():
    sizes, times = [np.array([10, 500]), np.array([20]), np.array([30, 40])], [np.array([9, 8]), np.array([1]), np.array([7, 2])]
    stay = [v.tolist() for v in anchored.met_most(sizes, times, 700)]
    assert stay == [[True, True], [False], [True, False]]  # 45 bytes a string besides its text
    assert [v.tolist() for v in anchored.met_most(sizes, times, 0)] == [[False, False], [False], [False, False]]


@pytest.mark.parametrize("keep_first", [True, False])
def test_a_shared_string_is_sent_once_a_task(keep_first):
    """With blocks given up after every second slice, a passage of all documents is sent once, not once a block; without room it is sent each time."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = some(300)
    docs = [(i, 0, (some(150) + shared + some(150)).encode(), 0) for i in range(60)]
    none, code = anchored.FrequentSet(np.zeros(0, np.uint64)), np.zeros(1, np.int64)

    def copies(room):
        held, sent, powers = {}, [], anchored.Powers()

        def given_up(room):
            out = yield from anchored._blocks(held, 100, keep_first, code, room)
            left.update(out)

        for at, part in enumerate(anchored.slices(iter(docs), 2000)):
            pieces, _ = anchored.map_slice(part, 100, 16, False, none, lambda buf, at, g: (g % np.uint64(7)).astype(np.int64), keep_first, powers)
            for b, p in pieces:
                held.setdefault(b, []).append(p)
            if at % 2:
                left = {}
                sent += given_up(room)
                held = left
        left = {}
        sent += given_up(0)
        assert not left
        inner = shared.encode()[100:200]
        blocks = [b for batch in sent for b in batch.column("block").to_pylist() if b is not None]
        return sum(anchored.unpack(b)[0].count(inner) for b in blocks)

    once, always = copies(1 << 20), copies(0)
    assert once <= 2 and always >= 7


@pytest.mark.parametrize("seed", range(3))
def test_strings_that_stay_in_spark(spark, monkeypatch, seed):
    """Both users of the packed strings against plain loops, with blocks given up often and strings staying in between."""
    monkeypatch.setattr(anchored, "HELD", 30_000)
    monkeypatch.setattr(anchored, "STAYING", 10_000)
    texts = passages(seed) + passages(seed + 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs, slice_bytes=1500, buckets=9).collect()}
    assert got == {i: len(c) for i, c in enumerate(covered(texts))}
    lines = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    at = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - 34):
            at.setdefault(t[j : j + 35], []).append((i, j))
    gone = [set() for _ in texts]
    for places in at.values():
        for i, j in places if len(places) > 1 else []:
            gone[i] |= set(range(j, j + 35))
    got = {r.doc_id: r.n_removed for r in superkmer.remove_repeats(docs, slice_bytes=1500).collect()}
    assert got == {i: len(g) for i, g in enumerate(gone)}


def test_splitters_are_quantiles(spark):
    """The driver gets about a value a splitter, evenly over the anchors, also over several range partitions."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(4000)) for _ in range(60)]
    rows = spark.createDataFrame([(i, 0, t.encode()) for i, t in enumerate(texts)], "doc long, key long, text binary")
    _, cuts = anchored.sampled_anchors(rows, 240_000, 100, 16, False, 1 << 24, 32, 32, 19)
    _, every = anchored.sampled_anchors(rows, 240_000, 100, 16, False, 1 << 24, 32, 32, 1 << 20)
    assert 15 <= len(cuts) <= 20 and len(every) > 3000
    share = np.diff(np.concatenate([[0], np.searchsorted(every, cuts), [len(every)]])) / len(every)
    assert share.max() < 2 / 19


def test_partitions_follow_the_buckets():
    """A terabyte is shared by as many tasks as its buckets need, however few shuffle partitions the session names; small inputs keep the session's number."""
    buckets = anchored.bucket_count(1 << 40, 50)
    assert anchored.partition_count(buckets, 50) * anchored.PARTITION_BUCKETS >= buckets > 100_000
    assert anchored.partition_count(anchored.bucket_count(1 << 20, 50), 50) == 50
