"""Min-max hashing against brute force over whole shingle sets."""

import random
import re

import numpy as np
import pytest

from litloom.llm import minmax_hash

SCHEMA = "doc_id long, text string, n_chars long, root string, fp string"


def shingles(text, n=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        c = min((d for d in least[find(i)] if d is not None), default=None)
        out.append((r[0], len(sets[i]), c, c == r[0]))
    return sorted(out, key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, None, "x", "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in minmax_hash.near_duplicates(df, **more).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(rng, words, places):
    out = list(words)
    for p in places:
        out[p] = f"e{rng.randrange(1 << 40)}"
    return out


def corpus(seed):
    rng, texts = random.Random(seed), []
    new = lambda n: [f"w{rng.randrange(1 << 30)}" for _ in range(n)]
    for n in (1, 2, 3, 4, 5, 8, 9, 12, 13, 40, 200, 900):
        w = new(n)
        texts += [w, w, w[: max(1, n - 1)], [*w, "more"], [x.upper() for x in w], w[: n - n // 6] or w]
    base = new(300)
    texts += [edited(rng, base, [20 + rng.randrange(10)]) for _ in range(60)]
    near = edited(rng, base, [60])
    texts += [near, edited(rng, near, [170, 190, 210, 230, 250, 270])]
    passage = new(60)
    texts += [new(20) + passage + new(20) for _ in range(20)]
    out = [" ".join(t) for t in texts] + [None, "", " \n\t", None, "x" * 3000, "a b\x0bc\td", "a b c d", "é É ü", "\x00 a", " ".join(new(6000))]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows + [rows[0], (None, rows[1][1]), (None, None), (5, rows[2][1]), (None, "nothing like any other one here")]


@pytest.mark.parametrize("seed, block", [(1, 20_000), (2, 7)])
def test_components(spark, seed, block):
    rows = corpus(seed)
    assert found(spark, rows, block=block) == brute(rows)


def test_pairs_at_the_limit(spark):
    rng, rows = random.Random(4), []
    for k in range(300):
        w = [f"w{rng.randrange(1 << 30)}" for _ in range(60 + k)]
        cut = (len(w) - 3) * (18 + k % 4) // 100
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: len(w) - cut]))]
    want = brute(rows)
    assert found(spark, rows) == want
    assert 150 < sum(not r[3] for r in want) < 300


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choice(["Ab", "cd", "é", "f" * 40]) + str(rng.randrange(200)) for _ in range(5000)).encode()
    whole = minmax_hash.shingle_sets([b"a b", text, b""])
    monkeypatch.setattr(minmax_hash, "SLICE", 1 << 10)
    assert all((a == b).all() for a, b in zip(whole, minmax_hash.shingle_sets([b"a b", text, b""]), strict=True))
    assert [len(s) for s in whole] == [1, len(shingles(text.decode())), 0]


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_estimate_is_unbiased_and_steadier_than_minima():
    """Both ends of 64 permutations against the minima of as many hash evaluations, and of twice as many."""
    rng = np.random.default_rng(1)
    both, minima, more = [], [], []
    hashing, twice = minmax_hash.MinMax(), minmax_hash.MinMax(128)
    for _ in range(400):
        x = rng.integers(-(1 << 62), 1 << 62, 60)
        pair = [np.unique(x[:50]), np.unique(x[10:])]  # similarity 40 / 60
        v, w = hashing.values(pair), twice.values(pair)
        both.append(hashing.similarity(*v))
        minima.append(hashing.similarity(*v[:, :64]))
        more.append(hashing.similarity(*w[:, :128]))
    assert abs(np.mean(both) - 2 / 3) < 0.01
    assert np.var(both) < 0.75 * np.var(minima) and np.var(both) < 1.15 * np.var(more)


def test_parities_never_overstate_and_are_close():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(-(1 << 62), 1 << 62, n)) for n in (3, 9, 40, 44, 90, 300, 700, 20_000)]
    sets += [np.concatenate([s[: len(s) // 2], rng.integers(-(1 << 62), 1 << 62, 5)]) for s in sets]
    x, y = (v.reshape(-1) for v in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    got = minmax_hash.Parities([minmax_hash.parities(s) for s in sets]).apart(x, y)
    true = np.array([len(set(sets[i].tolist()) ^ set(sets[j].tolist())) for i, j in zip(x, y, strict=True)])
    assert (got <= true).all() and (got[x == y] == 0).all()
    near = np.array([0.5 <= len(sets[i]) / len(sets[j]) <= 2 and i != j and 40 <= len(sets[i]) < 5000 for i, j in zip(x, y, strict=True)])
    assert near.sum() > 20 and (got[near] >= 0.5 * true[near]).all()


def test_buckets_across_batches():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(3).integers(0, 60, 100))
    rows = [(int(k), i, 1) for i, k in enumerate(keys)]
    want = sorted(r for r in rows if sum(r[0] == q[0] for q in rows) > 1)
    for size in (1, 2, 3, 100):
        parts = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], ["key", "fp", "n"]) for i in range(0, len(rows), size)]
        out = [r for b in minmax_hash._paired(iter(parts)) for r in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)]
        assert sorted(out) == want
