"""Clustering and vector codes against plain integer loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from litloom.llm import kd_clusters, product_codes

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, code string"


def kept(rows, dims=None):
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [r for r in ok if dims is None or len(r[1]) == dims]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(v, centres):
    d = [apart(v, c) for c in centres]
    return d.index(min(d)), min(d)


def lloyd(vectors, centres, rounds):
    for _ in range(rounds):
        own = [nearest(v, centres)[0] for v in vectors]
        centres = [[sum(x) // own.count(c) for x in zip(*(v for v, o in zip(vectors, own, strict=True) if o == c), strict=True)] if c in own else old for c, old in enumerate(centres)]
    return centres


def table(seed, dims, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(120):
        c = rng.choice(centres)
        rows.append((i, [x + rng.uniform(-spread, spread) for x in c], rng.choice([1, 2, None])))
    rows += [(200 + i, rows[7][1], 1) for i in range(50)]  # copies
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 2), (None, rows[9][1], 3), (None, [0.0] * dims, None)]
    rows += [(300, None, 1), (301, [0.0] * (dims - 1) + [None], 1), (302, [math.nan] * dims, 1), (303, [math.inf] + [0.0] * (dims - 1), 1), (304, [1.0] * (dims + 1), 1), (305, [], 1)]
    return [(*r, "x", "y") for r in rows]


def brute_clusters(rows, dims, k, rounds, seed, scale):
    rows = kept(rows, dims)
    vectors = [[math.floor(scale * x) for x in r[1]] for r in rows]
    name = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    packed = lambda v: np.array(v, "<i4").tobytes()
    first = sorted(range(len(rows)), key=lambda i: (name(rows[i][0]), packed(vectors[i])))[:k]
    centres = lloyd(vectors, [vectors[i] for i in first], rounds)
    found = [nearest(v, centres) for v in vectors]
    return [
        (r[0], c, d, sum(e for o, e in found if o == c), sum(e for _, e in found), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
        for r, (c, d) in zip(rows, found, strict=True)
    ]


@pytest.mark.parametrize("size, leaf", [(4096, 32), (40, 3), (7, 1)])
@pytest.mark.parametrize("dims, k, spread", [(3, 8, 0.2), (5, 12, 2.0)])
def test_clusters(spark, size, leaf, dims, k, spread):
    rows = table(dims, dims, spread)
    got = kd_clusters.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), dimensions=dims, clusters=k, rounds=3, tree=size, leaf=leaf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_clusters(rows, dims, k, 3, 2, 256), key=repr)


def test_clusters_of_few_and_none(spark):
    rows = table(1, 4)
    few = rows[:3] + rows[-6:]
    got = kd_clusters.cluster(spark.createDataFrame(few, SCHEMA), dimensions=4).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_clusters(few, 4, 40, 5, 2, 256), key=repr)
    for none in ([], rows[-6:-2]):
        out = kd_clusters.cluster(spark.createDataFrame(none, SCHEMA), dimensions=4)
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not out.count()
    with pytest.raises(Exception, match="not supported"):
        kd_clusters.cluster(spark.createDataFrame([(1, [1e9] * 4, 1, "", "")], SCHEMA), dimensions=4).collect()


@pytest.mark.parametrize("scale", [1 << 8, 1 << 23])
def test_walk_prunes_and_is_exact(scale):
    rng = np.random.default_rng(3)
    centres = rng.uniform(-1, 1, (40, 8))
    near = centres[rng.integers(40, size=3000)] + rng.normal(0, 0.02, (3000, 8))
    for x in (near, rng.uniform(-1, 1, (3000, 8)), np.repeat(near[:3], 900, axis=0)):
        q, c = np.floor(x * scale).astype(np.int32), np.floor(centres * scale).astype(np.int64)
        c[7] = c[3]  # a tie everywhere: the smaller number wins
        tree = kd_clusters.grow(q)
        p = q[tree["order"]]
        walk = kd_clusters.Walk(p, tree, c)
        d = ((p.astype(np.int64)[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        assert (walk.owners(tree, len(p)) == own).all() and 7 not in own
        count, total = walk.sums(p, tree, 40)
        assert (count == np.bincount(own, minlength=40)).all()
        assert all((total[k] == p[own == k].astype(np.int64).sum(axis=0)).all() for k in range(40))
        assert walk.compared < d.size
        if x is near:
            assert walk.compared < 0.1 * d.size and len(walk.whole) > 30


def brute_codes(rows, dims, parts, entries, rounds, scale):
    rows = kept(rows, dims)
    vectors = [[math.floor(scale * x) for x in r[1]] for r in rows]
    packed = lambda v: np.array(v, "<i4").tobytes()
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, packed(vectors[i])))[:entries]
    w = dims // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [lloyd([cut(v, p) for v in vectors], [cut(vectors[i], p) for i in first], rounds) for p in range(parts)]
    found = [[nearest(cut(v, p), books[p]) for p in range(parts)] for v in vectors]
    error = [sum(d for _, d in f) for f in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [
        (r[0], "".join(f"{i:02x}" for i, _ in f), e, sum(x for x, s in zip(error, rows, strict=True) if s[2] == r[2]), digest)
        for r, f, e in zip(rows, found, error, strict=True)
    ]


@pytest.mark.parametrize("dims, parts, entries", [(8, 4, 16), (12, 4, 256), (4, 4, 5), (6, 2, 30)])
def test_codes(spark, dims, parts, entries):
    rows = table(dims, dims)
    got = product_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=parts, entries=entries, rounds=3).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_codes(rows, dims, parts, entries, 3, 1024), key=repr)


def test_codes_of_none(spark):
    for none in ([], table(1, 8)[-6:-2]):
        out = product_codes.compress(spark.createDataFrame(none, SCHEMA))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not out.count()
    assert product_codes.compress(spark.createDataFrame([(1, [], None, "", "")], SCHEMA)).collect()[0][:4] == (1, "00000000", 0, 0)


@pytest.mark.parametrize("big", [500, 1 << 23])
def test_partial_distances_drop_entries_and_are_exact(big):
    rng = np.random.default_rng(5)
    entries = rng.integers(-big, big, (256, 16))
    entries[200] = entries[11]
    for x in (rng.integers(-big, big, (1500, 16)), entries[rng.integers(256, size=1500)] + rng.integers(-big // 50, big // 50, (1500, 16))):
        book = product_codes.Codebook(entries)
        number, distance = book.nearest(x.astype(np.int32))
        d = ((x[:, None].astype(np.int64) - entries[None]) ** 2).sum(axis=2)
        assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        assert book.steps < 0.8 * d.size * 16
    assert book.steps < 0.4 * d.size * 16
    assert (np.diff(entries.var(axis=0)[book.order]) <= 0).all()
