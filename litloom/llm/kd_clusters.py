"""Centroid clustering by kd-tree filtering.

Vectors become integer rows and each task puts its rows, a few thousand at a time, into kd-trees, which are
written once. A node holds the count, the integer sums and the bounding box of its vectors. A round broadcasts
the centroids (their number is a parameter) and walks the trees level by level:

* among the centroids a node still has, the one nearest to the box's middle is taken; every other one that is
  strictly farther than it from all points of the box is pruned (the difference of two squared distances is
  linear, so one corner of the box decides);
* a node with one centroid left goes to it whole, by its count and sums;
* vectors of leaves with several are compared with those that are left.

All arithmetic is exact: integers in doubles while every product fits 53 bits, else 64-bit integers. Ties
are never pruned, as only strictly dominated centroids go, so the smaller number wins as asked.
Nothing but one row a centroid reaches the driver in a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litloom.llm.common import quoted, written
from litloom.llm.vector_rows import blobs, floors, matrix, means, stacked

#: Vectors in one tree and in one leaf, at most (a leaf of equal vectors may hold more).
TREE = 4096
LEAF = 32
#: Bound of integer components; below ``_EXACT`` doubles hold every product exactly.
MOST = 1 << 26
_EXACT = 1 << 21


def grow(points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A kd-tree of integer rows: ``order`` of the rows and, for each node, ``span`` (first row, end), ``child`` (left and
    right, or -1), ``low``, ``high`` and ``total``. Split at the median of the widest dimension; equal rows are not split."""
    order = np.arange(len(points))
    span, child, low, high, total = [], [], [], [], []
    todo = [(0, len(points), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        rows = points[order[a:b]]
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        me = len(span)
        if parent >= 0:
            child[parent][side] = me
        span.append((a, b))
        child.append([-1, -1])
        low.append(lo)
        high.append(hi)
        total.append(rows.sum(axis=0, dtype=np.int64))
        wide = hi.astype(np.int64) - lo
        if b - a > leaf and wide.any():
            d, half = int(wide.argmax()), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows[:, d], half)]
            todo += [(a, a + half, me, 0), (a + half, b, me, 1)]
    return {
        "order": order.astype(np.int32), "span": np.array(span, np.int32), "child": np.array(child, np.int32),
        "low": np.array(low, np.int32), "high": np.array(high, np.int32), "total": np.array(total, np.int64),
    }


class Walk:
    """One round over one tree. ``whole``: (node, centroid); ``rows`` and ``own``: vectors compared one by one and their centroids;
    ``compared``: distances computed."""

    def __init__(self, points: np.ndarray, tree: dict[str, np.ndarray], centroids: np.ndarray) -> None:
        """``points`` in the order of the tree."""
        k = len(centroids)
        most = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
        kind = np.float64 if most < _EXACT else np.int64
        c = centroids.astype(kind)
        norm = (c * c).sum(axis=1)
        self.whole: list[tuple[int, int]] = []
        self.compared = 0
        rows, left = [], []
        nodes, may = np.zeros(1, np.int64), np.ones((1, k), bool)
        big = np.iinfo(np.int64).max if kind is np.int64 else np.inf
        while len(nodes):
            lo, hi = tree["low"][nodes].astype(kind), tree["high"][nodes].astype(kind)
            at = (lo + hi) @ c.T  # twice the middle, times each centroid
            near = np.where(may, norm - at, big).argmin(axis=1)
            reach = np.matmul(np.abs(c[None] - c[near][:, None]), (hi - lo)[:, :, None])[:, :, 0]
            each = np.arange(len(nodes))
            # The most that |x - near|^2 - |x - other|^2 comes to in the box: below zero, the other is dominated.
            gain = norm[near][:, None] - norm[None] + at - at[each, near][:, None] + reach
            may &= gain >= 0
            may[each, near] = True
            alone = may.sum(axis=1) == 1
            self.whole += zip(nodes[alone].tolist(), near[alone].tolist(), strict=True)
            ends = ~alone & (tree["child"][nodes, 0] < 0)
            for i in np.flatnonzero(ends).tolist():
                a, b = tree["span"][nodes[i]]
                rows.append(np.arange(a, b))
                left.append(np.broadcast_to(may[i], (b - a, k)))
            inner = ~alone & ~ends
            nodes, may = tree["child"][nodes[inner]].reshape(-1).astype(np.int64), np.repeat(may[inner], 2, axis=0)
        self.rows = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        self.own = np.zeros(0, np.int64)
        if len(self.rows):
            may = np.concatenate(left)
            some = np.flatnonzero(may.any(axis=0))
            d = norm[some] - 2 * (points[self.rows].astype(kind) @ c[some].T)
            self.compared = int(may.sum())
            self.own = some[np.where(may[:, some], d, big).argmin(axis=1)]

    def sums(self, points: np.ndarray, tree: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Count and componentwise sum of each centroid's vectors."""
        count, total = np.zeros(k, np.int64), np.zeros((k, points.shape[1]), np.int64)
        for node, c in self.whole:
            a, b = tree["span"][node]
            count[c] += b - a
            total[c] += tree["total"][node]
        np.add.at(total, self.own, points[self.rows].astype(np.int64))
        count += np.bincount(self.own, minlength=k)
        return count, total

    def owners(self, tree: dict[str, np.ndarray], n: int) -> np.ndarray:
        """The centroid of each of the tree's ``n`` vectors."""
        out = np.empty(n, np.int64)
        for node, c in self.whole:
            a, b = tree["span"][node]
            out[a:b] = c
        out[self.rows] = self.own
        return out


_PARTS = {"span": ("<i4", 2), "child": ("<i4", 2), "low": ("<i4", 0), "high": ("<i4", 0), "total": ("<i8", 0)}
_SCHEMA = T.StructType([T.StructField(c, T.BinaryType()) for c in ("ids", "points", *_PARTS)])


def _planted(rows: DataFrame, dimensions: int, size: int, leaf: int) -> DataFrame:
    """``(vec_id, q)`` -> a row a tree: ids (with their validity), points in the order of the tree, and its nodes."""
    names = _SCHEMA.names

    def tree_row(ids: list[int | None], q: np.ndarray) -> pa.RecordBatch:
        t = grow(q, leaf)
        named = np.array([0 if ids[i] is None else ids[i] for i in t["order"]], "<i8")
        valid = np.array([ids[i] is not None for i in t["order"]], np.uint8)
        parts = [named.tobytes() + valid.tobytes(), np.ascontiguousarray(q[t["order"]], "<i4").tobytes(), *(t[c].astype(kind).tobytes() for c, (kind, _) in _PARTS.items())]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in parts], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], np.zeros((0, dimensions), np.int32)
        for b in batches:
            ids += b.column(0).to_pylist()
            held = np.concatenate([held, stacked(b.column(1), dimensions)])
            while len(ids) >= size:
                yield tree_row(ids[:size], held[:size])
                ids, held = ids[size:], held[size:]
        if ids:
            yield tree_row(ids, held)

    return rows.mapInArrow(run, _SCHEMA)


def _read(b: pa.RecordBatch, i: int, dimensions: int) -> tuple[bytes, np.ndarray, dict[str, np.ndarray]]:
    ids, points, *parts = (c[i].as_py() for c in b.columns)
    tree = {c: np.frombuffer(v, kind).reshape(-1, width or dimensions) for v, (c, (kind, width)) in zip(parts, _PARTS.items(), strict=True)}
    return ids, np.frombuffer(points, "<i4").reshape(-1, dimensions), tree


def _round(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and sums of the vectors of every centroid that has any: at most a row a centroid."""
    k, dimensions = centroids.shape
    shared = trees.sparkSession.sparkContext.broadcast(centroids)
    sums = [f"s{i}" for i in range(dimensions)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                _, points, tree = _read(b, i, dimensions)
                n, s = Walk(points, tree, shared.value).sums(points, tree, k)
                count += n
                total += s
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), *(pa.array(total[some, j]) for j in range(dimensions))], ["cluster", "n", *sums])

    schema = "cluster int, n long, " + ", ".join(f"{c} long" for c in sums)
    found = trees.mapInArrow(run, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums]).collect()
    shared.unpersist()
    return {r["cluster"]: (r["n"], [r[c] for c in sums]) for r in found}


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    dimensions = centroids.shape[1]
    shared = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, points, tree = _read(b, i, dimensions)
                n = len(points)
                own = Walk(points, tree, shared.value).owners(tree, n)
                apart = points.astype(np.int64) - shared.value[own]
                valid = np.frombuffer(ids, np.uint8, n, 8 * n) == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(ids, "<i8", n), mask=valid), pa.array(own.astype(np.int32)), pa.array((apart * apart).sum(axis=1))], ["vec_id", "cluster", "distance"]
                )

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = 64, scale: int = 256,
    clusters: int = 40, rounds: int = 5, seed: int = 2, tree: int = TREE, leaf: int = LEAF,
) -> DataFrame:
    """One row per vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors that are null, of another length, or hold a null or non-finite component are left out. Components
    become floor(scale * x); above 2**26 they are refused, as sums of squares would not fit 64 bits. The first
    centroids are the vectors of least sha256 of ``seed:id``; ids tied or repeated are ordered by their vectors, null
    ids come last. With fewer vectors than ``clusters`` each is a centroid. Repeated rows each keep theirs, a null id too;
    a centroid without vectors stays where it is; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = matrix(b.column(1), dimensions)
            if len(rows):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), blobs(floors(np.stack(x), scale, MOST))], ["vec_id", "q"])

    given = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).cast("array<double>").alias("x"))
    rows = written(given.mapInArrow(whole, "vec_id long, q binary"), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "q").limit(clusters).select("q").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([np.frombuffer(r["q"], "<i4") for r in first], np.int64)
    trees = written(_planted(rows, dimensions, tree, leaf), "trees")
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (n, s) in _round(trees, centroids).items():
            centroids[c] = means(s, n)
    out = written(_assigned(trees, centroids), "assigned")
    inertia = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in inertia}
    # A row a cluster.
    known = spark.createDataFrame([(c, d, sum(inertia.values()), digest[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
