"""Vector collection: encoders, cosine top-k, similarity joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.sources.shared import written

#: Values of a vector block that may be broadcast (64 MB as doubles); larger sides are joined block by block.
BROADCAST_VALUES = 8 << 20
BLOCK = 4096
#: Groups of vectors around pivots, at most; larger tables have more blocks a group.
MOST_PIVOTS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, unit_query: Column) -> Column:
    """Similarity to a query of length one: one product and one norm a row. A zero vector scores 0."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.coalesce(dot(vector, unit_query) / F.nullif(norm, F.lit(0.0)), F.lit(0.0))


def hashing_encoder(dim: int = 64) -> Callable:
    """Offline stand-in for a sentence encoder: hashed word counts, deterministic, loaded once a worker."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for texts in batches:
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                for w in (t or "").lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    out[i, h % dim] += 1 if h >> 63 else -1
            yield pd.Series(list(out))

    return encode


def embed(payloads: DataFrame, encode: Callable | None = None, vectors: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """Points: payloads with an ``embedding``, from an encoder UDF or a table ``(text, embedding)``; ``dim`` is asserted."""
    out = payloads.withColumn("embedding", encode(F.col("text"))) if encode else payloads.join(vectors.select("text", "embedding"), "text")
    if dim:
        out = out.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit("embedding of another dimension"))))
    return out


def search(points: DataFrame, query: list[float], top_k: int = 10, domain: str | None = None) -> DataFrame:
    """``text, paper_ids, domain, score``: the nearest points, filtered by domain before the cut. Plain expressions, no Python."""
    norm = math.sqrt(sum(x * x for x in query)) or 1.0
    q = F.array(*[F.lit(float(x) / norm) for x in query])
    rows = points.where(F.col("domain") == domain) if domain is not None else points
    return rows.select("text", "paper_ids", "domain", cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "text", "domain").limit(top_k)


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    flat = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(n, -1) if n and len(flat) else np.zeros((n, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def best(l: np.ndarray, r: np.ndarray, sim: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``limit`` hits of each left id by similarity, then right id."""
    order = np.lexsort((r, -sim, l))
    l, r, sim = l[order], r[order], sim[order]
    start = np.flatnonzero(np.concatenate([[True], l[1:] != l[:-1]])) if len(l) else np.zeros(0, np.int64)
    place = np.arange(len(l)) - np.repeat(start, np.diff(np.append(start, len(l))))
    stay = place < limit
    return l[stay], r[stay], sim[stay]


def products(l_ids: np.ndarray, a: np.ndarray, r_ids: np.ndarray, b: np.ndarray, threshold: float, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Hits of rows ``a`` among rows ``b``, a batch a product of 32 MB; with ``limit`` the best of each row over all of ``b``, and never
    more than twice as many held."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for at in range(0, len(l_ids), 1024):
        held, most = none, 2 * (limit or 0) * min(1024, len(l_ids) - at)
        for to in range(0, len(r_ids), 4096):
            s = a[at : at + 1024] @ b[to : to + 4096].T
            i, j = np.nonzero(s >= threshold)
            hits = (l_ids[at + i], r_ids[to + j], s[i, j])
            if limit is None:
                yield _hits(hits)
            else:
                held = tuple(np.concatenate(x) for x in zip(held, best(*hits, limit), strict=True))
                if len(held[0]) > most:
                    held = best(*held, limit)
        if limit is not None:
            yield _hits(best(*held, limit))


def _hits(hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hits[0], pa.int64()), pa.array(hits[1], pa.int64()), pa.array(hits[2], pa.float64())], ["l", "r", "sim"])


def similar_pairs(
    left: DataFrame, right: DataFrame, threshold: float, broadcast_values: int = BROADCAST_VALUES, block: int = BLOCK, limit: int | None = None,
) -> DataFrame:
    """``left(l long, vec)``, ``right(r long, vec)`` -> ``(l, r, sim)`` with cosine ``threshold`` or more.

    Exact blocked matrix products. The right side is broadcast if its size, counted first, is
    within the bound. Else both sides are cut into blocks around pivots, and each pair of blocks that can hold a
    hit is one task: with centroid angle c and radii u and v no pair in them is nearer than c - u - v, so others are skipped
    without loss. ``limit`` keeps the best hits of each left id, ties by right id; rows that leave a task are then at most
    ``limit`` a left id and block.
    """
    spark = left.sparkSession
    size = right.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0)), F.count("*")).first()
    schema = "l long, r long, sim double"
    if size[0] <= broadcast_values:
        rows = right.select("r", "vec").toArrow()
        shared = spark.sparkContext.broadcast((rows.column("r").to_numpy().astype(np.int64), _matrix(rows.column("vec"))))

        def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r_ids, b = shared.value
            for x in batches:
                yield from products(x.column(0).to_numpy(), _matrix(x.column(1)), r_ids, b, threshold, limit)

        return left.select("l", "vec").mapInArrow(against, schema)

    def cell(t: pa.Table) -> pa.Table:
        side, ids, m = t.column("side").to_numpy(), t.column("id").to_numpy(), _matrix(t.column("vec"))
        out = [_hits((np.zeros(0, np.int64),) * 2 + (np.zeros(0),)), *products(ids[side == 0], m[side == 0], ids[side == 1], m[side == 1], threshold, limit)]
        return pa.Table.from_batches(out)

    found = _cells(left, right, threshold, block).groupBy("cell").applyInArrow(cell, schema)
    return found if limit is None else neighbours(found, limit).drop("pos")


def _pivoted(side: DataFrame, name: str, pivots: np.ndarray) -> DataFrame:
    """``id, vec, grp, angle``: the nearest pivot of each vector and the angle to it; vectors of length zero are a group of their own, the last."""
    shared = side.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            m = _matrix(b.column(1))
            s = m @ p.T
            grp = s.argmax(axis=1)
            angle = np.arccos(np.clip(s[np.arange(len(m)), grp], -1, 1))
            empty = ~m.any(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.where(empty, len(p), grp).astype(np.int32)), pa.array(np.where(empty, np.pi, angle))], ["id", "vec", "grp", "angle"])

    rows = side.select(F.col(name).cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return written(rows.mapInArrow(run, "id long, vec array<double>, grp int, angle double"), "pivoted")


def surviving(pivots: np.ndarray, left: dict[int, tuple[int, float]], right: dict[int, tuple[int, float]], threshold: float) -> list[tuple[int, int]]:
    """Pairs of groups ``{group: (size, radius)}`` that may hold a hit. Group ``len(pivots)`` has the vectors without direction, which have cosine 0."""
    most = np.arccos(np.clip(threshold, -1, 1)) + 1e-6
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    own = len(pivots)
    near = lambda i, j: threshold <= 0 if own in (i, j) else between[i, j] - left[i][1] - right[j][1] <= most
    return [(i, j) for i in left for j in right if near(i, j)]


def _cells(left: DataFrame, right: DataFrame, threshold: float, block: int) -> DataFrame:
    """``cell, side, id, vec``: every pair of blocks that may hold a hit, with the rows of both."""
    spark = left.sparkSession
    wanted = min(MOST_PIVOTS, max(1, -(-right.count() // block)))
    drawn = right.where(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("r", F.lit(3)), "r").limit(wanted).select("vec").toArrow()
    pivots = _matrix(drawn.column("vec")) if drawn.num_rows else np.ones((1, 1))
    sides = [_pivoted(left, "l", pivots), _pivoted(right, "r", pivots)]
    stats = [{r["grp"]: (r["n"], r["radius"]) for r in s.groupBy("grp").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()} for s in sides]
    cut = [{g: -(-n // block) for g, (n, _) in s.items()} for s in stats]  # a large group is several blocks
    kept = surviving(pivots, *stats, threshold)
    out = []
    for side, (rows, blocks) in enumerate(zip(sides, cut, strict=True)):
        # At most the square of the pivots' number.
        meets = spark.createDataFrame([(p[side], *p, blocks[p[side]], cut[1 - side][p[1 - side]]) for p in kept], "of int, i int, j int, mine int, other int")
        one = rows.join(F.broadcast(meets), rows["grp"] == meets["of"]).withColumn("m", F.pmod(F.xxhash64("id"), "mine"))
        one = one.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other").cast("long") - 1)))
        a, b = ("m", "o") if side == 0 else ("o", "m")
        out.append(one.select(F.concat_ws(":", "i", a, "j", b).alias("cell"), F.lit(side).alias("side"), "id", "vec"))
    return out[0].unionByName(out[1])


def neighbours(pairs: DataFrame, limit: int, right_text: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` hits of each left id by similarity, then right id; adds ``pos`` from 1."""
    w = Window.partitionBy("l").orderBy(F.desc("sim"), "r")
    return pairs.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)


def first_hits(hits: DataFrame, limit: int, bins: int = 4096) -> DataFrame:
    """``hits(l, r, sim)``: the first ``limit`` of each ``l`` by similarity (to twelve decimals), then ``r``, for limits of any size.

    Counts of narrow bands of similarity say which bands of an ``l`` stay whole; only the band in which the limit falls is put in order.
    """
    hits = written(hits, "ties")
    if hits.groupBy("l").count().where(F.col("count") > limit).isEmpty():
        return hits
    sim = F.round("sim", 12)
    rows = hits.withColumn("band", F.floor(sim * bins))
    before = Window.partitionBy("l").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("l", "band").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bands = written(bands.where(F.col("before") < limit), "bands")  # at most ``bins`` and as many again an ``l``
    whole = rows.join(bands.where(F.col("before") + F.col("n") <= limit).select("l", "band"), ["l", "band"], "left_semi").select("l", "r", "sim")
    cut = rows.join(bands.where(F.col("before") + F.col("n") > limit), ["l", "band"])
    cut = cut.withColumn("pos", F.row_number().over(Window.partitionBy("l").orderBy(F.desc(sim), "r")))
    return whole.unionByName(cut.where(F.col("before") + F.col("pos") <= limit).select("l", "r", "sim"))


def materialised_pairs(*args, **kwargs) -> DataFrame:
    return written(similar_pairs(*args, **kwargs), "pairs")
