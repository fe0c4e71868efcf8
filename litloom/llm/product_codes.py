"""Vector code compression: product codes, found by partial-distance search.

Vectors become integer rows, cut into equal parts; each part position has a codebook trained by a few rounds of
assignment and exact means. The nearest entry is found over dimensions in descending variance of the codebook:

* the distance over the first few dimensions is taken for all entries, and the entry that leads is completed:
  the current best complete distance;
* entries whose partial distance strictly exceeds it are dropped by a mask, what remains goes on dimension by dimension, and
  once in between the leading entry is completed again.

Partial sums of squares only grow, so no entry that is nearest, or ties with it, is ever dropped.
The codebooks (parts x entries) are what is broadcast and what returns from a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.common import quoted, written
from litloom.llm.vector_rows import blobs, floors, matrix, means, stacked

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bound of integer components: squares over a part of up to 2**12 dimensions fit 64 bits.
MOST = 1 << 24
#: Vectors searched at once.
_BLOCK = 512


class Codebook:
    """Entries of one part with their dimensions in descending variance."""

    def __init__(self, entries: np.ndarray) -> None:
        self.order = np.argsort(-entries.astype(np.float64).var(axis=0), kind="stable")
        self.entries = entries[:, self.order].astype(np.int64)
        #: Partial distances computed so far.
        self.steps = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest entry of each row; ties go to the lower number."""
        number, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), _BLOCK):
            number[at : at + _BLOCK], distance[at : at + _BLOCK] = self._block(x[at : at + _BLOCK, self.order])
        return number, distance

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, d = x.shape
        if not d:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.int32 if 4 * most * most * d < 1 << 31 else np.int64
        x, e = x.astype(kind), self.entries.astype(kind)
        head = max(1, d // 4)
        part = np.zeros((n, len(e)), kind)
        for j in range(head):
            step = x[:, j, None] - e[None, :, j]
            part += step * step
        self.steps += n * len(e) * head
        lead = part.argmin(axis=1)
        best = part[np.arange(n), lead] + self._rest(x, e[lead], head)
        row, entry = np.nonzero(part <= best[:, None])
        got = part[row, entry]
        for j in range(head, d):
            step = x[row, j] - e[entry, j]
            got = got + step * step
            self.steps += len(row)
            if j == d // 2 and j + 1 < d:  # the leading entry anew
                first = self._first(row, got)
                best = np.minimum(best, got[first] + self._rest(x, e[entry[first]], j + 1))
            stay = got <= best[row]
            row, entry, got = row[stay], entry[stay], got[stay]
        first = self._first(row, got)
        return entry[first], got[first].astype(np.int64)

    @staticmethod
    def _rest(x: np.ndarray, e: np.ndarray, begin: int) -> np.ndarray:
        step = x[:, begin:] - e[:, begin:]
        return (step * step).sum(axis=1, dtype=x.dtype)

    @staticmethod
    def _first(row: np.ndarray, got: np.ndarray) -> np.ndarray:
        """Where each row has its least value first. Every row has one: its best entry is never dropped."""
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.flatnonzero(got == np.repeat(np.minimum.reduceat(got, start), np.diff(np.append(start, len(row)))))
        return least[np.concatenate([[True], row[least][1:] != row[least][:-1]])]


def _round(rows: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and sums of the parts of every entry that is used: at most a row an entry."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)
    sums = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in shared.value]
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            x = stacked(b.column(0), parts * width)
            for p in range(parts):
                mine = x[:, p * width : (p + 1) * width]
                own = search[p].nearest(mine)[0] + p * entries
                count += np.bincount(own, minlength=parts * entries)
                np.add.at(total, own, mine.astype(np.int64))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), *(pa.array(total[some, j]) for j in range(width))], ["entry", "n", *sums])

    schema = ", ".join(["entry int, n long", *(f"{c} long" for c in sums)])
    found = rows.select("q").mapInArrow(run, schema).groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums]).collect()
    shared.unpersist()
    return {divmod(r["entry"], entries): (r["n"], [r[c] for c in sums]) for r in found}


def _coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    parts, _, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in shared.value]
        for b in batches:
            x = stacked(b.column(2), parts * width)
            found = [search[p].nearest(x[:, p * width : (p + 1) * width]) for p in range(parts)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bytes(c).hex() for c in codes], pa.string()), pa.array(sum(f[1] for f in found))], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "q").mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def trained(rows: DataFrame, dimensions: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks ``[part, entry, position]`` of ``rows(vec_id, q)``; None without rows. Fewer rows than ``entries`` give fewer entries."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    if not first:
        return None
    books = np.array([np.frombuffer(r["q"], "<i4") for r in first], np.int64).reshape(len(first), parts, dimensions // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for (p, e), (n, s) in _round(rows, books).items():
            books[p, e] = means(s, n)
    return books


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """One row per vector: ``vec_id, code, error, label_error, codebooks_sha256``.

    Vectors that are null or hold a null or non-finite component are left out; so are those of another length than
    most (the larger of equally many) and of a length that ``parts`` does not divide. Components become
    floor(scale * x); 2**24 and beyond are refused. Codebooks start from the smallest ids (null ids last, equal ones by
    vector); with fewer vectors than ``entries`` (256 at most) they are smaller. Repeated rows each keep theirs. ``label_error`` sums over
    equal labels, null ones together. An empty table gives no rows; other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code is one byte a part")
    spark = vectors.sparkSession
    label = quoted(label_col)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = matrix(b.column(2))
            size = np.array([len(v) for v in x])
            for d in np.unique(size[size % parts == 0]).tolist():
                at = np.flatnonzero(size == d)
                q = floors(np.stack([x[i] for i in at]), scale, MOST)
                some = pa.array(rows[at])
                yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), blobs(q)], ["vec_id", "label", "q"])

    given = vectors.select(quoted(id_col).cast("long").alias("vec_id"), label.alias("label"), quoted(vector_col).cast("array<double>").alias("x"))
    schema = f"vec_id long, label {given.schema['label'].dataType.simpleString()}, q binary"
    rows = written(given.mapInArrow(whole, schema), "vectors")
    lengths = rows.groupBy(F.length("q").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dimensions = lengths["size"] // 4 if lengths else 0
    rows = rows.where(F.length("q") == 4 * dimensions)
    books = trained(rows, dimensions, parts, entries, rounds)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    out = written(_coded(rows, books), "codes")
    by_label = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    # A label may hold a third of all rows: summed before the join, which adaptive execution splits.
    out = out.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
