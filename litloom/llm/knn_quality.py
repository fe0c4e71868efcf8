"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are byte-class trigrams (hashed) and a few measures of style. A truncated SVD of the
labelled sample gives the space; its vectors and labels are broadcast (their number is the
parameter ``sample``, so the size is bounded), and every document is compared with all of them in
blocks: exact cosines, no index. The nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.anchored import Powers, Sequence
from litloom.llm.common import text_of

#: Labelled documents the space is fitted on and that vote, at most.
SAMPLE = 3000
TERMS = 2048
DIMENSIONS = 64
NEIGHBOURS = 25
THRESHOLD = 0.3
#: Power of the similarity in a vote: nearer neighbours count for more.
SHARPNESS = 8
#: Bytes of text made into features at once.
_PIECE = 1 << 20
#: Rows of the sample that are weighted at once.
_BLOCK = 256
_STYLES = 6


def _byte_classes() -> np.ndarray:
    c = np.full(256, 1, np.uint32)
    c[32], c[48:58], c[65:91], c[97:123] = 0, 2, 3, np.arange(26) + 4
    c[0x80:0xA0], c[0xA0:0xC0], c[0xC0:] = 30, 31, 32
    marks = b".,!?|$%&*#-'\":;()/_=<>[]{}@+~"
    c[list(marks)] = np.arange(len(marks)) + 33
    return c


_CLASS = _byte_classes()


def features(texts: list[bytes]) -> np.ndarray:
    """One row a text: log counts of hashed trigrams, then measures of style in 0..1."""
    n = len(texts)
    out = np.zeros((n, TERMS + _STYLES), np.float32)
    size = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if not len(buf):
        return out
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(n), size)
    c = _CLASS[buf]
    if len(c) > 2:
        code = (((c[:-2] << np.uint32(6) | c[1:-1]) << np.uint32(6) | c[2:]) * np.uint32(2654435761)) >> np.uint32(21)
        inside = owner[:-2] == owner[2:]
        counts = np.bincount(owner[:-2][inside] * TERMS + code[inside], minlength=n * TERMS).reshape(n, TERMS)
        out[:, :TERMS] = np.log1p(counts)
    per = np.maximum(size, 1)
    style = [(c == 3) | (c == 30), c >= 33, c == 2, c == 0]
    for i, hit in enumerate(style):
        out[:, TERMS + i] = np.add.reduceat(np.append(hit, False).astype(np.int64), first[:-1]) * (size > 0) / per
    seq = Sequence(buf, first.astype(np.int64), True, Powers())
    words = np.diff(seq.first)
    if len(seq) > 1:
        of = np.searchsorted(seq.first, np.arange(len(seq)), "right") - 1
        again = (seq.value[1:] == seq.value[:-1]) & (of[1:] == of[:-1])
        out[:, TERMS + 4] = np.bincount(of[1:][again], minlength=n) / np.maximum(words, 1)
    out[:, TERMS + 5] = np.minimum(1, per / np.maximum(words, 1) / 20)
    return out


class Model:
    """``idf``, projection ``basis``, unit vectors and labels of the voters, and the share of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> None:
        self.neighbours = neighbours
        self.prior = float(y.mean()) if len(y) else 0.5
        self.labels = y.astype(np.float32)
        # Block by block: of the features one further copy is held, as this runs on the driver.
        has = sum(((x[i : i + _BLOCK, :TERMS] > 0).sum(axis=0) for i in range(0, len(x), _BLOCK)), np.zeros(TERMS, np.int64))
        self.idf = (np.log((1 + len(x)) / (1 + has)) + 1).astype(np.float32)
        m = np.empty((len(x), TERMS + _STYLES), np.float32)
        for i in range(0, len(x), _BLOCK):
            m[i : i + _BLOCK] = self._weighted(x[i : i + _BLOCK].astype(np.float32))
        k = min(dimensions, *m.shape) if len(m) else 0
        draw = np.random.default_rng(5).standard_normal((m.shape[1], min(k + 16, m.shape[1]))).astype(np.float32)
        q = m @ draw
        for _ in range(3):
            q = m @ (m.T @ np.linalg.qr(q)[0]) if len(m) else q
        basis = np.linalg.svd(np.linalg.qr(q)[0].T @ m, full_matrices=False)[2][:k] if len(m) else np.zeros((0, m.shape[1]), np.float32)
        self.basis = np.ascontiguousarray(basis.T.astype(np.float32))
        self.voters = self._unit(m @ self.basis)

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        terms = x[:, :TERMS] * self.idf
        norm = np.linalg.norm(terms, axis=1, keepdims=True)
        return np.concatenate([terms / np.maximum(norm, 1e-9), x[:, TERMS:]], axis=1).astype(np.float32)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest; the prior where nothing is similar."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        sim = np.maximum(self._unit(self._weighted(x) @ self.basis) @ self.voters.T, 0)
        k = min(self.neighbours, sim.shape[1])
        near = np.argpartition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k :]
        w = np.take_along_axis(sim, near, axis=1).astype(np.float64) ** SHARPNESS
        total = w.sum(axis=1)
        vote = (w * self.labels[near]).sum(axis=1)
        empty = (x[:, :TERMS].sum(axis=1) == 0) | (total <= 0)
        return np.where(empty, self.prior, vote / np.maximum(total, 1e-12)).clip(0, 1)


def _pieces(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _PIECE or len(held) >= 1024:
            yield held
            held, size = [], 0
    if held:
        yield held


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality") -> Model:
    """Fits on at most ``sample`` labelled rows outside the held-out fifth, drawn by hash of the id."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("__y"))
    drawn = ids.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample).withColumnRenamed("doc_id", "__id")
    rows = docs.select(F.col("doc_id").alias("__d"), text_of("text").alias("__t")).join(F.broadcast(drawn), F.col("__d") == F.col("__id"))
    rows = rows.groupBy("__d").agg(F.min("__t").cast("binary").alias("t"), F.min("__y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([np.zeros((0, TERMS + _STYLES), np.float32), *map(features, _pieces(v.as_py() for v in b.column(1)))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary()), b.column(2)], ["d", "x", "y"])

    found = rows.mapInArrow(run, "d long, x binary, y int").toArrow().sort_by("d").combine_chunks()
    # Halves of floats as they came, a few bytes a value: the model makes floats of them.
    x = np.concatenate([np.zeros(0, "<f2"), *(np.frombuffer(v.as_buffer(), "<f2") for v in found.column("x"))]).reshape(-1, TERMS + _STYLES)
    return Model(x, found.column("y").to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """All rows and columns plus the score, from the text alone.

    Null and empty texts score the share of label 1 in the sample (0.5 without any label);
    repeated rows score alike; ``score_col`` is replaced if there.
    """
    names = [c for c in docs.columns if c != score_col]
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: workers may lack this module
    rows = docs.select(*[F.col(f"`{c}`") for c in names], text_of("text").cast("binary").alias("__bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        vars(m).update(shared.value)
        for b in batches:
            found = [m.score(features(p)) for p in _pieces(v.as_py() for v in b.column("__bytes"))]
            s = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s, pa.float64())], [*names, score_col])

    schema = rows.drop("__bytes").schema.add(score_col, "double")
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Texts as in ``score``; a null id is held out by the hash of the empty text and never fitted on. Labels that are null, or of
    a null or absent id, are left out; of several labels of an id the largest counts. Repeated rows each keep theirs; other columns are
    ignored; an empty table gives no rows, and without labels all score 0.5.
    """
    model = fit(docs, labels)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows that score ``threshold`` or more, columns and values as given; nulls, repeats and labels as in ``score`` and ``classify``."""
    names = docs.columns
    return score(docs, fit(docs, labels), "__score").where(F.col("__score") >= threshold).select(*[F.col(f"`{c}`") for c in names])
