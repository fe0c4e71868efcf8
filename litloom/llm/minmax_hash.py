"""MinHash near-duplicates by min-max hashing.

Under each permutation of the 64-bit hashes of a document's shingles both the least and the greatest value are kept,
so 64 permutations give 128 values, each agreeing between two sets with a chance equal to their similarity. The two
values of one permutation rarely come from one shingle, and agreement at one end makes it slightly less likely at the
other, so an estimate from both has a lower variance than from as many independent minima. Values are banded by four;
minima of consecutive permutations, maxima of permutations 16 apart, so that no two bands share more than one permutation.

A pair at similarity 0.8 misses all 32 bands with a chance of (1 - 0.8**4)**32, 5e-8; above it, less. What meets in a band is
decided by whole sets. No bucket is held or expanded whole: its members are first compared with the two that meet most others, and
afterwards, in buckets that still hold several components, every pair across these, in blocks
(``simhash``: equal sets are one node; sizes and parities by hash class rule pairs out without loss before texts are read again).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm import simhash
from litloom.llm.anchored import SLICE, Powers, concatenated, mix, parts_of, slices
from litloom.llm.common import id_key, quoted, shuffle_width, text_of, written
from litloom.llm.components import components

WORDS, SIMILARITY = 4, 0.8
PERMUTATIONS, ROWS = 64, 4
#: Members of a bucket that all others are compared with first; a pair of near copies shares most of its 32 buckets.
LEADERS = 2
U = np.uint64


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``words``-word shingles, A-Z in lower case; of fewer words the whole; none: empty."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    powers = Powers()
    docs = (part for i, t in enumerate(texts) for part in parts_of(i, 0, t.lower(), words, True, SLICE))
    for some in slices(docs, SLICE):
        seq = concatenated(some, True, powers)
        many = np.diff(seq.first)
        left = np.repeat(seq.first[1:], many) - np.arange(len(seq))
        begin = np.flatnonzero((left >= words) | (np.repeat(many, many) == left))
        h = seq.span_hash(begin, begin + np.minimum(left[begin], words)).view(np.int64)
        cut = np.searchsorted(begin, seq.first)
        for (i, *_), a, b in zip(some, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            found[i].append(h[a:b])
    return [np.unique(np.concatenate([np.zeros(0, np.int64), *f])) for f in found]


def parities(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of four to eight times as many hash classes (64 to 65,536), a bit a class."""
    classes = 1 << min(16, max(6, (4 * len(shingles)).bit_length()))
    return np.packbits(np.bincount(shingles & (classes - 1), minlength=classes) & 1, bitorder="little").tobytes()


class Parities:
    """Parities of many sets, for many pairs at once. Every class in which they differ has a shingle that the sets do not share."""

    def __init__(self, bits: list[bytes]) -> None:
        self.size = np.array([len(b) for b in bits])
        self.row, self.table = {}, {}
        for size in np.unique(self.size).tolist():
            # All members of this many bytes or more, folded to this many.
            own = np.flatnonzero(self.size >= size)
            self.row[size] = np.zeros(len(bits), np.int64)
            self.row[size][own] = np.arange(len(own))
            self.table[size] = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint8).reshape(-1, size), axis=0).view(U) for i in own])

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Shingles that members ``x`` and ``y`` do not share, at the least."""
        out = np.zeros(len(x), np.int64)
        least = np.minimum(self.size[x], self.size[y])
        for size, table in self.table.items():
            row, pairs = self.row[size], np.flatnonzero(least == size)
            step = max(1, (1 << 22) // size)
            for at in range(0, len(pairs), step):
                p = pairs[at : at + step]
                out[p] = np.bitwise_count(table[row[x[p]]] ^ table[row[y[p]]]).sum(axis=1, dtype=np.int64)
        return out


class MinMax:
    """Least and greatest values under ``permutations`` of 64-bit hashes, and keys of bands of ``rows`` of them."""

    def __init__(self, permutations: int = PERMUTATIONS, rows: int = ROWS) -> None:
        if permutations % (rows * rows):
            raise ValueError("permutations must be a multiple of the square of rows")
        odd = mix(np.arange(1, 2 * permutations + 1, dtype=U))
        self.turn, self.times = odd[:permutations], odd[permutations:] | U(1)
        each = np.arange(permutations)
        bands = permutations // rows
        self.bands = np.concatenate([each.reshape(bands, rows), permutations + each.reshape(rows, bands).T])

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row a set (none may be empty): minima, then maxima."""
        x = np.concatenate(sets).view(U)
        start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        out = np.empty((len(sets), 2 * len(self.turn)), U)
        for p, (a, b) in enumerate(zip(self.turn, self.times, strict=True)):
            v = (x ^ a) * b
            out[:, p] = np.minimum.reduceat(v, start)
            out[:, p + len(self.turn)] = np.maximum.reduceat(v, start)
        return out

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row a set: the key of each band."""
        values = self.values(sets)
        out = np.broadcast_to(np.arange(1, len(self.bands) + 1, dtype=U), (len(sets), len(self.bands)))
        for column in self.bands.T:
            out = mix(out * U(0x9E3779B97F4A7C15) + values[:, column])
        return out.view(np.int64)

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Share of values that agree: an unbiased estimate of the similarity."""
        return float((a == b).mean())


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, n) sorted by key -> those of keys with two rows or more, and how many were seen together. Holds a batch."""
    held = [np.zeros(0, np.int64)] * 3
    given = None  # a key whose rows have gone out already, so later ones follow them
    for b in batches:
        if not b.num_rows:
            continue
        key, fp, n = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns, strict=True))
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        stay = np.repeat(size > 1, size)
        if key[0] == given:
            stay[: size[0]] = True
        if stay[-1]:
            given, held = key[-1], [np.zeros(0, np.int64)] * 3
        else:  # may go on in the next batch
            given, held = None, [key[-1:], fp[-1:], n[-1:]]
        yield pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (key, fp, n, np.repeat(size, size))], ["key", "fp", "n", "size"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    permutations: int = PERMUTATIONS, rows: int = ROWS, block: int = simhash.BLOCK,
) -> DataFrame:
    """One row per input row: ``doc_id, text_key, n_shingles, root, component_id, kept``; ``root`` tells components apart.

    Documents whose shingle sets have ``similarity`` or more are linked; equal texts are. Null and empty texts and texts
    without words have no shingles, link with nothing and are components of their own (``root`` null). Repeated rows and ids each
    keep their row. ``component_id`` is the smallest id of the component (null only where all its ids are null); ``kept``
    where it equals the row's own. An empty table gives no rows; other columns are ignored.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    width = shuffle_width(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = MinMax(permutations, rows)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = shingle_sets([t.as_py() or b"" for t in part.column(2)], words)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys: list[bytes | None] = [None] * len(sets)
                if some:
                    for i, k in zip(some, bands.keys([sets[i] for i in some]), strict=True):
                        keys[i] = k.astype("<i8").tobytes()
                fps = [xxhash.xxh64_intdigest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([None if f is None else f - (f >> 63 << 64) for f in fps], pa.int64()),
                     pa.array(keys, pa.binary()), pa.array([parities(s) for s in sets], pa.binary())],
                    ["doc_id", "text_key", "n", "fp", "keys", "counts"],
                )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                keys = np.frombuffer(b"".join(k.as_py() for k in part.column(2)), "<i8")
                times = len(keys) // part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.repeat(part.column(i).to_numpy(), times)) for i in (0, 1))], ["key", "fp", "n"])

    given = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"), text_of(text_col).cast("binary").alias("t"))
    found = written(given.mapInArrow(run, "doc_id long, text_key long, n long, fp long, keys binary, counts binary"), "minmax")
    # Equal sets stand as one node.
    one = F.min(F.struct("doc_id", "text_key")).alias("one")
    nodes = found.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least_id"), one, *[F.first(c).alias(c) for c in ("n", "keys", "counts")])
    nodes = written(nodes.select("fp", "least_id", "one.*", "n", "keys", "counts"), "nodes")
    keyed = nodes.select("fp", "n", "keys").mapInArrow(spread, "key long, fp long, n long")
    paired = keyed.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_paired, "key long, fp long, n long, size long")
    paired = written(paired, "paired")
    # Members that meet most others lead: the centre of a family is similar to more of it than its fringes are to each other.
    central = paired.groupBy("fp").agg(F.sum("size").alias("met"))
    led = paired.join(central, "fp").repartition(width, "key").sortWithinPartitions("key", F.desc("met"), "fp")
    met = led.select("key", "fp", "n", F.lit(0).cast("long").alias("at")).mapInArrow(simhash._leader_stage(similarity, LEADERS), "kind int, a long, b long, n long, at long")
    met = written(met, "met")
    near = met.where("kind = 0").select("a", "b").distinct()
    edges = simhash._linked(docs, nodes, near, id_col, text_col, words, similarity, Parities)
    rest = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), "n", "at")
    near = written(simhash._across(rest, edges, similarity, block, nodes.select("fp", "counts"), Parities), "across")
    roots = components(edges.unionByName(simhash._linked(docs, nodes, near, id_col, text_col, words, similarity, Parities)))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    # Written, so that the join below shuffles both sides and a large component can be split.
    owner = written(member.groupBy("root").agg(F.min("least_id").alias("component_id")), "owners")
    of_fp = member.join(owner, "root").select(F.col("fp").alias("of"), "root", "component_id")
    out = found.join(of_fp, F.col("fp") == F.col("of"), "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "root", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
