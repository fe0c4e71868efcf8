"""Benchmark decontamination: broadcast hash set of normalised test n-grams against training token windows.

The set is built once, on the driver, as flat arrays: sorted hashes of the distinct windows, the
items that own each of them, and the words they come from. Tasks hash the word windows of training texts with the
same rolling hash (vectorised) and look them up; a hit is verified word for word.

The set is broadcast only in blocks of bounded size. A benchmark above the bound is cut into
several blocks, each scanned in a pass of its own that writes the texts hit and nothing else; they are joined to the rows once, before
the last block. An item above the bound is cut into parts that share windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litloom.llm.anchored import SLICE, Powers, classes, concatenated, joined_form, parts_of, slices
from litloom.llm.common import given, quoted, renamed, text_of, without, written

#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20
#: Upper-case ASCII to lower case; other ASCII but digits and letters to space; the rest unchanged.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPAN_BITS = 32
ADDED = ("n_words", "n_hit", "hit_spans", "hit_items")
_FRONT = 1 << 20


def folded(text: bytes | None) -> bytes:
    return (text or b"").translate(_FOLD)


def words_of(text: bytes | None) -> list[bytes]:
    return folded(text).split()


class WindowTable:
    """Distinct windows of one size: sorted ``hashes``, where their words stand in ``text``, and their owners (numbers of items)."""

    def __init__(self, size: int, text: bytes, h: np.ndarray, at: np.ndarray, length: np.ndarray, owner: np.ndarray) -> None:
        _, lead, cls = np.unique(classes(np.frombuffer(text, np.uint8), h, at, length), return_index=True, return_inverse=True)
        order = np.argsort(h[lead], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pair = np.unique(np.stack([place[cls], owner], axis=1), axis=0)
        self.size, self.text = size, text
        self.hashes, self.at, self.length = h[lead][order], at[lead][order], length[lead][order]
        self.owners, self.first = pair[:, 1].astype(np.int32), np.searchsorted(pair[:, 0], np.arange(len(order) + 1))
        self.front = np.zeros(_FRONT, bool)
        self.front[(self.hashes & np.uint64(_FRONT - 1)).astype(np.int64)] = True

    def found(self, g: np.ndarray) -> np.ndarray:
        """Positions of hashes that are in the table."""
        p = np.flatnonzero(self.front[(g & np.uint64(_FRONT - 1)).astype(np.int32)])
        at = np.minimum(np.searchsorted(self.hashes, g[p]), len(self.hashes) - 1)
        return p[self.hashes[at] == g[p]]

    def entry(self, h: np.uint64, words: bytes) -> int:
        """The window of this hash and these words, or -1."""
        i = int(np.searchsorted(self.hashes, h))
        while i < len(self.hashes) and self.hashes[i] == h:
            if self.text[self.at[i] : self.at[i] + self.length[i]] == words:
                return i
            i += 1
        return -1


def ordered(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda i: (i is None, i or ""))


class NgramIndex:
    """Windows of ``n`` words (or a shorter item's whole sequence) of ``(item, text)`` pairs."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int) -> None:
        self.n = n
        self.items = ordered({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        texts, size, powers = [], 0, Powers()
        for some in slices(((number[item], 0, folded(text), 0) for item, text in items), SLICE):
            seq = concatenated(some, True, powers)
            joined, put = joined_form(seq)
            words = np.diff(seq.first)
            owner = np.repeat(np.array([r[0] for r in some], np.int64), words)
            left = np.repeat(seq.first[1:], words) - np.arange(len(seq))
            whole = np.repeat(words, words)
            for k in np.unique(np.minimum(words[words > 0], n)).tolist():
                # Windows of n words; of a shorter item the one that is all of it.
                p = np.flatnonzero((left >= k) & ((whole >= n) if k == n else (whole == k)))
                parts.setdefault(k, []).append((seq.grams(k)[p], size + put[p], put[p + k] - 1 - put[p], owner[p]))
            texts.append(joined.tobytes())
            size += len(joined)
        text = b"".join(texts)
        self.tables = [WindowTable(k, text, *(np.concatenate(c) for c in zip(*v, strict=True))) for k, v in sorted(parts.items())]

    def plain(self) -> dict:
        """What a broadcast carries: plain arrays, as broadcasts go by reference and workers may lack this module."""
        return vars(self) | {"tables": [vars(t) for t in self.tables]}

    @staticmethod
    def of(plain: dict) -> NgramIndex:
        index = NgramIndex.__new__(NgramIndex)
        vars(index).update(plain | {"tables": [WindowTable.__new__(WindowTable) for _ in plain["tables"]]})
        for t, v in zip(index.tables, plain["tables"], strict=True):
            vars(t).update(v)
        return index

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str | None]]]:
        """For each text its number of words, the word windows hit as (start, end), and the items, sorted."""
        count = [0] * len(texts)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        entries: list[set[tuple[int, int]]] = [set() for _ in texts]
        powers = Powers()
        docs = (part for i, t in enumerate(texts) for part in parts_of(i, 0, folded(t), self.n, True, SLICE))
        for some in slices(docs, SLICE):
            seq, joined = concatenated(some, True, powers), None
            for (i, _, _, base), words in zip(some, np.diff(seq.first).tolist(), strict=True):
                count[i] = max(count[i], base + words)
            for t, table in enumerate(self.tables):
                if len(seq) < table.size:
                    continue
                g = seq.grams(table.size)
                p = table.found(g)
                d = np.searchsorted(seq.first, p, "right") - 1
                inside = p + table.size <= seq.first[d + 1]
                if inside.any() and joined is None:
                    joined, put = joined_form(seq)
                    joined = joined.tobytes()
                for x, y in zip(p[inside].tolist(), d[inside].tolist(), strict=True):
                    if (at := table.entry(g[x], joined[put[x] : put[x + table.size] - 1])) >= 0:
                        i, _, _, base = some[y]
                        begin = x - int(seq.first[y]) + base
                        spans[i].append((begin, begin + table.size))
                        entries[i].add((t, at))
        return [(c, s, self._owners(e)) for c, s, e in zip(count, spans, entries, strict=True)]

    def _owners(self, entries: set[tuple[int, int]]) -> list[str | None]:
        if not entries:
            return []
        tables = [(self.tables[t], at) for t, at in entries]
        return [self.items[i] for i in np.unique(np.concatenate([t.owners[t.first[at] : t.first[at + 1]] for t, at in tables])).tolist()]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, limit: int) -> list[DataFrame]:
    """``(item, t)`` in blocks of at most ``limit`` bytes each, long items in parts that overlap by n - 1 words."""
    rows = benchmark.select(quoted(item_col).cast("string").alias("item"), text_of(text_col).cast("binary").alias("t"))
    size = F.sum(F.length("t") + 64)
    total, longest = rows.agg(F.coalesce(size, F.lit(0)), F.coalesce(F.max(F.length("t")), F.lit(0))).first()
    if total <= limit:
        return [rows]
    part = max(1, limit // 64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for _, _, piece, _ in parts_of(0, 0, folded(t.as_py()), n, True, part):
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([piece], pa.binary())], ["item", "t"])

    if longest > 4 * part:
        rows = written(rows.mapInArrow(cut, "item string, t binary"), "items")
    blocks = max(1, -(-int(total) // (limit // 2)))
    while True:
        of = F.pmod(F.xxhash64("item", "t"), F.lit(blocks))
        most = rows.groupBy(of.alias("block")).agg(size.alias("b"), F.count("*").alias("n")).agg(F.max(F.when(F.col("n") > 1, F.col("b")))).first()[0]
        if (most or 0) <= limit or blocks >= 1 << 20:
            return [rows.where(of == i) for i in range(blocks)]
        blocks *= 2


def _scanned(docs: DataFrame, benchmark: DataFrame, names: list[str], text_col: str, item_col: str, item_text: str, n: int, block_bytes: int) -> DataFrame:
    """Columns ``names`` as ``__c0``, .. and ``__n, __spans, __items`` of every row."""
    spans, items = F.col("__spans"), F.col("__items")
    empty = [F.array().cast("array<bigint>"), F.array().cast("array<string>")]
    text = text_of(text_col).cast("binary").alias("__text")
    blocks = _blocks(benchmark, item_col, item_text, n, block_bytes)
    hits = None
    for block in blocks[:-1]:
        shared = _index(block, n)
        # Hits depend on the text alone, so texts hit are written under their digest, and no other column.
        once = docs.select(text, *(e.alias(c) for e, c in zip(empty, ("__spans", "__items"), strict=True)), F.lit(0).cast("long").alias("__n"))
        found = once.mapInArrow(_scanner(shared, False), once.schema).where(F.size(spans) > 0)
        found = written(found.select(F.sha2("__text", 256).alias("__hit"), spans, items).dropDuplicates(["__hit"]), "hits")
        hits = found if hits is None else hits.unionByName(found)
        shared.unpersist()
    have = docs.select(*renamed(names), text)
    if hits is None:
        have = have.withColumns({"__spans": empty[0], "__items": empty[1]})
    else:
        hits = hits.groupBy("__hit").agg(F.flatten(F.collect_list(spans)).alias("__spans"), F.flatten(F.collect_list(items)).alias("__items"))
        have = have.join(hits, F.sha2("__text", 256) == F.col("__hit"), "left").drop("__hit")
        have = have.withColumns({"__spans": F.coalesce(spans, empty[0]), "__items": F.coalesce(items, empty[1])})
    have = have.withColumn("__n", F.lit(0).cast("long"))
    schema = T.StructType([f for f in have.schema.fields if f.name != "__text"])
    return have.mapInArrow(_scanner(_index(blocks[-1], n), True), schema)


def _index(block: DataFrame, n: int):
    """Broadcast set of a block: at most ``block_bytes`` of text, see ``_blocks``."""
    items = [(r["item"], bytes(r["t"])) for r in block.collect()]
    return block.sparkSession.sparkContext.broadcast(NgramIndex(items, n).plain())


def scan(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10,
    keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns ``keep`` (all by default) of every row plus ``n_words, n_hit, hit_spans, hit_items``.

    ``hit_spans`` holds maximal runs of hit words as (start, end), end exclusive; ``hit_items``
    the ids of items with an occurring window. A null or empty text has no words and no hit; an
    item without words has no window; a null item id reads "null" and is an item of its own, beside one named so; repeated items are one. An empty benchmark
    hits nothing. Columns of the added names in ``docs`` are replaced; see ``without_contaminated`` to keep them.
    """
    names = without(keep or docs.columns, ADDED)
    have = _scanned(docs, benchmark, names, text_col, item_col, item_text, n, block_bytes)
    low = F.lit((1 << _SPAN_BITS) - 1)
    spans = F.transform("__spans", lambda s: F.struct(F.shiftright(s, _SPAN_BITS).alias("start"), s.bitwiseAND(low).alias("end")))
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s.bitwiseAND(low) - F.shiftright(s, _SPAN_BITS))
    return have.select(*given(names), F.col("__n").alias("n_words"), n_hit.alias("n_hit"), spans.alias("hit_spans"), F.transform("__items", lambda i: F.coalesce(i, F.lit("null"))).alias("hit_items"))


def _scanner(shared, drop_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = NgramIndex.of(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = index.scan([t.as_py() for t in part.column("__text")])
                old = part.column("__spans").to_pylist()
                ids = part.column("__items").to_pylist()
                spans = [merged([divmod(s, 1 << _SPAN_BITS) for s in o] + x[1]) for o, x in zip(old, found, strict=True)]
                new = {
                    "__n": pa.array([x[0] for x in found], pa.int64()),
                    "__spans": pa.array([[(a << _SPAN_BITS) | e for a, e in s] for s in spans], pa.list_(pa.int64())),
                    "__items": pa.array([ordered({*o, *x[2]}) for o, x in zip(ids, found, strict=True)], pa.list_(pa.string())),
                }
                names = [c for c in part.schema.names if not (drop_text and c == "__text")]
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in names], names)

    return run


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Nulls, empty texts, items and tables as in ``scan``; repeated rows each keep theirs; other columns are ignored.
    """
    found = scan(docs, benchmark, keep=[id_col])
    items = F.array_join(F.array_sort("hit_items"), ",")
    return found.select(
        quoted(id_col).alias("doc_id"), "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` with no hit, all columns and values as given, whatever their names; null and empty texts stay."""
    have = _scanned(docs, benchmark, docs.columns, text_col, "item_id", "text", n, block_bytes)
    return have.where(F.size("__spans") == 0).select(*given(docs.columns))


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns as given, hit words cut from the text (normalised words joined by a space where anything is cut)."""
    at = f"__c{docs.columns.index(text_col)}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, spans in zip(b.column(at).to_pylist(), b.column("__spans").to_pylist(), strict=True):
                if spans:
                    w = words_of(t.encode())
                    for s in reversed(spans):
                        begin, end = divmod(s, 1 << _SPAN_BITS)
                        del w[begin:end]
                    t = b" ".join(w).decode()
                texts.append(t)
            names = [c for c in b.schema.names if c != "__spans"]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == at else b.column(c) for c in names], names)

    found = _scanned(docs, benchmark, docs.columns, text_col, "item_id", "text", n, block_bytes).drop("__n", "__items")
    return found.mapInArrow(cut, T.StructType([f for f in found.schema.fields if f.name != "__spans"])).select(*given(docs.columns))
