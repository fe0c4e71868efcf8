"""Substring deduplication of long word passages by super-k-mer partitioning.

A window is ``window`` consecutive words. Consecutive windows sharing a minimiser (a word
4-gram) travel as one packed string to the minimiser's bucket, where sorting counts windows
exactly. Every occurrence of a window that starts more than once is covered; covered words go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.anchored import SLICE, Powers, U, bucket_count, by_document, cover, covered_runs, keyed_rows, partition_count, repeated_windows, sampled_anchors, text_bytes
from litloom.llm.common import shuffle_width

WINDOW = 35
MINIMISER = 4
#: Bytes of documents looked at for frequent minimisers, and how often one must be seen. Routing only.
SAMPLE_BYTES = 16 << 20
FREQUENT = 16


def find_repeats(rows: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, slice_bytes: int = 2 * SLICE) -> DataFrame:
    """``rows(doc, key, text)`` -> ``(doc, key, runs)``: covered word runs, ``first << 24 | words``, of rows that have any."""
    width = shuffle_width(rows.sparkSession)
    rows = rows.select("doc", "key", "text")
    total = text_bytes(rows)
    frequent, _ = sampled_anchors(rows, total, window, minimiser, True, SAMPLE_BYTES, FREQUENT, 1, 1)
    buckets = bucket_count(total, width)
    n, powers = U(buckets), Powers()

    def bucket(_buf: np.ndarray, _at: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return (gram % n).astype(np.int64)

    def decide(_number: int, blocks: list[bytes]) -> Iterator[tuple[tuple[np.ndarray, ...], None]]:
        return ((found, None) for found in repeated_windows(blocks, window, True, powers, slice_bytes))

    return by_document(covered_runs(rows, window, minimiser, True, False, bucket, decide, frequent, partition_count(buckets, width), slice_bytes))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slice_bytes: int = 2 * SLICE) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept`` (kept words joined by a space).

    Null and empty texts have no words. Texts shorter than a window lose nothing. A row repeated
    with the same id and text is one document; the same text under another id is elsewhere.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = keyed_rows(docs, id_col, text_col)
    runs = find_repeats(rows, window, slice_bytes=slice_bytes)
    both = rows.join(runs, ["doc", "key"], "left").select("doc_id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, kept = [], [], []
            for t, r in zip(b.column(1), b.column(2), strict=True):
                w = t.as_py().split()
                r = r.as_py()
                if r:
                    keep, _ = cover(r, len(w))
                    left = [w[i] for i in np.flatnonzero(keep).tolist()]
                else:
                    left = w
                total.append(len(w))
                gone.append(len(w) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = dict(rows.dtypes)["doc_id"]
    return both.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per input row, nulls, repeats and empty tables as in ``remove_repeats``."""
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

