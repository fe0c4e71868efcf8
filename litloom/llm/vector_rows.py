"""Vectors as rows of integers: validity, exact quantisation and their form between stages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array, dimensions: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of the rows of a list column that are finite throughout (and of ``dimensions`` components, if given), and their components.

    Null rows, and rows with a null or non-finite component, are left out.
    """
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    first = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = (size >= 0) & (bad[first[1:]] == bad[first[:-1]])
    if dimensions is not None:
        ok &= size == dimensions
    rows = np.flatnonzero(ok)
    return rows, [flat[first[i] : first[i + 1]] for i in rows.tolist()]


def floors(x: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) as 32-bit integers. Values of ``most`` or beyond are refused: exact distances would not fit 64 bits."""
    q = np.floor(scale * x)
    if q.size and np.abs(q).max() >= most:
        raise ValueError(f"components of {most // scale} or more are not supported")
    return q.astype(np.int32)


def stacked(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of 32-bit integers from a binary column of ``dimensions`` integers each."""
    return np.frombuffer(b"".join(v.as_py() for v in column), "<i4").reshape(len(column), dimensions)


def blobs(q: np.ndarray) -> pa.Array:
    """A binary value for each row of 32-bit integers."""
    size = q.shape[1] * 4
    at = pa.array(np.arange(len(q) + 1, dtype=np.int32) * size)
    return pa.Array.from_buffers(pa.binary(), len(q), [None, at.buffers()[1], pa.py_buffer(np.ascontiguousarray(q, "<i4"))])


def means(sums: list[int], count: int) -> list[int]:
    """Componentwise exact floor(sum / count)."""
    return [s // count for s in sums]
