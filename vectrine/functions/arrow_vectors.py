"""Arrow columns of vectors as NumPy matrices, without a Python object per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flat(col) -> pa.Array:
    """One contiguous array from an array or a chunked array."""
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def usable(col, dim: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, matrix (float64 for doubles, else float32) and float64 norms of the usable vectors.

    A vector is usable if it isn't null, has ``dim`` elements (any length if
    ``dim`` is None and all agree), none of them null or not finite, and isn't
    all zero.
    """
    arr = flat(col)
    n = len(arr)
    if n == 0:
        return np.empty(0, np.int64), np.empty((0, dim or 0), np.float32), np.empty(0)
    off = arr.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = arr.values.to_numpy(zero_copy_only=False)
    valid = np.ones(n, bool) if arr.null_count == 0 else arr.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.diff(off)
    if dim is None:
        dim = int(lengths[valid][0]) if valid.any() else 0
    rows = np.flatnonzero(valid & (lengths == dim))
    if dim == 0 or len(rows) == 0:
        return np.empty(0, np.int64), np.empty((0, dim), np.float32), np.empty(0)
    if len(rows) == n:
        m = values[off[0] : off[-1]].reshape(n, dim)
    else:
        m = values[off[rows][:, None] + np.arange(dim)]
    m = np.ascontiguousarray(m, dtype=np.float64 if m.dtype == np.float64 else np.float32)
    wide = m.astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        norms = np.sqrt((wide * wide).sum(1))
    good = np.isfinite(norms) & (norms > 0)
    return rows[good], m[good], norms[good]


def take(col, rows: np.ndarray) -> pa.Array:
    """The rows of a column by number."""
    return flat(col).take(pa.array(rows, pa.int64()))


def list_column(values: np.ndarray, counts: np.ndarray, value_type: pa.DataType) -> pa.Array:
    """A list column from flat values and the count of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, value_type))
