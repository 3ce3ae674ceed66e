"""Vectors in Arrow batches: valid rows as matrices, packed as binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) for each length of vector in a list column.

    Rows that are null or hold a null or non-finite component are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for n in np.unique(lengths[valid]).tolist():
        rows = np.flatnonzero(valid & (lengths == n))
        m = values[offsets[rows][:, None] + np.arange(n)]
        good = np.isfinite(m).all(axis=1)
        yield rows[good], m[good]


def pack_ints(m: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 2, 4 or 8 bytes a component that holds it."""
    most = np.abs(m).max(axis=1, initial=0)
    kinds = [("<i2", most < 1 << 15), ("<i4", most < 1 << 31), ("<i8", most >= 0)]
    out: list[bytes] = [b""] * len(m)
    left = np.ones(len(m), bool)
    for kind, fits in kinds:
        for i in np.flatnonzero(left & fits):
            out[i] = m[i].astype(kind).tobytes()
        left &= ~fits
    return out


def unpack_ints(packed: list[bytes], dim: int) -> np.ndarray:
    """The packed rows as one int64 matrix."""
    out = np.zeros((len(packed), dim), np.int64)
    if not dim:
        return out
    widths = np.array([len(p) // dim for p in packed])
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join(packed[i] for i in at), f"<i{w}").reshape(len(at), dim)
    return out
