"""Vectors of an Arrow list column as numpy rows, by dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) for each dimension; rows that are null or hold null or non-finite components are left out."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(sizes):
        if dim < 0:
            continue
        at = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(at)).flatten()
        matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)  # null becomes NaN
        good = np.isfinite(matrix).all(axis=1)
        out.append((at[good], matrix[good]))
    return out


def to_binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(matrix)], pa.binary())


def from_binary(column: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    """Rows of equal size."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1) if rows else np.zeros((0, 0), dtype)
