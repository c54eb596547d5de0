"""Arrow columns of vectors as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places of vectors that have no null or non-finite component and are not zero, and their values."""
    offsets, values = column.offsets.to_numpy(), column.values
    bad = ~pc.fill_null(pc.is_finite(values), False).to_numpy(zero_copy_only=False)
    some = pc.fill_null(pc.not_equal(values, 0.0), False).to_numpy(zero_copy_only=False)
    bad, some = (np.append(0, np.cumsum(x))[offsets] for x in (bad, some))
    good = (np.diff(bad) == 0) & (np.diff(some) > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    flat, at = values.to_numpy(zero_copy_only=False), np.flatnonzero(good)
    return at, [flat[offsets[k] : offsets[k + 1]] for k in at]


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stacked(column: pa.Array, dtype: str) -> np.ndarray:
    """Binary values of equal length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)
