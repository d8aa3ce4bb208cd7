"""Arrow columns as numpy arrays."""

from __future__ import annotations

import numpy as np


def matrix(column, width: int | None = None) -> np.ndarray:
    """An Arrow column of lists of one width as rows of doubles; other widths are an error."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n and (len(flat) % n or width is not None and len(flat) != n * width or (np.diff(column.value_lengths().to_numpy(zero_copy_only=False)) != 0).any()):
        raise ValueError(f"rows are of different widths, or not of {width}")
    return flat.reshape(n, -1 if n else width or 0)
