"""Vectors of Arrow batches as matrices, and which vectors take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def finite(column: str):
    """Not null, and without null, NaN or infinite components."""
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def padded(rows: list[np.ndarray]) -> np.ndarray:
    """Rows as one float64 matrix; shorter ones end in zeros."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a float64 matrix; shorter lists end in zeros."""
    size = np.asarray(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))))
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
