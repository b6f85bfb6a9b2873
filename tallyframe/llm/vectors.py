"""Embedding tables as whole numbers: which rows can be used, and their components as integer matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers up to this are kept as 64-bit integers; larger ones as Python's, which have no end.
PLAIN = 2**31


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def longest(df: DataFrame, vector: str) -> int:
    """The number of components of the longest vector, 0 without rows."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """(rows, dims) of floor(scale * component), exact; a shorter vector goes on with zeros. A scaled component that is no double any more is an error."""
    size = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if not np.isfinite(flat).all():
        raise OverflowError(f"a component times {scale} is beyond the doubles")
    wide = bool(len(flat)) and np.abs(flat).max() >= PLAIN
    flat = np.array([int(x) for x in flat], object) if wide else flat.astype(np.int64)
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), flat.dtype)
    out[np.arange(dims) < size[:, None]] = flat
    return out
