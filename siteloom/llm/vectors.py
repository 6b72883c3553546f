"""Vectors of an Arrow list column as a matrix, and their bytes as keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """n x d float64 matrix of a list column whose rows all have d components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(name: str = "embedding") -> Column:
    """False for vectors that are null, empty, zero, or hold null or non-finite components."""
    x = F.col(name)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def doubles(df: DataFrame, name: str = "embedding") -> Column:
    return F.transform(F.col(name), lambda v: v.cast("double") + F.lit(0.0))  # -0.0 and 0.0 are one value
