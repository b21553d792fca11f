"""Vector columns as numpy blocks, and a grid that meets two sets of rows
block by block inside Spark groups of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """True for vectors that are not null and hold finite numbers only."""
    return F.coalesce(vec.isNotNull() & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(arr: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list array as float64; shorter rows are padded with zeros."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    lengths = arr.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if n else np.zeros(0, np.int64)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(int(lengths.max(initial=0)), dim or 0, 1)
    if n and (lengths == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    out[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def widen(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def blocks_of(n: Column, rows: int) -> Column:
    """Number of blocks of about ``rows`` rows."""
    return F.greatest(F.ceil(n / F.lit(rows)), F.lit(1)).cast("int")


def spread(df: DataFrame, key: str, own: Column, others: Column, own_col: str, other_col: str) -> DataFrame:
    """Deal a row to block ``pmod(hash(key), own)`` of its side, once for
    each of the ``others`` blocks of the other side."""
    return df.withColumn(own_col, F.pmod(F.xxhash64(F.col(key), F.lit(7)), own).cast("int")) \
             .withColumn(other_col, F.explode(F.sequence(F.lit(0), others - 1)))
