"""Vector tables: checks, packing into blocks of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str, nonzero: bool = False) -> DataFrame:
    """``vec_id, vec`` (array of double) of rows with an id and a vector of finite numbers.

    Rows that repeat an id count once, with the smallest vector.
    """
    v = F.col("vec")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    if nonzero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix, short vectors filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def block_of(id_col: str, n: int) -> Column:
    """The block, of ``n``, a row belongs to."""
    return F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
