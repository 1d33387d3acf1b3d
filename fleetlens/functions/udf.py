"""User-function hooks (survey 2.14).

A known function name maps to a built-in expression (JVM-side, codegen);
anything else runs as an Arrow-batched pandas UDF, never row at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars as S
from ..operators.profile import value_counts

KNOWN: dict[str, Callable[[Column], Column]] = {
    "cafv_code3": S.cafv_code3,
    "cafv_code2": S.cafv_code2,
    "lower": F.lower,
    "upper": F.upper,
    "bin_range": S.bin_range,
    "bin_price": S.bin_price,
    "sanitize": S.sanitize_text,
}


def vectorized(fn: Callable, return_type: T.DataType = T.StringType()):
    """Wrap a per-value Python function as a pandas UDF (Arrow batches)."""
    @F.pandas_udf(return_type)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else fn(v))
    return run


def apply_fn(col: str, fn: str | Callable, return_type: T.DataType = T.StringType()) -> Column:
    if isinstance(fn, str):
        return KNOWN[fn](F.col(col))
    return vectorized(fn, return_type)(F.col(col))


def apply_column_fn(df: DataFrame, col: str, fn: str | Callable, out: str = "value",
                    return_type: T.DataType = T.StringType()) -> DataFrame:
    """Apply a function to each value of a column, then count the results."""
    mapped = df.select(apply_fn(col, fn, return_type).alias(out))
    return value_counts(mapped, out)


def apply_cellwise_fn(df: DataFrame, fn: str | Callable, types=(T.StringType,)) -> DataFrame:
    """Apply a function to every cell of the columns whose type is listed."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, tuple(types)):
            c = (KNOWN[fn](c) if isinstance(fn, str) else vectorized(fn, f.dataType)(c))
        cols.append(c.alias(f.name))
    return df.select(*cols)
