"""Cleaning: imputation and the cleaning chain (survey 2.9, first half).

Imputation statistics for all columns are computed together: the columns are
unpivoted into (column, value) pairs and one grouped job answers every column
(exact medians through the distributed quantile job, modes through two
partially aggregated groupBys). The fill itself is one narrow projection.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import bound_and_cap_price, bound_and_cap_range, bound_coordinates, bound_year
from .quantiles import quantiles


def _long_form(df: DataFrame, cols, cast: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(cast).alias("value"))
                                for c in cols]))
    return df.select(pairs.alias("p")).select("p.*")


def column_medians(df: DataFrame, cols, method: str = "exact") -> dict[str, float]:
    """Median of each numeric column over its non-null values (one job set)."""
    cols = list(cols)
    if not cols:
        return {}
    long = _long_form(df, cols, "double")
    rows = quantiles(long, "value", [0.5], by=["column"], names=["median"], method=method).collect()
    return {r["column"]: r["median"] for r in rows}


def column_modes(df: DataFrame, cols) -> dict[str, str | None]:
    """Most frequent non-null value of each column, smallest on ties; None if all null."""
    cols = list(cols)
    if not cols:
        return {}
    long = _long_form(df, cols, "string").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.max("n").alias("n"))
    top = counts.join(best, ["column", "n"]).groupBy("column").agg(F.min("value").alias("mode"))
    found = {r["column"]: r["mode"] for r in top.collect()}
    return {c: found.get(c) for c in cols}


def columns_with_nulls(df: DataFrame, cols) -> list[str]:
    """The columns (of ``cols``) holding at least one null: one aggregate."""
    cols = list(cols)
    if not cols:
        return []
    row = df.agg(*[F.max(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def impute_median(df: DataFrame, cols=None, method: str = "exact", check_nulls: bool = True) -> DataFrame:
    """Numeric nulls -> column median (only columns that have a null)."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    cols = list(cols)
    if not cols:
        return df
    todo = columns_with_nulls(df, cols) if check_nulls else cols
    med = column_medians(df, todo, method)
    fills = {c: v for c, v in med.items() if v is not None}
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(fills[c]).cast(df.schema[c].dataType)).alias(c)
                       if c in fills else F.col(f"`{c}`") for c in df.columns])


def impute_mode(df: DataFrame, cols=None, unknown: str = "Unknown", check_nulls: bool = True) -> DataFrame:
    """String nulls -> mode (smallest on ties), or 'Unknown' if the column is all null."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cols = list(cols)
    if not cols:
        return df
    todo = columns_with_nulls(df, cols) if check_nulls else cols
    modes = column_modes(df, todo)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(modes[c] if modes[c] is not None else unknown)).alias(c)
                       if c in modes else F.col(f"`{c}`") for c in df.columns])


def impute_constant(df: DataFrame, values: dict) -> DataFrame:
    """Nulls -> a constant per column (1, 'unknown', 0, ...)."""
    return df.na.fill({k: v for k, v in values.items() if k in df.columns})


def clean_table(df: DataFrame, range_col: str = "Electric Range", price_col: str = "Base MSRP",
                year_col: str = "Model Year", ref_year: int = 2024, lat: str = "Latitude",
                lon: str = "Longitude", method: str = "exact", range_cap=1000, price_cap=500000,
                year_low: int = 2010) -> DataFrame:
    """distinct rows -> median/mode imputation -> domain bounds -> coordinate bounds.

    The de-duplicated table is persisted (memory, spilling to disk) because the
    imputation statistics read it several times; a lost executor only means
    its blocks are recomputed from lineage.
    """
    out = df.dropDuplicates().persist(StorageLevel.MEMORY_AND_DISK)
    numeric = [f.name for f in out.schema.fields if isinstance(f.dataType, T.NumericType)]
    strings = [f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType)]
    holes = set(columns_with_nulls(out, numeric + strings))     # one pass decides both fills
    out = impute_median(out, [c for c in numeric if c in holes], method=method, check_nulls=False)
    out = impute_mode(out, [c for c in strings if c in holes], check_nulls=False)
    out = bound_and_cap_range(out, range_col, range_cap)
    out = bound_and_cap_price(out, price_col, price_cap)
    out = bound_year(out, year_col, ref_year, year_low)
    return bound_coordinates(out, lat, lon)
