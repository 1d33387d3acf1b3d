"""Projections, filters and predicates (survey 2.2) and set logic on column
lists (2.7). Filters are plain Column predicates so Catalyst pushes them into
the Parquet scan; column checks compare ``df.columns`` and run no job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The three required-column lists of the reference.
REQUIRED_EV_COLUMNS = ["VIN (1-10)", "County", "City", "State", "Model Year", "Make", "Model",
                       "Electric Vehicle Type", "Electric Range", "Base MSRP"]
REQUIRED_PROCESSED_COLUMNS = ["Model Year", "Make", "Model", "Electric Vehicle Type", "Electric Range"]


def missing_columns(df: DataFrame, required) -> list[str]:
    """Required minus present columns, in the order given."""
    present = set(df.columns)
    return [c for c in required if c not in present]


def require_columns(df: DataFrame, required) -> tuple[bool, list[str]]:
    """(all present?, missing list)."""
    miss = missing_columns(df, required)
    return (not miss, miss)


def range_warnings(df: DataFrame, year: str, measure: str, year_bounds=(2000, 2030),
                   measure_bounds=(0, 1000)) -> DataFrame:
    """min/max of the year and the measure plus out-of-range flags, one agg."""
    s = df.agg(F.min(year).alias("min_year"), F.max(year).alias("max_year"),
               F.min(measure).cast("double").alias("min_measure"),
               F.max(measure).cast("double").alias("max_measure"))
    return s.select("*",
                    ((F.col("min_year") < year_bounds[0]) | (F.col("max_year") > year_bounds[1]))
                    .alias("year_warning"),
                    ((F.col("min_measure") < measure_bounds[0]) | (F.col("max_measure") > measure_bounds[1]))
                    .alias("measure_warning"))


def drop_columns(df: DataFrame, cols) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def select_rename(df: DataFrame, keep, rename: dict | None = None) -> DataFrame:
    out = df.select(*[F.col(f"`{c}`") for c in keep])
    for a, b in (rename or {}).items():
        out = out.withColumnRenamed(a, b)
    return out


def lowercase_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def lowercase_strings(df: DataFrame) -> DataFrame:
    """lower() on every string column; other types untouched."""
    return df.select(*[F.lower(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def flag_equals(col: str | Column, value, yes="yes", no="no") -> Column:
    """yes if equal, else no (a null becomes no)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == F.lit(value), F.lit(yes)).otherwise(F.lit(no))


def bound_and_cap(df: DataFrame, col: str, lower, cap, lower_inclusive: bool = True) -> DataFrame:
    """Drop rows below ``lower`` (nulls go too, as in a pandas mask); cap at ``cap``."""
    if col not in df.columns:
        return df
    c = F.col(col)
    keep = c >= lower if lower_inclusive else c > lower
    return df.where(keep).withColumn(col, F.least(c, F.lit(cap).cast(df.schema[col].dataType)))


def bound_and_cap_range(df: DataFrame, col: str, cap=1000) -> DataFrame:
    return bound_and_cap(df, col, 0, cap, lower_inclusive=True)


def bound_and_cap_price(df: DataFrame, col: str, cap=500000) -> DataFrame:
    return bound_and_cap(df, col, 0, cap, lower_inclusive=False)


def bound_year(df: DataFrame, col: str, ref_year: int, low: int = 2010) -> DataFrame:
    """Keep year in [low, ref_year + 1]; ref_year is a parameter, never the clock."""
    if col not in df.columns:
        return df
    return df.where(F.col(col).between(low, ref_year + 1))


def bound_coordinates(df: DataFrame, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    if lat in df.columns and lon in df.columns:
        return df.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    return df


def filter_by_dict(df: DataFrame, filters: dict) -> DataFrame:
    """AND of equality filters; unknown columns are ignored."""
    conds = [F.col(f"`{k}`") == F.lit(v) for k, v in (filters or {}).items() if k in df.columns]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def filter_registry(df: DataFrame, search: str | None = None, search_cols=(), date_col: str | None = None,
                    date_from=None, date_to=None, status_col: str | None = None, status=None,
                    sort_by: str | None = None, descending: bool = True, id_col: str | None = None,
                    skip: int = 0, limit: int | None = None) -> DataFrame:
    """Search term, date window, status, sort (ties by id), skip/limit."""
    out = df
    if search and search_cols:
        term = F.lit(search.lower())
        out = out.where(reduce(lambda a, b: a | b,
                               [F.coalesce(F.lower(F.col(c)).contains(term), F.lit(False)) for c in search_cols]))
    if date_col and date_from is not None:
        out = out.where(F.col(date_col) >= F.lit(date_from).cast(df.schema[date_col].dataType))
    if date_col and date_to is not None:
        out = out.where(F.col(date_col) <= F.lit(date_to).cast(df.schema[date_col].dataType))
    if status_col and status is not None:
        out = out.where(F.col(status_col) == F.lit(status))
    if sort_by:
        key = F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last()
        out = out.orderBy(key, *([F.col(id_col).asc()] if id_col else []))
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out


def drop_incomplete(df: DataFrame, cols) -> DataFrame:
    return df.na.drop(how="any", subset=list(cols))


def select_numeric_features(df: DataFrame, target: str | None = None) -> list[str]:
    """All numeric columns but the target (the default feature list)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name != target]


def fan_out_copies(df: DataFrame, names=("RC", "DC", "LR", "LogReg")) -> dict[str, DataFrame]:
    """Named 'copies' for independent branches. DataFrames are immutable, so
    every name maps to the same cached plan; no data is copied."""
    cached = df.cache()
    return {n: cached for n in names}
