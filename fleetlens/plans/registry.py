"""Registry of named queries: a Spark builder and (where SQL can say it) the
DuckDB text that must give the same rows.

Conventions shared by both sides: every computed column is aliased, doubles
are rounded to 6 places, counts are BIGINT, ties are broken by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def round_doubles(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places (the oracle does the same)."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.simpleString() in ("double", "float")
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def money_mean_sql(x: str, scale: int = 2) -> str:
    """DuckDB twin of ``profile.fixed_point_mean``."""
    u = f"CAST(round({x} * {10 ** scale}) AS BIGINT)"
    return (f"(CAST(floor((CAST(sum({u}) AS HUGEINT) * {2 * 10 ** (6 - scale)} + count({u})) "
            f"/ (2 * count({u}))) AS DOUBLE) / 1000000.0)")


def load_all() -> None:
    """Import every query module so that its queries register."""
    from . import (  # noqa: F401
        q_profile, q_clean, q_ordered, q_metrics, q_logs, q_sources, q_learn, q_streams,
    )
