"""Set operations (survey 2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .predicates import missing_columns  # noqa: F401  (required minus present)


def append_categories(known: DataFrame, seen: DataFrame, col: str) -> DataFrame:
    """Known classes union classes first seen at scoring (anti-join, no duplicates)."""
    k = known.select(col).distinct()
    new = seen.select(col).distinct().join(k, col, "left_anti")
    return k.unionByName(new)
