"""Joins and lookups (dictionary maps, membership, registry keys).

The reference maps group statistics back onto rows with Python dicts. Here a
lookup is a grouped aggregate (partially aggregated map-side, so a hot key
costs one row per partition in the shuffle) joined back to the rows on the
key. The lookup table (one row per key) is computed once and checkpointed, then
broadcast only when its row count is proven small (``small_lookup``), so the
large side is never shuffled for a small lookup; a large lookup table is
sort-merge joined (AQE splits skewed partitions). Static dimension tables are
broadcast only after ``bounded_broadcast`` has proven their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MAX_LOOKUP_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame):
    """Column: bytes of a row as text, plus a fixed part per column (a measure of its broadcast size)."""
    width = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif f.dataType.simpleString().startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    return width


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast-hint ``df`` only if it has at most ``max_rows`` rows and ``max_bytes`` bytes.

    Both are proven on at most ``max_rows + 1`` rows; beyond them the frame is
    returned unhinted and the planner picks a shuffle join.
    """
    r = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if r["n"] <= max_rows and r["b"] <= max_bytes else df


def small_lookup(table: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """A lookup table computed once (checkpointed: one row per key) and
    broadcast only if its rows and bytes are proven small; beyond that the
    join falls back to a shuffle join. Without this, the planner shuffles the
    large side by the key before it learns that the lookup side is small."""
    from ..session import materialize
    return bounded_broadcast(materialize(table), max_rows)


def lookup_count(df: DataFrame, key: str, out: str) -> DataFrame:
    """Attach the size of each row's key group; a null key gets null."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return df.join(small_lookup(counts), on=key, how="left")


def lookup_share(df: DataFrame, key: str, out: str) -> DataFrame:
    """Attach count(key)/count(non-null keys) (value_counts(normalize=True))."""
    total = df.where(F.col(key).isNotNull()).count()
    shares = (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg((F.count(F.lit(1)) / F.lit(float(total) if total else None)).alias(out)))
    return df.join(small_lookup(shares), on=key, how="left")


def lookup_mean(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Attach the mean of ``value`` over the row's key group."""
    means = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(out))
    return df.join(small_lookup(means), on=key, how="left")


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent non-null keys, ties broken by key (distributed top-k)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.desc("_n"), F.asc(key)).limit(n).select(key))


def flag_in_top_n(df: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """1 if the row's key is among the n most frequent keys, else 0.

    The top-n frame has at most n rows, so the broadcast is bounded by n.
    """
    top = top_keys(df, key, n).withColumn(out, F.lit(1))
    return (df.join(F.broadcast(top), on=key, how="left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(0))))


def flag_in_set(col: str | Column, values, upper: bool = True) -> Column:
    """1 if the value is in a fixed list (optionally upper-casing first), else 0."""
    c = F.col(col) if isinstance(col, str) else col
    if upper:
        c = F.upper(c)
    return F.coalesce(c.isin(list(values)).cast("int"), F.lit(0))


def join_registry(parent: DataFrame, child: DataFrame, on, how: str = "inner",
                  small_side_rows: int | None = None) -> DataFrame:
    """1:N equi-join between registry tables (dataset->models, model->runs...).

    If ``small_side_rows`` is given, the parent is broadcast after its size
    is proven; otherwise the planner decides.
    """
    if small_side_rows is not None:
        parent = bounded_broadcast(parent, small_side_rows)
    return child.join(parent, on=on, how=how)


def orphans(children: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """Children whose parent is gone (the rows a cascade delete-orphan removes)."""
    return children.join(parents.select(F.col(pk).alias(fk)), on=fk, how="left_anti")


def orphan_cleanup(children: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """Children that keep a parent."""
    return children.join(parents.select(F.col(pk).alias(fk)), on=fk, how="left_semi")


def lookup_by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The single row with ``key == value`` (first by key order if repeated)."""
    return df.where(F.col(key) == F.lit(value)).orderBy(*df.columns).limit(1)


def lookup_many(df: DataFrame, keys: DataFrame, key: str, max_keys: int = 1_000_000) -> DataFrame:
    """Rows whose key is in ``keys`` (semi-join; broadcast when proven small)."""
    return df.join(bounded_broadcast(keys.select(key).distinct(), max_keys), on=key, how="left_semi")
