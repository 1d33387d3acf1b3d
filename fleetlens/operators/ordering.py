"""Positions, running sums and runs in a global order, without a one-task window.

Rows are sorted by range partitioning (Spark samples the order values, so
partitions are even under skew) with a hash of the row as the last order column
(so rows of equal order values may be cut apart). A row's position is its place
in its partition plus the rows of the partitions before. The partitions' totals
are one small row each; their number is the session's, not the data's.

The sorted rows are a checkpoint: Spark samples anew for every execution, so the
cuts must be taken once. Row positions inside a partition come from the ids that
Spark gives to consecutive rows, not from a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

PART, PLACE = "_part", "_place"


def _row_hash(df: DataFrame) -> Column:
    """A hash over the columns that Spark can hash (maps and variants are left out)."""
    def simple(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return all(simple(f.dataType) for f in t.fields)
        return simple(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.MapType, T.VariantType))
    return F.xxhash64(F.lit(0), *[F.col(f"`{f.name}`") for f in df.schema.fields if simple(f.dataType)])


def sorted_parts(df: DataFrame, order, split_ties: bool = True, rows_per_part: int | None = None) -> DataFrame:
    """``df`` sorted by ``order`` over range partitions, with the partition (``_part``) and the
    place in it (``_place``, from 0) of every row. Nulls come first. As many partitions as the
    session's shuffles have, or, if given, one for ``rows_per_part`` rows."""
    keys = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
    if split_ties:
        keys.append(_row_hash(df))
    many = [] if rows_per_part is None else [max(1, -(-df.count() // rows_per_part))]
    rows = df.repartitionByRange(*many, *keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    rows = rows.withColumn(PART, F.shiftright("_mid", 33).cast("int")).withColumn(PLACE, F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    return materialize(rows.drop("_mid"))


def _before(parts: DataFrame, total: Column, out: str, zero) -> DataFrame:
    """``_part`` and the sum of ``total`` over the partitions before it (as many rows as partitions)."""
    rows = parts.groupBy(PART).agg(total.alias("_t"))
    kind = rows.schema["_t"].dataType
    done, run = [], zero
    for r in sorted(rows.collect(), key=lambda r: r[PART]):
        done.append((r[PART], run))
        run = run + (r["_t"] if r["_t"] is not None else zero)
    return df_of(parts, done, f"{PART} int, {out} {kind.simpleString()}")


def df_of(like: DataFrame, rows: list, schema: str) -> DataFrame:
    return F.broadcast(like.sparkSession.createDataFrame(rows, schema))


def positions(df: DataFrame, order, out: str = "_position", rows_per_part: int | None = None) -> DataFrame:
    """Position (from 0) of every row in the whole frame's ``order``; ties by the hash of the row."""
    parts = sorted_parts(df, order, rows_per_part=rows_per_part)
    before = _before(parts, F.count(F.lit(1)), "_b", 0)
    return parts.join(before, PART).withColumn(out, F.col("_b") + F.col(PLACE)).drop(PART, PLACE, "_b")


def prefix_sums(df: DataFrame, order, value: str, out: str, inclusive: bool = False, rows_per_part: int | None = None) -> DataFrame:
    """Running sum of ``value`` over the whole frame in ``order`` (null values add nothing)."""
    parts = sorted_parts(df, order, rows_per_part=rows_per_part)
    kind = parts.select(F.sum(f"`{value}`").alias("s")).schema["s"].dataType
    before = _before(parts, F.coalesce(F.sum(f"`{value}`"), F.lit(0).cast(kind)), "_b", 0.0 if isinstance(kind, T.DoubleType) else 0)
    w = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (parts.join(before, PART).withColumn(out, F.col("_b") + F.coalesce(F.sum(f"`{value}`").over(w), F.lit(0).cast(kind)))
            .drop(PART, PLACE, "_b"))


def runs(df: DataFrame, key: str, time: str, step, out: str = "_run", rows_per_part: int | None = None) -> DataFrame:
    """A number for every run of rows of one ``key`` whose ``time`` values (numbers) lie ``step`` apart.

    A partition looks only at itself and at the last row before it, so a key's
    history is spread over as many tasks as its rows fill.
    """
    parts = sorted_parts(df, [key, time], False, rows_per_part)
    ends = parts.groupBy(PART).agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(time).alias("t")), PLACE).alias("e")).collect()
    last, carried = None, []
    for r in sorted(ends, key=lambda r: r[PART]):
        carried.append((r[PART], last is not None, None if last is None else last["k"], None if last is None else last["t"]))
        last = r["e"]
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    carry = df_of(parts, carried, f"{PART} int, __has boolean, __k {kinds[key]}, __t {kinds[time]}")
    w = Window.partitionBy(PART).orderBy(PLACE)
    first = F.lag(F.lit(1)).over(w).isNull()
    prev_k = F.when(first, F.col("__k")).otherwise(F.lag(key).over(w))
    prev_t = F.when(first, F.col("__t")).otherwise(F.lag(time).over(w))
    there = F.when(first, F.col("__has")).otherwise(F.lit(True))
    same = there & prev_k.eqNullSafe(F.col(key)) & F.coalesce(F.col(time) - prev_t == F.lit(step), F.lit(False))
    flagged = parts.join(carry, PART).withColumn("_new", F.when(same, 0).otherwise(1)).drop("__has", "__k", "__t")
    before = _before(flagged, F.sum("_new"), "_b", 0)
    numbered = flagged.join(before, PART).withColumn(out, F.col("_b") + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.drop(PART, PLACE, "_new", "_b")
