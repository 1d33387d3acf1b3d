"""Exact, distributed, linear-interpolated quantiles.

pandas ``quantile`` / DuckDB ``quantile_cont`` interpolate between the order
statistics at ranks floor(h) and ceil(h), h = (n-1)·p. Spark's ``percentile``
gives the same numbers but keeps every distinct value of a group in one
aggregation buffer, so one hot group (a third of all rows) would land in a
single task. This module finds the order statistics by histogram refinement
instead:

1. one grouped pass: n, min, max per group;
2. per group value intervals [lo, hi], the count ``below`` each and the ranks
   that lie in it; each pass splits an interval into ``bins`` equal-width buckets,
   counts rows per bucket with a partially aggregated ``groupBy`` (bounded
   shuffle: intervals x bins rows), and keeps the buckets that hold ranks;
3. once an interval holds at most ``small`` rows (100,000 doubles, about 800 KB) or
   a single value, the rows left in it are gathered ONCE, sorted inside one
   group of bounded size, and all its ranks are read from there.

Rows meet the intervals by broadcast joins: an open interval holds more than ``small``
rows, so there are few of them, and a shuffle by the group would sort all rows of a
hot group in one task. The closed intervals (a few per group) are broadcast if they
are proven small; with more groups than that the join is a shuffle join.

Every step is a DataFrame job; the loop's state is a small table that is
checkpointed each pass. ``method="approx"`` switches to ``percentile_approx``.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .lookups import bounded_broadcast


def _nsjoin(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null (group keys may be null)."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def quantiles(df: DataFrame, value: str, probs, by=(), names=None, method: str = "exact",
              bins: int = 1024, small: int = 100_000, accuracy: int = 1_000_000) -> DataFrame:
    """One row per group of ``by`` with one column per probability.

    Nulls and NaN in ``value`` are ignored, as in pandas.
    """
    probs = [float(p) for p in probs]
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    by = list(by)
    base = (df.select(*by, F.col(value).cast("double").alias("_v"))
            .where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    if method == "approx":
        return base.groupBy(*by).agg(*[F.percentile_approx("_v", p, accuracy).alias(n)
                                       for p, n in zip(probs, names)])
    keys = by or ["_g"]
    if not by:
        base = base.withColumn("_g", F.lit(0))
    # every pass re-reads only (keys, value): keep that projection, not the upstream plan
    base = base.persist(StorageLevel.MEMORY_AND_DISK)

    stats = materialize(base.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    ranks = F.array(*[c for p in probs for c in (F.floor((F.col("_n") - 1) * F.lit(p)), F.ceil((F.col("_n") - 1) * F.lit(p)))])
    # one row per open interval, with all the ranks that lie in it: intervals of a group are disjoint, so no
    # row of the data is counted or gathered twice, however many ranks are asked for
    state = stats.select(*keys, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_cnt"),
                         F.array_distinct(F.transform(ranks, lambda k: k.cast("long"))).alias("_ks"))
    largest = stats.agg(F.max("_n")).first()[0] or 0

    while largest > small:  # ends: a pass narrows an open interval to buckets' own least and greatest values
        is_open = (F.col("_lo") < F.col("_hi")) & (F.col("_cnt") > small)
        open_ = state.where(is_open)
        closed = state.where(~is_open)
        j = _nsjoin(base, F.broadcast(open_), keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # halves first: the span of two finite doubles may overflow; the top value has a bucket of its own
        rel = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        j = j.withColumn("_b", F.when(F.col("_v") == F.col("_hi"), F.lit(bins)).when(F.col("_v") == F.col("_lo"), F.lit(-1))
                         .otherwise(F.least(F.floor(rel * F.lit(bins)), F.lit(bins - 1))).cast("int"))
        hist = j.groupBy(*keys, "_below", "_b").agg(
            F.count(F.lit(1)).alias("_nb"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi"))
        w = Window.partitionBy(*keys, "_below").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("_end", F.col("_below") + F.sum("_nb").over(w)).withColumn("_start", F.col("_end") - F.col("_nb"))
        refined = _nsjoin(hist, open_.select(*keys, "_below", "_ks"), [*keys, "_below"])
        refined = refined.withColumn("_ks", F.filter("_ks", lambda k: (k >= F.col("_start")) & (k < F.col("_end")))).where(F.size("_ks") > 0)
        refined = refined.select(*keys, F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"), F.col("_start").alias("_below"),
                                 F.col("_nb").alias("_cnt"), "_ks")
        state = materialize(closed.unionByName(refined))
        largest = state.where("_lo < _hi").agg(F.max("_cnt")).first()[0] or 0

    single = state.where(F.col("_lo") == F.col("_hi")).select(*keys, F.explode("_ks").alias("_k"), F.col("_lo").alias("_x"))
    rest = state.where(F.col("_lo") < F.col("_hi"))
    inside = F.transform("_ks", lambda k: F.struct(k.alias("_k"), F.element_at("_arr", (k - F.col("_below") + 1).cast("int")).alias("_x")))
    gathered = (_nsjoin(base, bounded_broadcast(rest.select(*keys, "_lo", "_hi", "_below")), keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
                .groupBy(*keys, "_below").agg(F.sort_array(F.collect_list("_v")).alias("_arr")))
    gathered = (_nsjoin(gathered, rest.select(*keys, "_below", "_ks"), [*keys, "_below"])
                .select(*keys, F.explode(inside).alias("_e")).select(*keys, "_e._k", "_e._x"))
    values = single.unionByName(gathered)
    vmap = values.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_k", "_x"))).alias("_m"))
    out = _nsjoin(stats.select(*keys, "_n"), vmap, keys)
    cols = []
    for p, name in zip(probs, names):
        h = (F.col("_n") - 1) * F.lit(p)
        k0 = F.floor(h).cast("long")
        k1 = F.ceil(h).cast("long")
        x0 = F.element_at("_m", k0)
        x1 = F.element_at("_m", k1)
        cols.append((x0 + (h - k0) * (x1 - x0)).alias(name))
    result = materialize(out.select(*(by or []), *cols))
    base.unpersist()
    return result


def quantile_values(df: DataFrame, value: str, probs, method: str = "exact") -> list[float]:
    """Ungrouped quantiles as Python floats (one small row to the driver)."""
    row = quantiles(df, value, probs, method=method, names=[f"p{i}" for i in range(len(probs))]).first()
    if row is None:
        return [None] * len(probs)
    return [row[f"p{i}"] for i in range(len(probs))]
