"""Window, ranking and ordered operations; sorts, limits, top-k (2.5, 2.6).

Scale rules used here:
* sliding-window counts per client are computed per (client, time bucket):
  each row is also copied into the next bucket as context, so no window
  partition ever holds more than two buckets of one client, even when one
  client sends a third of all requests;
* "latest"/"best" per group are aggregates (max of a struct), partially
  aggregated before the shuffle, not windows;
* top-n per group filters ``row_number() <= n`` so Spark plans a group
  limit before the shuffle; the complement is an anti-join, not a window;
* windows without PARTITION BY only ever see small grouped frames (k-means
  k values, PCA components, per-value counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import prefix_sums


def event_micros(ts: str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rolling_count(df: DataFrame, key: str, ts: str, window_seconds: float, out: str = "recent") -> DataFrame:
    """Rows of the same key with time in [t - w, t] (peers with equal time included).

    A row without a time has a null count and is in no window."""
    w = int(window_seconds * 1_000_000)
    t = event_micros(ts)
    base = df.withColumn("_t", t).withColumn("_b", F.floor(F.col("_t") / F.lit(w)))
    own = base.withColumn("_own", F.lit(True))
    ctx = base.where(F.col("_t").isNotNull()).withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    both = own.unionByName(ctx)
    win = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(-w, 0)
    return (both.withColumn(out, F.when(F.col("_t").isNotNull(), F.count(F.lit(1)).over(win)))
            .where(F.col("_own")).drop("_t", "_b", "_own"))


def rolling_request_count(df: DataFrame, client: str, ts: str, window_seconds: float = 60,
                          limit: int | None = None) -> DataFrame:
    """Requests of the same client in the preceding window; flags those over ``limit``."""
    out = rolling_count(df, client, ts, window_seconds, "recent_requests")
    if limit is not None:
        out = out.withColumn("over_limit", F.col("recent_requests") > F.lit(limit))
    return out


# Daily limits per action.
DAILY_LIMITS = {"train_model": 10, "batch_predict": 50, "single_predict": 1000}


def daily_quota_usage(df: DataFrame, user: str, action: str, ts: str, id_col: str,
                      limits: DataFrame) -> DataFrame:
    """Running count of a user's actions per day, against a (action, daily_limit) table.

    The running count is the exact rank inside (user, action, day) in time
    order, computed by ``rank_within`` (bucketed by time, so one busy user's
    day is spread over several tasks); the limits table is tiny and joined by
    broadcast after a size check.
    """
    from .features import rank_within
    from .lookups import bounded_broadcast
    base = df.withColumn("day", F.to_date(F.col(ts))).withColumn("_t", event_micros(ts))
    ranked = rank_within(base, [user, action, "day"], "_t", tiebreak=[id_col], out="_r")
    used = ranked.withColumn("used_today", F.col("_r") + 1).drop("_r", "_t")
    out = used.join(bounded_broadcast(limits, 10_000), action, "left")
    return out.withColumn("over_quota", F.coalesce(F.col("used_today") > F.col("daily_limit"), F.lit(False)))


def keep_last_n(runs: DataFrame, group: str, start: str, id_col: str, n: int = 10) -> DataFrame:
    """The n newest runs per group (ties by id). Planned with a group limit."""
    w = Window.partitionBy(group).orderBy(F.col(start).desc(), F.col(id_col).desc())
    return runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def runs_to_delete(runs: DataFrame, group: str, start: str, id_col: str, n: int = 10) -> DataFrame:
    """Everything keep_last_n does not keep (anti-join on the id)."""
    kept = keep_last_n(runs, group, start, id_col, n).select(id_col)
    return runs.join(kept, id_col, "left_anti")


def latest_version(versions: DataFrame, name: str, version: str, stage: str | None = None,
                   stages=None) -> DataFrame:
    """Newest version per name (per name and stage if ``stage`` is given); an aggregate."""
    df = versions
    if stage and stages:
        df = df.where(F.col(stage).isin(list(stages)))
    keys = [name] + ([stage] if stage else [])
    others = [c for c in df.columns if c not in keys and c != version]
    # ordered by the version alone: the other columns may be of types without an order (maps)
    best = F.max_by(F.struct(F.col(version).alias("_v"), *[F.col(c) for c in others]), F.col(version)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, F.col("_best._v").alias(version),
                                              *[F.col(f"_best.{c}").alias(c) for c in others])


def stage_transition(versions: DataFrame, name_col: str, version_col: str, stage_col: str,
                     name: str, version, new_stage: str, archive: bool = True) -> DataFrame:
    """Move one version to ``new_stage``; versions already there become Archived."""
    is_target = (F.col(name_col) == F.lit(name)) & (F.col(version_col) == F.lit(version))
    expr = F.when(is_target, F.lit(new_stage))
    if archive:
        expr = expr.when((F.col(name_col) == F.lit(name)) & (F.col(stage_col) == F.lit(new_stage)), F.lit("Archived"))
    return versions.withColumn(stage_col, expr.otherwise(F.col(stage_col)))


def cumulative_share(df: DataFrame, order_col: str, value_col: str, out: str = "cumulative") -> DataFrame:
    """Running sum in order, of frames of any size (null values add nothing)."""
    return prefix_sums(df, [order_col], value_col, out, inclusive=True)


def elbow_point(df: DataFrame, k_col: str, inertia_col: str, group: str | None = None) -> DataFrame:
    """k maximising (I[k-1]-I[k]) - (I[k]-I[k+1]); smallest k on ties."""
    part = [group] if group else []
    w = Window.partitionBy(*part).orderBy(k_col)
    d2 = (F.lag(inertia_col).over(w) - F.col(inertia_col)) - (F.col(inertia_col) - F.lead(inertia_col).over(w))
    scored = df.withColumn("_d2", d2).where(F.col("_d2").isNotNull())
    best = F.min(F.struct((-F.col("_d2")).alias("nd"), F.col(k_col).alias("k"))).alias("b")
    return scored.groupBy(*part).agg(best).select(*part, F.col("b.k").alias("optimal_k"),
                                                  (-F.col("b.nd")).alias("second_difference"))


def confidence_series(df: DataFrame, model: str, ts: str, id_col: str, conf: str) -> DataFrame:
    """(position, confidence) of predictions that have one, per model in time order (ties: id, confidence)."""
    from .features import rank_within
    have = df.where(F.col(conf).isNotNull() & (F.col(conf) != 0))
    have = have.withColumn("_o", event_micros(ts))
    ranked = rank_within(have, [model], "_o", tiebreak=[id_col, conf], out="position")
    return ranked.select(model, id_col, "position", conf)


def majority_vote(cols, out: str = "vote") -> Column:
    """Most common of m prediction columns per row; smallest label on ties."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    cands = []
    for c in cs:
        n = sum((F.coalesce((c == o).cast("int"), F.lit(0)) for o in cs), F.lit(0))
        cands.append(F.struct((-n).alias("n"), c.alias("label")))
    return F.array_min(F.array(*cands)).getField("label").alias(out)


def pick_best(df: DataFrame, score: str, order: str, group: str | None = None) -> DataFrame:
    """Row with the highest score; the first (smallest ``order``) wins ties.

    A row without a score (null or NaN) wins only where no row has one."""
    keys = [group] if group else []
    others = [c for c in df.columns if c not in keys]
    s = F.col(score)
    missing = s.isNull() | F.isnan(s.cast("double"))
    rank = F.struct(missing.alias("m"), F.when(~missing, -s).alias("ns"), F.col(order).alias("o"))
    best = F.min_by(F.struct(*[F.col(c) for c in others]), rank).alias("_b")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows by an explicit order (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def preview(df: DataFrame, order, n: int = 100) -> DataFrame:
    return df.orderBy(*order).limit(n)


def recent_runs(runs: DataFrame, start: str, id_col: str, n: int = 50) -> DataFrame:
    return runs.orderBy(F.col(start).desc(), F.col(id_col).desc()).limit(n)


def search_runs(runs: DataFrame, filter_expr: str | None = None, experiment_col: str | None = None,
                experiment_ids=None, order=None, n: int = 100) -> DataFrame:
    """Filter string (SQL predicate), experiment ids, max results."""
    out = runs
    if experiment_col and experiment_ids:
        out = out.where(F.col(experiment_col).isin(list(experiment_ids)))
    if filter_expr:
        out = out.where(F.expr(filter_expr))
    if order:
        out = out.orderBy(*order)
    return out.limit(n)


def paginate(df: DataFrame, order, skip: int = 0, limit: int = 20) -> DataFrame:
    """One page (skip/limit in an explicit order) with total and has_more."""
    total = df.count()
    page = df.orderBy(*order).offset(skip).limit(limit)
    return page.withColumn("total", F.lit(total).cast("long")).withColumn(
        "has_more", F.lit(skip + limit < total))
