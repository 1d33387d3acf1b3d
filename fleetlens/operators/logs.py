"""Log and metric analytics in batch form (survey 2.12).

The monitoring rules of the reference are time-bucketed aggregates over a
request log. Here they are ``groupBy(window(ts, ...))`` jobs: partial
aggregation per window before the shuffle, so a busy endpoint or client
costs one row per partition and window. Alert state ("condition held for N
minutes") is a gaps-and-islands computation over the (small) per-window
metric table, partitioned by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookups import bounded_broadcast
from .ordering import runs as numbered_runs
from .quantiles import quantiles

# Alert rules (metric, comparison, threshold, hold time).
ALERT_RULES = [
    ("HighErrorRate", "error_rate", ">", 0.1, "5 minutes"),
    ("HighResponseTime", "p95_latency", ">", 1.0, "5 minutes"),
    ("ModelAccuracyDrop", "model_accuracy", "<", 0.8, "10 minutes"),
    ("HighMemoryUsage", "memory_usage", ">", 0.9, "5 minutes"),
    ("HighCPUUsage", "cpu_usage", ">", 90.0, "5 minutes"),
    ("LowDiskSpace", "disk_free", "<", 0.1, "1 minute"),
]

# Default latency histogram bucket bounds (seconds) of the
# metrics client library; +Inf is implied.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def _win(ts: str, size: str, slide: str | None = None) -> Column:
    return F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)


def request_rate(df: DataFrame, ts: str, size: str = "5 minutes", seconds: int = 300, by=()) -> DataFrame:
    """Requests per second per tumbling window (and group)."""
    return (df.groupBy(_win(ts, size).alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("w.start").alias("window_start"), *by, "requests",
                    (F.col("requests") / F.lit(float(seconds))).alias("rate")))


def sliding_rate(df: DataFrame, ts: str, size: str = "5 minutes", slide: str = "15 seconds",
                 seconds: int = 300) -> DataFrame:
    """Requests per second over ``size`` evaluated every ``slide`` (see ``sliding_windows``)."""
    panes = df.groupBy(_win(ts, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("pane"), "n")
    return (sliding_windows(panes, size, slide, F.sum("n").alias("requests"))
            .select("window_start", "requests", (F.col("requests") / F.lit(float(seconds))).alias("rate")))


def interval_seconds(text: str) -> int:
    """Seconds of a text such as "5 minutes" (a whole number of seconds, minutes, hours or days)."""
    n, unit = text.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def sliding_windows(panes: DataFrame, size: str, slide: str, *aggs: Column) -> DataFrame:
    """Windows of ``size`` every ``slide`` from partial results of one ``slide`` each (column ``pane``: its start).

    Rows are aggregated once, to their pane; only panes (at most one row per
    slide) are copied to the ``size / slide`` windows that hold them. ``size``
    must be a multiple of ``slide``.
    """
    width, step = interval_seconds(size), interval_seconds(slide)
    if width % step:
        raise ValueError("the window's size must be a multiple of its slide")
    back = F.sequence(F.lit(0), F.lit(width - step), F.lit(step))
    starts = panes.select("*", F.explode(F.transform(back, lambda s: F.col("pane") - F.make_dt_interval(secs=s))).alias("window_start"))
    return starts.groupBy("window_start").agg(*aggs)


def success_rate(df: DataFrame, ts: str, is_error: Column, size: str = "5 minutes") -> DataFrame:
    """(1 - errors / requests) * 100 per window."""
    return (df.groupBy(_win(ts, size).alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"), F.count_if(is_error).alias("errors"))
            .select(F.col("w.start").alias("window_start"), "requests", "errors",
                    ((1 - F.col("errors") / F.col("requests")) * 100).alias("success_rate")))


def latency_quantile(df: DataFrame, ts: str, value: str, q: float = 0.95, size: str = "5 minutes",
                     method: str = "exact") -> DataFrame:
    """q-quantile of latency per window (exact distributed, or approximate)."""
    w = df.select(F.window(F.col(ts), size).start.alias("window_start"), F.col(value))
    return quantiles(w, value, [q], by=["window_start"], names=["latency_q"], method=method)


def bucket_quantile(df: DataFrame, ts: str, value: str, q: float = 0.95, size: str = "5 minutes",
                    bounds=LATENCY_BUCKETS) -> DataFrame:
    """histogram_quantile: the q-quantile read from cumulative bucket counts,
    interpolating linearly inside the bucket; the +Inf bucket returns the
    highest finite bound, the first bucket starts at 0. Null values are not counted."""
    df = df.where(F.col(value).isNotNull())
    bounds = list(bounds)
    idx = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        idx = F.when(F.col(value) <= F.lit(bounds[i]), F.lit(i)).otherwise(idx)
    counts = (df.select(F.window(F.col(ts), size).start.alias("window_start"), idx.alias("b"))
              .groupBy("window_start", "b").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("window_start").orderBy("b")
    cum = (counts.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("total", F.sum("n").over(Window.partitionBy("window_start"))))
    ub = F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.col("b") + 1)
    lb = F.when(F.col("b") == 0, F.lit(0.0)).otherwise(
        F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.col("b")))
    rank = F.lit(q) * F.col("total")
    hit = cum.where(F.col("cum") >= rank)
    first = hit.groupBy("window_start").agg(F.min(F.struct("b", "cum", "n", "total")).alias("h")).select(
        "window_start", "h.*")
    est = F.when(F.col("b") == len(bounds), F.lit(float(bounds[-1]))).otherwise(
        lb + (ub - lb) * (rank - (F.col("cum") - F.col("n"))) / F.col("n"))
    return first.select("window_start", est.alias("latency_q"))


def mean_metric(df: DataFrame, value: str, by=(), out: str = "mean_value") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(out))


def count_by_type(df: DataFrame, type_col: str, value: str | None = None) -> DataFrame:
    """sum by (type) of a counter, or row counts when no counter column is given."""
    agg = F.sum(value) if value else F.count(F.lit(1))
    return df.groupBy(type_col).agg(agg.alias("total"))


def rules_frame(spark, rules=ALERT_RULES) -> DataFrame:
    return spark.createDataFrame([(a, m, o, float(t), h) for a, m, o, t, h in rules],
                                 "alert string, metric string, op string, threshold double, hold string")


def alert_threshold(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(window_start, metric, value) joined to the rules on metric -> firing flag.

    The rules table is broadcast if it is proven small.
    """
    j = metrics.join(bounded_broadcast(rules), "metric")
    fire = (F.when(F.col("op") == ">", F.col("value") > F.col("threshold"))
            .when(F.col("op") == "<", F.col("value") < F.col("threshold"))
            .when(F.col("op") == ">=", F.col("value") >= F.col("threshold"))
            .otherwise(F.col("value") <= F.col("threshold")))
    return j.select("alert", "metric", "window_start", "value", "threshold", F.coalesce(fire, F.lit(False))
                    .alias("condition"))


def alert_sustained(conditions: DataFrame, step_seconds: int, hold_col: str | None = None,
                    hold_seconds: int | None = None) -> DataFrame:
    """Gaps-and-islands: runs of consecutive windows where the condition holds;
    a run fires once it has lasted ``hold`` (one row per run).

    Input rows: (alert, window_start, condition). Windows are consecutive
    when they are ``step_seconds`` apart. The history of an alert is sorted over
    range partitions, and runs go on across them (see ``ordering.runs``).
    """
    t = F.unix_seconds(F.col("window_start").cast("timestamp"))
    isl = numbered_runs(conditions.where(F.col("condition")).withColumn("_t", t), "alert", "_t", step_seconds, "_island")
    hold = F.max(hold_col) if hold_col else F.lit(hold_seconds)
    runs = isl.groupBy("alert", "_island").agg(F.min("window_start").alias("start"), F.max("window_start").alias("last"),
                                               F.count(F.lit(1)).alias("windows"), hold.alias("_hold"))
    return runs.withColumn("duration_seconds", F.col("windows") * step_seconds).withColumn(
        "fires", F.col("duration_seconds") >= F.col("_hold")).drop("_island", "_hold")


def target_down(df: DataFrame, source: str, ts: str, size_seconds: int) -> DataFrame:
    """(source, window_start) windows with no row from that source, between the
    first and last window seen overall. Built from gaps between each source's
    seen windows, so the work is proportional to rows plus the answer."""
    b = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / size_seconds).cast("long")
    seen = df.select(source, b.alias("b")).distinct()
    rng = seen.agg(F.min("b").alias("lo"), F.max("b").alias("hi")).first()
    lo, hi = rng["lo"], rng["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], f"{source} long, window_start timestamp")
    w = Window.partitionBy(source).orderBy("b")
    prev = F.coalesce(F.lag("b").over(w), F.lit(lo - 1))
    gaps = seen.select(source, (prev + 1).alias("g0"), (F.col("b") - 1).alias("g1"))
    tail = seen.groupBy(source).agg((F.max("b") + 1).alias("g0")).select(source, "g0", F.lit(hi).alias("g1"))
    allg = gaps.unionByName(tail).where(F.col("g1") >= F.col("g0"))
    miss = allg.select(source, F.explode(F.sequence("g0", "g1")).alias("b"))
    return miss.select(source, F.timestamp_seconds(F.col("b") * size_seconds).alias("window_start"))


def api_log_report(df: DataFrame, by, time_col: str, is_error: Column) -> DataFrame:
    """Requests, mean and max response time, error share per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.avg(time_col).alias("avg_response_time"),
                               F.max(time_col).alias("max_response_time"),
                               (F.count_if(is_error) / F.count(F.lit(1))).alias("error_share"))


def job_report(jobs: DataFrame, type_col: str, status_col: str, total: str, processed: str, retries: str,
               max_retries: str, duration: str) -> DataFrame:
    """Jobs by type and status: count, mean duration, mean progress, retries left."""
    progress = F.try_divide(F.col(processed).cast("double"), F.col(total).cast("double"))
    return jobs.groupBy(type_col, status_col).agg(
        F.count(F.lit(1)).alias("jobs"), F.avg(duration).alias("avg_duration"),
        F.avg(progress).alias("avg_progress"),
        F.sum(F.greatest(F.col(max_retries) - F.col(retries), F.lit(0))).cast("long").alias("retries_left"))


def feedback_accuracy(df: DataFrame, model: str, feedback: str) -> DataFrame:
    """Share of predictions marked correct per model (rows without feedback ignored)."""
    return df.groupBy(model).agg(F.avg(F.col(feedback).cast("double")).alias("feedback_accuracy"),
                                 F.count(feedback).alias("with_feedback"))
