"""Aggregations and profiling (value counts, chart data, column profiles,
quality reports, distributions, dashboard cards).

Rules followed throughout: every statistic of one report is computed in ONE
``agg`` (one scan, partial aggregation before the shuffle); ties are broken
by key so results repeat; scalar statistics that later expressions need are
fetched as one small row and used as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import quantiles


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value_counts(df: DataFrame, col: str, limit: int | None = None, count_col: str = "count") -> DataFrame:
    """Rows per non-null value, largest first (ties by value), optional head(limit)."""
    out = (df.where(F.col(col).isNotNull()).groupBy(col)
           .agg(F.count(F.lit(1)).alias(count_col))
           .orderBy(F.desc(count_col), F.asc(col)))
    return out.limit(limit) if limit is not None else out


def share_label(count: Column, total: Column) -> Column:
    """'12.3%' with half-up rounding done in exact integer arithmetic."""
    tenths = F.floor((count * 1000 + F.floor(total / 2)) / total).cast("long")
    return F.concat((tenths / 10).cast("long").cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("%"))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Count, share and pie label (one decimal percent) per non-null value."""
    total = df.where(F.col(col).isNotNull()).count()
    t = F.lit(total).cast("long")
    return (value_counts(df, col)
            .withColumn("share", F.col("count") / t)
            .withColumn("pct_label", share_label(F.col("count"), t)))


def chart_type_distribution(df: DataFrame, col: str, limit: int = 100) -> DataFrame:
    """labels/values (top `limit` by count) plus total_count = all rows."""
    total = df.count()
    return value_counts(df, col, limit).withColumn("total_count", F.lit(total).cast("long"))


def chart_mean_by_year(df: DataFrame, year: str, measure: str, out: str = "mean_range") -> DataFrame:
    """Mean of a measure per year, ordered by year."""
    return (df.where(F.col(year).isNotNull()).groupBy(year)
            .agg(F.avg(measure).alias(out)).orderBy(year))


def chart_make_distribution(df: DataFrame, col: str, limit: int = 100) -> DataFrame:
    """Top values by count plus the number of distinct values."""
    n_distinct = df.agg(F.count_distinct(col)).first()[0]
    return value_counts(df, col, limit).withColumn("total_makes", F.lit(n_distinct).cast("long"))


def chart_geo_distribution(df: DataFrame, a: str, b: str, limit: int = 100) -> DataFrame:
    """Count per (a, b) in key order, head(limit); ``returned`` is what the
    reference calls total_locations, ``total_locations`` is the true total."""
    grouped = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))
    total = grouped.count()
    head = grouped.orderBy(F.asc_nulls_last(a), F.asc_nulls_last(b)).limit(limit)
    returned = min(total, limit)
    return (head.withColumn("returned", F.lit(returned).cast("long"))
            .withColumn("total_locations", F.lit(total).cast("long")))


def describe_measure(df: DataFrame, col: str, method: str = "exact") -> DataFrame:
    """mean, median, sample std, min, max of a measure; nulls if the column is absent."""
    if col not in df.columns:
        return df.sparkSession.createDataFrame(
            [(None, None, None, None, None)],
            "mean double, median double, std double, min double, max double").limit(1)
    base = df.agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                  F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"))
    row = quantiles(df, col, [0.5], names=["median"], method=method).first()
    med = row["median"] if row else None
    return base.select("mean", F.lit(med).cast("double").alias("median"), "std", "min", "max")


def dataset_overview(df: DataFrame, make: str, model: str, year: str) -> DataFrame:
    """Row count, distinct makes and models, min and max year in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total_vehicles"),
                  F.count_distinct(make).alias("total_makes"),
                  F.count_distinct(model).alias("total_models"),
                  F.min(year).alias("min_year"), F.max(year).alias("max_year"))


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: dtype, missing count, distinct non-null count (one agg, then unpivot).

    ``exact=False`` uses HyperLogLog (``approx_count_distinct``), the switch
    for very wide or very large tables: exact distinct counts of k columns
    expand every row k times before the shuffle.
    """
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"m__{f.name}"))
        aggs.append((F.count_distinct(c) if exact else F.approx_count_distinct(c)).alias(f"u__{f.name}"))
    wide = df.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col(f"`m__{f.name}`").cast("long").alias("missing"),
                 F.col(f"`u__{f.name}`").cast("long").alias("unique"))
        for i, f in enumerate(df.schema.fields)])).alias("p")
    return wide.select(stack).select("p.*")


def high_missing_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Columns with more than ``threshold`` of their values missing."""
    n = df.count()
    prof = profile_columns(df)
    return (prof.withColumn("missing_share", F.col("missing") / F.lit(max(n, 1)))
            .where(F.col("missing_share") > threshold))


def _type_group(dt) -> str:
    if isinstance(dt, T.NumericType):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (null equals null), as one-row frame."""
    return (df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates removed (null equals null)."""
    return df.dropDuplicates()


def quality_report(df: DataFrame, range_col: str | None, price_col: str | None) -> DataFrame:
    """Shape, missing total, duplicates, dtype histogram, range/price statistics."""
    kinds = [_type_group(f.dataType) for f in df.schema.fields]
    aggs = [F.count(F.lit(1)).alias("total_records"),
            sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0)).cast("long")
            .alias("missing_values")]
    for name, col in (("range", range_col), ("price", price_col)):
        if col and col in df.columns:
            aggs += [F.min(col).cast("double").alias(f"{name}_min"),
                     F.max(col).cast("double").alias(f"{name}_max"),
                     F.avg(col).alias(f"{name}_mean"),
                     F.count_if(F.col(col) == 0).cast("long").alias(f"{name}_zero_count")]
    stats = df.agg(*aggs)
    dup = duplicate_count(df).first()["duplicate_rows"]
    return stats.select(
        "*",
        F.lit(len(df.columns)).cast("long").alias("total_features"),
        F.lit(dup).cast("long").alias("duplicate_rows"),
        F.lit(kinds.count("numeric")).cast("long").alias("numeric_columns"),
        F.lit(kinds.count("string")).cast("long").alias("string_columns"),
        F.lit(kinds.count("other")).cast("long").alias("other_columns"))


def quality_scorecard(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """completeness = non-null cells/cells, consistency = distinct rows/rows,
    validity = rows passing every rule/rows, overall = their mean."""
    ncols = len(df.columns)
    valid = F.lit(True)
    for r in rules.values():
        valid = valid & F.coalesce(r, F.lit(False))
    stats = df.agg(F.count(F.lit(1)).alias("n"),
                   sum((F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0)).alias("filled"),
                   F.count_if(valid).alias("valid")).first()
    n = stats["n"]
    distinct = df.dropDuplicates().count()
    completeness = stats["filled"] / (n * ncols) if n else 0.0
    consistency = distinct / n if n else 0.0
    validity = stats["valid"] / n if n else 0.0
    overall = (completeness + consistency + validity) / 3
    return df.sparkSession.createDataFrame(
        [(int(n), int(stats["valid"]), int(n - stats["valid"]), completeness, consistency, validity, overall)],
        "total_records long, valid_records long, invalid_records long, completeness double, "
        "consistency double, validity double, overall_score double")


def group_max(df: DataFrame, key: str, value: str, out: str = "max_value") -> DataFrame:
    return df.groupBy(key).agg(F.max(value).alias(out))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed on the right.

    Bin edges come from one scalar pass; counting is a partially aggregated
    groupBy on the bin index; empty bins are filled from a ``bins``-row range.
    """
    b = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    v = F.col(col).cast("double")
    idx = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def group_distribution(df: DataFrame, key: str, value: str, method: str = "exact") -> DataFrame:
    """n, min, q1, median, q3, max of ``value`` per class (violin data)."""
    basic = df.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.count(value).alias("n"), F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"))
    qs = quantiles(df, value, [0.25, 0.5, 0.75], by=[key], names=["q1", "median", "q3"], method=method)
    return basic.join(qs, key, "inner").select(key, "n", "min", "q1", "median", "q3", "max")


def scatter_groups(df: DataFrame, code: Column | str, measure: str) -> DataFrame:
    """(code, measure, colour) with red for -1, blue for 0, green otherwise."""
    c = _c(code)
    return df.select(c.alias("code"), F.col(measure).alias("measure"),
                     F.when(c == -1, "red").when(c == 0, "blue").otherwise("green").alias("color"))


def correlation_with_target(df: DataFrame, features, target: str) -> DataFrame:
    """Pearson r of each feature (and the target itself) with the target, descending."""
    cols = list(features) + ([target] if target not in features else [])
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    return (wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in cols])).alias("r"))
        .select("r.*").orderBy(F.desc_nulls_last("correlation"), "feature"))


def dashboard_stats(df: DataFrame, type_col: str, bev: str, phev: str, year: str, measure: str,
                    make: str) -> DataFrame:
    """Total, BEV and PHEV counts, unweighted mean of yearly means, top make,
    growth of the yearly mean from the first to the last year (numeric order)."""
    yearly = chart_mean_by_year(df, year, measure, "ym")
    ys = yearly.agg(F.avg("ym").alias("average_range"),
                    F.min_by("ym", year).alias("first"), F.max_by("ym", year).alias("last"),
                    F.count(F.lit(1)).alias("n_years")).first()
    tops = value_counts(df, make, 1).first()
    totals = df.agg(F.count(F.lit(1)).alias("total_vehicles"),
                    F.count_if(F.col(type_col) == bev).alias("bev_count"),
                    F.count_if(F.col(type_col) == phev).alias("phev_count"))
    growth = None
    if ys["n_years"] and ys["n_years"] >= 2 and ys["first"]:
        growth = (ys["last"] - ys["first"]) / ys["first"] * 100
    elif ys["n_years"] is not None and ys["n_years"] < 2:
        growth = 0.0
    return totals.select(
        F.col("total_vehicles").cast("long"), F.col("bev_count").cast("long"),
        F.col("phev_count").cast("long"),
        F.lit(ys["average_range"]).cast("double").alias("average_range"),
        F.lit(tops[make] if tops else None).cast("string").alias("top_make"),
        F.lit(growth).cast("double").alias("growth_rate"))


def prediction_stats(df: DataFrame, time_col: str, conf_col: str) -> DataFrame:
    """Total predictions, mean processing time, mean confidence over rows that
    have one (0 counts as absent)."""
    conf = F.col(conf_col)
    return df.agg(F.count(F.lit(1)).alias("total_predictions"),
                  F.avg(time_col).alias("avg_processing_time"),
                  F.avg(F.when(conf.isNotNull() & (conf != 0), conf)).alias("avg_confidence"))


def platform_summary(runs: DataFrame, predictions: DataFrame, datasets: DataFrame,
                     type_col: str, score_col: str) -> DataFrame:
    """Totals of models, predictions, datasets; mean accuracy; usage per model type."""
    totals = runs.agg(F.count(F.lit(1)).alias("total_models"), F.avg(score_col).alias("avg_accuracy"))
    n_pred = predictions.count()
    n_data = datasets.count()
    usage = runs.groupBy(type_col).agg(F.count(F.lit(1)).alias("usage_count"))
    t = totals.first()
    return usage.select(
        type_col, F.col("usage_count").cast("long"),
        F.lit(t["total_models"]).cast("long").alias("total_models"),
        F.lit(n_pred).cast("long").alias("total_predictions"),
        F.lit(n_data).cast("long").alias("total_datasets"),
        F.lit(t["avg_accuracy"]).cast("double").alias("avg_accuracy"))


def fixed_point_mean(c: str, scale: int = 2) -> Column:
    """Exact mean of fixed-point values (e.g. cents), half-up at 6 decimals.

    Floating sums depend on the order rows are added, i.e. on partitioning;
    summing integer units makes the result identical on any cluster size.
    """
    units = F.round(F.col(c) * (10 ** scale)).cast("long")
    s = F.sum(units).cast("decimal(38,0)")
    n = F.count(units)
    micro = (s * F.lit(2 * 10 ** (6 - scale)) + n).cast("decimal(38,0)")
    q = F.floor(micro / (n * 2).cast("decimal(38,0)"))
    return (q.cast("double") / F.lit(1_000_000.0))


def model_performance_over_time(runs: DataFrame, model_col: str, ts_col: str, score_col: str,
                                unit: str = "day", score_scale: int | None = 2) -> DataFrame:
    """Metric statistics per model and time bucket (exact mean for fixed-point scores)."""
    mean = fixed_point_mean(score_col, score_scale) if score_scale is not None else F.avg(score_col)
    return (runs.groupBy(model_col, F.date_trunc(unit, F.col(ts_col)).alias("period"))
            .agg(F.count(F.lit(1)).alias("runs"), mean.alias("avg_score"),
                 F.max(score_col).alias("best_score")))
