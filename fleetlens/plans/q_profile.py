"""Registered queries: profiling, charts, dashboard cards (survey 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import profile as P
from ..roles import vehicles, with_vehicles
from ..sources.registry import registry_sql, registry_tables
from ..session import table
from .registry import money_mean_sql, register, round_doubles

MEASURES = ["make", "model_year", "electric_range"]


@register("chart_mean_by_year", with_vehicles(
    "SELECT model_year, round(avg(electric_range), 6) AS mean_range FROM vehicles "
    "WHERE model_year IS NOT NULL GROUP BY model_year", ["model_year", "electric_range"]))
def q_chart_mean_by_year(spark, d):
    v = vehicles(spark, d, ["model_year", "electric_range"])
    return round_doubles(P.chart_mean_by_year(v, "model_year", "electric_range", "mean_range"))


@register("value_counts_make", with_vehicles(
    "SELECT make, count(*) AS count FROM vehicles WHERE make IS NOT NULL GROUP BY make", ["make"]))
def q_value_counts(spark, d):
    return P.value_counts(vehicles(spark, d, ["make"]), "make")


@register("top_k_makes", with_vehicles(
    "SELECT make, count(*) AS count FROM vehicles WHERE make IS NOT NULL GROUP BY make "
    "ORDER BY count DESC, make LIMIT 10", ["make"]))
def q_top_k(spark, d):
    return P.value_counts(vehicles(spark, d, ["make"]), "make", limit=10)


@register("value_shares_cafv", with_vehicles(
    "SELECT cafv_eligibility, count, round(count / total, 6) AS share, "
    "CAST(floor(tenths / 10) AS BIGINT)::VARCHAR || '.' || CAST(tenths % 10 AS BIGINT)::VARCHAR || '%' AS pct_label "
    "FROM (SELECT cafv_eligibility, count, total, "
    "CAST(floor((count * 1000 + floor(total / 2)) / total) AS BIGINT) AS tenths FROM "
    "(SELECT cafv_eligibility, count(*) AS count, sum(count(*)) OVER () AS total FROM vehicles "
    "WHERE cafv_eligibility IS NOT NULL GROUP BY cafv_eligibility))", ["cafv_eligibility"]))
def q_value_shares(spark, d):
    return round_doubles(P.value_shares(vehicles(spark, d, ["cafv_eligibility"]), "cafv_eligibility"))


@register("chart_type_distribution", with_vehicles(
    "SELECT ev_type_text, count(*) AS count, (SELECT count(*) FROM vehicles) AS total_count "
    "FROM vehicles WHERE ev_type_text IS NOT NULL GROUP BY ev_type_text "
    "ORDER BY count DESC, ev_type_text LIMIT 100", ["ev_type_text"]))
def q_chart_type(spark, d):
    return P.chart_type_distribution(vehicles(spark, d, ["ev_type_text"]), "ev_type_text", 100)


@register("chart_make_distribution", with_vehicles(
    "SELECT make, count(*) AS count, (SELECT count(DISTINCT make) FROM vehicles) AS total_makes "
    "FROM vehicles WHERE make IS NOT NULL GROUP BY make ORDER BY count DESC, make LIMIT 100", ["make"]))
def q_chart_make(spark, d):
    return P.chart_make_distribution(vehicles(spark, d, ["make"]), "make", 100)


@register("chart_geo_distribution", with_vehicles(
    "SELECT state, county, count, least(n, 20) AS returned, n AS total_locations FROM "
    "(SELECT state, county, count(*) AS count, count(*) OVER () AS n FROM vehicles GROUP BY state, county) "
    "ORDER BY state, county LIMIT 20", ["state", "county"]))
def q_chart_geo(spark, d):
    return P.chart_geo_distribution(vehicles(spark, d, ["state", "county"]), "state", "county", 20)


@register("describe_measure", with_vehicles(
    "SELECT round(avg(electric_range), 6) AS mean, round(median(electric_range), 6) AS median, "
    "round(stddev_samp(electric_range), 6) AS std, round(min(electric_range), 6) AS min, "
    "round(max(electric_range), 6) AS max FROM vehicles", ["electric_range"]))
def q_describe(spark, d):
    return round_doubles(P.describe_measure(vehicles(spark, d, ["electric_range"]), "electric_range"))


@register("describe_measure_price", with_vehicles(
    "SELECT round(avg(base_msrp), 6) AS mean, round(median(base_msrp), 6) AS median, "
    "round(stddev_samp(base_msrp), 6) AS std, round(min(base_msrp), 6) AS min, "
    "round(max(base_msrp), 6) AS max FROM vehicles", ["base_msrp"]))
def q_describe_price(spark, d):
    return round_doubles(P.describe_measure(vehicles(spark, d, ["base_msrp"]), "base_msrp"))


@register("dataset_overview", with_vehicles(
    "SELECT count(*) AS total_vehicles, count(DISTINCT make) AS total_makes, "
    "count(DISTINCT model) AS total_models, min(model_year) AS min_year, max(model_year) AS max_year "
    "FROM vehicles", ["make", "model", "model_year"]))
def q_overview(spark, d):
    return P.dataset_overview(vehicles(spark, d, ["make", "model", "model_year"]), "make", "model", "model_year")


PROFILE_ROLES = ["make", "model_year", "electric_range", "base_msrp", "tax_or_null", "rebate_or_null", "county"]


def _profile_sql(roles, types):
    parts = [f"SELECT {i} AS position, '{r}' AS \"column\", '{types[r]}' AS dtype, "
             f"CAST(count(*) - count({r}) AS BIGINT) AS missing, "
             f"CAST(count(DISTINCT {r}) AS BIGINT) AS \"unique\" FROM vehicles"
             for i, r in enumerate(roles)]
    return with_vehicles(" UNION ALL ".join(parts), roles)


_TYPES = {"make": "string", "model_year": "int", "electric_range": "double", "base_msrp": "double",
          "tax_or_null": "double", "rebate_or_null": "double", "county": "string"}


@register("profile_columns", _profile_sql(PROFILE_ROLES, _TYPES))
def q_profile(spark, d):
    return P.profile_columns(vehicles(spark, d, PROFILE_ROLES))


@register("high_missing_columns", with_vehicles(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS position, '{r}' AS \"column\", '{_TYPES[r]}' AS dtype, "
        f"CAST(count(*) - count({r}) AS BIGINT) AS missing, CAST(count(DISTINCT {r}) AS BIGINT) AS \"unique\", "
        f"round((count(*) - count({r})) / count(*), 6) AS missing_share FROM vehicles"
        for i, r in enumerate(PROFILE_ROLES)) + ") WHERE missing_share > 0.5", PROFILE_ROLES))
def q_high_missing(spark, d):
    return round_doubles(P.high_missing_columns(vehicles(spark, d, PROFILE_ROLES), 0.5))


QR_ROLES = ["make", "model_year", "cafv_eligibility", "electric_range", "base_msrp", "tax_or_null"]


@register("quality_report", with_vehicles(
    "SELECT count(*) AS total_records, CAST(" + " + ".join(f"(count(*) - count({r}))" for r in QR_ROLES)
    + " AS BIGINT) AS missing_values, round(min(electric_range), 6) AS range_min, "
    "round(max(electric_range), 6) AS range_max, round(avg(electric_range), 6) AS range_mean, "
    "CAST(count(*) FILTER (WHERE electric_range = 0) AS BIGINT) AS range_zero_count, "
    "round(min(base_msrp), 6) AS price_min, round(max(base_msrp), 6) AS price_max, "
    "round(avg(base_msrp), 6) AS price_mean, "
    "CAST(count(*) FILTER (WHERE base_msrp = 0) AS BIGINT) AS price_zero_count, "
    f"CAST({len(QR_ROLES)} AS BIGINT) AS total_features, "
    "CAST((SELECT count(*) FROM vehicles) - (SELECT count(*) FROM (SELECT DISTINCT * FROM vehicles)) AS BIGINT) "
    "AS duplicate_rows, CAST(4 AS BIGINT) AS numeric_columns, CAST(2 AS BIGINT) AS string_columns, "
    "CAST(0 AS BIGINT) AS other_columns FROM vehicles", QR_ROLES))
def q_quality_report(spark, d):
    return round_doubles(P.quality_report(vehicles(spark, d, QR_ROLES), "electric_range", "base_msrp"))


SC_ROLES = ["make", "model_year", "electric_range", "base_msrp", "rebate_or_null"]


@register("quality_scorecard", with_vehicles(
    "SELECT total_records, valid_records, total_records - valid_records AS invalid_records, "
    "round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, "
    "round(validity, 6) AS validity, round((completeness + consistency + validity) / 3, 6) AS overall_score FROM "
    "(SELECT count(*) AS total_records, "
    "CAST(count(*) FILTER (WHERE electric_range >= 0 AND base_msrp > 0 AND model_year BETWEEN 1990 AND 2030) "
    "AS BIGINT) AS valid_records, "
    "(" + " + ".join(f"count({r})" for r in SC_ROLES) + f") / (count(*) * {len(SC_ROLES)}) AS completeness, "
    "(SELECT count(*) FROM (SELECT DISTINCT * FROM vehicles)) / count(*) AS consistency, "
    "count(*) FILTER (WHERE electric_range >= 0 AND base_msrp > 0 AND model_year BETWEEN 1990 AND 2030) "
    "/ count(*) AS validity FROM vehicles)", SC_ROLES))
def q_scorecard(spark, d):
    rules = {"range_non_negative": F.col("electric_range") >= 0, "price_positive": F.col("base_msrp") > 0,
             "year_plausible": F.col("model_year").between(1990, 2030)}
    return round_doubles(P.quality_scorecard(vehicles(spark, d, SC_ROLES), rules))


@register("group_max", with_vehicles(
    "SELECT make, max(electric_range) AS max_value FROM vehicles GROUP BY make", ["make", "electric_range"]))
def q_group_max(spark, d):
    return P.group_max(vehicles(spark, d, ["make", "electric_range"]), "make", "electric_range")


@register("histogram_price", with_vehicles(
    "SELECT b.bin, round(lo + b.bin * w, 6) AS bin_lo, round(lo + (b.bin + 1) * w, 6) AS bin_hi, "
    "CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM "
    "(SELECT CAST(range AS INT) AS bin FROM range(10)) b CROSS JOIN "
    "(SELECT min(base_msrp) AS lo, (max(base_msrp) - min(base_msrp)) / 10 AS w FROM vehicles) s "
    "LEFT JOIN (SELECT CAST(least(floor((base_msrp - s2.lo) / s2.w), 9) AS INT) AS bin, count(*) AS n "
    "FROM vehicles, (SELECT min(base_msrp) AS lo, (max(base_msrp) - min(base_msrp)) / 10 AS w FROM vehicles) s2 "
    "GROUP BY 1) c ON c.bin = b.bin", ["base_msrp"]))
def q_histogram(spark, d):
    return round_doubles(P.histogram(vehicles(spark, d, ["base_msrp"]), "base_msrp", 10))


@register("group_distribution", with_vehicles(
    "SELECT cafv_eligibility, count(electric_range) AS n, round(min(electric_range), 6) AS min, "
    "round(quantile_cont(electric_range, 0.25), 6) AS q1, round(quantile_cont(electric_range, 0.5), 6) AS median, "
    "round(quantile_cont(electric_range, 0.75), 6) AS q3, round(max(electric_range), 6) AS max "
    "FROM vehicles GROUP BY cafv_eligibility", ["cafv_eligibility", "electric_range"]))
def q_group_distribution(spark, d):
    v = vehicles(spark, d, ["cafv_eligibility", "electric_range"])
    return round_doubles(P.group_distribution(v, "cafv_eligibility", "electric_range"))


@register("group_distribution_price_by_make", with_vehicles(
    "SELECT make, count(base_msrp) AS n, round(min(base_msrp), 6) AS min, "
    "round(quantile_cont(base_msrp, 0.25), 6) AS q1, round(quantile_cont(base_msrp, 0.5), 6) AS median, "
    "round(quantile_cont(base_msrp, 0.75), 6) AS q3, round(max(base_msrp), 6) AS max "
    "FROM vehicles GROUP BY make", ["make", "base_msrp"]))
def q_group_distribution_price(spark, d):
    v = vehicles(spark, d, ["make", "base_msrp"])
    return round_doubles(P.group_distribution(v, "make", "base_msrp"))


@register("scatter_groups", with_vehicles(
    "SELECT code, electric_range AS measure, CASE WHEN code = -1 THEN 'red' WHEN code = 0 THEN 'blue' "
    "ELSE 'green' END AS color FROM (SELECT CASE WHEN lower(cafv_text) LIKE '%clean%' THEN 1 "
    "WHEN lower(cafv_text) LIKE '%eligibility unknown%' THEN 0 ELSE -1 END AS code, electric_range "
    "FROM vehicles)", ["cafv_text", "electric_range"]))
def q_scatter(spark, d):
    v = vehicles(spark, d, ["cafv_text", "electric_range"])
    return round_doubles(P.scatter_groups(v, S.cafv_code3("cafv_text"), "electric_range"))


CORR_FEATURES = ["base_msrp", "discount", "tax", "model_year"]


@register("correlation_with_target", with_vehicles(
    "SELECT feature, round(correlation, 6) AS correlation FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), electric_range) AS correlation FROM vehicles"
        for c in CORR_FEATURES + ["electric_range"]) + ")", CORR_FEATURES + ["electric_range"]))
def q_corr(spark, d):
    v = vehicles(spark, d, CORR_FEATURES + ["electric_range"])
    return round_doubles(P.correlation_with_target(v, CORR_FEATURES, "electric_range"))


@register("distinct_rows", with_vehicles(
    "SELECT DISTINCT make, model_year, cafv_eligibility FROM vehicles", ["make", "model_year", "cafv_eligibility"]))
def q_distinct(spark, d):
    return P.distinct_rows(vehicles(spark, d, ["make", "model_year", "cafv_eligibility"]))


@register("duplicate_count",
          "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) "
          "AS BIGINT) AS duplicate_rows FROM documents")
def q_duplicate_count(spark, d):
    return P.duplicate_count(table(spark, d, "documents").select("text", "lang", "source"))


@register("dashboard_stats", with_vehicles(
    "SELECT (SELECT count(*) FROM vehicles) AS total_vehicles, "
    "(SELECT count(*) FROM vehicles WHERE ev_type_text = 'Battery Electric Vehicle (BEV)') AS bev_count, "
    "(SELECT count(*) FROM vehicles WHERE ev_type_text = 'Plug-in Hybrid Electric Vehicle (PHEV)') AS phev_count, "
    "round(avg(ym), 6) AS average_range, "
    "(SELECT make FROM vehicles GROUP BY make ORDER BY count(*) DESC, make LIMIT 1) AS top_make, "
    "round((max_by(ym, model_year) - min_by(ym, model_year)) / min_by(ym, model_year) * 100, 6) AS growth_rate "
    "FROM (SELECT model_year, avg(electric_range) AS ym FROM vehicles WHERE model_year IS NOT NULL "
    "GROUP BY model_year)", ["ev_type_text", "model_year", "electric_range", "make"]))
def q_dashboard(spark, d):
    v = vehicles(spark, d, ["ev_type_text", "model_year", "electric_range", "make"])
    return round_doubles(P.dashboard_stats(v, "ev_type_text", "Battery Electric Vehicle (BEV)",
                                           "Plug-in Hybrid Electric Vehicle (PHEV)", "model_year",
                                           "electric_range", "make"))


@register("prediction_stats", registry_sql(
    "SELECT count(*) AS total_predictions, round(avg(processing_time), 6) AS avg_processing_time, "
    "round(avg(CASE WHEN confidence <> 0 THEN confidence END), 6) AS avg_confidence FROM predictions"))
def q_prediction_stats(spark, d):
    preds = registry_tables(spark, d)["predictions"]
    return round_doubles(P.prediction_stats(preds, "processing_time", "confidence"))


@register("platform_summary", registry_sql(
    "SELECT model_type, count(*) AS usage_count, (SELECT count(*) FROM runs) AS total_models, "
    "(SELECT count(*) FROM predictions) AS total_predictions, (SELECT count(*) FROM datasets) AS total_datasets, "
    "(SELECT round(avg(score), 6) FROM runs) AS avg_accuracy FROM runs GROUP BY model_type"))
def q_platform_summary(spark, d):
    t = registry_tables(spark, d)
    return round_doubles(P.platform_summary(t["runs"], t["predictions"], t["datasets"], "model_type", "score"))


@register("model_performance_over_time", registry_sql(
    "SELECT model_type, date_trunc('month', start_time)::VARCHAR AS period, count(*) AS runs, "
    f"{money_mean_sql('score')} AS avg_score, round(max(score), 6) AS best_score FROM runs GROUP BY 1, 2"))
def q_model_perf(spark, d):
    runs = registry_tables(spark, d)["runs"]
    out = P.model_performance_over_time(runs, "model_type", "start_time", "score", unit="month")
    return round_doubles(out.withColumn("period", F.date_format("period", "yyyy-MM-dd HH:mm:ss")))


# ---------------------------------------------------------------- flagship

REPORT_ROLES = ["make", "model_year", "electric_range", "base_msrp", "tax_or_null", "cafv_or_null"]

_CLEAN_SQL = (
    "SELECT make, model_year, least(electric_range, 300) AS electric_range, least(base_msrp, 50000) AS base_msrp, "
    "tax_or_null, cafv_or_null FROM (SELECT make, model_year, electric_range, base_msrp, "
    "coalesce(tax_or_null, (SELECT median(tax_or_null) FROM (SELECT DISTINCT * FROM vehicles))) AS tax_or_null, "
    "coalesce(cafv_or_null, (SELECT cafv_or_null FROM (SELECT DISTINCT * FROM vehicles) WHERE cafv_or_null IS NOT NULL "
    "GROUP BY cafv_or_null ORDER BY count(*) DESC, cafv_or_null LIMIT 1)) AS cafv_or_null "
    "FROM (SELECT DISTINCT * FROM vehicles)) WHERE electric_range >= 0 AND base_msrp > 0 "
    "AND model_year BETWEEN 1996 AND 2000")


@register("market_report", with_vehicles(
    f"SELECT make, vehicles, round(vehicles / sum(vehicles) OVER (), 6) AS share, round(mean_range, 6) AS mean_range, "
    "round(mean_price_per_range, 6) AS mean_price_per_range, round(ultra_share, 6) AS ultra_share, "
    "CAST(row_number() OVER (ORDER BY vehicles DESC, make) AS INT) AS rank FROM "
    "(SELECT make, count(*) AS vehicles, avg(electric_range) AS mean_range, "
    "avg(base_msrp / (electric_range + 1)) AS mean_price_per_range, "
    "avg(CASE WHEN electric_range > 200 AND electric_range <= 500 THEN 1.0 ELSE 0.0 END) AS ultra_share "
    f"FROM ({_CLEAN_SQL}) GROUP BY make)", REPORT_ROLES))
def q_market_report(spark, d):
    """Flagship: clean -> service features -> per-make count, share, mean range,
    mean price per range, share of 'Ultra' range, rank by count."""
    from ..operators import clean as C
    from ..operators import features as FE
    from pyspark.sql import Window
    v = vehicles(spark, d, REPORT_ROLES)
    cleaned = C.clean_table(v, range_col="electric_range", price_col="base_msrp", year_col="model_year",
                            ref_year=1999, year_low=1996, range_cap=300.0, price_cap=50000.0)
    feats = FE.service_features(cleaned, range_col="electric_range", price_col="base_msrp", year_col="model_year",
                                make_col="make", ref_year=1999)
    per_make = feats.groupBy("make").agg(
        F.count(F.lit(1)).alias("vehicles"), F.avg("electric_range").alias("mean_range"),
        F.avg("Price_per_Range").alias("mean_price_per_range"),
        F.avg((F.col("Range_Category") == "Ultra").cast("double")).alias("ultra_share"))
    total = per_make.agg(F.sum("vehicles")).first()[0]
    # one row per make: the rank window runs over the grouped table only
    ranked = per_make.select(
        "make", "vehicles", (F.col("vehicles") / F.lit(total)).alias("share"), "mean_range",
        "mean_price_per_range", F.coalesce("ultra_share", F.lit(0.0)).alias("ultra_share"),
        F.row_number().over(Window.orderBy(F.desc("vehicles"), "make")).cast("int").alias("rank"))
    return round_doubles(ranked)
