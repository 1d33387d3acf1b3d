"""Registered queries: log and metric analytics (2.12) over ``events``.

Stand-in request log: ts, client = user_id, endpoint = event_type, a 5xx is
event_type = 'error', response time in seconds = value / 100.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as LG
from ..session import table
from ..sources.registry import registry_sql, registry_tables
from .registry import register, round_doubles

TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _bucket_sql(seconds: int, col: str = "ts") -> str:
    us = seconds * 1_000_000
    return f"make_timestamp(CAST(floor(epoch_us({col}) / {us}) * {us} AS BIGINT))"


def _fmt(df, col="window_start"):
    return df.withColumn(col, F.date_format(col, TS_FMT))


def _events(spark, d):
    return table(spark, d, "events").withColumn("latency", F.col("value") / 100)


@register("request_rate",
          f"SELECT strftime({_bucket_sql(300)}, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, "
          "round(count(*) / 300.0, 6) AS rate FROM events GROUP BY 1")
def q_request_rate(spark, d):
    return round_doubles(_fmt(LG.request_rate(_events(spark, d), "ts", "5 minutes", 300)))


@register("request_rate_by_type",
          f"SELECT strftime({_bucket_sql(60)}, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS requests, "
          "round(count(*) / 60.0, 6) AS rate FROM events GROUP BY 1, 2")
def q_request_rate_by_type(spark, d):
    return round_doubles(_fmt(LG.request_rate(_events(spark, d), "ts", "1 minute", 60, by=["event_type"])))


@register("sliding_rate",
          "SELECT strftime(make_timestamp(CAST((floor(epoch_us(ts) / 15000000) - k) * 15000000 AS BIGINT)), "
          "'%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, round(count(*) / 300.0, 6) AS rate "
          "FROM events, (SELECT unnest(range(20)) AS k) GROUP BY 1")
def q_sliding_rate(spark, d):
    return round_doubles(_fmt(LG.sliding_rate(_events(spark, d), "ts", "5 minutes", "15 seconds", 300)))


@register("success_rate",
          f"SELECT strftime({_bucket_sql(300)}, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, "
          "count(*) FILTER (WHERE event_type = 'error') AS errors, "
          "round((1 - count(*) FILTER (WHERE event_type = 'error') / count(*)) * 100, 6) AS success_rate "
          "FROM events GROUP BY 1")
def q_success_rate(spark, d):
    return round_doubles(_fmt(LG.success_rate(_events(spark, d), "ts", F.col("event_type") == "error")))


@register("latency_p95",
          f"SELECT strftime({_bucket_sql(300)}, '%Y-%m-%d %H:%M:%S') AS window_start, "
          "round(quantile_cont(value / 100, 0.95), 6) AS latency_q FROM events GROUP BY 1")
def q_latency_p95(spark, d):
    return round_doubles(_fmt(LG.latency_quantile(_events(spark, d), "ts", "latency", 0.95, "5 minutes")))


def _bucket_quantile_sql(q=0.95, seconds=3600, bounds=LG.LATENCY_BUCKETS):
    idx = " ".join(f"WHEN value / 100 <= {b} THEN {i}" for i, b in enumerate(bounds))
    arr = "[" + ", ".join(str(float(b)) for b in bounds) + "]"
    return (f"WITH c AS (SELECT {_bucket_sql(seconds)} AS w, CASE {idx} ELSE {len(bounds)} END AS b, count(*) AS n "
            "FROM events GROUP BY 1, 2), cum AS (SELECT *, sum(n) OVER (PARTITION BY w ORDER BY b ROWS BETWEEN "
            "UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(n) OVER (PARTITION BY w) AS total FROM c), "
            f"h AS (SELECT w, arg_min(b, b) AS b, arg_min(cum, b) AS cum, arg_min(n, b) AS n, arg_min(total, b) AS total "
            f"FROM cum WHERE cum >= {q} * total GROUP BY w) "
            f"SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, round(CASE WHEN b = {len(bounds)} THEN "
            f"{float(bounds[-1])} ELSE (CASE WHEN b = 0 THEN 0.0 ELSE {arr}[b] END) + ({arr}[b + 1] - "
            f"(CASE WHEN b = 0 THEN 0.0 ELSE {arr}[b] END)) * ({q} * total - (cum - n)) / n END, 6) AS latency_q FROM h")


@register("bucket_quantile", _bucket_quantile_sql())
def q_bucket_quantile(spark, d):
    return round_doubles(_fmt(LG.bucket_quantile(_events(spark, d), "ts", "latency", 0.95, "1 hour")))


@register("mean_metric", "SELECT event_type, round(avg(value / 100), 6) AS mean_value FROM events GROUP BY 1")
def q_mean_metric(spark, d):
    return round_doubles(LG.mean_metric(_events(spark, d), "latency", by=["event_type"]))


@register("count_by_type", registry_sql("SELECT model_type, count(*) AS total FROM runs GROUP BY 1", ["runs"]))
def q_count_by_type(spark, d):
    return LG.count_by_type(registry_tables(spark, d)["runs"], "model_type")


@register("sum_by_type", "SELECT event_type, round(sum(value), 6) AS total FROM events GROUP BY 1")
def q_sum_by_type(spark, d):
    return round_doubles(LG.count_by_type(table(spark, d, "events"), "event_type", "value"))


def _minute_metrics(spark, d):
    e = _events(spark, d)
    w = e.select(F.window("ts", "1 minute").start.alias("window_start"), "latency",
                 (F.col("event_type") == "error").alias("err"))
    err = w.groupBy("window_start").agg((F.count_if("err") / 60.0).alias("value")).withColumn(
        "metric", F.lit("error_rate"))
    from ..operators.quantiles import quantiles
    p95 = quantiles(w, "latency", [0.95], by=["window_start"], names=["value"]).withColumn(
        "metric", F.lit("p95_latency"))
    return err.unionByName(p95)


_MINUTE_SQL = (f"WITH m AS (SELECT {_bucket_sql(60)} AS window_start, 'error_rate' AS metric, "
               "count(*) FILTER (WHERE event_type = 'error') / 60.0 AS value FROM events GROUP BY 1 UNION ALL "
               f"SELECT {_bucket_sql(60)}, 'p95_latency', quantile_cont(value / 100, 0.95) FROM events GROUP BY 1), "
               "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{m}', '{o}', CAST({float(t)} AS DOUBLE))" for a, m, o, t, _ in
                                                          LG.ALERT_RULES) +
               ") t(alert, metric, op, threshold)), "
               "c AS (SELECT alert, m.metric, window_start, value, threshold, coalesce(CASE op WHEN '>' THEN value > "
               "threshold WHEN '<' THEN value < threshold END, false) AS condition FROM m JOIN r ON m.metric = r.metric) ")


@register("alert_threshold", _MINUTE_SQL + "SELECT alert, metric, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS "
                                           "window_start, round(value, 6) AS value, threshold, condition FROM c")
def q_alert_threshold(spark, d):
    out = LG.alert_threshold(_minute_metrics(spark, d), LG.rules_frame(spark))
    return round_doubles(_fmt(out))


_HOLD = {"1 minute": 60, "5 minutes": 300, "10 minutes": 600}


@register("alert_sustained", _MINUTE_SQL +
          ", h AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {_HOLD[hh]})" for a, _, _, _, hh in LG.ALERT_RULES) +
          ") t(alert, hold)), on_ AS (SELECT alert, epoch(window_start) AS t, window_start FROM c WHERE condition), "
          "g AS (SELECT *, sum(CASE WHEN lt IS NULL OR t - lt <> 60 THEN 1 ELSE 0 END) OVER (PARTITION BY alert ORDER BY t "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (SELECT *, lag(t) OVER (PARTITION BY alert "
          "ORDER BY t) AS lt FROM on_)) "
          "SELECT g.alert, strftime(min(window_start), '%Y-%m-%d %H:%M:%S') AS start, "
          "strftime(max(window_start), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS windows, "
          "count(*) * 60 AS duration_seconds, count(*) * 60 >= any_value(h.hold) AS fires "
          "FROM g JOIN h ON g.alert = h.alert GROUP BY g.alert, island")
def q_alert_sustained(spark, d):
    cond = LG.alert_threshold(_minute_metrics(spark, d), LG.rules_frame(spark))
    holds = spark.createDataFrame([(a, _HOLD[hh]) for a, _, _, _, hh in LG.ALERT_RULES], "alert string, hold int")
    runs = LG.alert_sustained(cond.join(F.broadcast(holds), "alert"), 60, hold_col="hold")
    return (runs.withColumn("start", F.date_format("start", TS_FMT)).withColumn("last", F.date_format("last", TS_FMT))
            .withColumn("duration_seconds", F.col("duration_seconds").cast("long")))


@register("target_down",
          "WITH s AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS b FROM events), "
          "r AS (SELECT min(b) AS lo, max(b) AS hi FROM s), "
          "a AS (SELECT u.user_id, d.b FROM (SELECT DISTINCT user_id FROM s) u, r, "
          "LATERAL (SELECT unnest(range(r.lo, r.hi + 1)) AS b) d) "
          "SELECT user_id, strftime(make_timestamp(b * 86400 * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start FROM "
          "(SELECT user_id, b FROM a EXCEPT SELECT user_id, b FROM s)")
def q_target_down(spark, d):
    out = LG.target_down(table(spark, d, "events"), "user_id", "ts", 86400)
    return out.withColumn("window_start", F.date_format(F.col("window_start").cast("timestamp_ntz"), TS_FMT))


@register("api_log_report", registry_sql(
    "SELECT endpoint, status_code, count(*) AS requests, round(avg(response_time), 6) AS avg_response_time, "
    "round(max(response_time), 6) AS max_response_time, round(count(*) FILTER (WHERE status_code >= 500) / count(*), 6) "
    "AS error_share FROM api_log GROUP BY 1, 2", ["api_log"]))
def q_api_log(spark, d):
    log = registry_tables(spark, d)["api_log"]
    return round_doubles(LG.api_log_report(log, ["endpoint", "status_code"], "response_time",
                                           F.col("status_code") >= 500))


_JOBS_SQL = ("SELECT o_orderkey AS job_id, o_orderpriority AS job_type, o_orderstatus AS status, count(*) AS total_items, "
             "count(*) FILTER (WHERE l_linestatus = 'F') AS processed_items, count(*) FILTER (WHERE l_returnflag = 'R') "
             "AS retry_count, 3 AS max_retries, date_diff('day', o_orderdate, max(l_shipdate)) AS duration_days "
             "FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus, "
             "o_orderdate")


@register("job_report",
          f"SELECT job_type, status, count(*) AS jobs, round(avg(duration_days), 6) AS avg_duration, "
          "round(avg(processed_items / total_items), 6) AS avg_progress, "
          f"CAST(sum(greatest(max_retries - retry_count, 0)) AS BIGINT) AS retries_left FROM ({_JOBS_SQL}) GROUP BY 1, 2")
def q_job_report(spark, d):
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem")
    jobs = (o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
            .agg(F.count(F.lit(1)).alias("total_items"), F.count_if(F.col("l_linestatus") == "F").alias("processed_items"),
                 F.count_if(F.col("l_returnflag") == "R").alias("retry_count"), F.max("l_shipdate").alias("last_ship"))
            .select(F.col("o_orderpriority").alias("job_type"), F.col("o_orderstatus").alias("status"), "total_items",
                    "processed_items", "retry_count", F.lit(3).alias("max_retries"),
                    F.datediff(F.to_date("last_ship"), F.to_date("o_orderdate")).alias("duration_days")))
    return round_doubles(LG.job_report(jobs, "job_type", "status", "total_items", "processed_items", "retry_count",
                                       "max_retries", "duration_days"))


@register("feedback_accuracy", registry_sql(
    "SELECT model_id, round(avg(CAST(feedback AS DOUBLE)), 6) AS feedback_accuracy, count(feedback) AS with_feedback "
    "FROM predictions GROUP BY 1", ["predictions"]))
def q_feedback(spark, d):
    return round_doubles(LG.feedback_accuracy(registry_tables(spark, d)["predictions"], "model_id", "feedback"))
