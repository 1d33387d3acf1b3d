"""Registered queries: ordered logic, ranking, top-k and pages (2.5, 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import profile as P
from ..session import table
from ..sources.registry import registry_sql, registry_tables
from .registry import register, round_doubles


@register("rolling_request_count",
          "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN "
          "INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS recent_requests, "
          "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING "
          "AND CURRENT ROW) > 1 AS over_limit FROM events")
def q_rolling(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return O.rolling_request_count(e, "user_id", "ts", 60, limit=1).drop("ts")


@register("rolling_request_count_1h",
          "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN "
          "INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent_requests FROM events")
def q_rolling_1h(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return O.rolling_request_count(e, "user_id", "ts", 3600).drop("ts")


_ACTION = ("CASE event_type WHEN 'purchase' THEN 'train_model' WHEN 'click' THEN 'batch_predict' "
           "WHEN 'view' THEN 'single_predict' ELSE event_type END")


@register("daily_quota_usage",
          f"WITH a AS (SELECT event_id, user_id, {_ACTION} AS action, ts FROM events), "
          "l AS (SELECT * FROM (VALUES ('train_model', 10), ('batch_predict', 50), ('single_predict', 1000)) "
          "t(action, daily_limit)) "
          "SELECT a.action, a.event_id, a.user_id, CAST(a.ts AS DATE)::VARCHAR AS day, "
          "count(*) OVER (PARTITION BY a.user_id, a.action, CAST(a.ts AS DATE) ORDER BY a.ts, a.event_id "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used_today, l.daily_limit, "
          "coalesce(count(*) OVER (PARTITION BY a.user_id, a.action, CAST(a.ts AS DATE) ORDER BY a.ts, a.event_id "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > l.daily_limit, false) AS over_quota "
          "FROM a LEFT JOIN l ON a.action = l.action")
def q_daily_quota(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.expr(_ACTION).alias("action"), "ts")
    limits = spark.createDataFrame(list(O.DAILY_LIMITS.items()), "action string, daily_limit int")
    out = O.daily_quota_usage(e, "user_id", "action", "ts", "event_id", limits)
    return out.withColumn("day", F.col("day").cast("string")).drop("ts")


@register("keep_last_n", registry_sql(
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY start_time DESC, "
    "run_id DESC) AS rn FROM runs) WHERE rn <= 3", ["runs"]))
def q_keep_last_n(spark, d):
    runs = registry_tables(spark, d)["runs"]
    return round_doubles(O.keep_last_n(runs, "experiment_id", "start_time", "run_id", 3))


@register("runs_to_delete", registry_sql(
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY start_time DESC, "
    "run_id DESC) AS rn FROM runs) WHERE rn > 3", ["runs"]))
def q_runs_to_delete(spark, d):
    runs = registry_tables(spark, d)["runs"]
    return round_doubles(O.runs_to_delete(runs, "experiment_id", "start_time", "run_id", 3))


@register("latest_version", registry_sql(
    "SELECT experiment_id, max(run_id) AS run_id, arg_max(start_time, run_id) AS start_time, "
    "arg_max(model_type, run_id) AS model_type, arg_max(status, run_id) AS status, "
    "round(arg_max(score, run_id), 6) AS score FROM runs GROUP BY experiment_id", ["runs"]))
def q_latest_version(spark, d):
    runs = registry_tables(spark, d)["runs"]
    return round_doubles(O.latest_version(runs, "experiment_id", "run_id"))


@register("latest_version_by_stage", registry_sql(
    "SELECT experiment_id, status, max(run_id) AS run_id, arg_max(start_time, run_id) AS start_time, "
    "arg_max(model_type, run_id) AS model_type, round(arg_max(score, run_id), 6) AS score FROM runs "
    "WHERE status IN ('F', 'O') GROUP BY experiment_id, status", ["runs"]))
def q_latest_version_stage(spark, d):
    runs = registry_tables(spark, d)["runs"]
    return round_doubles(O.latest_version(runs, "experiment_id", "run_id", stage="status", stages=["F", "O"]))


@register("stage_transition", registry_sql(
    "SELECT run_id, experiment_id, CASE WHEN experiment_id = 42 AND run_id = (SELECT min(run_id) FROM runs "
    "WHERE experiment_id = 42) THEN 'Production' WHEN experiment_id = 42 AND status = 'Production' THEN 'Archived' "
    "ELSE status END AS status FROM runs", ["runs"]))
def q_stage_transition(spark, d):
    runs = registry_tables(spark, d)["runs"].select("run_id", "experiment_id", "status")
    first = runs.where(F.col("experiment_id") == 42).agg(F.min("run_id")).first()[0]
    return O.stage_transition(runs, "experiment_id", "run_id", "status", 42, first, "Production")


@register("cumulative_share",
          "SELECT p_brand, count, position, round(share, 6) AS share, round(sum(share) OVER (ORDER BY position "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative FROM (SELECT p_brand, count(*) AS count, "
          "row_number() OVER (ORDER BY count(*) DESC, p_brand) AS position, count(*) / sum(count(*)) OVER () AS share "
          "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)")
def q_cumulative_share(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    shares = P.value_shares(li.select("p_brand"), "p_brand").drop("pct_label")
    from pyspark.sql import Window
    ranked = shares.withColumn("position", F.row_number().over(Window.orderBy(F.desc("count"), "p_brand")))
    return round_doubles(O.cumulative_share(ranked, "position", "share"))


_INERTIA_SQL = ("SELECT k, sum(ss) AS inertia FROM (SELECT k, bin, sum((q - m) * (q - m)) AS ss FROM "
                "(SELECT k, bin, q, avg(q) OVER (PARTITION BY k, bin) AS m FROM (SELECT r.k, l_quantity AS q, "
                "CAST(least(floor((l_quantity - 1) * r.k / 50), r.k - 1) AS INT) AS bin FROM lineitem, "
                "(SELECT CAST(range AS INT) AS k FROM range(2, 11)) r)) GROUP BY k, bin) GROUP BY k")


def _inertia_curve(spark, d):
    """Within-bin sum of squares of l_quantity for k = 2..10 equal-width bins."""
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("q"))
    x = li.select("q", F.explode(F.sequence(F.lit(2), F.lit(10))).alias("k"))
    x = x.withColumn("bin", F.least(F.floor((F.col("q") - 1) * F.col("k") / 50), F.col("k") - 1).cast("int"))
    stats = x.groupBy("k", "bin").agg(F.sum(F.col("q") * F.col("q")).alias("s2"), F.sum("q").alias("s1"),
                                      F.count(F.lit(1)).alias("n"))
    return stats.groupBy("k").agg(F.sum(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")).alias("inertia"))


@register("elbow_point",
          f"WITH c AS ({_INERTIA_SQL}), s AS (SELECT k, (lag(inertia) OVER (ORDER BY k) - inertia) - "
          "(inertia - lead(inertia) OVER (ORDER BY k)) AS d2 FROM c) "
          "SELECT k AS optimal_k, round(d2, 3) AS second_difference FROM s WHERE d2 IS NOT NULL "
          "ORDER BY d2 DESC, k LIMIT 1")
def q_elbow(spark, d):
    out = O.elbow_point(_inertia_curve(spark, d), "k", "inertia")
    return out.withColumn("second_difference", F.round("second_difference", 3))


@register("confidence_series", registry_sql(
    "SELECT model_id, prediction_id, row_number() OVER (PARTITION BY model_id ORDER BY timestamp, prediction_id, "
    "confidence) - 1 AS position, round(confidence, 6) AS confidence FROM predictions "
    "WHERE confidence IS NOT NULL AND confidence <> 0", ["predictions"]))
def q_confidence_series(spark, d):
    preds = registry_tables(spark, d)["predictions"]
    return round_doubles(O.confidence_series(preds, "model_id", "timestamp", "prediction_id", "confidence"))


_P2 = "CASE WHEN l_quantity > 25 THEN 'A' ELSE 'N' END"
_P3 = "CASE WHEN l_discount > 0.05 THEN 'R' ELSE 'N' END"


@register("majority_vote",
          f"SELECT l_orderkey, l_linenumber, p1, p2, p3, list_min([{{'n': -((p1 = p1)::INT + (p1 = p2)::INT + "
          "(p1 = p3)::INT), 'label': p1}, {'n': -((p2 = p1)::INT + (p2 = p2)::INT + (p2 = p3)::INT), 'label': p2}, "
          "{'n': -((p3 = p1)::INT + (p3 = p2)::INT + (p3 = p3)::INT), 'label': p3}]).label AS vote FROM "
          f"(SELECT l_orderkey, l_linenumber, l_returnflag AS p1, {_P2} AS p2, {_P3} AS p3 FROM lineitem)")
def q_majority_vote(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("p1"),
                                            F.expr(_P2).alias("p2"), F.expr(_P3).alias("p3"))
    return li.withColumn("vote", O.majority_vote(["p1", "p2", "p3"]))


@register("pick_best", registry_sql(
    "SELECT experiment_id, round(score, 6) AS score, run_id, start_time, model_type, status FROM "
    "(SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY score DESC, run_id) AS rn FROM runs) "
    "WHERE rn = 1", ["runs"]))
def q_pick_best(spark, d):
    runs = registry_tables(spark, d)["runs"]
    return round_doubles(O.pick_best(runs, "score", "run_id", group="experiment_id"))


@register("top_k_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_top_k_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return O.top_k(o, 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def q_preview(spark, d):
    return O.preview(table(spark, d, "orders"), [F.col("o_orderkey")], 100)


@register("recent_runs", registry_sql(
    "SELECT * FROM runs ORDER BY start_time DESC, run_id DESC LIMIT 50", ["runs"]))
def q_recent_runs(spark, d):
    return O.recent_runs(registry_tables(spark, d)["runs"], "start_time", "run_id", 50)


@register("search_runs", registry_sql(
    "SELECT * FROM runs WHERE experiment_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND status = 'F' "
    "AND score > 100000 ORDER BY run_id LIMIT 100", ["runs"]))
def q_search_runs(spark, d):
    runs = registry_tables(spark, d)["runs"]
    return O.search_runs(runs, "status = 'F' AND score > 100000", "experiment_id", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89],
                         [F.col("run_id")], 100)


@register("paginate", "SELECT *, (SELECT count(*) FROM customer) AS total, 40 + 20 < (SELECT count(*) FROM customer) "
                      "AS has_more FROM customer ORDER BY c_acctbal DESC, c_custkey OFFSET 40 LIMIT 20")
def q_paginate(spark, d):
    c = table(spark, d, "customer")
    return O.paginate(c, [F.desc("c_acctbal"), F.asc("c_custkey")], skip=40, limit=20)
