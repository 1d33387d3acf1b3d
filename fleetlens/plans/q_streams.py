"""Registered queries: Structured Streaming (2.13) over the events table.

Each stream runs with ``availableNow`` into Parquet under the session's
checkpoint folder (own checkpoint location per run) and is read back.
Complete-mode aggregates equal their batch SQL twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..learn import models as MD
from ..session import table
from ..streaming import streams as ST
from .registry import register, round_doubles

TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _bucket_sql(seconds: int) -> str:
    us = seconds * 1_000_000
    return f"make_timestamp(CAST(floor(epoch_us(ts) / {us}) * {us} AS BIGINT))"


@register("stream_scan", "SELECT event_id, user_id, event_type FROM events")
def q_stream_scan(spark, d):
    sdf = ST.stream_scan(spark, d, "events").select("event_id", "user_id", "event_type")
    return ST.run_to_table(sdf, "scan", mode="append")


@register("stream_tumbling_rate",
          f"SELECT strftime({_bucket_sql(60)}, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, "
          "round(count(*) / 60.0, 6) AS rate FROM events GROUP BY 1")
def q_stream_tumbling(spark, d):
    out = ST.run_to_table(ST.tumbling_rate(ST.stream_scan(spark, d, "events")), "tumbling", "complete")
    return round_doubles(out.withColumn("window_start", F.date_format("window_start", TS_FMT)))


@register("stream_sliding_rate",
          "SELECT strftime(make_timestamp(CAST((floor(epoch_us(ts) / 15000000) - k) * 15000000 AS BIGINT)), "
          "'%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, "
          "count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) / 300.0, 6) AS rate, "
          "round((1 - count(*) FILTER (WHERE event_type = 'error') / count(*)) * 100, 6) AS success_rate, "
          "round(avg(value / 100), 6) AS avg_latency FROM events, (SELECT unnest(range(20)) AS k) GROUP BY 1")
def q_stream_sliding(spark, d):
    out = ST.run_to_table(ST.sliding_stats(ST.stream_scan(spark, d, "events")), "sliding", "complete")
    return round_doubles(out.withColumn("window_start", F.date_format("window_start", TS_FMT)))


@register("stream_sliding_p95")
def q_stream_sliding_p95(spark, d):
    """Sliding-window stats with an approximate p95 latency (bounded sketch in state)."""
    out = ST.run_to_table(ST.sliding_stats(ST.stream_scan(spark, d, "events"), with_p95=True), "sliding_p95",
                          "complete")
    return round_doubles(out.withColumn("window_start", F.date_format("window_start", TS_FMT)))


@register("stream_alerts_complete",
          f"SELECT strftime({_bucket_sql(60)}, '%Y-%m-%d %H:%M:%S') AS window_start, "
          "count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS requests, "
          "round(count(*) FILTER (WHERE event_type = 'error') / 60.0, 6) AS error_rate FROM events GROUP BY 1 "
          "HAVING count(*) FILTER (WHERE event_type = 'error') / 60.0 > 0.02")
def q_stream_alerts_complete(spark, d):
    out = ST.run_to_table(ST.error_alerts(ST.stream_scan(spark, d, "events"), threshold=0.02), "alerts_c", "complete")
    return round_doubles(out.withColumn("window_start", F.date_format("window_start", TS_FMT)))


@register("stream_alerts",
          f"SELECT strftime({_bucket_sql(60)}, '%Y-%m-%d %H:%M:%S') AS window_start, "
          "count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS requests, "
          "round(count(*) FILTER (WHERE event_type = 'error') / 60.0, 6) AS error_rate FROM events GROUP BY 1 "
          "HAVING count(*) FILTER (WHERE event_type = 'error') / 60.0 > 0.02 "
          f"AND max({_bucket_sql(60)}) + INTERVAL 60 SECONDS <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES")
def q_stream_alerts(spark, d):
    """Append mode: a window is emitted once the watermark has passed it, so the
    windows of the last watermark delay of the stream stay open."""
    out = ST.run_to_table(ST.error_alerts(ST.stream_scan(spark, d, "events"), threshold=0.02), "alerts", "append")
    return round_doubles(out.withColumn("window_start", F.date_format("window_start", TS_FMT)))


@register("stream_dedupe", "SELECT DISTINCT event_id FROM events")
def q_stream_dedupe(spark, d):
    """Two of three events arrive twice or three times; each is kept once."""
    sdf = ST.stream_scan(spark, d, "events").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("event_id") % 3 + 1)))
    out = ST.run_to_table(ST.dedupe(sdf), "dedupe", "append")
    return out.select("event_id")


_RATE_LIMIT_SQL = (
    "WITH RECURSIVE e AS (SELECT event_id, user_id AS client, ts, row_number() OVER (PARTITION BY user_id "
    "ORDER BY ts, event_id) AS rn FROM events), "
    "r AS (SELECT event_id, client, rn, TRUE AS accepted, ts AS last_acc FROM e WHERE rn = 1 "
    "UNION ALL SELECT e.event_id, e.client, e.rn, "
    "epoch_us(e.ts) - epoch_us(r.last_acc) >= 3600000000 AS accepted, "
    "CASE WHEN epoch_us(e.ts) - epoch_us(r.last_acc) >= 3600000000 THEN e.ts ELSE r.last_acc END "
    "FROM r JOIN e ON e.client = r.client AND e.rn = r.rn + 1) "
    "SELECT event_id, client, accepted FROM r")


@register("rate_limit_stateful", _RATE_LIMIT_SQL)
def q_rate_limit(spark, d):
    """Accepted-only limiter (1 accepted request per client per hour) on the event
    stream. With limit 1 a request is accepted exactly when an hour has passed
    since the client's last accepted one, which the SQL twin states recursively."""
    sdf = ST.stream_scan(spark, d, "events")
    out = ST.run_to_table(ST.rate_limit_stream(sdf, "user_id", 3600, 1), "ratelimit", "append")
    return out.select("event_id", "client", "accepted")


_DAY = 86_400_000_000


@register("rate_limit_burst",
          "WITH RECURSIVE e AS (SELECT event_id, user_id AS client, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id "
          "ORDER BY ts, event_id) AS rn FROM events), "
          "r AS (SELECT event_id, client, rn, TRUE AS accepted, t AS a1, NULL::BIGINT AS a2, NULL::BIGINT AS a3 FROM e WHERE rn = 1 "
          "UNION ALL SELECT event_id, client, rn, ok, CASE WHEN ok THEN t ELSE a1 END, CASE WHEN ok THEN a1 ELSE a2 END, "
          "CASE WHEN ok THEN a2 ELSE a3 END FROM (SELECT e.event_id, e.client, e.rn, e.t, r.a1, r.a2, r.a3, "
          f"r.a3 IS NULL OR e.t - r.a3 >= {_DAY} AS ok FROM r JOIN e ON e.client = r.client AND e.rn = r.rn + 1)) "
          "SELECT event_id, client, accepted FROM r")
def q_rate_limit_burst(spark, d):
    """Accepted-only limiter with three accepted requests per client and day: a request passes
    exactly when the third last accepted one is a day old (or there is none)."""
    out = ST.run_to_table(ST.rate_limit_stream(ST.stream_scan(spark, d, "events"), "user_id", 86400, 3), "ratelimit3", "append")
    return out.select("event_id", "client", "accepted")


@register("rate_limit_fixed",
          "WITH RECURSIVE e AS (SELECT event_id, user_id AS client, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id "
          "ORDER BY ts, event_id) AS rn FROM events), "
          "r AS (SELECT event_id, client, rn, t AS start, 1 AS c FROM e WHERE rn = 1 "
          f"UNION ALL SELECT e.event_id, e.client, e.rn, CASE WHEN e.t - r.start >= {_DAY} THEN e.t ELSE r.start END, "
          f"CASE WHEN e.t - r.start >= {_DAY} THEN 1 ELSE r.c + 1 END FROM r JOIN e ON e.client = r.client AND e.rn = r.rn + 1) "
          "SELECT event_id, client, c <= 2 AS accepted FROM r")
def q_rate_limit_fixed(spark, d):
    """Two requests per client in a fixed window of one day, opened by the first request."""
    out = ST.run_to_table(ST.rate_limit_fixed(ST.stream_scan(spark, d, "events"), "user_id", 86400, 2), "ratelimit-fixed", "append")
    return out.select("event_id", "client", "accepted")


_DELIVERY_DAYS = 5


@register("stream_late_data",
          "WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, "
          f"date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // {_DELIVERY_DAYS} + CASE WHEN event_id % 25 = 0 THEN 1 ELSE 0 END AS d "
          "FROM events), "
          "m AS (SELECT d, max(max(t)) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000000 AS mark "
          "FROM e GROUP BY d) "
          "SELECT event_id, user_id, round((mark - t) / 1000000, 6) AS late_by FROM e JOIN m USING (d) WHERE t < mark")
def q_stream_late(spark, d):
    """Events land in deliveries of five days each, one of 25 a delivery too late; the stream runs
    after each delivery. Returns the rows older than the watermark, which windowed aggregates drop."""
    e = table(spark, d, "events").withColumn("_d", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / _DELIVERY_DAYS)
                                             + F.when(F.col("event_id") % 25 == 0, 1).otherwise(0))
    base = ST.scratch(spark, "late")
    sdf_schema = table(spark, d, "events").schema
    late = None
    for i in [r[0] for r in e.select("_d").distinct().orderBy("_d").collect()]:  # a month has seven deliveries
        e.where(F.col("_d") == i).drop("_d").write.mode("append").parquet(f"{base}/in")
        sdf = ST.stream_folder(spark, f"{base}/in", sdf_schema, 1_000)
        late = ST.LateRows(spark, f"{base}/out", sdf.schema)
        late.run(sdf)
    return round_doubles(late.late().select("event_id", "user_id", "late_by"))


@register("rate_limit_replay", _RATE_LIMIT_SQL)
def q_rate_limit_replay(spark, d):
    """Batch twin: weekly slices replayed in order with the limiter state carried."""
    out = ST.rate_limit_replay(table(spark, d, "events"), "user_id", "ts", 3600, 1, slice_seconds=7 * 86400)
    return out.select("event_id", "client", "accepted")


@register("stream_score")
def q_stream_score(spark, d):
    """Fit on the lineitem table, score the lineitem rows arriving as a stream."""
    feats = ["l_quantity", "l_discount", "l_tax"]
    li = table(spark, d, "lineitem")
    fm = MD.fit_classifier(li.select(*feats, "l_returnflag"), feats, "l_returnflag", "decision_tree")
    sdf = ST.stream_scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *feats)
    scored = fm.transform(sdf).select("l_orderkey", "l_linenumber", "predicted_label")
    return ST.run_to_table(scored, "score", "append")
