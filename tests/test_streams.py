"""Stream invariants: complete mode equals batch, late rows are dropped,
the stateful limiter equals a plain loop."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from fleetlens.operators import logs as LG
from fleetlens.streaming import streams as ST

from conftest import SMALL


def test_complete_mode_equals_batch(spark):
    sdf = ST.stream_scan(spark, SMALL, "events")
    stream = {(r.window_start, r.requests) for r in ST.run_to_table(ST.tumbling_rate(sdf), "t", "complete").collect()}
    batch = LG.request_rate(spark.read.parquet(f"{SMALL}/events.parquet")
                            .withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 minute", 60)
    assert stream == {(r.window_start, r.requests) for r in batch.collect()}


def test_late_rows_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    base = dt.datetime(2024, 1, 1, 12, 0, 0)
    # a row is late against the watermark of the previous micro-batch, so the
    # late row comes in the third batch, after the watermark has moved to 13:50
    batches = [[(1, base, 1, "view", 1.0, "{}"), (2, base + dt.timedelta(hours=2), 1, "view", 1.0, "{}")],
               [(4, base + dt.timedelta(hours=2, minutes=5), 1, "view", 1.0, "{}")],
               [(3, base + dt.timedelta(minutes=1), 1, "view", 1.0, "{}")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ST.EVENTS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(str(folder / f"b{i}"))
    # move files to one flat folder in order
    flat = tmp_path / "flat"
    flat.mkdir()
    import os
    for i in range(3):
        for f in sorted((folder / f"b{i}").glob("*.parquet")):
            target = flat / f"part-{i}.parquet"
            f.rename(target)
            os.utime(target, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))  # file order = batch order
    sdf = ST.stream_folder(spark, str(flat), ST.EVENTS_SCHEMA, 1)
    out = ST.run_to_table(ST.tumbling_rate(sdf, "1 minute", 60, "10 minutes"), "late", "append")
    counts = {r.window_start: r.requests for r in out.collect()}
    # the 12:00 window is emitted with one row; the late 12:01 row never counts
    assert counts.get(dt.datetime(2024, 1, 1, 12, 0)) == 1
    assert dt.datetime(2024, 1, 1, 12, 1) not in counts


def test_stateful_limiter_equals_loop(spark):
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    out = ST.run_to_table(ST.rate_limit_stream(ST.stream_scan(spark, SMALL, "events"), "user_id", 3600, 2),
                          "rl", "append")
    got = {r.event_id: r.accepted for r in out.collect()}
    pdf = e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).toPandas()
    exp = {}
    for _, g in pdf.sort_values(["user_id", "ts", "event_id"]).groupby("user_id"):
        acc = []
        for eid, ts in zip(g.event_id, g.ts):
            acc = [a for a in acc if (ts - a).total_seconds() < 3600]
            exp[eid] = len(acc) < 2
            if exp[eid]:
                acc.append(ts)
    assert got == exp
