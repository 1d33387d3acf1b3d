"""Structured Streaming operators (survey 2.13).

* Sources: a Parquet folder read as a stream (``pathGlobFilter`` picks one
  table); ``ts`` is cast to TIMESTAMP because watermarks refuse
  TIMESTAMP_NTZ.
* Windowed rates/alerts: ``withWatermark`` + ``groupBy(window)``; state is one
  aggregation buffer per (window, group). A row older than the watermark of
  the previous micro-batch is dropped (Spark's late-event rule), and a window
  is emitted in append mode once the watermark passes its end. Percentiles in a stream use
  ``percentile_approx`` (bounded sketch) since exact ones keep every value.
* Sinks: results land as Parquet under the session's checkpoint folder
  (``spark.checkpoint.dir``, a shared folder on a cluster), never in driver
  memory; complete mode rewrites the table per micro-batch via foreachBatch.
* Accepted-only rate limiting depends on earlier decisions, so it keeps per
  client state: the accepted timestamps inside the window (at most ``limit``
  values) - ``applyInPandasWithState``. Its batch twin replays time slices in
  order with the same state carried as a table, so no group ever holds more
  than one client's rows of one slice.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ensure_checkpoint_dir, materialize, table

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def stream_scan(spark: SparkSession, sf_dir: str, name: str = "events", schema: T.StructType | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """New rows of one table of a Parquet folder as a stream; ``ts`` as TIMESTAMP."""
    schema = schema or table(spark, sf_dir, name).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    sdf = r.parquet(sf_dir)
    if "ts" in sdf.columns:
        sdf = sdf.withColumn("ts", F.col("ts").cast("timestamp"))
    return sdf


def stream_folder(spark: SparkSession, folder: str, schema: T.StructType, max_files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream (one file per micro-batch by default)."""
    sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder)
    return sdf.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in sdf.columns else sdf


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"


def run_to_table(sdf: DataFrame, name: str, mode: str = "complete", base: str | None = None) -> DataFrame:
    """Run a stream to completion (availableNow) into Parquet and read it back."""
    spark = sdf.sparkSession
    base = base or scratch(spark, name)
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    if mode == "complete":
        def sink(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        q = (sdf.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
    else:
        q = (sdf.writeStream.outputMode(mode).format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return _written(spark, out, sdf.schema)


def _written(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table that a sink writes; empty as long as no batch has been run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class LateRows:
    """A stream cut into rows on time and a side table of rows older than the watermark.

    The watermark of a micro-batch is the latest time of all batches before it,
    less the delay (Spark's own rule, so a row that a windowed aggregate of the
    same delay drops is in the side table). Every batch writes its rows and its
    latest time in a folder of its own number: a batch that is run again after a
    failure replaces what it wrote, and the next run goes on from the same
    checkpoint. Rows without a time are on time and move no watermark.
    """

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, ts: str = "ts", delay_seconds: float = 600):
        self.spark, self.base, self.ts, self.delay = spark, base.rstrip("/"), ts, int(delay_seconds * 1_000_000)
        self.schema = schema

    def _clock(self) -> DataFrame:
        return _written(self.spark, f"{self.base}/clock", "latest long, batch long")

    def _sink(self, batch: DataFrame, epoch: int) -> None:
        seen = self._clock().where(F.col("batch") < epoch).agg(F.max("latest")).first()[0]
        mark = F.lit(None if seen is None else seen - self.delay).cast("long")
        t = F.unix_micros(F.col(f"`{self.ts}`").cast("timestamp"))
        rows = batch.withColumn("late_by", (mark - t) / 1_000_000).persist(StorageLevel.MEMORY_AND_DISK)
        late = F.coalesce(F.col("late_by") > 0, F.lit(False))
        rows.where(~late).drop("late_by").write.mode("overwrite").parquet(f"{self.base}/rows/batch={epoch}")
        rows.where(late).write.mode("overwrite").parquet(f"{self.base}/late/batch={epoch}")
        rows.agg(F.max(t).alias("latest")).write.mode("overwrite").parquet(f"{self.base}/clock/batch={epoch}")
        rows.unpersist()

    def run(self, sdf: DataFrame) -> None:
        """All input there is now."""
        (sdf.writeStream.foreachBatch(self._sink).option("checkpointLocation", f"{self.base}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())

    def on_time(self) -> DataFrame:
        """The rows on time, with their ``batch``."""
        return _written(self.spark, f"{self.base}/rows", T.StructType([*self.schema, T.StructField("batch", T.LongType())]))

    def late(self) -> DataFrame:
        """The late rows, with ``late_by`` (seconds behind the watermark) and their ``batch``."""
        return _written(self.spark, f"{self.base}/late", T.StructType(
            [*self.schema, T.StructField("late_by", T.DoubleType()), T.StructField("batch", T.LongType())]))


def tumbling_rate(sdf: DataFrame, size: str = "1 minute", seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """Requests per window (and per second) on a stream."""
    return (sdf.withWatermark("ts", watermark).groupBy(F.window("ts", size).alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("w.start").alias("window_start"), "requests",
                    (F.col("requests") / F.lit(float(seconds))).alias("rate")))


def sliding_stats(sdf: DataFrame, size: str = "5 minutes", slide: str = "15 seconds", seconds: int = 300,
                  watermark: str = "10 minutes", with_p95: bool = False) -> DataFrame:
    """Sliding-window rate, success rate and mean latency (optional approximate p95)."""
    aggs = [F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"),
            F.avg(F.col("value") / 100).alias("avg_latency")]
    if with_p95:
        aggs.append(F.percentile_approx(F.col("value") / 100, 0.95, 10000).alias("p95_latency"))
    out = sdf.withWatermark("ts", watermark).groupBy(F.window("ts", size, slide).alias("w")).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), "requests", "errors",
                      (F.col("requests") / F.lit(float(seconds))).alias("rate"),
                      ((1 - F.col("errors") / F.col("requests")) * 100).alias("success_rate"),
                      "avg_latency", *(["p95_latency"] if with_p95 else []))


def error_alerts(sdf: DataFrame, threshold: float = 0.1, size: str = "1 minute", seconds: int = 60,
                 watermark: str = "10 minutes") -> DataFrame:
    """Windows whose 5xx rate per second crosses the threshold (emitted in
    append mode once the watermark has passed the window)."""
    w = (sdf.withWatermark("ts", watermark).groupBy(F.window("ts", size).alias("w"))
         .agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("requests")))
    return (w.select(F.col("w.start").alias("window_start"), "errors", "requests",
                     (F.col("errors") / F.lit(float(seconds))).alias("error_rate"))
            .where(F.col("error_rate") > threshold))


def dedupe(sdf: DataFrame, key: str = "event_id", watermark: str = "10 minutes") -> DataFrame:
    """Drop repeated request ids seen within the watermark delay."""
    return sdf.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


# ---------------------------------------------------------------- rate limiting

DECISION_SCHEMA = "event_id long, client long, ts timestamp, accepted boolean"
STATE_SCHEMA = "accepted array<timestamp>"


def _decide(rows: pd.DataFrame, accepted: list, window_s: float, limit: int):
    """Sliding-window limiter over accepted requests only (rows sorted by ts, id)."""
    acc = deque(accepted)
    out = []
    for eid, ts in zip(rows["event_id"], rows["ts"]):
        while acc and (ts - acc[0]).total_seconds() >= window_s:
            acc.popleft()
        ok = len(acc) < limit
        if ok:
            acc.append(ts)
        out.append((eid, ok))
    return out, list(acc)


def rate_limit_stream(sdf: DataFrame, client: str = "user_id", window_seconds: float = 60, limit: int = 100,
                      watermark: str = "10 minutes") -> DataFrame:
    """Per-client accepted-only sliding-window rate limiter on a stream.

    State per client: the accepted timestamps still inside the window (at most
    ``limit`` values). Rows of one client inside one micro-batch are sorted
    by (ts, event_id) before deciding; micro-batches arrive in time order.
    An event-time timeout (last accepted time + window, under the watermark)
    drops the state of clients that went quiet, so state is bounded by the
    clients active within one window.
    """
    window_ms = int(window_seconds * 1000)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        prev = list(state.get[0]) if state.exists else []
        prev = [pd.Timestamp(p) for p in prev]
        dec, acc = _decide(rows, prev, window_seconds, limit)
        state.update(([a.to_pydatetime() for a in acc],))
        last = max([rows["ts"].max()] + acc)
        state.setTimeoutTimestamp(int(pd.Timestamp(last).timestamp() * 1000) + window_ms)
        ts_map = dict(zip(rows["event_id"], rows["ts"]))
        yield pd.DataFrame({"event_id": [e for e, _ in dec], "client": key[0],
                            "ts": [ts_map[e] for e, _ in dec], "accepted": [a for _, a in dec]})

    return (sdf.withWatermark("ts", watermark).select("event_id", F.col(client).alias("client"), "ts")
            .groupBy("client")
            .applyInPandasWithState(fn, DECISION_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout))


def fixed_windows(times: np.ndarray, start: int | None, count: int, window: int, limit: int):
    """Which of the sorted ``times`` pass, and the open window's ``(start, count)`` after them.

    A window opens with the first request after the one before has ended, lasts
    ``window`` and lets its first ``limit`` requests pass; refused ones count too.
    """
    ok, at = np.zeros(len(times), bool), 0
    while at < len(times):
        if start is None or times[at] >= start + window:
            start, count = int(times[at]), 0
        end = int(np.searchsorted(times, start + window, "left"))
        ok[at:end] = count + 1 + np.arange(end - at) <= limit
        count, at = count + end - at, end
    return ok, start, count


def rate_limit_fixed(sdf: DataFrame, client: str = "user_id", window_seconds: float = 3600, limit: int = 100,
                     watermark: str = "10 minutes") -> DataFrame:
    """Fixed-window rate limiter on a stream: ``limit`` requests of a client per window, which its first request opens.

    State per client: the start of its window and the requests in it, two numbers
    whatever the limit; it is dropped once the watermark has passed the window's
    end. Rows of a client inside a micro-batch are decided in order of (ts,
    event_id), a window at a time. Rows without a time are not decided (null).
    """
    window = int(window_seconds * 1_000_000)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"], na_position="last")
        known = rows["ts"].notna().to_numpy()
        times = rows["ts"][known].to_numpy("datetime64[us]").astype("int64")
        start, count = state.get if state.exists else (None, 0)
        ok, start, count = fixed_windows(times, start, count, window, limit)
        if start is not None:
            state.update((start, count))
            state.setTimeoutTimestamp(max((start + window) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        rows["accepted"] = None
        rows.loc[known, "accepted"] = ok
        rows["client"] = key[0]
        yield rows[["event_id", "client", "ts", "accepted"]]

    rows = sdf.withWatermark("ts", watermark).select("event_id", F.col(client).alias("client"), "ts")
    return rows.groupBy("client").applyInPandasWithState(fn, DECISION_SCHEMA, "start long, requests long", "append",
                                                         GroupStateTimeout.EventTimeTimeout)


def rate_limit_replay(df: DataFrame, client: str = "user_id", ts: str = "ts", window_seconds: float = 60,
                      limit: int = 100, slice_seconds: int = 86400) -> DataFrame:
    """Batch twin of ``rate_limit_stream``: time slices (>= the window) are
    decided in order; the per-client state (accepted timestamps inside the
    window) is a table carried from slice to slice and checkpointed."""
    if slice_seconds < window_seconds:
        raise ValueError("slice must be at least one window long")
    spark = df.sparkSession
    base = (df.select("event_id", F.col(client).alias("client"), F.col(ts).cast("timestamp").alias("ts"))
            .withColumn("_slice", F.floor(F.unix_seconds("ts") / slice_seconds).cast("long"))
            .persist(StorageLevel.MEMORY_AND_DISK))
    slices = [r[0] for r in base.select("_slice").distinct().orderBy("_slice").collect()]
    state = spark.createDataFrame([], "client long, accepted array<timestamp>")
    outputs = []
    out_schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("client", T.LongType()),
                               T.StructField("ts", T.TimestampType()), T.StructField("accepted", T.BooleanType()),
                               T.StructField("state", T.ArrayType(T.TimestampType()))])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["ts", "event_id"])
        v = pdf["accepted_prev"].iloc[0]
        prev = [] if v is None or (isinstance(v, float) and pd.isna(v)) else [pd.Timestamp(x) for x in v]
        dec, acc = _decide(rows, prev, window_seconds, limit)
        ts_map = dict(zip(rows["event_id"], rows["ts"]))
        # the carried state rides on the client's last decision only
        state_col = [None] * (len(dec) - 1) + [[a.to_pydatetime() for a in acc]]
        return pd.DataFrame({"event_id": [e for e, _ in dec], "client": pdf["client"].iloc[0],
                             "ts": [ts_map[e] for e, _ in dec], "accepted": [a for _, a in dec],
                             "state": state_col})

    for s in slices:
        rows = base.where(F.col("_slice") == s).drop("_slice")
        joined = rows.join(state.withColumnRenamed("accepted", "accepted_prev"), "client", "left")
        decided = materialize(joined.groupBy("client").applyInPandas(fn, out_schema))
        outputs.append(decided.select("event_id", "client", "ts", "accepted"))
        new_state = decided.where(F.col("state").isNotNull()).select("client", F.col("state").alias("accepted"))
        # clients without rows in this slice keep no state: the slice is >= the window
        state = materialize(new_state)
    base.unpersist()
    if not outputs:
        return spark.createDataFrame([], DECISION_SCHEMA)
    res = outputs[0]
    for o in outputs[1:]:
        res = res.unionByName(o)
    return res
