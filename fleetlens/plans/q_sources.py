"""Registered queries: scans, ingestion, sinks and registry tables (2.1).

Sinks write into a fresh folder under the session's checkpoint directory
(the cluster's shared folder) and the query reads the written data back, so
the check covers the round trip.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, table
from ..sources import files as FS
from ..sources.registry import registry_sql, registry_tables, run_sql
from .registry import register, round_doubles


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex[:8]}"


@register("scan_csv", "SELECT * FROM part")
def q_scan_csv(spark, d):
    part = table(spark, d, "part")
    path = _scratch(spark, "part_csv")
    FS.sink_csv(part, path)
    return FS.scan_csv(spark, path, schema=part.schema)


@register("scan_parquet", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'")
def q_scan_parquet(spark, d):
    return FS.scan_parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_extendedprice"],
                           F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))


@register("ingest_raw", "SELECT event_id, user_id, event_type FROM events")
def q_ingest_raw(spark, d):
    raw = _scratch(spark, "raw_events")
    FS.ingest_raw(spark, table(spark, d, "events"), raw)
    again = FS.ingest_raw(spark, table(spark, d, "events"), raw)  # second call reuses the landed copy
    return again.select("event_id", "user_id", "event_type")


@register("ingest_upload", "SELECT *, (SELECT count(*) FROM customer) AS records FROM customer")
def q_ingest_upload(spark, d):
    cust = table(spark, d, "customer")
    up = _scratch(spark, "upload")
    FS.sink_csv(cust.coalesce(1), up)
    src = f"{up}/*.csv"  # Spark's glob: works on any file system the session reaches
    stored, n = FS.ingest_upload(spark, src, ["c_custkey", "c_name"], _scratch(spark, "datasets"),
                                 "20240101_000000", schema=cust.schema)
    return stored.drop("ingest_ts").withColumn("records", F.lit(n).cast("long"))


@register("records_to_frame", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def q_records(spark, d):
    e = table(spark, d, "events").select("event_id", "props")
    return FS.records_to_frame(e, "props", "k int")


@register("run_sql", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def q_run_sql(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return run_sql(spark, "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > :min_price "
                          "GROUP BY o_orderpriority", {"min_price": 100000})


@register("sink_csv", "SELECT * FROM orders")
def q_sink_csv(spark, d):
    path = _scratch(spark, "orders_csv")
    o = table(spark, d, "orders")
    FS.sink_csv(o, path)
    return FS.scan_csv(spark, path, schema=o.schema)


@register("sink_parquet", "SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INT) AS model_year FROM orders "
                          "WHERE year(o_orderdate) = 1998")
def q_sink_parquet(spark, d):
    path = _scratch(spark, "orders_by_year")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice",
                                         F.year("o_orderdate").alias("model_year"))
    FS.sink_parquet(o, path, partition_by=["model_year"])
    # the year filter prunes to one partition folder
    back = spark.read.parquet(path).where(F.col("model_year") == 1998)
    return back.select("o_orderkey", "o_totalprice", F.col("model_year").cast("int"))


@register("sink_json_records", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_sink_json(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = _scratch(spark, "customer_json")
    FS.sink_json_records(cust, path)
    rec = FS.json_records(spark.read.schema(cust.schema).json(path))
    return rec.select(F.get_json_object("record", "$.c_custkey").cast("long").alias("c_custkey"),
                      F.get_json_object("record", "$.c_name").alias("c_name"),
                      F.get_json_object("record", "$.c_acctbal").cast("double").alias("c_acctbal"))


_CUST_TYPES = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
               ("c_mktsegment", "string")]


@register("sink_summary", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS \"unique\", count(*) AS total_records FROM customer"
    for i, (c, t) in enumerate(_CUST_TYPES)) + ")")
def q_sink_summary(spark, d):
    path = _scratch(spark, "summary")
    FS.sink_summary(table(spark, d, "customer"), path)
    back = spark.read.json(path)
    return back.select(F.col("position").cast("int"), "column", "dtype", "missing", "unique", "total_records")


@register("sink_features",
          "SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice, CAST(year(o_orderdate) AS INT) "
          "AS model_year FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def q_sink_features(spark, d):
    from ..operators.features import scale_standard
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("model_year"))
    scaled, _ = scale_standard(o, ["o_totalprice"])
    folder = _scratch(spark, "features")
    FS.sink_features(o, scaled, ["o_totalprice", "model_year"], folder)
    return round_doubles(spark.read.parquet(f"{folder}/scaled"))


_SAMPLE_SQL = ("SELECT * FROM (SELECT {n} AS sample, * FROM lineitem ORDER BY md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), "
               "CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))), "
               "l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT {n})")


@register("sink_samples", " UNION ALL ".join(_SAMPLE_SQL.format(n=n) for n in (1000, 10000)))
def q_sink_samples(spark, d):
    """Both samples, read back."""
    folder = _scratch(spark, "samples")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    FS.sink_samples(table(spark, d, "lineitem"), folder, keys, sizes=(1000, 10000))
    small, large = (spark.read.parquet(f"{folder}/sample_{n}").withColumn("sample", F.lit(n)) for n in (1000, 10000))
    return small.unionByName(large)


@register("sink_prediction_history", registry_sql(
    "SELECT CAST(prediction_id AS VARCHAR) AS prediction_id, CAST(model_id AS VARCHAR) AS model_id, prediction, "
    "CAST(confidence AS VARCHAR) AS confidence, CAST(input_quantity AS VARCHAR) AS quantity, "
    "CAST(input_price AS VARCHAR) AS price FROM predictions", ["predictions"]))
def q_prediction_history(spark, d):
    preds = registry_tables(spark, d)["predictions"].withColumn(
        "input_data", F.to_json(F.struct(F.col("input_quantity").alias("quantity"), F.col("input_price").alias("price"))))
    flat = FS.prediction_history(preds, ["prediction_id", "model_id", "prediction", "confidence"], "input_data",
                                 "quantity double, price double")
    FS.sink_csv(flat, _scratch(spark, "prediction_history"))
    return flat


@register("registry_tables", registry_sql(
    "SELECT ds.dataset_id, ds.name AS dataset_name, count(DISTINCT m.model_id) AS models, count(p.prediction_id) "
    "AS predictions FROM datasets ds LEFT JOIN models m ON m.dataset_id = ds.dataset_id "
    "LEFT JOIN predictions p ON p.model_id = m.model_id GROUP BY 1, 2"))
def q_registry(spark, d):
    t = registry_tables(spark, d)
    j = (t["datasets"].join(t["models"].select("model_id", "dataset_id"), "dataset_id", "left")
         .join(t["predictions"].select("prediction_id", "model_id"), "model_id", "left"))
    return j.groupBy("dataset_id", F.col("name").alias("dataset_name")).agg(
        F.count_distinct("model_id").alias("models"), F.count("prediction_id").alias("predictions"))
