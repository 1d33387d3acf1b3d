"""Registry tables (datasets, models, runs, predictions, API log, jobs) and
parameterised SQL.

The reference keeps seven bookkeeping tables in a relational database. Here
they are declared StructTypes; the stand-ins built from the driver tables
(``registry_tables``) give rows in those schemas so that registry operators
run over data that grows with the inputs:

* datasets    <- nation     (dataset_id)
* models      <- supplier   (model_id, dataset_id, accuracy)
* predictions <- lineitem   (model_id = supplier, timestamp, confidence...)
* runs        <- orders     (run_id, experiment_id = customer, start, type, status, score)
* api_log     <- events     (user_id, endpoint, status_code, response_time)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import table

DATASET_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.LongType(), False), T.StructField("name", T.StringType()),
    T.StructField("file_path", T.StringType()), T.StructField("record_count", T.LongType()),
    T.StructField("statistics", T.StringType()), T.StructField("created_at", T.TimestampType())])
MODEL_SCHEMA = T.StructType([
    T.StructField("model_id", T.LongType(), False), T.StructField("dataset_id", T.LongType()),
    T.StructField("name", T.StringType()), T.StructField("model_type", T.StringType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("parameters", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("stage", T.StringType()), T.StructField("version", T.IntegerType()),
    T.StructField("created_at", T.TimestampType())])
PREDICTION_SCHEMA = T.StructType([
    T.StructField("prediction_id", T.LongType(), False), T.StructField("model_id", T.LongType()),
    T.StructField("input_data", T.StringType()), T.StructField("prediction", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("processing_time", T.DoubleType()),
    T.StructField("feedback", T.BooleanType()), T.StructField("timestamp", T.TimestampType())])
EXPERIMENT_SCHEMA = T.StructType([
    T.StructField("experiment_id", T.LongType(), False), T.StructField("model_id", T.LongType()),
    T.StructField("name", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("start_time", T.TimestampType()), T.StructField("end_time", T.TimestampType())])
JOB_SCHEMA = T.StructType([
    T.StructField("job_id", T.LongType(), False), T.StructField("job_type", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("total_items", T.LongType()),
    T.StructField("processed_items", T.LongType()), T.StructField("retry_count", T.IntegerType()),
    T.StructField("max_retries", T.IntegerType()), T.StructField("started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType())])
QUALITY_SCHEMA = T.StructType([
    T.StructField("check_id", T.LongType(), False), T.StructField("dataset_id", T.LongType()),
    T.StructField("total_records", T.LongType()), T.StructField("valid_records", T.LongType()),
    T.StructField("invalid_records", T.LongType()), T.StructField("completeness", T.DoubleType()),
    T.StructField("consistency", T.DoubleType()), T.StructField("validity", T.DoubleType()),
    T.StructField("overall_score", T.DoubleType())])
API_LOG_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType(), False), T.StructField("user_id", T.LongType()),
    T.StructField("endpoint", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("status_code", T.IntegerType()), T.StructField("response_time", T.DoubleType()),
    T.StructField("ts", T.TimestampType())])

SCHEMAS = {"datasets": DATASET_SCHEMA, "models": MODEL_SCHEMA, "predictions": PREDICTION_SCHEMA,
           "experiments": EXPERIMENT_SCHEMA, "jobs": JOB_SCHEMA, "quality_checks": QUALITY_SCHEMA,
           "api_log": API_LOG_SCHEMA}

# Stand-in views, as SQL valid in both Spark and DuckDB.
STANDIN_SQL = {
    "datasets": "SELECT CAST(n_nationkey AS BIGINT) AS dataset_id, n_name AS name FROM nation",
    "models": "SELECT s_suppkey AS model_id, CAST(s_nationkey AS BIGINT) AS dataset_id, s_name AS name, "
              "s_acctbal AS accuracy FROM supplier",
    "predictions": "SELECT l_orderkey * 8 + l_linenumber AS prediction_id, l_suppkey AS model_id, "
                   "l_shipdate AS timestamp, l_discount * 10 AS confidence, l_tax * 100 AS processing_time, "
                   "l_quantity AS input_quantity, l_extendedprice AS input_price, l_returnflag AS prediction, "
                   "l_linestatus = 'F' AS feedback FROM lineitem",
    "runs": "SELECT o_orderkey AS run_id, o_custkey AS experiment_id, o_orderdate AS start_time, "
            "o_orderpriority AS model_type, o_orderstatus AS status, o_totalprice AS score FROM orders",
    "api_log": "SELECT event_id AS request_id, user_id, event_type AS endpoint, "
               "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, "
               "value AS response_time, ts FROM events",
}


def registry_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    src = {"nation", "supplier", "lineitem", "orders", "events"}
    for t in src:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return {name: spark.sql(sql) for name, sql in STANDIN_SQL.items()}


def registry_sql(body: str, names=None) -> str:
    names = names or list(STANDIN_SQL)
    ctes = ", ".join(f"{n} AS ({STANDIN_SQL[n]})" for n in names)
    return f"WITH {ctes} {body}"


def empty_registry(spark: SparkSession, name: str) -> DataFrame:
    """An empty table with the declared schema of one registry table."""
    return spark.createDataFrame([], SCHEMAS[name])


def run_sql(spark: SparkSession, query: str, params: dict | None = None) -> DataFrame:
    """Parameterised SQL over temp views (named markers ``:name``)."""
    return spark.sql(query, args=params or {})
