"""Scans, ingestion and sinks (survey 2.1).

Paths are parameters: on a cluster they name shared storage (the checkpoint
folder, an object store, a warehouse path); nothing here writes to a
machine-local folder on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.predicates import missing_columns
from ..operators.profile import profile_columns


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
             infer: bool = False) -> DataFrame:
    """Headered CSV; the schema is given in code (inference only for exploration)."""
    r = spark.read.option("header", header)
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True)
    return r.csv(path)


def scan_parquet(spark: SparkSession, path: str, columns=None, where: Column | None = None) -> DataFrame:
    """Columnar scan; the projection and filter reach the reader (pruning, pushdown)."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def _exists(spark: SparkSession, path: str, fmt: str) -> bool:
    try:
        spark.read.format(fmt).load(path).limit(0).collect()
        return True
    except AnalysisException:
        return False


def ingest_raw(spark: SparkSession, source: DataFrame, raw_path: str, fmt: str = "parquet") -> DataFrame:
    """Land the source unchanged in the raw zone once; reuse it when present."""
    if not _exists(spark, raw_path, fmt):
        source.write.mode("ignore").format(fmt).save(raw_path)
    return spark.read.format(fmt).load(raw_path)


def ingest_upload(spark: SparkSession, path: str, required, store: str, ingest_ts: str,
                  schema: T.StructType | str | None = None) -> tuple[DataFrame, int]:
    """Accept a CSV only if it is .csv and has the required columns; store it
    under an ``ingest_ts`` partition; return the stored rows and the count
    observed while writing (no second pass)."""
    if not path.lower().endswith(".csv"):
        raise ValueError("only .csv files are accepted")
    df = scan_csv(spark, path, schema=schema, infer=schema is None)
    miss = missing_columns(df, required)
    if miss:
        raise ValueError(f"missing required columns: {miss}")
    obs = Observation("ingest")
    observed = df.withColumn("ingest_ts", F.lit(ingest_ts)).observe(obs, F.count(F.lit(1)).alias("records"))
    observed.write.mode("append").partitionBy("ingest_ts").parquet(store)
    n = obs.get["records"]
    stored = spark.read.parquet(store).where(F.col("ingest_ts") == ingest_ts)
    return stored, n


def records_to_frame(df: DataFrame, col: str, schema: T.StructType | str) -> DataFrame:
    """JSON objects in a text column -> typed columns."""
    parsed = df.withColumn("_rec", F.from_json(F.col(col), schema))
    return parsed.select(*[c for c in df.columns if c != col], "_rec.*")


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def sink_parquet(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def json_records(df: DataFrame, out: str = "record") -> DataFrame:
    """One JSON object per row (the rows of a JSON records export)."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(out))


def sink_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def sink_summary(df: DataFrame, path: str) -> DataFrame:
    """Per-column profile (dtype, missing, unique) + row count, written as JSON."""
    n = df.count()
    prof = profile_columns(df).withColumn("total_records", F.lit(n).cast("long"))
    prof.coalesce(1).write.mode("overwrite").json(path)
    return prof


def sink_features(features: DataFrame, scaled: DataFrame, names, folder: str) -> None:
    """Engineered table, scaled table and the feature list (one-column table)."""
    features.write.mode("overwrite").parquet(f"{folder}/features")
    scaled.write.mode("overwrite").parquet(f"{folder}/scaled")
    features.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "position int, feature string") \
        .write.mode("overwrite").parquet(f"{folder}/feature_list")


def sample_rows(df: DataFrame, n: int, key_cols, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by a seeded md5 order of the key
    (per-partition top-n then merge; reproducible in SQL)."""
    txt = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    return df.withColumn("_o", F.md5(txt)).orderBy("_o", *key_cols).limit(n).drop("_o")


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Fast approximate sample (Bernoulli per row, no shuffle)."""
    return df.sample(fraction=fraction, seed=seed)


def sink_samples(df: DataFrame, folder: str, key_cols, sizes=(1000, 10000), seed: int = 42) -> None:
    for n in sizes:
        sample_rows(df, n, key_cols, seed).write.mode("overwrite").parquet(f"{folder}/sample_{n}")


def prediction_history(preds: DataFrame, meta_cols, input_col: str, input_schema: T.StructType | str) -> DataFrame:
    """Flatten prediction metadata + nested input features to flat text
    columns; missing values become empty strings (the CSV export rows)."""
    parsed = preds.withColumn("_in", F.from_json(F.col(input_col), input_schema))
    in_fields = parsed.schema["_in"].dataType.fieldNames()
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in meta_cols]
    cols += [F.coalesce(F.col(f"_in.{f}").cast("string"), F.lit("")).alias(f) for f in in_fields]
    return parsed.select(*cols)


def sink_prediction_history(preds: DataFrame, path: str, meta_cols, input_col: str, input_schema) -> None:
    sink_csv(prediction_history(preds, meta_cols, input_col, input_schema), path)
