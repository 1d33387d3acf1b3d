"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, materialize

__all__ = ["materialize", "shared_dir", "stored", "delete_path", "table", "words_count", "native_bytes", "row_keys", "release"]

#: Java/RE2 class of the six ASCII white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder (shared by driver and executors)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage like a checkpoint, but column pruning still works on reads.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder this library wrote itself (merged runs, spent work tables)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of past rounds of a loop, which it does
    only when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_count(text: str | Column) -> Column:
    """Number of runs of non-space characters; null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def native_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def _hashable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_hashable(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _hashable(t.elementType)
    return not isinstance(t, (T.MapType, T.VariantType))


def row_keys(df: DataFrame) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a whole row; equal rows share them. Columns that Spark
    does not hash (maps, variants) count by their JSON text."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)]
    rest = [F.col(f"`{f.name}`") for f in df.schema.fields if not _hashable(f.dataType)]
    if rest:
        cols.append(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(rest)])))
    return F.xxhash64(F.lit(0), *cols), F.xxhash64(F.lit(1), *reversed(cols))
