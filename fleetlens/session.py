"""Session construction, table access and lineage control.

Everything here is plain SparkSession configuration; the settings are the
ones that matter when the same code runs on a large cluster:

* AQE re-plans joins and coalesces shuffle partitions at runtime, and splits
  skewed sort-merge-join partitions (a hot key may hold a third of the rows).
* The session time zone is pinned to UTC so timestamp arithmetic repeats.
* The checkpoint directory is read from the session (``spark.checkpoint.dir``)
  and only set by us when it is missing, as in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of ``kept`` rows.
KEPT_BLOCK = 4 << 20

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def make_session(master: str | None = None, shuffle_partitions: int | None = None,
                 app_name: str = "fleetlens", extra: dict | None = None) -> SparkSession:
    """A session with this library's settings. The master and the number of shuffle
    partitions stay what spark-submit or the cluster says unless they are given."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; create a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Local runs (tests, bench) get a fresh temporary folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not sc.master.startswith("local") or not d and sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="fleetlens-ckpt-", dir=os.environ.get("FLEETLENS_SCRATCH", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage for iterative jobs with a reliable checkpoint.

    Used by loops (exact quantiles, density clustering) so that iteration i
    does not recompute iterations 0..i-1, and so that a lost executor only
    costs the current step.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A path of its own, not made yet, below the checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write ``df`` once below the checkpoint folder and read it back: what several jobs read.

    Cuts lineage like ``materialize``, but later reads take only the columns they use, compressed, and nothing
    stays in the executors' memory. Row groups are small, so that a file of many rows is read by many tasks
    however few tasks wrote it, and no shuffle is needed to spread the rows.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("parquet.block.size", str(KEPT_BLOCK)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
