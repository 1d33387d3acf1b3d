r"""Line deduplication on levelled sorted runs of line hashes (DataFrame functions only).

:class:`LineRuns` keeps, per 128-bit line hash, the number of documents that
hold the line, spread over runs. All runs are cut alike: ``n_buckets`` buckets by
the hash, one file each, sorted by hash. So a batch meets the runs by merge joins
that neither shuffle nor sort a run: only the batch's own counts are brought into
the buckets. A batch of documents counts its line hashes, merges them with the runs
and leaves out those that the runs already hold often enough (nothing more has to be
known about them); the rest is a run of level 0. When a level holds ``fanout`` runs
they are merged into one run of the next level, so a key is rewritten once per level.

A line's key is the line without white space ``[\x20\x09-\x0D]`` at either end,
A-Z in lower case. Keys of at least ``min_chars`` code points that occur in at
least ``min_docs`` documents lose all their lines in every document.

Defined cases: a null or empty text is one empty line, which is never dropped
(its key has no code point); a row is a document, so repeated rows each count;
(ten rows of one id are ten documents); null ids are ordinary; an empty table stays empty. All columns of the input are
kept, and their names cannot clash with work columns: rows meet their decisions
on two 64-bit hashes of (id, text), which equal rows share with equal results.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, shared_dir, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRIMMED = " \t\n\x0b\x0c\r"
BUCKET_LINES, MAX_BUCKETS = 2_000_000, 100_000  # distinct-line rows a bucket is meant for; Spark's own limit
#: With these Spark takes the buckets and the order of one-file buckets as given.
RUN_CONF = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.enabled": "true",
            "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return F.xxhash64(i, t), F.xxhash64(F.lit(1), t, i)


def hash_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1,
               n_batches: int = 1) -> DataFrame:
    """``row, batch, r1, r2, pos, h1, h2``: the hashed key of every line that may be dropped."""
    r1, r2 = _row_key(id_col, text_col)
    folded = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), r1.alias("r1"), r2.alias("r2"), folded.alias("folded"))
    rows = rows.select("row", "r1", "r2", F.posexplode(F.split("folded", "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("key", F.btrim("line", F.lit(TRIMMED)))
    if min_chars > 0:
        rows = rows.where(F.length("key") >= min_chars)
    return rows.select("row", F.pmod("r2", F.lit(n_batches)).cast("int").alias("batch"), "r1", "r2", "pos",
                       F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


@contextmanager
def ordered_runs(spark: SparkSession):
    """Plans made and run inside use the runs' buckets and their order; the session's settings come back after."""
    old = {k: spark.conf.get(k, None) for k in RUN_CONF}
    try:
        for k, v in RUN_CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class LineRuns:
    """Document counts of line hashes in levelled sorted runs, bucketed tables below ``path``.

    Each level maps its runs' table names to their folders; ``drop`` removes all.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10, fanout: int = 3, n_buckets: int = 8):
        self.spark, self.min_docs, self.fanout, self.n_buckets = spark, min_docs, fanout, n_buckets
        self.path = path or shared_dir(spark, "line-runs")
        self.levels: dict[int, dict[str, str]] = {}
        self._made, self._name = 0, f"line_run_{uuid.uuid4().hex[:12]}"

    def _read(self, paths) -> DataFrame:
        """Runs as plain files: a union of bucketed scans loses the buckets but claims them, so its counts would be wrong."""
        return reduce(DataFrame.union, [self.spark.read.schema("h1 long, h2 long, n long").parquet(p) for p in paths])

    def _write(self, counts: DataFrame, level: int) -> None:
        """``counts`` (already in the runs' buckets) as one more run, a file per bucket."""
        name, path = f"{self._name}_{self._made}", f"{self.path}/level{level}-run{self._made}"
        self._made += 1
        (counts.sortWithinPartitions("h1", "h2").write.bucketBy(self.n_buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", path).format("parquet").saveAsTable(name))
        self.levels.setdefault(level, {})[name] = path

    def _drop(self, level: int) -> None:
        for name, path in self.levels.pop(level).items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, path)

    def drop(self) -> None:
        """Remove all runs."""
        for level in list(self.levels):
            self._drop(level)

    def totals(self) -> DataFrame | None:
        """``h1, h2, n`` over all runs; None before the first batch."""
        paths = [p for level in self.levels.values() for p in level.values()]
        return self._read(paths).groupBy("h1", "h2").agg(F.sum("n").alias("n")) if paths else None

    def frequent(self) -> DataFrame | None:
        """``h1, h2`` of the lines known to be in ``min_docs`` documents or more."""
        t = self.totals()
        return None if t is None else t.where(F.col("n") >= self.min_docs).select("h1", "h2")

    def fresh(self, batch: DataFrame) -> DataFrame:
        """``h1, h2, n`` of a batch (``row, h1, h2``) without keys already known to be frequent, in the runs' buckets.

        To be planned and run inside ``ordered_runs``.
        """
        own = batch.select("h1", "h2", "row").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        own = own.repartition(self.n_buckets, "h1", "h2").withColumn("known", F.lit(0).cast("long"))
        for name in (n for level in self.levels.values() for n in level):
            run = self.spark.table(name).withColumnRenamed("n", "held").hint("merge")
            own = own.join(run, ["h1", "h2"], "left").select("h1", "h2", "n", (F.col("known") + F.coalesce("held", F.lit(0))).alias("known"))
        return own.where(F.col("known") < self.min_docs).select("h1", "h2", "n")

    def add(self, batch: DataFrame) -> None:
        """Add the run of a batch (``row, h1, h2``)."""
        with ordered_runs(self.spark):
            self._write(self.fresh(batch), 0)
        self.compact()

    def compact(self) -> None:
        """Merge each full level into one run of the next; the merged runs go once it is written."""
        level = 0
        while len(self.levels.get(level, {})) >= self.fanout:
            merged = self._read(self.levels[level].values()).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
            self._write(merged.repartition(self.n_buckets, "h1", "h2"), level + 1)
            self._drop(level)
            level += 1


def _flags(dropped: Column, n: Column) -> Column:
    """Boolean per line from the sorted dropped positions, linear in the lines."""
    ends = F.concat(F.array(F.lit(-1)), dropped, F.array(n))

    def gap(i):
        skip = F.array_repeat(F.lit(False), F.element_at(ends, i + 2) - F.element_at(ends, i + 1) - 1)
        return F.concat(skip, F.when(i < F.size(dropped), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), gap))


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                        min_chars: int = 1, n_batches: int = 4, fanout: int = 3,
                        work: str = "_line") -> DataFrame:
    """``docs`` and three columns more: ``{work}_kept`` (text), ``{work}_n`` and ``{work}_dropped`` (lines).

    The table is taken as ``n_batches`` batches that arrive one after the other
    (each row's batch is its hash); every batch adds its run before the lines of
    all documents are held against the frequent keys.
    """
    spark = docs.sparkSession
    hashed = stored(hash_lines(docs, id_col, text_col, min_chars, n_batches), "lines")
    n_buckets = min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-hashed.count() // BUCKET_LINES)))
    runs = LineRuns(spark, min_docs=min_docs, fanout=fanout, n_buckets=n_buckets)
    for b in range(n_batches):
        runs.add(hashed.where(F.col("batch") == b))
    frequent = stored(runs.frequent(), "frequent-lines")
    runs.drop()
    drops = (hashed.select("r1", "r2", "pos", "h1", "h2").join(frequent, ["h1", "h2"], "left_semi")
             .select("r1", "r2", "pos").distinct()
             .groupBy("r1", "r2").agg(F.sort_array(F.collect_list("pos")).alias("drop")))
    r1, r2 = _row_key(id_col, text_col)
    left = docs.select(r1.alias("r1"), r2.alias("r2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    j = left.join(drops, ["r1", "r2"], "left")
    text = F.col("doc").getField(text_col)
    lines = _lines(text)
    kept = F.when(F.col("drop").isNull(), text).otherwise(
        F.array_join(F.transform(
            F.filter(F.arrays_zip(lines.alias("line"), _flags(F.col("drop"), F.size(lines)).alias("flag")), lambda x: ~x["flag"]),
            lambda x: x["line"]), "\n"))
    out = F.struct(kept.alias("kept"), F.size(lines).cast("long").alias("n"),
                   F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("dropped"))
    return j.select("doc", out.alias("out")).select(
        "doc.*", *[F.col(f"out.{c}").alias(f"{work}_{c}") for c in ("kept", "n", "dropped")])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
                **options) -> DataFrame:
    """``docs`` with the frequent lines taken out of their texts (same columns; ``chars_col`` follows)."""
    out = drop_frequent_lines(docs, id_col, text_col, **options)
    cols = [F.col("_line_kept").alias(c) if c == text_col
            else F.when(F.col("_line_dropped") > 0, F.length("_line_kept").cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c)
            if c == chars_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols)
