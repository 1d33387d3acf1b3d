"""Sharding by extendible hashing (DataFrame functions only).

Every row has a 62-bit hash: 31 bits of the MD5 of its key, then 31 bits that
tell rows of one key apart (their position in the input). The directory starts
as one bucket of depth 0; a bucket above the byte limit is split on the next
bit, and only such buckets are. A bucket ends when it fits the limit, holds a
single row, or has no bit left.

A key with very many rows is therefore split too, by the second half of the
bits. Buckets are counted on a histogram of hash prefixes; rows themselves are
shuffled only to look up their bucket.

Defined cases: a null key hashes as the empty string; a null text has 0 bytes; a
row larger than the limit is a shard of its own; an empty table has no shard.
Repeated rows are rows of one key. Input columns are kept and may have any name
but ``shard``, which the result adds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, native_bytes, stored

BITS, KEY_BITS = 62, 31


def _md5_bits(c: Column) -> Column:
    """The first 31 bits of an MD5 as a number."""
    return F.shiftright(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), 1)


def row_hash(key_col: str) -> Column:
    """62 bits: of the key, then of the row's position in the input."""
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))
    row = F.monotonically_increasing_id().cast("string")
    return F.shiftleft(_md5_bits(F.encode(key, "UTF-8")), KEY_BITS).bitwiseOR(_md5_bits(F.encode(row, "UTF-8")))


def directory(hashed: DataFrame, limit: int, cell_bits: int = 20) -> DataFrame:
    """``depth, prefix, shard, shard_bytes, shard_rows``: one row per bucket.

    Counts first come down to a histogram of ``cell_bits`` bits, which is all that
    is read to find the buckets of every depth that it covers: one that fits is
    kept if the bucket it was split from does not. Buckets still too large at the
    histogram's depth get a new one, of further bits, from their own rows.
    """
    done, open_rows, low = [], hashed, 0
    while not open_rows.isEmpty():
        reach = min(BITS, low + cell_bits)
        cells = open_rows.groupBy(F.shiftright("hash", BITS - reach).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        at = cells.select(F.explode(F.sequence(F.lit(low), F.lit(reach))).alias("depth"), "cell", "bytes", "n")
        buckets = at.groupBy("depth", F.expr(f"shiftright(cell, {reach} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        fits = (F.col("bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == BITS)
        buckets = materialize(buckets.withColumn("fits", fits))
        large = buckets.where("not fits").select("depth", "prefix")
        halves = large.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        kept = buckets.where("fits").drop("fits")
        # the buckets of depth ``low`` are the root, or halves of what the histogram before left too large
        done.append(kept.where(F.col("depth") == low).unionByName(kept.where(F.col("depth") > low).join(halves, ["depth", "prefix"], "left_semi")))
        still = large.where(F.col("depth") == reach).select("prefix")
        if still.isEmpty():
            break
        open_rows = open_rows.withColumn("prefix", F.shiftright("hash", BITS - reach)).join(still, "prefix", "left_semi").drop("prefix")
        low = reach + 1
    if not done:
        return hashed.sparkSession.createDataFrame([], "depth int, prefix long, shard string, shard_bytes long, shard_rows long")
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return reduce(DataFrame.unionByName, done).select(
        "depth", "prefix", F.concat(F.lit("b"), bits).alias("shard"), F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"))


def assign_shards(docs: DataFrame, key_col: str = "doc_id", size: Column | str = "text", limit: int = 128 << 20) -> DataFrame:
    """``docs`` plus ``shard``, ``shard_bytes`` and ``shard_rows``.

    ``size`` is a text column, or any expression for a row's bytes. Rows are
    written once with their hash (its second half depends on the input's
    partitioning, so it must not be computed twice).
    """
    size = native_bytes(F.col(f"`{size}`")) if isinstance(size, str) else size
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                              row_hash(key_col).alias("hash"), size.alias("bytes")), "shard-rows")
    dirs = materialize(directory(rows.select("hash", "bytes"), limit))
    depths = [r[0] for r in dirs.select("depth").distinct().collect()]  # at most 63 values
    if not depths:
        return docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("shard", "string"), ("shard_bytes", "long"), ("shard_rows", "long"))])
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("hash", BITS - d).alias("prefix")) for d in sorted(depths)]))
    probe = rows.select("hash", at.alias("at")).select("hash", "at.depth", "at.prefix").distinct()
    found = probe.join(dirs, ["depth", "prefix"]).select("hash", "shard", "shard_bytes", "shard_rows")
    return rows.join(found, "hash").select("doc.*", "shard", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write each shard as one folder ``shard=...`` of Parquet files."""
    assign_shards(docs, **options).repartition("shard").write.partitionBy("shard").parquet(path)
