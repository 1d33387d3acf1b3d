from collections import defaultdict

from pyspark.sql import functions as F

from fleetlens.llm import sharding


def check(rows, limit):
    """Shards partition the hash space, hold what they say and fit unless they hold one row."""
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for shard, members in by.items():
        total = sum(len((r.text or "").encode()) for r in members)
        assert total == members[0].shard_bytes and len(members) == members[0].shard_rows
        assert total <= limit or len(members) == 1
    names = [s[1:] for s in by]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    return by


def test_only_oversized_buckets_split(spark, docs):
    rows = [(i, "x" * (i % 50)) for i in range(800)]
    out = sharding.assign_shards(docs(rows), limit=1000).collect()
    by = check(out, 1000)
    assert len(out) == 800 and len(by) > 10
    # every bucket that was split was too large
    size, n = defaultdict(int), defaultdict(int)
    for r in out:
        for k in range(len(r.shard)):
            size[r.shard[1:k + 1]] += len(r.text)
            n[r.shard[1:k + 1]] += 1
    for s in by:
        for k in range(len(s) - 1):
            assert size[s[1:k + 1]] > 1000 and n[s[1:k + 1]] > 1


def test_what_fits_is_one_shard(spark, docs):
    out = sharding.assign_shards(docs([(i, "x" * 10) for i in range(50)]), limit=500).collect()
    assert {(r.shard, r.shard_bytes, r.shard_rows) for r in out} == {("b", 500, 50)}


def test_one_large_row_makes_no_small_shards_of_the_others(spark, docs):
    rows = [(i, "x" * 10) for i in range(1000)] + [(5000, "y" * 500_000)]
    out = sharding.assign_shards(docs(rows), limit=10_000).collect()
    by = check(out, 10_000)
    # only the buckets on the large row's own path are split
    assert len(by) == max(len(s) for s in by)
    assert sum(len(m) for m in by.values()) == 1001


def test_directory_goes_on_in_further_histograms(spark, docs):
    rows = docs([(i % 7, "z" * 10) for i in range(600)]).select("doc_id", "text")
    hashed = sharding.materialize(rows.select(sharding.row_hash("doc_id").alias("hash"), F.lit(10).alias("bytes")))
    a, b = ({tuple(r) for r in sharding.directory(hashed, 200, bits).collect()} for bits in (3, 20))
    assert a == b and sum(r[4] for r in a) == 600


def test_one_key_with_many_rows_is_split(spark, docs):
    rows = [(1, "y" * 100)] * 300 + [(i, "z" * 10) for i in range(2, 50)]
    by = check(sharding.assign_shards(docs(rows), limit=2000).collect(), 2000)
    assert max(len(s) for s in by) > sharding.KEY_BITS


def test_large_rows_nulls_and_empty(spark, awkward):
    out = sharding.assign_shards(awkward, limit=60).collect()
    assert len(out) == awkward.count()
    check(out, 60)
    none = sharding.assign_shards(awkward.limit(0), limit=60)
    assert none.count() == 0 and none.columns[-3:] == ["shard", "shard_bytes", "shard_rows"]


def test_write_shards(spark, docs, tmp_path):
    rows = [(i, "t" * 20) for i in range(100)]
    sharding.write_shards(docs(rows), str(tmp_path / "out"), limit=300)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100
    assert back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).where("n > 300").count() == 0
