import random

from pyspark.sql import functions as F

from fleetlens.llm import lines


def brute(rows, min_docs, min_chars=1):
    low = str.maketrans(lines.UPPER, lines.LOWER)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    count = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < min_chars or count[key(x)] < min_docs]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df, **options):
    out = lines.drop_frequent_lines(df, **options)
    return sorted(((r.doc_id, r._line_n, r._line_dropped, r._line_kept or "") for r in out.collect()), key=str)


def test_matches_brute_force(spark, docs):
    rng = random.Random(3)
    pool = ["Alpha", " alpha\t", "béta", "BÉTA", "", "  ", "gamma \x0b", "delta", "É", "é"]
    rows = [(i if i % 7 else None, None if i % 11 == 0 else "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += rows[:5]
    for min_docs, n_batches, fanout in ((10, 4, 2), (3, 5, 3), (2, 1, 2)):
        assert got(docs(rows), min_docs=min_docs, n_batches=n_batches, fanout=fanout) == brute(rows, min_docs)


def test_long_text_many_repeats_and_empty(spark, docs):
    rows = [(1, "\n".join(f"l{i}" for i in range(5000))), (2, "l7\nx\nl7\nl4999"), (3, "a\n" * 300)]
    assert got(docs(rows), min_docs=2) == brute(rows, 2)
    assert got(docs(rows).limit(0), min_docs=2) == []
    assert lines.dedup_lines(docs(rows).limit(0)).columns == docs(rows).columns


def test_dedup_keeps_columns_and_counts(awkward):
    out = lines.dedup_lines(awkward, min_docs=2)
    assert out.schema.names == awkward.schema.names and out.count() == awkward.count()
    by = {(r.doc_id, r.n_chars): r for r in out.where("doc_id in (5, 6, 7, 2)").collect()}
    assert by[(6, 0)].text == "" and by[(7, 22)].text == "Line A\nline b\n\nLINE A " and by[(2, 0)].text == ""


def test_runs_compact_and_keep_counts(spark):
    runs = lines.LineRuns(spark, min_docs=3, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(r, h, h) for r in (10 * b, 10 * b + 1) for h in (1, 100 + b)], "row long, h1 long, h2 long"))
    assert len([p for level in runs.levels.values() for p in level]) <= 3 and max(runs.levels) >= 2
    assert {r.h1 for r in runs.frequent().collect()} == {1}
    # a key that is frequent already is left out of later runs
    assert runs.totals().where(F.col("h1") == 1).first().n < 10
    with lines.ordered_runs(spark):
        one = spark.table(next(iter(runs.levels[max(runs.levels)])))
        for part in one.select(F.spark_partition_id().alias("p"), "h1").groupBy("p").agg(F.collect_list("h1").alias("h")).collect():
            assert part.h == sorted(part.h)
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs._name)]


def test_runs_are_merged_without_shuffle_or_sort(spark):
    runs = lines.LineRuns(spark, min_docs=3, fanout=4, n_buckets=5)
    batch = spark.createDataFrame([(r, h, h % 3) for r in range(4) for h in range(40)], "row long, h1 long, h2 long")
    for _ in range(3):
        runs.add(batch)
    assert [len(v) for v in runs.levels.values()] == [3]
    with lines.ordered_runs(spark):
        plan = runs.fresh(batch)._jdf.queryExecution().executedPlan().toString()
    # only the batch moves (its distinct rows, its counts, its buckets) and is sorted, once; no run is
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 3 and plan.count("Sort [") == 1
    assert runs.totals().count() == 40 and {r.n for r in runs.totals().collect()} == {4}
    runs.drop()


def test_totals_over_many_keys_and_runs(spark):
    runs = lines.LineRuns(spark, min_docs=2, fanout=5, n_buckets=4)
    for low, high in ((0, 1000), (990, 1010), (995, 1200)):
        ids = spark.range(low, high)
        runs.add(ids.select(F.lit(low).alias("row"), F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2")))
    # keys 995 to 999 are frequent before the third batch, so it leaves them out
    n = {r.id: r.n for r in runs.totals().join(spark.range(1200).withColumn("h1", F.xxhash64("id")), "h1").collect()}
    assert n == {i: 1 + (990 <= i < 1000) + (1000 <= i < 1010) for i in range(1200)}
    runs.drop()


def test_rows_of_one_id_are_documents(docs):
    rows = [(1, "same\nown %d" % i) for i in range(10)]
    assert got(docs(rows)) == brute(rows, 10) and got(docs(rows))[0][2] == 1
