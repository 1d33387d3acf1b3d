"""Global order under skew and ties, runs across partitions, shared quantile gathers, cluster metrics in two scans, panes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.learn import cluster as CL
from fleetlens.operators import logs as LG
from fleetlens.operators import metrics as M
from fleetlens.operators import ordering as OR
from fleetlens.operators.features import fit_label_encoder, rank_within
from fleetlens.operators.quantiles import quantiles


def skewed(spark, n=20_000):
    """90 % of the values in a thousandth of the range, a third of the rows in one value, some nulls."""
    r = random.Random(1)
    rows = []
    for i in range(n):
        u = r.random()
        v = None if u < 0.02 else 0.5 if u < 0.35 else r.random() / 1000 if u < 0.9 else r.random()
        rows.append((i, "a" if r.random() < 0.9 else r.choice("bc"), v))
    return spark.createDataFrame(rows, "id long, g string, v double"), rows


def test_partitions_are_even_under_skew_and_ties(spark):
    df, rows = skewed(spark)
    sizes = [r["count"] for r in OR.sorted_parts(df, ["v"], rows_per_part=1000).groupBy("_part").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 2 * len(rows) / 20


def test_positions_and_ranks(spark):
    df, rows = skewed(spark, 5000)
    got = {r.id: r.p for r in OR.positions(df, ["v", "id"], "p", 200).collect()}
    want = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert [got[r[0]] for r in want] == list(range(len(rows)))
    ranked = rank_within(df, ["g"], "v", rows_per_bucket=200, tiebreak=["id"], keep_size="n").collect()
    for g in "abc":
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert {r.id: (r._rank, r.n) for r in ranked if r.g == g} == {r[0]: (i, len(mine)) for i, r in enumerate(mine)}


def test_prefix_sums(spark):
    df = spark.createDataFrame([(i * i, i % 7 if i % 5 else None) for i in range(500)], "o long, v long")
    got = {r.o: (r.x, r.y) for r in OR.prefix_sums(OR.prefix_sums(df, ["o"], "v", "x", False, 40), ["o"], "v", "y", True, 40).collect()}
    run = 0
    for i in range(500):
        v = i % 7 if i % 5 else 0
        assert got[i * i] == (run, run + v)
        run += v
    assert OR.prefix_sums(df.limit(0), ["o"], "v", "x").count() == 0


def test_runs_go_on_across_partitions(spark):
    r = random.Random(2)
    rows = [(k, t * 60) for k in ("hot", "b", None) for t in range(3000 if k == "hot" else 50) if r.random() < 0.9]
    df = spark.createDataFrame(rows, "alert string, t long").repartition(7)
    out = OR.runs(df, "alert", "t", 60, "run", 100)
    assert out.select("run").distinct().count() > 50
    got = {}
    for x in out.collect():
        got.setdefault(x.run, []).append((x.alert, x.t))
    want, last = [], None
    for k, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1])):
        if last == (k, t - 60):
            want[-1].append((k, t))
        else:
            want.append([(k, t)])
        last = (k, t)
    assert sorted(map(sorted, got.values()), key=str) == sorted(map(sorted, want), key=str)
    fired = LG.alert_sustained(spark.createDataFrame([], "alert string, window_start timestamp, condition boolean"), 60, hold_seconds=300)
    assert fired.count() == 0


def test_codes_have_no_single_task_window(spark, capsys):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("string").alias("v")).unionByName(spark.range(1).select(F.lit(None).cast("string").alias("v")))
    labels = fit_label_encoder(df, "v").labels
    labels.explain()
    assert "Window" not in capsys.readouterr().out
    want = {v: i for i, v in enumerate(sorted([str(i) for i in range(50_000)] + ["nan"]))}
    assert {r["value"]: r["index"] for r in labels.collect()} == want


def test_quantiles_gather_an_interval_once(spark):
    df, rows = skewed(spark, 4000)
    probs = [0.0, 0.25, 0.3, 0.5, 0.75, 0.95, 1.0]
    for small in (10, 300, 10 ** 6):
        got = {r.g: list(r)[1:] for r in quantiles(df, "v", probs, by=["g"], names=[f"p{i}" for i in range(7)], small=small, bins=8).collect()}
        for g in "abc":
            v = [r[2] for r in rows if r[1] == g and r[2] is not None]
            assert np.allclose(got[g], np.quantile(v, probs), rtol=0, atol=1e-12)


def test_cluster_metrics_match_the_long_forms(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(3 * (i % 4), 1), r.gauss(0, 2), r.random()], i % 4) for i in range(400)]
    extra = [(1000, [1.0, None, 2.0], 1), (1001, [1.0, 1.0, 1.0], None), (1002, [9.0, 9.0, 9.0], -1), (1003, None, 2)]
    df = spark.createDataFrame(rows, "id int, vec array<double>, c int")
    more = spark.createDataFrame(rows + extra, "id int, vec array<double>, c int")
    long = M.long_vectors(df, "id", "vec", "c")
    got = M.clustering_metrics(more, "vec", "c").first()
    assert got["n_clusters"] == 4
    for name, want in (("within_cost", M.within_cluster_cost(long, "c")), ("silhouette_sq", M.silhouette_sq(long, "id", "c")),
                       ("calinski_harabasz", M.calinski_harabasz(long, "id", "c")), ("davies_bouldin", M.davies_bouldin(long, "id", "c"))):
        assert abs(got[name] - want.first()[0]) < 1e-9 * max(1, abs(got[name])), name
    one = M.clustering_metrics(df.withColumn("c", F.lit(5)), "vec", "c").first()
    assert one["n_clusters"] == 1 and one["silhouette_sq"] is None and one["within_cost"] > 0
    assert M.clustering_metrics(df.limit(0), "vec", "c").first()["n_clusters"] == 0


def test_clusters_of_rows_with_nulls(spark):
    r = random.Random(4)
    rows = [(i, None if i % 9 == 0 else r.gauss(10 * (i % 2), 1), r.random()) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    out = CL.cluster_train(df, "id", ["a", "b"], k=2, n_init=1)
    pca = out["pca"].collect()
    assert len(pca) == 90 and all((x.cluster is None) == (x.a is None) == (x.pc1 is None) for x in pca)
    assert out["metrics"]["n_clusters"] == 2 and out["metrics"]["davies_bouldin"] > 0
    curve = {x.k: x for x in CL.choose_k(df, "id", ["a", "b"], max_k=3, n_init=1).collect()}
    assert curve[1].silhouette is None and curve[1].inertia > curve[2].inertia > curve[3].inertia
    assert [k for k, x in curve.items() if x.picked] == [max((2, 3), key=lambda k: curve[k].silhouette)]


def test_sliding_rate_copies_panes_not_rows(spark, capsys):
    df = spark.range(20_000).select(F.timestamp_seconds(F.col("id") * 37 % 4000).alias("ts"))
    out = LG.sliding_rate(df, "ts", "5 minutes", "15 seconds", 300)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate", plan.index("Generate"))  # rows are aggregated below the copies
    want = df.groupBy(F.window("ts", "5 minutes", "15 seconds").alias("w")).count().select(F.col("w.start").alias("window_start"), F.col("count").alias("requests"))
    assert sorted(map(tuple, out.select("window_start", "requests").collect())) == sorted(map(tuple, want.collect()))


def test_rows_meet_quantile_intervals_without_a_shuffle_of_the_rows(spark, monkeypatch):
    """A shuffle of the rows by their group would sort a hot group in one task."""
    from fleetlens.operators import quantiles as Q

    plans = []
    held = Q.materialize

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return held(df)

    monkeypatch.setattr(Q, "materialize", seen)
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.pmod(F.col("id") * 7919, F.lit(5000)).cast("double").alias("v"))
    got = {r.g: (r.q50, r.q90) for r in Q.quantiles(df, "v", [0.5, 0.9], by=["g"], small=100, bins=16).collect()}
    for g in (0, 1):
        v = sorted(float(i * 7919 % 5000) for i in range(5000) if i % 2 == g)
        h = 2499 * 0.9
        assert got[g] == (pytest.approx((v[1249] + v[1250]) / 2), pytest.approx(v[int(h)] + (h - int(h)) * (v[int(h) + 1] - v[int(h)])))
    # the data's rows (the kept relation) are joined in every refining pass and in the gather
    rows = [p for p in plans if "InMemoryRelation" in p and "Join Inner" in p]
    assert len(rows) >= 2 and all("rightHint=(strategy=broadcast)" in p for p in rows)
