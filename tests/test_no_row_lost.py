"""Rows with nulls stay; degenerate input gives nulls, not errors."""

import pytest
from pyspark.sql import functions as F

from fleetlens.learn import cluster as CL
from fleetlens.learn import models as MD
from fleetlens.learn import workflow as WF
from fleetlens.learn.density import grid_density_clusters
from fleetlens.operators import features as FE
from fleetlens.operators import logs as L
from fleetlens.operators import metrics as M
from fleetlens.operators import ordered as O


@pytest.fixture(scope="module")
def holes(spark):
    """200 rows; every tenth has a null feature, every seventh a null label."""
    rows = [(i, None if i % 10 == 0 else float(i % 17), float(i % 5), None if i % 7 == 0 else ("a" if i % 17 < 8 else "b")) for i in range(200)]
    return spark.createDataFrame(rows, "id long, x double, z double, label string")


def test_scoring_returns_every_row(holes):
    fm = MD.fit_classifier(holes, ["x", "z"], "label", "logistic_regression")
    out = WF.score_batch(fm, holes).collect()
    assert len(out) == 200
    assert all((r.predicted_label is None) == (r.id % 10 == 0) for r in out)
    assert fm.dropped == sum(i % 10 == 0 or i % 7 == 0 for i in range(200))
    reg = MD.fit_regressor(holes.withColumn("y", F.col("x") * 2 + F.col("z")), ["x", "z"], "y", "linear_regression")
    got = WF.score_batch(reg, holes).collect()
    assert len(got) == 200
    assert all(r.prediction is None if r.x is None else abs(r.prediction - 2 * r.x - r.z) < 1e-6 for r in got)
    km = CL.fit_kmeans(holes, ["x", "z"], 2, n_init=1)
    assert km.assign(holes).count() == 200 and km.assign(holes).where("cluster is null").count() == 20


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest", "neural_network"])
def test_probabilities_have_one_entry_per_class(holes, kind):
    fm = MD.fit_classifier(holes, ["x", "z"], "label", kind, {"n_estimators": 3, "max_iter": 20})
    assert fm.labels == ["a", "b"]
    r = fm.transform(holes).where("probabilities is not null").agg(
        F.min(F.size("probabilities")).alias("lo"), F.max(F.size("probabilities")).alias("hi"),
        F.max(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x) - 1)).alias("off")).first()
    assert r.lo == r.hi == 2 and r.off < 1e-9


def test_logistic_solves_the_unstandardised_problem(spark):
    """One feature without intercept shift: the gradient of log loss + w^2 / (2 C n) vanishes."""
    rows = [(float(x), "p" if (x + (x % 3)) > 12 else "n") for x in range(25)]
    df = spark.createDataFrame(rows, "x double, y string")
    fm = MD.fit_classifier(df, ["x"], "y", "logistic_regression", {"C": 0.5})
    m = fm.model.stages[1]
    import math
    w, b, n = m.coefficients[0], m.intercept, len(rows)
    g = sum((1 / (1 + math.exp(-(w * x + b))) - (y == fm.labels[1])) * x for x, y in rows) / n + w / (0.5 * n)
    assert abs(g) < 1e-3


def test_saved_model_loads_by_itself(holes, tmp_path):
    fm = MD.fit_regressor(holes.withColumn("y", F.col("x")), ["x", "z"], "y", "svr", {"n_components": 8})
    WF.save_model(fm, str(tmp_path / "m"))
    back = WF.load_model(str(tmp_path / "m"))
    assert (back.kind, back.features, back.dropped) == (fm.kind, fm.features, fm.dropped)
    a, b = ([r.prediction for r in m.transform(holes).orderBy("id").collect()] for m in (fm, back))
    assert a == b


def test_splits_folds_and_quotas_keep_null_groups(spark, holes):
    split = FE.split_train_test(holes, ["id"], "label", 0.2)
    assert split.count() == 200 and split.where("label is null and split = 'test'").count() == 6  # ceil(0.2 * 29)
    folds = FE.assign_folds(holes, ["id"], "label", 5)
    assert folds.count() == 200 and folds.where("fold is null").count() == 0
    df = spark.createDataFrame([("u", "a", "2024-01-01 00:00:00", 1), (None, "a", "2024-01-01 00:00:01", 2), ("u", "a", None, 3)],
                               "user string, action string, ts string, id int").withColumn("ts", F.to_timestamp("ts"))
    limits = spark.createDataFrame([("a", 5)], "action string, daily_limit int")
    out = {r.id: r.used_today for r in O.daily_quota_usage(df, "user", "action", "ts", "id", limits).collect()}
    assert out == {1: 1, 2: 1, 3: 1}


def test_ranks_with_null_order_and_small_buckets(spark):
    rows = [(g, None if i % 9 == 0 else i * 37 % 101, i) for g in ("a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, o int, id int")
    got = FE.rank_within(df, ["g"], "o", rows_per_bucket=7, tiebreak=["id"]).collect()
    for g in ("a", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r._rank)] == [r[2] for r in want]


def test_density_of_a_long_chain_is_one_cluster(spark):
    df = spark.range(1100).select("id", (F.col("id") * 0.19 + 0.01).alias("x"))
    out = grid_density_clusters(df, "id", ["x"], eps=0.4, min_samples=2)
    assert out.count() == 1100 and [r.cluster for r in out.select("cluster").distinct().collect()] == [0]


def test_metrics_without_divisors(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert M.roc_auc(one, "y", "s").first()[0] is None
    const = spark.createDataFrame([(2.0, 1.0), (2.0, 2.0)], "y double, p double")
    r = M.regression_metrics(const, "y", "p").first()
    assert r.r2 is None and r.explained_variance is None and r.mse == 0.5
    three = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "r double")
    assert M.residual_analysis(three, "r").first().kurtosis is None
    assert M.noise_stats(spark.createDataFrame([], "c int"), "c").first().noise_percent is None
    same = spark.createDataFrame([(i, i % 2, 0, 1.0) for i in range(4)], "id int, c int, dim int, x double")
    assert M.silhouette_sq(same, "id", "c").first()[0] == 0.0
    assert M.calinski_harabasz(same.withColumn("c", F.lit(0)), "id", "c").first()[0] is None


def test_metrics_leave_nulls_out(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None), (0, None), (None, 0.5)], "y int, s double")
    assert M.roc_auc(df, "y", "s").first()[0] == 1.0
    r = M.regression_metrics(spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (50.0, None)], "y double, p double"), "y", "p").first()
    assert (r.n, r.mse, r.r2) == (2, 2.0, 1 - 2.0 / 0.25)
    rep = M.classification_report(spark.createDataFrame([("a", "a"), ("b", None), (None, "a")], "y string, p string"), "y", "p").collect()
    assert [x.label for x in rep] == ["a"]


def test_ordered_operators_with_nulls_and_maps(spark):
    df = spark.createDataFrame([("m", 1, None, {"a": 1}), ("m", 2, 0.5, {"b": 2}), ("m", 3, 0.5, {"c": 3})], "name string, v int, score double, tags map<string,int>")
    assert O.pick_best(df, "score", "v", "name").first().v == 2
    assert O.latest_version(df, "name", "v").first().tags == {"c": 3}
    t = spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", None), ("k", "2024-01-01 00:00:10")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(((r.recent is None, r.recent or 0) for r in O.rolling_count(t, "k", "ts", 60).collect())) == [(False, 1), (False, 2), (True, 0)]
    lat = spark.createDataFrame([("2024-01-01 00:00:00", 0.01), ("2024-01-01 00:00:01", None)], "ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert L.bucket_quantile(lat, "ts", "v").first().latency_q < 1


def test_search_is_asked_for():
    grid = {k: [1, 2] for k in "abcde"}
    assert len(WF.param_grid(grid)) == 32
    draws = WF.param_grid(grid, "random", 20)
    assert len(draws) == 20 and draws == WF.param_grid(grid, "random", 20)
    with pytest.raises(ValueError):
        WF.param_grid(grid, "other")
