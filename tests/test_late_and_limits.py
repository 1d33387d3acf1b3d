"""Late rows, fixed windows and tuning against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.learn import models as MD
from fleetlens.learn import workflow as WF
from fleetlens.operators.features import assign_folds, fit_scaler
from fleetlens.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1, 12)


def rows_at(*minutes, first=1):
    return [(first + i, None if m is None else T0 + dt.timedelta(minutes=m), 7, "view", 1.0, "{}") for i, m in enumerate(minutes)]


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, ST.EVENTS_SCHEMA).write.mode("append").parquet(str(folder))


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    late = None
    # minutes; the watermark is the latest time of earlier deliveries less 10 minutes
    for k, part in enumerate([(0, 60, None), (49, 50, 55, 120), (109.9, 110, 0, None)]):
        deliver(spark, tmp_path / "in", rows_at(*part, first=10 * k))
        sdf = ST.stream_folder(spark, str(tmp_path / "in"), ST.EVENTS_SCHEMA, 100)
        late = ST.LateRows(spark, str(tmp_path / "out"), sdf.schema)
        late.run(sdf)
    assert {r.event_id: r.late_by for r in late.late().collect()} == {10: 60.0, 20: pytest.approx(6.0), 22: 6600.0}
    assert {r.event_id for r in late.on_time().collect()} == {0, 1, 2, 11, 12, 13, 21, 23}


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    deliver(spark, tmp_path / "in", rows_at(0, 60))
    sdf = ST.stream_folder(spark, str(tmp_path / "in"), ST.EVENTS_SCHEMA, 100)
    late = ST.LateRows(spark, str(tmp_path / "out"), sdf.schema)
    late.run(sdf)
    batch = spark.createDataFrame(rows_at(10, 200), ST.EVENTS_SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):  # as after a failure between the sink and the commit
        late._sink(batch, 1)
    assert late.late().count() == 1 and late.on_time().count() == 3


def test_late_rows_of_no_input(spark, tmp_path):
    late = ST.LateRows(spark, str(tmp_path / "out"), ST.EVENTS_SCHEMA)
    assert late.late().count() == 0 and late.on_time().count() == 0


def fixed_loop(times, window, limit):
    start, count, out = None, 0, []
    for t in times:
        if start is None or t >= start + window:
            start, count = t, 0
        count += 1
        out.append(count <= limit)
    return out


def test_fixed_windows_equal_a_loop():
    rng = np.random.default_rng(3)
    for _ in range(50):
        times = np.sort(rng.integers(0, 200, rng.integers(0, 60)))
        cut = int(rng.integers(0, len(times) + 1))
        a, start, count = ST.fixed_windows(times[:cut], None, 0, 17, 3)
        b, _, _ = ST.fixed_windows(times[cut:], start, count, 17, 3)
        assert [*a, *b] == fixed_loop(times.tolist(), 17, 3)


def test_fixed_limiter_over_deliveries_and_null_times(spark, tmp_path):
    out = None
    for first, part in ((1, (0, 1, 2)), (4, (59.9, 60, 61, 62, None))):  # the window's state goes from one run to the next
        deliver(spark, tmp_path / "in", rows_at(*part, first=first))
        sdf = ST.stream_folder(spark, str(tmp_path / "in"), ST.EVENTS_SCHEMA, 100)
        out = ST.run_to_table(ST.rate_limit_fixed(sdf, "user_id", 3600, 2), "fixed", "append", str(tmp_path / "out"))
    got = {r.event_id: r.accepted for r in out.collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: False, 8: None}


def test_tuning_scales_inside_folds_and_assigns_folds_once(spark, monkeypatch):
    df = spark.range(240).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5 * 1000).cast("double").alias("b"),
                                 F.when((F.col("id") % 17) + (F.col("id") % 5) > 10, "y").otherwise("n").alias("label"))
    calls = []
    monkeypatch.setattr(WF, "assign_folds", lambda *a, **k: calls.append(1) or assign_folds(*a, **k))
    grid = {"C": [0.01, 10.0]}
    got = WF.tune(df, ["id"], ["a", "b"], "label", "logistic_regression", grid, True, folds=3, search="auto")
    assert len(calls) == 1
    folded = assign_folds(df, ["id"], "label", 3, 42)
    for r in got:
        for i in range(3):
            train, test = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
            scaler = fit_scaler(train, ["a", "b"])
            fm = MD.fit_classifier(scaler.transform(train), ["a", "b"], "label", "logistic_regression", r["params"])
            assert WF.evaluate(fm, scaler.transform(test))["accuracy"] == pytest.approx(r["scores"][i])
    assert got[0]["mean"] >= got[1]["mean"]


def test_auto_search_draws_at_random_from_many_parameters(monkeypatch):
    seen = {}
    monkeypatch.setattr(WF, "_fold_scores", lambda *a: seen.update(c=a[8]) or ("accuracy", [[1.0]] * len(a[8])))
    grid = {k: [1, 2, 3] for k in "wxyz"}
    WF.tune(None, [], [], "l", "decision_tree", grid, search="auto")
    assert len(seen["c"]) == 20
    WF.tune(None, [], [], "l", "decision_tree", {"x": [1, 2]}, search="auto")
    assert len(seen["c"]) == 2


def test_numeric_classes_are_in_order_of_value(spark):
    df = spark.range(60).select((F.col("id") % 3).cast("double").alias("x"), F.array(F.lit(2), F.lit(10), F.lit(1))[(F.col("id") % 3).cast("int")].alias("y"))
    fm = MD.fit_classifier(df, ["x"], "y", "decision_tree")
    assert fm.labels == ["1", "2", "10"]
    assert all(str(r.y) == r.predicted_label for r in fm.transform(df).collect())


def test_a_continuous_label_is_refused(spark, monkeypatch):
    monkeypatch.setattr(MD, "MAX_CLASSES", 5)
    df = spark.range(40).select(F.col("id").cast("double").alias("x"), (F.col("id") / 7).alias("y"))
    with pytest.raises(ValueError):
        MD.fit_classifier(df, ["x"], "y", "decision_tree")
    nulls = df.select("x", F.when(F.col("x") < 30, F.col("x") % 3).alias("y"))
    assert MD.fit_classifier(nulls, ["x"], "y", "decision_tree").dropped == 10
