"""Invariants: distributed operators against brute force on small inputs,
including a hot group holding a third of the rows."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import logs as LG
from fleetlens.operators import metrics as M
from fleetlens.operators import ordered as O
from fleetlens.operators.features import assign_folds, rank_within, split_train_test
from fleetlens.operators.quantiles import quantiles

from conftest import SMALL


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        g = 0 if i % 3 == 0 else rng.randint(1, 20)     # group 0 holds a third of all rows
        v = rng.choice([1.0, 2.0, 2.0, 3.5]) if g == 0 else rng.gauss(0, 10)
        rows.append((i, g, v if i % 97 else None))
    return spark.createDataFrame(rows, "id long, g int, v double")


def test_exact_quantiles_match_pandas(skewed):
    probs = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]
    # small interval size forces several refinement passes
    got = quantiles(skewed, "v", probs, by=["g"], names=[f"p{i}" for i in range(len(probs))], small=50, bins=8)
    pdf = skewed.toPandas()
    for r in got.collect():
        s = pdf[pdf.g == r.g].v.dropna()
        for i, p in enumerate(probs):
            assert r[f"p{i}"] == pytest.approx(s.quantile(p), rel=1e-12, abs=1e-12)


def test_ungrouped_quantile_and_approx(skewed):
    exact = quantiles(skewed, "v", [0.5], names=["m"], small=10, bins=4).first()["m"]
    assert exact == pytest.approx(skewed.toPandas().v.median())
    approx = quantiles(skewed, "v", [0.5], names=["m"], method="approx").first()["m"]
    assert approx is not None


def test_rank_within_is_exact(skewed):
    ranked = rank_within(skewed.withColumn("o", F.col("id") * 7 % 1000), ["g"], "o", rows_per_bucket=64,
                         tiebreak=["id"], out="r")
    pdf = ranked.toPandas()
    exp = pdf.sort_values(["g", "o", "id"]).groupby("g").cumcount()
    assert (pdf.sort_values(["g", "o", "id"]).r.values == exp.values).all()


def test_split_counts_and_folds(skewed):
    s = split_train_test(skewed, ["id"], "g", 0.2, 42).toPandas()
    for g, part in s.groupby("g"):
        assert (part.split == "test").sum() == math.ceil(0.2 * len(part))
    f = assign_folds(skewed, ["id"], "g", 5, 42).toPandas()
    for g, part in f.groupby("g"):
        counts = part.fold.value_counts()
        assert counts.max() - counts.min() <= 1


def test_rolling_count_matches_brute_force(spark):
    e = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id", "ts")
    got = {r.event_id: r.recent_requests for r in O.rolling_request_count(e, "user_id", "ts", 3600).collect()}
    pdf = e.toPandas()
    for uid, g in pdf.groupby("user_id"):
        t = g.ts.values
        for eid, ti in zip(g.event_id, t):
            exp = int(((t >= ti - np.timedelta64(3600, "s")) & (t <= ti)).sum())
            assert got[eid] == exp


def test_prefix_sum(spark):
    df = spark.createDataFrame([(float(i), i % 5) for i in range(500)], "o double, v int")
    out = M.prefix_sum(df, "o", "v", "cum", rows_per_bucket=37).toPandas().sort_values("o")
    assert (out.cum.values == (out.v.cumsum() - out.v).values).all()


def test_silhouette_sq_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(c, 0.5, size=(40, 3)) for c in (0, 3, 6)])
    lab = np.repeat([0, 1, 2], 40)
    rows = [(i, int(lab[i]), [float(x) for x in pts[i]]) for i in range(len(pts))]
    df = spark.createDataFrame(rows, "id long, c int, vec array<double>")
    got = M.silhouette_sq(M.long_vectors(df, "id", "vec", "c"), "id", "c").first()[0]
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(pts)):
        same = lab == lab[i]
        a = d2[i, same & (np.arange(len(pts)) != i)].mean()
        b = min(d2[i, lab == k].mean() for k in set(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(float(np.mean(s)))


def test_target_down_matches_grid(spark):
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    got = {(r.user_id, r.window_start) for r in LG.target_down(e, "user_id", "ts", 86400).collect()}
    pdf = e.select("user_id", (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)).alias("b")).toPandas()
    lo, hi = pdf.b.min(), pdf.b.max()
    seen = set(zip(pdf.user_id, pdf.b))
    exp = {(u, b) for u in set(pdf.user_id) for b in range(lo, hi + 1) if (u, b) not in seen}
    assert {(u, int(pd.Timestamp(w).timestamp()) // 86400) for u, w in got} == exp


def test_majority_vote_ties_smallest(spark):
    df = spark.createDataFrame([("b", "a", "c"), ("b", "b", "a"), ("c", "a", "a")], "x string, y string, z string")
    assert [r.vote for r in df.select(O.majority_vote(["x", "y", "z"])).collect()] == ["a", "b", "a"]


def test_elbow_and_pick_best(spark):
    inertia = [(2, 100.0), (3, 60.0), (4, 45.0), (5, 40.0), (6, 37.0)]
    df = spark.createDataFrame(inertia, "k int, inertia double")
    assert O.elbow_point(df, "k", "inertia").first()["optimal_k"] == 3
    runs = spark.createDataFrame([(1, 0.9, "a"), (2, 0.95, "b"), (3, 0.95, "c")], "o int, score double, name string")
    assert O.pick_best(runs, "score", "o").first()["name"] == "b"


def test_row_local_split_share(skewed):
    s = split_train_test(skewed, ["id"], None, 0.2, 42, exact=False).toPandas()
    share = (s.split == "test").mean()
    assert 0.17 < share < 0.23
    again = split_train_test(skewed, ["id"], None, 0.2, 42, exact=False).toPandas()
    assert (s.sort_values("id").split.values == again.sort_values("id").split.values).all()


def test_rolling_count_hot_client(spark):
    """One client sends a third of all requests; counts stay exact."""
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 0 if i % 3 == 0 else i % 50, base + dt.timedelta(seconds=7 * i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    got = {r.event_id: r.recent_requests for r in O.rolling_request_count(df, "user_id", "ts", 600).collect()}
    pdf = df.toPandas()
    for uid, g in pdf.groupby("user_id"):
        t = g.ts.values
        for eid, ti in zip(g.event_id, t):
            assert got[eid] == int(((t >= ti - np.timedelta64(600, "s")) & (t <= ti)).sum())


def test_fast_paths_agree(spark):
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.normal(c, 0.3, size=(50, 2)) for c in (0, 4)])
    rows = [(i, int(i >= 50), [float(x) for x in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, c int, vec array<double>")
    exact = M.silhouette_sq(M.long_vectors(df, "id", "vec", "c"), "id", "c").first()[0]
    flat = df.select("id", "c", df.vec[0].alias("a"), df.vec[1].alias("b"))
    v = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(flat)
    assert M.silhouette_evaluator(v, "f", "c") == pytest.approx(exact, rel=1e-6)
    scores = spark.createDataFrame([(int(i % 2), float(i % 2) + 0.1 * (i % 7)) for i in range(200)], "y int, s double")
    a = M.roc_auc(scores, "y", "s").first()[0]
    b = M.roc_auc(scores, "y", "s", method="evaluator").first()[0]
    assert a == pytest.approx(b, abs=1e-6)
