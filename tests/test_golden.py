"""Hand-worked golden values (FIXTURES.md part 3) on the reference's small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.operators import clean as C
from fleetlens.operators import metrics as M
from fleetlens.operators.quantiles import quantile_values


@pytest.fixture(scope="module")
def cls(spark):
    y = [0, 0, 1, 1, 0, 1]
    p = [0, 1, 1, 1, 0, 0]
    s = [.2, .7, .8, .9, .1, .4]
    return spark.createDataFrame(list(zip(y, p, s)), "y int, p int, s double")


def test_classification_metrics(cls):
    assert M.accuracy(cls, "y", "p").first()[0] == pytest.approx(2 / 3)
    prf = M.precision_recall_f1(cls, "y", "p").first().asDict()
    for v in prf.values():
        assert v == pytest.approx(2 / 3)


def test_confusion_matrix(cls):
    cm = {(r.actual, r.predicted): r["count"] for r in M.confusion_matrix(cls, "y", "p").collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 2}


def test_roc_auc(cls):
    assert M.roc_auc(cls, "y", "s", positive=1).first()[0] == pytest.approx(8 / 9)


def test_roc_auc_ties_count_half(spark):
    df = spark.createDataFrame([(1, .5), (0, .5), (1, .9), (0, .1)], "y int, s double")
    # pairs: (.5 vs .5) tie -> 0.5, (.5 vs .1) 1, (.9 vs .5) 1, (.9 vs .1) 1 -> 3.5 / 4
    assert M.roc_auc(df, "y", "s").first()[0] == pytest.approx(3.5 / 4)


def test_regression_metrics_train(spark):
    df = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.0], [1.1, 1.9, 3.1, 3.9, 5.1])), "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert r["mse"] == pytest.approx(0.01)
    assert r["mae"] == pytest.approx(0.1)
    assert r["r2"] == pytest.approx(0.995)


def test_regression_metrics_test(spark):
    df = spark.createDataFrame(list(zip([6.0, 7.0, 8.0], [5.9, 7.1, 7.8])), "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert r["mse"] == pytest.approx(0.02)
    assert r["rmse"] == pytest.approx(math.sqrt(0.02))
    assert r["mae"] == pytest.approx(0.133333, abs=1e-6)
    assert r["r2"] == pytest.approx(0.97)
    assert r["max_error"] == pytest.approx(0.2)
    assert r["explained_variance"] == pytest.approx(0.976667, abs=1e-6)
    assert M.mape(df, "y", "p").first()[0] == pytest.approx(1.865079, abs=1e-6)


def test_mape_undefined_with_zero_truth(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, p double")
    assert M.mape(df, "y", "p").first()[0] is None


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(1.0, "a", None), (2.0, "b", "y"), (None, "c", "z"), (4.0, None, "x")],
                                 "A double, B string, C string")


def test_null_handling(nulls):
    filled = C.impute_constant(nulls, {"A": 1.0})
    assert [r.A for r in filled.collect()] == [1.0, 2.0, 1.0, 4.0]
    assert quantile_values(nulls, "A", [0.5])[0] == pytest.approx(2.0)
    modes = C.column_modes(nulls, ["B", "C"])
    assert modes == {"B": "a", "C": "x"}


def test_impute_chain(nulls):
    out = C.impute_mode(C.impute_median(nulls)).collect()
    assert [r.A for r in out] == [1.0, 2.0, 2.0, 4.0]
    assert [r.B for r in out] == ["a", "b", "c", "a"]
    assert [r.C for r in out] == ["x", "y", "z", "x"]


def test_range_bins(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (50.1,), (500.0,), (501.0,), (-1.0,)], "v double")
    got = [r[0] for r in df.select(S.bin_range("v")).collect()]
    assert got == ["Low", "Low", "Medium", "Ultra", None, None]


def test_price_bins_exclude_zero(spark):
    df = spark.createDataFrame([(0.0,), (30000.0,), (30000.5,), (75000.0,), (1e9,)], "v double")
    got = [r[0] for r in df.select(S.bin_price("v")).collect()]
    assert got == [None, "budget", "mid", "premium", "luxury"]


def test_residual_analysis_matches_pandas(spark):
    import pandas as pd
    vals = [0.5, -1.2, 3.3, 0.1, -0.4, 2.2, -2.5, 0.0, 1.1]
    df = spark.createDataFrame([(v,) for v in vals], "r double")
    r = M.residual_analysis(df, "r").first()
    s = pd.Series(vals)
    assert r["skewness"] == pytest.approx(s.skew())
    assert r["kurtosis"] == pytest.approx(s.kurt())
    assert r["median"] == pytest.approx(s.median())
    assert r["q1"] == pytest.approx(s.quantile(0.25))
    assert r["std"] == pytest.approx(s.std())


def test_sanitize_and_format(spark):
    df = spark.createDataFrame([("  <b>hi</b>; x(1)\n",)], "s string")
    assert df.select(S.sanitize_text("s")).first()[0] == "bhib x1"
    df2 = spark.createDataFrame([(0.5,)], "v double")
    assert df2.select(S.format_percentage("v", 2)).first()[0] == "50.00%"
    df3 = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df3.select(S.safe_divide("a", "b")).collect()] == [0.0, 0.5]
