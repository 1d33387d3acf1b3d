"""Column-list invariants (no job runs): required columns, numeric feature
defaults, fan-out copies, registry schemas, parameterised SQL."""

from pyspark.sql import functions as F

from fleetlens.operators import predicates as PR
from fleetlens.operators.setops import append_categories
from fleetlens.sources.registry import SCHEMAS, empty_registry, run_sql


def test_require_and_missing_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "`Model Year` int, Make string, `Electric Range` double")
    ok, miss = PR.require_columns(df, ["Model Year", "Make"])
    assert ok and miss == []
    ok, miss = PR.require_columns(df, PR.REQUIRED_PROCESSED_COLUMNS)
    assert not ok and miss == ["Model", "Electric Vehicle Type"]


def test_select_numeric_features(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 3)], "a int, b string, c double, y long")
    assert PR.select_numeric_features(df, "y") == ["a", "c"]


def test_fan_out_copies_share_one_plan(spark):
    df = spark.range(10)
    copies = PR.fan_out_copies(df)
    assert set(copies) == {"RC", "DC", "LR", "LogReg"}
    assert len({id(v) for v in copies.values()}) == 1
    assert copies["RC"].count() == 10


def test_bound_and_cap_drops_nulls_and_caps(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (5.0,), (2000.0,)], "r double")
    assert sorted(r.r for r in PR.bound_and_cap_range(df, "r").collect()) == [5.0, 1000.0]
    assert PR.bound_and_cap_range(df, "not_there").count() == 4


def test_filter_by_dict_ignores_unknown(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    assert PR.filter_by_dict(df, {"b": "y", "zzz": 1}).collect()[0].a == 2
    assert PR.filter_by_dict(df, {}).count() == 2


def test_append_categories(spark):
    known = spark.createDataFrame([("a",), ("b",)], "v string")
    seen = spark.createDataFrame([("b",), ("c",), ("c",)], "v string")
    assert sorted(r.v for r in append_categories(known, seen, "v").collect()) == ["a", "b", "c"]


def test_registry_schemas_and_run_sql(spark):
    assert set(SCHEMAS) == {"datasets", "models", "predictions", "experiments", "jobs", "quality_checks", "api_log"}
    assert empty_registry(spark, "models").count() == 0
    spark.range(5).createOrReplaceTempView("nums")
    assert run_sql(spark, "SELECT count(*) AS n FROM nums WHERE id >= :lo", {"lo": 2}).first().n == 3
