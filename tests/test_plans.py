"""Plan-level guards for the scale properties (read from the executed plan)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from fleetlens.operators import lookups as L
from fleetlens.operators import ordered as O

from conftest import SMALL


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_and_pushes(spark):
    plan = _plan(E.queries()["scan_parquet"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan


def test_top_n_per_group_uses_group_limit(spark):
    plan = _plan(E.queries()["keep_last_n"](spark, SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_lookup_join_broadcasts_small_table(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_returnflag")
    plan = _plan(L.lookup_count(li, "l_returnflag", "n"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rolling_window_partitions_by_client_and_bucket(spark):
    e = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id", "ts")
    plan = _plan(O.rolling_request_count(e, "user_id", "ts", 60))
    assert "hashpartitioning(user_id" in plan and "_b#" in plan.split("hashpartitioning(user_id")[1][:40]
