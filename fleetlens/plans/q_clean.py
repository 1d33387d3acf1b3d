"""Registered queries: predicates, lookups, scalars, cleaning, features, UDF
hooks (survey 2.2, 2.3, 2.7, 2.8, 2.9, 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import udf as U
from ..operators import clean as C
from ..operators import features as FE
from ..operators import lookups as L
from ..operators import predicates as PR
from ..operators.setops import append_categories
from ..roles import vehicles, with_vehicles
from ..session import table
from ..sources.registry import registry_sql, registry_tables
from .registry import register, round_doubles

T_ROLES = {"make": "Make", "model": "Model", "model_year": "Model Year", "electric_range": "Electric Range",
           "base_msrp": "Base MSRP", "ev_type_text": "Electric Vehicle Type", "city": "City", "county": "County",
           "cafv_text": "Clean Alternative Fuel Vehicle (CAFV) Eligibility"}


def _titled(spark, d, roles):
    v = vehicles(spark, d, roles)
    return v.select(*[F.col(r).alias(T_ROLES.get(r, r)) for r in roles])


# ---------------------------------------------------------------- 2.2

@register("range_warnings", with_vehicles(
    "SELECT min(model_year) AS min_year, max(model_year) AS max_year, round(min(electric_range), 6) AS min_measure, "
    "round(max(electric_range), 6) AS max_measure, (min(model_year) < 2000 OR max(model_year) > 2030) AS year_warning, "
    "(min(electric_range) < 0 OR max(electric_range) > 1000) AS measure_warning FROM vehicles",
    ["model_year", "electric_range"]))
def q_range_warnings(spark, d):
    return round_doubles(PR.range_warnings(vehicles(spark, d, ["model_year", "electric_range"]),
                                           "model_year", "electric_range"))


@register("drop_columns", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_drop_columns(spark, d):
    return PR.drop_columns(table(spark, d, "customer"), ["c_name", "not_there"])


@register("clean_dc", with_vehicles(
    "SELECT county, \"electric range\", \"electric vehicle type\", "
    "CASE WHEN lower(cafv_text) = 'clean alternative fuel vehicle eligible' THEN 'yes' ELSE 'no' END "
    "AS \"cafv eligibility\", make FROM (SELECT lower(county) AS county, electric_range AS \"electric range\", "
    "lower(ev_type_text) AS \"electric vehicle type\", cafv_text, lower(make) AS make FROM vehicles)",
    ["county", "electric_range", "ev_type_text", "cafv_text", "make"]))
def q_clean_dc(spark, d):
    """lower-case headers and strings, keep 5 columns, rename one, yes/no flag."""
    v = _titled(spark, d, ["county", "electric_range", "ev_type_text", "cafv_text", "make"])
    v = PR.lowercase_strings(PR.lowercase_headers(v))
    v = PR.select_rename(v, ["county", "electric range", "electric vehicle type",
                             "clean alternative fuel vehicle (cafv) eligibility", "make"],
                         {"clean alternative fuel vehicle (cafv) eligibility": "cafv eligibility"})
    v = v.withColumn("cafv eligibility", PR.flag_equals("`cafv eligibility`", "clean alternative fuel vehicle eligible"))
    return round_doubles(v)


@register("lowercase_strings", "SELECT p_partkey, lower(p_name) AS p_name, lower(p_brand) AS p_brand, "
                               "lower(p_type) AS p_type, p_size, p_retailprice FROM part")
def q_lower(spark, d):
    return PR.lowercase_strings(table(spark, d, "part"))


@register("bound_and_cap_range",
          "SELECT c_custkey, least(c_acctbal, 1000) AS c_acctbal FROM customer WHERE c_acctbal >= 0")
def q_bound_range(spark, d):
    return PR.bound_and_cap_range(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@register("bound_and_cap_price",
          "SELECT o_orderkey, least(o_totalprice, 500000) AS o_totalprice FROM orders WHERE o_totalprice > 0")
def q_bound_price(spark, d):
    return PR.bound_and_cap_price(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@register("bound_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS model_year FROM orders "
                        "WHERE year(o_orderdate) BETWEEN 1997 AND 2000")
def q_bound_year(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("model_year"))
    return PR.bound_year(o, "model_year", ref_year=1999, low=1997)


@register("bound_coordinates",
          "SELECT c_custkey, c_acctbal / 100 AS Latitude, CAST(c_nationkey AS DOUBLE) * 10 - 100 AS Longitude FROM customer "
          "WHERE c_acctbal / 100 BETWEEN -90 AND 90 AND CAST(c_nationkey AS DOUBLE) * 10 - 100 BETWEEN -180 AND 180")
def q_bound_coordinates(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("Latitude"),
                                           (F.col("c_nationkey") * 10.0 - 100).alias("Longitude"))
    return PR.bound_coordinates(c)


@register("filter_by_dict", with_vehicles(
    "SELECT * FROM vehicles WHERE make = 'Brand#2' AND cafv_eligibility = 'R'",
    ["make", "cafv_eligibility", "electric_range", "base_msrp"]))
def q_filter_by_dict(spark, d):
    v = vehicles(spark, d, ["make", "cafv_eligibility", "electric_range", "base_msrp"])
    return PR.filter_by_dict(v, {"make": "Brand#2", "cafv_eligibility": "R", "no_such_column": 1})


@register("filter_registry", registry_sql(
    "SELECT * FROM runs WHERE (coalesce(contains(lower(model_type), 'urgent'), false) "
    "OR coalesce(contains(lower(status), 'urgent'), false)) "
    "AND start_time >= TIMESTAMP '1996-01-01' AND start_time <= TIMESTAMP '1997-12-31' AND status = 'F' "
    "ORDER BY score DESC NULLS LAST, run_id OFFSET 5 LIMIT 20", ["runs"]))
def q_filter_registry(spark, d):
    runs = registry_tables(spark, d)["runs"]
    return PR.filter_registry(runs, search="URGENT", search_cols=["model_type", "status"], date_col="start_time",
                              date_from="1996-01-01", date_to="1997-12-31", status_col="status", status="F",
                              sort_by="score", descending=True, id_col="run_id", skip=5, limit=20)


@register("drop_incomplete", with_vehicles(
    "SELECT * FROM vehicles WHERE tax_or_null IS NOT NULL AND rebate_or_null IS NOT NULL",
    ["order_key", "tax_or_null", "rebate_or_null"]))
def q_drop_incomplete(spark, d):
    v = vehicles(spark, d, ["order_key", "tax_or_null", "rebate_or_null"])
    return PR.drop_incomplete(v, ["tax_or_null", "rebate_or_null"])


# ---------------------------------------------------------------- 2.3

@register("lookup_count", with_vehicles(
    "SELECT v.order_key, v.city, c.n AS city_ev_density FROM vehicles v LEFT JOIN "
    "(SELECT city, count(*) AS n FROM vehicles WHERE city IS NOT NULL GROUP BY city) c ON v.city = c.city",
    ["order_key", "city"]))
def q_lookup_count(spark, d):
    return L.lookup_count(vehicles(spark, d, ["order_key", "city"]), "city", "city_ev_density")


@register("lookup_share", with_vehicles(
    "SELECT v.order_key, v.make, round(c.s, 6) AS manufacturer_market_share FROM vehicles v LEFT JOIN "
    "(SELECT make, count(*) / sum(count(*)) OVER () AS s FROM vehicles WHERE make IS NOT NULL GROUP BY make) c "
    "ON v.make = c.make", ["order_key", "make"]))
def q_lookup_share(spark, d):
    v = vehicles(spark, d, ["order_key", "make"])
    return round_doubles(L.lookup_share(v, "make", "manufacturer_market_share"))


@register("lookup_mean", with_vehicles(
    "SELECT v.order_key, v.make, v.electric_range, round(c.m, 6) AS manufacturer_avg_range FROM vehicles v "
    "LEFT JOIN (SELECT make, avg(electric_range) AS m FROM vehicles WHERE make IS NOT NULL GROUP BY make) c "
    "ON v.make = c.make", ["order_key", "make", "electric_range"]))
def q_lookup_mean(spark, d):
    v = vehicles(spark, d, ["order_key", "make", "electric_range"])
    return round_doubles(L.lookup_mean(v, "make", "electric_range", "manufacturer_avg_range"))


@register("flag_in_top_n", with_vehicles(
    "SELECT v.order_key, v.city, CASE WHEN t.city IS NULL THEN 0 ELSE 1 END AS is_urban FROM vehicles v LEFT JOIN "
    "(SELECT city FROM vehicles WHERE city IS NOT NULL GROUP BY city ORDER BY count(*) DESC, city LIMIT 10) t "
    "ON v.city = t.city", ["order_key", "city"]))
def q_flag_top_n(spark, d):
    return L.flag_in_top_n(vehicles(spark, d, ["order_key", "city"]), "city", 10, "is_urban")


@register("flag_in_set", "SELECT p_partkey, p_brand, CAST(upper(p_brand) IN ('BRAND#1', 'BRAND#2', 'BRAND#3') AS INT) "
                         "AS in_set FROM part")
def q_flag_in_set(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return p.withColumn("in_set", L.flag_in_set("p_brand", ["BRAND#1", "BRAND#2", "BRAND#3"], upper=True))


@register("join_registry", registry_sql(
    "SELECT p.model_id, m.dataset_id, p.prediction_id, m.name AS model_name, ds.name AS dataset_name "
    "FROM predictions p JOIN models m ON p.model_id = m.model_id JOIN datasets ds ON m.dataset_id = ds.dataset_id"))
def q_join_registry(spark, d):
    t = registry_tables(spark, d)
    models = t["models"].select("model_id", "dataset_id", F.col("name").alias("model_name"))
    datasets = t["datasets"].select("dataset_id", F.col("name").alias("dataset_name"))
    pm = L.join_registry(models, t["predictions"].select("prediction_id", "model_id"), "model_id")
    return L.join_registry(datasets, pm, "dataset_id", small_side_rows=100_000)


@register("orphans", registry_sql(
    "SELECT prediction_id, model_id FROM predictions WHERE model_id NOT IN "
    "(SELECT model_id FROM models WHERE accuracy > 0)"))
def q_orphans(spark, d):
    t = registry_tables(spark, d)
    live = t["models"].where(F.col("accuracy") > 0)
    return L.orphans(t["predictions"].select("prediction_id", "model_id"), live, "model_id", "model_id")


@register("orphan_cleanup", registry_sql(
    "SELECT prediction_id, model_id FROM predictions WHERE model_id IN "
    "(SELECT model_id FROM models WHERE accuracy > 0)"))
def q_orphan_cleanup(spark, d):
    t = registry_tables(spark, d)
    live = t["models"].where(F.col("accuracy") > 0)
    return L.orphan_cleanup(t["predictions"].select("prediction_id", "model_id"), live, "model_id", "model_id")


@register("lookup_by_key", "SELECT * FROM customer WHERE c_custkey = 42")
def q_lookup_by_key(spark, d):
    return L.lookup_by_key(table(spark, d, "customer"), "c_custkey", 42)


@register("lookup_many", "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer "
                         "WHERE c_mktsegment = 'MACHINERY')")
def q_lookup_many(spark, d):
    keys = table(spark, d, "customer").where(F.col("c_mktsegment") == "MACHINERY") \
        .select(F.col("c_custkey").alias("o_custkey"))
    return L.lookup_many(table(spark, d, "orders"), keys, "o_custkey")


# ---------------------------------------------------------------- 2.7

@register("append_categories",
          "SELECT DISTINCT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) ")
def q_append_categories(spark, d):
    """Customers known from orders before 1997, plus those first seen later."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    known = o.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return append_categories(known, o, "c_name")


# ---------------------------------------------------------------- 2.8

SCALAR_ROLES = ["order_key", "make", "model", "model_year", "cafv_text", "discount", "tax", "electric_range",
                "base_msrp", "ship_ts"]


@register("scalar_functions", with_vehicles(
    "SELECT order_key, "
    "CASE WHEN contains(lower(cafv_text), 'clean') THEN 1 WHEN contains(lower(cafv_text), 'eligibility unknown') "
    "THEN 0 ELSE -1 END AS cafv_code3, "
    "CASE WHEN contains(lower(cafv_text), 'not eligible') THEN 0 ELSE 1 END AS cafv_code2, "
    "round(CASE WHEN tax = 0 THEN 0.0 ELSE discount / tax END, 6) AS safe_ratio, "
    "printf('%.2f%%', discount * 100) AS discount_pct, "
    "md5(concat_ws('|', coalesce(CAST(make AS VARCHAR), ''), coalesce(CAST(model AS VARCHAR), ''), "
    "coalesce(CAST(order_key AS VARCHAR), ''))) AS fingerprint, "
    "sha256(make) AS make_sha, round(base_msrp / (electric_range + 1), 6) AS price_per_range, "
    "2024 - model_year AS vehicle_age, round((2024 - model_year) * electric_range, 6) AS age_range_interaction, "
    "CASE WHEN electric_range > 200 THEN 1 ELSE 0 END AS has_long_range, "
    "strftime(ship_ts, '%Y-%m-%dT%H:%M:%S') AS ship_iso, strftime(ship_ts, '%Y%m%d_%H%M%S') AS run_stamp, "
    "CASE WHEN discount * 10 IS NULL OR discount * 10 = 0 THEN '-' WHEN discount * 10 > 0.8 THEN 'success' "
    "WHEN discount * 10 > 0.6 THEN 'normal' ELSE 'exception' END AS confidence_band "
    "FROM vehicles", SCALAR_ROLES))
def q_scalars(spark, d):
    v = vehicles(spark, d, SCALAR_ROLES)
    return round_doubles(v.select(
        "order_key",
        S.cafv_code3("cafv_text").alias("cafv_code3"), S.cafv_code2("cafv_text").alias("cafv_code2"),
        S.safe_divide("discount", "tax").alias("safe_ratio"),
        S.format_percentage("discount", 2).alias("discount_pct"),
        S.row_fingerprint(["make", "model", "order_key"]).alias("fingerprint"),
        S.sha256_column("make").alias("make_sha"),
        S.ratio_plus_one("base_msrp", "electric_range").alias("price_per_range"),
        S.age_from_year("model_year", 2024).alias("vehicle_age"),
        S.product_interaction(S.age_from_year("model_year", 2024), F.col("electric_range"))
        .alias("age_range_interaction"),
        S.threshold_flag("electric_range", 200).alias("has_long_range"),
        S.iso_timestamp("ship_ts").alias("ship_iso"), S.run_name_stamp("ship_ts").alias("run_stamp"),
        S.confidence_band(F.col("discount") * 10).alias("confidence_band")))


@register("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k, "
                        "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_num FROM events")
def q_json_field(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", S.json_field("props", "$.k").alias("k"),
                    S.json_field("props", "$.k").cast("long").alias("k_num"))


@register("sanitize_text", "SELECT doc_id, regexp_replace(substring(regexp_replace(text, "
                           "'[<>&\"''/\\\\;(){}]', '', 'g'), 1, 1000), '^\\s+|\\s+$', '', 'g') AS clean_text, "
                           "substring(text, 1, 250) AS text_param FROM documents")
def q_sanitize(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", S.sanitize_text("text").alias("clean_text"),
                       S.truncate_param("text", 250).alias("text_param"))


# ---------------------------------------------------------------- 2.9

IMP_ROLES = ["order_key", "line_number", "tax_or_null", "discount_or_null", "cafv_or_null", "make"]


@register("impute_median", with_vehicles(
    "SELECT order_key, line_number, coalesce(tax_or_null, (SELECT median(tax_or_null) FROM vehicles)) AS tax_or_null, "
    "coalesce(discount_or_null, (SELECT median(discount_or_null) FROM vehicles)) AS discount_or_null, "
    "cafv_or_null, make FROM vehicles", IMP_ROLES))
def q_impute_median(spark, d):
    return round_doubles(C.impute_median(vehicles(spark, d, IMP_ROLES)))


_MODE_SQL = ("(SELECT cafv_or_null FROM vehicles WHERE cafv_or_null IS NOT NULL GROUP BY cafv_or_null "
             "ORDER BY count(*) DESC, cafv_or_null LIMIT 1)")


@register("impute_mode", with_vehicles(
    f"SELECT order_key, line_number, tax_or_null, discount_or_null, coalesce(cafv_or_null, {_MODE_SQL}) "
    "AS cafv_or_null, make FROM vehicles", IMP_ROLES))
def q_impute_mode(spark, d):
    return round_doubles(C.impute_mode(vehicles(spark, d, IMP_ROLES)))


@register("impute_constant", with_vehicles(
    "SELECT order_key, line_number, coalesce(tax_or_null, 1) AS tax_or_null, "
    "coalesce(discount_or_null, 0) AS discount_or_null, coalesce(cafv_or_null, 'unknown') AS cafv_or_null, make "
    "FROM vehicles", IMP_ROLES))
def q_impute_constant(spark, d):
    v = vehicles(spark, d, IMP_ROLES)
    return round_doubles(C.impute_constant(v, {"tax_or_null": 1.0, "discount_or_null": 0.0,
                                               "cafv_or_null": "unknown"}))


CLEAN_ROLES = ["make", "model_year", "electric_range", "base_msrp", "tax_or_null", "cafv_or_null"]


@register("clean_table", with_vehicles(
    "SELECT make, model_year, least(electric_range, 300) AS electric_range, least(base_msrp, 50000) AS base_msrp, "
    "tax_or_null, cafv_or_null FROM (SELECT make, model_year, electric_range, base_msrp, "
    "coalesce(tax_or_null, (SELECT median(tax_or_null) FROM (SELECT DISTINCT * FROM vehicles))) AS tax_or_null, "
    "coalesce(cafv_or_null, (SELECT cafv_or_null FROM (SELECT DISTINCT * FROM vehicles) WHERE cafv_or_null IS NOT NULL "
    "GROUP BY cafv_or_null ORDER BY count(*) DESC, cafv_or_null LIMIT 1)) AS cafv_or_null "
    "FROM (SELECT DISTINCT * FROM vehicles)) WHERE electric_range >= 0 AND base_msrp > 0 "
    "AND model_year BETWEEN 1996 AND 2000", CLEAN_ROLES))
def q_clean_table(spark, d):
    """The cleaning chain; stand-in caps and years fit the driver tables (years 1995-2001)."""
    v = vehicles(spark, d, CLEAN_ROLES)
    out = C.clean_table(v, range_col="electric_range", price_col="base_msrp", year_col="model_year",
                        ref_year=1999, year_low=1996, range_cap=300.0, price_cap=50000.0)
    return round_doubles(out)


SF_ROLES = ["order_key", "make", "model_year", "electric_range", "base_msrp"]
_RANGE_CAT = ("CASE WHEN electric_range >= 0 AND electric_range <= 50 THEN 'Low' WHEN electric_range > 50 AND "
              "electric_range <= 100 THEN 'Medium' WHEN electric_range > 100 AND electric_range <= 200 THEN 'High' "
              "WHEN electric_range > 200 AND electric_range <= 500 THEN 'Ultra' END")


@register("service_features", with_vehicles(
    "SELECT order_key, make AS \"Make\", model_year AS \"Model Year\", electric_range AS \"Electric Range\", "
    f"base_msrp AS \"Base MSRP\", {_RANGE_CAT} AS \"Range_Category\", "
    "round(base_msrp / (electric_range + 1), 6) AS \"Price_per_Range\", 1999 - model_year AS \"Vehicle_Age\", "
    "CASE WHEN model_year >= 1995 AND model_year <= 1997 THEN 'Early' WHEN model_year > 1997 AND model_year <= 1999 "
    "THEN 'Mid' WHEN model_year > 1999 AND model_year <= 2000 THEN 'Recent' END AS \"Model_Year_Category\", "
    "upper(make) IN ('TESLA', 'BMW', 'MERCEDES-BENZ', 'AUDI', 'JAGUAR', 'PORSCHE') AS \"Is_Luxury_Brand\" "
    "FROM vehicles", SF_ROLES))
def q_service_features(spark, d):
    """Service feature set; the year edges are moved onto the stand-in years (1995-2001)."""
    v = vehicles(spark, d, SF_ROLES).select(
        "order_key", *[F.col(r).alias(T_ROLES[r]) for r in SF_ROLES[1:]])
    out = FE.service_features(v, ref_year=1999, year_edges=[1995, 1997, 1999, 2000])
    return round_doubles(out)


NB_ROLES = ["order_key", "line_number", "make", "model", "model_year", "ev_type_text", "electric_range",
            "base_msrp", "city", "county", "cafv_or_null"]


def _nb_sql():
    return with_vehicles(
        "SELECT v.order_key, v.line_number, v.make, v.model, v.model_year, v.ev_type_text, v.electric_range, "
        "v.base_msrp, v.city, v.county, v.cafv_or_null, 2024 - v.model_year AS vehicle_age, "
        "CAST(coalesce(v.make IN ('TESLA', 'PORSCHE', 'BMW', 'AUDI', 'MERCEDES-BENZ', 'JAGUAR', 'LEXUS'), false) AS INT) "
        "AS is_luxury, CAST(coalesce(v.ev_type_text = 'Battery Electric Vehicle (BEV)', false) AS INT) AS is_bev, "
        "CAST(coalesce(v.electric_range > 200, false) AS INT) AS has_long_range, "
        "CASE WHEN v.base_msrp > 0 AND v.base_msrp <= 30000 THEN 'budget' WHEN v.base_msrp > 30000 AND "
        "v.base_msrp <= 50000 THEN 'mid' WHEN v.base_msrp > 50000 AND v.base_msrp <= 75000 THEN 'premium' "
        "WHEN v.base_msrp > 75000 THEN 'luxury' END AS price_category, "
        "cc.n AS city_ev_density, co.n AS county_ev_density, CASE WHEN tc.city IS NULL THEN 0 ELSE 1 END AS is_urban, "
        "round(ms.s, 6) AS manufacturer_market_share, mp.n AS model_popularity, "
        "round(mr.m, 6) AS manufacturer_avg_range, enc.idx AS cafv_or_null_encoded, "
        "round(mr.m, 6) AS make_target_encoded, round(mo.m, 6) AS model_target_encoded, "
        "round(v.electric_range / (v.base_msrp + 1), 6) AS range_price_ratio, "
        "round((2024 - v.model_year) * v.electric_range, 6) AS age_range_interaction, "
        "CAST(coalesce(v.make IN ('TESLA', 'PORSCHE', 'BMW', 'AUDI', 'MERCEDES-BENZ', 'JAGUAR', 'LEXUS'), false) AS INT) "
        "* CAST(coalesce(v.ev_type_text = 'Battery Electric Vehicle (BEV)', false) AS INT) AS luxury_bev "
        "FROM vehicles v "
        "LEFT JOIN (SELECT city, count(*) AS n FROM vehicles WHERE city IS NOT NULL GROUP BY city) cc ON v.city = cc.city "
        "LEFT JOIN (SELECT county, count(*) AS n FROM vehicles WHERE county IS NOT NULL GROUP BY county) co "
        "ON v.county = co.county "
        "LEFT JOIN (SELECT city FROM vehicles WHERE city IS NOT NULL GROUP BY city ORDER BY count(*) DESC, city "
        "LIMIT 10) tc ON v.city = tc.city "
        "LEFT JOIN (SELECT make, count(*) / sum(count(*)) OVER () AS s FROM vehicles WHERE make IS NOT NULL "
        "GROUP BY make) ms ON v.make = ms.make "
        "LEFT JOIN (SELECT model, count(*) AS n FROM vehicles WHERE model IS NOT NULL GROUP BY model) mp "
        "ON v.model = mp.model "
        "LEFT JOIN (SELECT make, avg(electric_range) AS m FROM vehicles WHERE make IS NOT NULL GROUP BY make) mr "
        "ON v.make = mr.make "
        "LEFT JOIN (SELECT model, avg(electric_range) AS m FROM vehicles WHERE model IS NOT NULL GROUP BY model) mo "
        "ON v.model = mo.model "
        "LEFT JOIN (SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INT) AS idx FROM "
        "(SELECT DISTINCT coalesce(cafv_or_null, 'Unknown') AS value FROM vehicles)) enc "
        "ON coalesce(v.cafv_or_null, 'Unknown') = enc.value", NB_ROLES)


@register("notebook_features", _nb_sql())
def q_notebook_features(spark, d):
    v = vehicles(spark, d, NB_ROLES)
    out = FE.notebook_features(v, make="make", model="model", year="model_year", ev_type="ev_type_text",
                               range_col="electric_range", price="base_msrp", city="city", county="county",
                               cafv="cafv_or_null", ref_year=2024)
    return round_doubles(out)


@register("label_encode", with_vehicles(
    "SELECT v.order_key, v.cafv_or_null, e.idx AS cafv_code FROM vehicles v JOIN "
    "(SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INT) AS idx FROM "
    "(SELECT DISTINCT coalesce(cafv_or_null, 'nan') AS value FROM vehicles)) e "
    "ON coalesce(v.cafv_or_null, 'nan') = e.value", ["order_key", "cafv_or_null"]))
def q_label_encode(spark, d):
    return FE.label_encode(vehicles(spark, d, ["order_key", "cafv_or_null"]), "cafv_or_null", "cafv_code")


@register("label_encode_unseen",
          "WITH o AS (SELECT o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey), "
          "k AS (SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INT) AS idx FROM "
          "(SELECT DISTINCT c_name AS value FROM o WHERE o_orderdate < TIMESTAMP '1997-01-01')), "
          "n AS (SELECT value, CAST((SELECT max(idx) FROM k) + dense_rank() OVER (ORDER BY value) AS INT) AS idx FROM "
          "(SELECT DISTINCT c_name AS value FROM o WHERE c_name NOT IN (SELECT value FROM k))) "
          "SELECT value, idx AS \"index\" FROM k UNION ALL SELECT value, idx FROM n")
def q_label_unseen(spark, d):
    """Encoder fitted on customers of orders before 1997, extended by later ones."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    enc = FE.fit_label_encoder(o.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")), "c_name")
    return enc.extend(o).labels


SC_ROLES = ["order_key", "electric_range", "base_msrp", "discount"]


@register("scale_standard", with_vehicles(
    "SELECT order_key, round((electric_range - m1) / s1, 6) AS electric_range, "
    "round((base_msrp - m2) / s2, 6) AS base_msrp, round((discount - m3) / s3, 6) AS discount FROM vehicles, "
    "(SELECT avg(electric_range) m1, stddev_pop(electric_range) s1, avg(base_msrp) m2, stddev_pop(base_msrp) s2, "
    "avg(discount) m3, stddev_pop(discount) s3 FROM vehicles)", SC_ROLES))
def q_scale(spark, d):
    v = vehicles(spark, d, SC_ROLES)
    out, _ = FE.scale_standard(v, ["electric_range", "base_msrp", "discount"])
    return round_doubles(out)


@register("outliers_iqr", with_vehicles(
    "SELECT order_key, base_msrp, coalesce(base_msrp < q1 - 1.5 * (q3 - q1) OR base_msrp > q3 + 1.5 * (q3 - q1), "
    "false) AS is_outlier FROM vehicles, (SELECT quantile_cont(base_msrp, 0.25) q1, quantile_cont(base_msrp, 0.75) q3 "
    "FROM vehicles)", ["order_key", "base_msrp"]))
def q_outliers_iqr(spark, d):
    return round_doubles(FE.outliers_iqr(vehicles(spark, d, ["order_key", "base_msrp"]), "base_msrp"))


@register("outliers_zscore",
          "SELECT c_custkey, c_acctbal, coalesce(abs(c_acctbal - m) / s > 1.5, false) AS is_outlier FROM customer, "
          "(SELECT avg(c_acctbal) m, stddev_samp(c_acctbal) s FROM customer)")
def q_outliers_z(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return round_doubles(FE.outliers_zscore(c, "c_acctbal", threshold=1.5))


_HASH_SQL = ("CAST(('0x' || substr(md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), 1, 15)) AS BIGINT)")


@register("split_train_test",
          f"SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY "
          f"{_HASH_SQL}) - 1 < ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) THEN 'test' ELSE 'train' END "
          "AS split FROM orders")
def q_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return FE.split_train_test(o, ["o_orderkey"], label="o_orderstatus", test_size=0.2, seed=42)


@register("assign_folds",
          f"SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY "
          f"{_HASH_SQL}) - 1) % 5 AS INT) AS fold FROM orders")
def q_folds(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return FE.assign_folds(o, ["o_orderkey"], label="o_orderstatus", k=5, seed=42)


@register("prepare_for_modeling")
def q_prepare(spark, d):
    """clean -> features -> encode on train -> split; returns the training rows."""
    v = _titled(spark, d, ["make", "model_year", "electric_range", "base_msrp", "ev_type_text"])
    train, test, feats = FE.prepare_for_modeling(
        v, "Electric Vehicle Type", key_cols=["Make", "Model Year", "Electric Range", "Base MSRP"],
        features=["Model Year", "Electric Range", "Base MSRP", "Make"], ref_year=1999,
        clean_kwargs={"year_low": 1996}, year_edges=[1995, 1997, 1999, 2000])
    return train


# ---------------------------------------------------------------- 2.14

@register("apply_column_fn", with_vehicles(
    "SELECT CASE WHEN contains(lower(cafv_text), 'clean') THEN 1 WHEN contains(lower(cafv_text), "
    "'eligibility unknown') THEN 0 ELSE -1 END AS value, count(*) AS count FROM vehicles GROUP BY 1",
    ["cafv_text"]))
def q_apply_column_fn(spark, d):
    return U.apply_column_fn(vehicles(spark, d, ["cafv_text"]), "cafv_text", "cafv_code3")


@register("apply_cellwise_fn", "SELECT p_partkey, reverse(p_name) AS p_name, reverse(p_brand) AS p_brand, "
                               "reverse(p_type) AS p_type FROM part")
def q_apply_cellwise(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return U.apply_cellwise_fn(p, lambda s: s[::-1])
