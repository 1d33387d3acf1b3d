"""Column roles: how the driver tables stand in for the vehicle table.

Operators in this package take column names as parameters. The registered
queries need a concrete table, so this module maps each vehicle role to an
expression over the TPC-H-like driver tables and joins only the tables that
the requested roles need (a query that uses make and range never touches
orders or customer).

Each role is one SQL expression string that is valid both in Spark SQL and in
DuckDB, so the oracle side (``vehicles_sql``) is built from the very same map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.lookups import bounded_broadcast
from .session import table

# role -> (table that provides it, expression)
ROLES: dict[str, tuple[str, str]] = {
    "order_key": ("lineitem", "l_orderkey"),
    "line_number": ("lineitem", "l_linenumber"),
    "part_key": ("lineitem", "l_partkey"),
    "supp_key": ("lineitem", "l_suppkey"),
    "ev_type": ("lineitem", "l_linestatus"),
    "cafv_eligibility": ("lineitem", "l_returnflag"),
    "electric_range": ("lineitem", "l_quantity * 10"),
    "base_msrp": ("lineitem", "l_extendedprice"),
    "discount": ("lineitem", "l_discount"),
    "tax": ("lineitem", "l_tax"),
    # columns with holes: the driver tables carry no null, so zeros become null
    "tax_or_null": ("lineitem", "nullif(l_tax, 0)"),
    "discount_or_null": ("lineitem", "nullif(l_discount, 0)"),
    "cafv_or_null": ("lineitem", "nullif(l_returnflag, 'N')"),
    "rebate_or_null":("lineitem", "CASE WHEN l_discount < 0.06 THEN NULL ELSE l_discount END"),
    "ship_ts": ("lineitem", "l_shipdate"),
    # The vehicle-type and CAFV eligibility texts of the source
    # file, laid over the two flag columns.
    "ev_type_text": ("lineitem", "CASE l_linestatus WHEN 'F' THEN 'Battery Electric Vehicle (BEV)' "
                                 "ELSE 'Plug-in Hybrid Electric Vehicle (PHEV)' END"),
    "cafv_text": ("lineitem", "CASE l_returnflag WHEN 'A' THEN 'Clean Alternative Fuel Vehicle Eligible' "
                              "WHEN 'N' THEN 'Eligibility unknown as battery range has not been researched' "
                              "ELSE 'Not eligible due to low battery range' END"),
    "make": ("part", "p_brand"),
    "model": ("part", "p_name"),
    "part_type": ("part", "p_type"),
    "model_year": ("orders", "CAST(year(o_orderdate) AS INT)"),
    "order_status": ("orders", "o_orderstatus"),
    "city": ("customer", "c_name"),
    "segment": ("customer", "c_mktsegment"),
    "county": ("nation", "n_name"),
    "state": ("region", "r_name"),
}

DEFAULT_ROLES = (
    "make", "model", "model_year", "ev_type", "cafv_eligibility",
    "electric_range", "base_msrp", "county", "state", "city",
)

# which tables each table needs to reach lineitem
_PATH = {
    "lineitem": [],
    "part": ["part"],
    "orders": ["orders"],
    "customer": ["orders", "customer"],
    "nation": ["orders", "customer", "nation"],
    "region": ["orders", "customer", "nation", "region"],
}


def _needed(roles) -> list[str]:
    need: list[str] = []
    for r in roles:
        for t in _PATH[ROLES[r][0]]:
            if t not in need:
                need.append(t)
    return need


def vehicles(spark: SparkSession, sf_dir: str, roles=DEFAULT_ROLES) -> DataFrame:
    """The vehicle table with one column per requested role.

    Joins are equi-joins on TPC-H keys. nation and region are bounded
    dimension tables (checked before the broadcast hint); part, orders and
    customer grow with the data, so they are left to the planner (sort-merge
    join, or broadcast by AQE when the runtime size is small).
    """
    roles = list(roles)
    need = _needed(roles)
    li = table(spark, sf_dir, "lineitem")
    df = li
    if "part" in need:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "orders" in need:
        dim = table(spark, sf_dir, "orders")
        if "customer" in need:
            cust = table(spark, sf_dir, "customer")
            if "nation" in need:
                nat = table(spark, sf_dir, "nation")
                if "region" in need:
                    nat = nat.join(bounded_broadcast(table(spark, sf_dir, "region"), 10_000),
                                   F.col("n_regionkey") == F.col("r_regionkey"))
                cust = cust.join(bounded_broadcast(nat, 10_000), F.col("c_nationkey") == F.col("n_nationkey"))
            dim = dim.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        df = df.join(dim, F.col("l_orderkey") == F.col("o_orderkey"))
    return df.select(*[F.expr(ROLES[r][1]).alias(r) for r in roles])


def vehicles_sql(roles=DEFAULT_ROLES) -> str:
    """DuckDB text of the same table, for ``oracle_sql``."""
    roles = list(roles)
    need = _needed(roles)
    frm = "lineitem"
    if "part" in need:
        frm += " JOIN part ON l_partkey = p_partkey"
    if "orders" in need:
        frm += " JOIN orders ON l_orderkey = o_orderkey"
    if "customer" in need:
        frm += " JOIN customer ON o_custkey = c_custkey"
    if "nation" in need:
        frm += " JOIN nation ON c_nationkey = n_nationkey"
    if "region" in need:
        frm += " JOIN region ON n_regionkey = r_regionkey"
    cols = ", ".join(f"{ROLES[r][1]} AS {r}" for r in roles)
    return f"SELECT {cols} FROM {frm}"


def with_vehicles(sql_body: str, roles=DEFAULT_ROLES) -> str:
    return f"WITH vehicles AS ({vehicles_sql(roles)}) {sql_body}"
