"""Joins and aggregates on the way to gold."""

from pyspark.sql import functions as F

from tidewater.operators import relational
from tidewater.operators.products import materialise
from tidewater.plans.inputs import BRONZE_ORDERS, EVIDENCE, NOW, bronze_orders, evidence
from tidewater.plans.registry import query
from tidewater.session import scratch_path
from tidewater.sources import zones
from tidewater.sources.extract import scan

AMOUNT = "CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))"
REVENUE = f"CAST(sum({AMOUNT}) AS DOUBLE)"

ROLLUP = f"""
SELECT r_name, n_name, year(o_orderdate) AS order_year, count(*) AS line_count, {REVENUE} AS revenue
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
JOIN {{customer}} c ON o.o_custkey = c.c_custkey
JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey
JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
GROUP BY r_name, n_name, year(o_orderdate)
"""
ROLLUP_TABLES = ("lineitem", "orders", "customer", "nation", "region")
_BY_NAME = {t: t for t in ROLLUP_TABLES}


@query("gold_join_rollup", ROLLUP.format(**_BY_NAME).replace(
    "year(o_orderdate) AS", "CAST(year(o_orderdate) AS INTEGER) AS"))
def gold_join_rollup(spark, folder):
    return materialise(spark, ROLLUP, {t: scan(spark, folder, t) for t in ROLLUP_TABLES})


COUNT_BY_NATION = """
SELECT n_name, count(*) AS customers FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
GROUP BY n_name
"""


@query("gold_count_by_nation", COUNT_BY_NATION.format(customer="customer", nation="nation"))
def gold_count_by_nation(spark, folder):
    return materialise(spark, COUNT_BY_NATION,
                       {t: scan(spark, folder, t) for t in ("customer", "nation")})


@query("cross_zone_join", "WITH" + BRONZE_ORDERS + """
SELECT _batch_id, o_orderkey, o_totalprice, c_name, c_mktsegment
FROM bronze_orders JOIN customer ON o_custkey = c_custkey""")
def cross_zone_join(spark, folder):
    silver = scan(spark, folder, "customer")
    return bronze_orders(spark, folder).join(
        silver, F.col("o_custkey") == F.col("c_custkey")).select(
        "_batch_id", "o_orderkey", "o_totalprice", "c_name", "c_mktsegment")


@query("enrich_reference", """
SELECT c.*, n_name, n_regionkey, n_nationkey IS NULL AS reference_missing
FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON c_nationkey = n_nationkey""")
def enrich_reference(spark, folder):
    known = scan(spark, folder, "nation").filter(F.col("n_regionkey") != 3)
    return relational.enrich_reference(scan(spark, folder, "customer"), known,
                                       {"c_nationkey": "n_nationkey"}, ["n_name", "n_regionkey"])


@query("conditional_rollup", """
SELECT event_type, count(*) AS row_count, count(*) FILTER (value >= 130) AS high,
       count(*) FILTER (value < 10 OR value IS NULL) AS low,
       count(*) FILTER (user_id % 2 = 0) AS even_users, count(*) FILTER (props IS NULL) AS no_props,
       count(DISTINCT user_id) AS users, max(CASE WHEN value < 100 THEN ts END) AS last_normal
FROM events GROUP BY event_type""")
def conditional_rollup(spark, folder):
    value = F.col("value")
    return relational.conditional_rollup(scan(spark, folder, "events"), ["event_type"], {
        "high": value >= 130, "low": (value < 10) | value.isNull(),
        "even_users": F.col("user_id") % 2 == 0, "no_props": F.col("props").isNull(),
    }, {
        "users": F.count_distinct("user_id"),
        "last_normal": F.max(F.when(value < 100, F.col("ts"))),
    })


@query("distinct_keys", """
SELECT count(*) AS distinct_keys FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def distinct_keys(spark, folder):
    return relational.distinct_keys(scan(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("range_sum", """
SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT) * (CAST(l_quantity AS BIGINT) - 1) // 2) AS BIGINT) AS total,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS row_count
FROM lineitem GROUP BY l_returnflag""")
def range_sum(spark, folder):
    """Each line's pieces, numbered; the SQL knows the sums in closed form."""
    pieces = scan(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("pieces"))
    return relational.range_sum(pieces, "pieces", ["l_returnflag"])


@query("latest_results", "WITH" + EVIDENCE + """
SELECT * FROM evidence ORDER BY checked_at DESC, snapshot_id LIMIT 25""")
def latest_results(spark, folder):
    return relational.newest(evidence(spark, folder), "checked_at", 25, ["snapshot_id"])


@query("anti_reference", """
SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def anti_reference(spark, folder):
    solvent = scan(spark, folder, "customer").filter(F.col("c_acctbal") >= 0)
    return relational.anti_reference(scan(spark, folder, "orders"), "o_custkey", solvent, "c_custkey")


@query("gold_publish", COUNT_BY_NATION.format(customer="customer", nation="nation"))
def gold_publish(spark, folder):
    """The stored form: a rebuild replaces the table, readers see the newest version."""
    table = scratch_path(spark, "gold") + "/customers_by_nation"
    zones.publish(scan(spark, folder, "nation").select("n_name", F.lit(0).alias("customers")),
                  table, "gold", NOW)
    zones.publish(gold_count_by_nation(spark, folder), table, "gold", NOW)
    return zones.read_table(spark, table)
