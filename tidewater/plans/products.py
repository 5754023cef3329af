"""Marts, semantic views and scorecards."""

from pyspark.sql import functions as F

from tidewater.operators import products
from tidewater.plans import lineage as governed
from tidewater.plans.gold import AMOUNT, REVENUE, ROLLUP, ROLLUP_TABLES
from tidewater.plans.registry import query
from tidewater.session import scratch_path, written
from tidewater.sources.extract import scan

MART = f"""
SELECT o_custkey, c_mktsegment, n_name, r_name, count(DISTINCT o_orderkey) AS order_count,
       count(*) AS line_count, {REVENUE} AS revenue
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
JOIN {{customer}} c ON o.o_custkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey
JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
GROUP BY o_custkey, c_mktsegment, n_name, r_name
"""
MART_SQL = MART.format(**{t: t for t in ROLLUP_TABLES})

# Lines are summed per order before any join, so an order is one row there and needs no distinct count.
MART_PLAN = f"""
SELECT o_custkey, c_mktsegment, n_name, r_name, count(*) AS order_count,
       CAST(sum(lines) AS BIGINT) AS line_count, CAST(sum(amount) AS DOUBLE) AS revenue
FROM (SELECT l_orderkey, count(*) AS lines, sum({AMOUNT}) AS amount FROM {{lineitem}} GROUP BY l_orderkey) l
JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
JOIN {{customer}} c ON o.o_custkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey
JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
GROUP BY o_custkey, c_mktsegment, n_name, r_name
"""


def _mart(spark, folder):
    return products.mart(spark, MART_PLAN, {t: scan(spark, folder, t) for t in ROLLUP_TABLES})


@query("mart_customer_revenue", MART_SQL)
def mart_customer_revenue(spark, folder):
    return _mart(spark, folder)


EXACT = "CAST(sum(CAST(revenue AS DECIMAL(18, 4))) AS DOUBLE)"
METRICS = {"customers": "count(DISTINCT o_custkey)", "orders_placed": "CAST(sum(order_count) AS BIGINT)",
           "revenue": EXACT, "largest_customer": "max(revenue)"}


@query("semantic_view", "WITH mart AS (" + MART_SQL + f"""
) SELECT r_name, c_mktsegment, count(DISTINCT o_custkey) AS customers,
       CAST(sum(order_count) AS BIGINT) AS orders_placed, {EXACT} AS revenue,
       max(revenue) AS largest_customer
FROM mart GROUP BY r_name, c_mktsegment""")
def semantic_view(spark, folder):
    return products.semantic_view(_mart(spark, folder), ["r_name", "c_mktsegment"], METRICS)


@query("semantic_rollup", """
SELECT CASE WHEN grouping(c_mktsegment) = 0 THEN c_mktsegment END AS c_mktsegment,
       CASE WHEN grouping(o_orderstatus) = 0 THEN o_orderstatus END AS o_orderstatus,
       count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue, TRUE AS customers_close
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_mktsegment), (o_orderstatus))""")
def semantic_rollup(spark, folder):
    """States by segment, status and month, stored; then by segment and by status, with distinct customers within 5 %."""
    orders = scan(spark, folder, "orders").join(scan(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    states = written(spark, products.metric_states(
        orders, ["c_mktsegment", "o_orderstatus", "month"], {"revenue": "CAST(o_totalprice AS DECIMAL(18, 2))"},
        {"customers": "o_custkey"}), scratch_path(spark, "states"))
    both = None
    for dim, other in (("c_mktsegment", "o_orderstatus"), ("o_orderstatus", "c_mktsegment")):
        exact = orders.groupBy(dim).agg(F.count_distinct("o_custkey").alias("exact"))
        part = products.rolled_up(states, [dim], ["revenue"], ["customers"]).join(exact, dim).select(
            dim, F.lit(None).cast("string").alias(other), "rows", F.col("revenue").cast("double").alias("revenue"),
            (F.abs(F.col("customers") / F.col("exact") - 1) <= 0.05).alias("customers_close"))
        both = part if both is None else both.unionByName(part)
    return both


@query("metric_parity", "WITH mart AS (" + MART_SQL + f"""
), view AS (SELECT r_name, {EXACT} AS revenue, CAST(sum(line_count) AS BIGINT) AS line_count
            FROM mart GROUP BY r_name),
rollup AS ({ROLLUP.format(**{t: t for t in ROLLUP_TABLES})}),
gold AS (SELECT r_name, {EXACT} AS revenue,
                CAST(sum(CASE WHEN order_year < 2001 THEN line_count END) AS BIGINT) AS line_count
         FROM rollup GROUP BY r_name)
SELECT r_name, 'revenue' AS metric, v.revenue AS view_value, g.revenue AS mart_value,
       abs(v.revenue - g.revenue) <= 0.01 AS agrees FROM view v JOIN gold g USING (r_name)
UNION ALL
SELECT r_name, 'line_count', v.line_count, g.line_count, abs(v.line_count - g.line_count) <= 0.01
FROM view v JOIN gold g USING (r_name)""")
def metric_parity(spark, folder):
    """Revenue agrees; the line count is compared with gold that lacks the last year."""
    lines = "CAST(sum(line_count) AS BIGINT)"
    view = products.semantic_view(_mart(spark, folder), ["r_name"], {"revenue": EXACT, "line_count": lines})
    rollup = products.materialise(spark, ROLLUP, {t: scan(spark, folder, t) for t in ROLLUP_TABLES})
    gold = products.semantic_view(rollup, ["r_name"], {
        "revenue": EXACT,
        "line_count": "CAST(sum(CASE WHEN order_year < 2001 THEN line_count END) AS BIGINT)"})
    return products.metric_parity(view, gold, ["r_name"], 0.01)


@query("product_scorecard", "WITH" + governed.REGISTRY + """,
status AS (
  SELECT 'ds_' || o_custkey AS dataset,
         CASE WHEN count(*) FILTER (o_totalprice > 480000) > 0 THEN 'failed' ELSE 'passed' END AS quality_status
  FROM orders GROUP BY o_custkey),
traced AS (SELECT DISTINCT 'ds_' || o_custkey AS dataset FROM orders WHERE o_orderpriority = '1-URGENT'),
points AS (
  SELECT dataset, owner IS NOT NULL AS has_owner,
         coalesce(greatest(quality_checked_at, snapshot_at) >= TIMESTAMP '2001-08-02' - INTERVAL 90 DAY
                  AND least(quality_checked_at, snapshot_at) >= TIMESTAMP '2001-08-02' - INTERVAL 90 DAY,
                  FALSE) AS is_fresh,
         coalesce(quality_status = 'passed', FALSE) AS quality_passed,
         dataset IN (SELECT dataset FROM traced) AS has_lineage, contract IS NOT NULL AS has_contract,
         (SELECT count(*) FROM gaps g WHERE g.dataset = registry.dataset) AS gaps
  FROM registry LEFT JOIN status USING (dataset))
SELECT *, CAST(has_owner AS INTEGER) + CAST(is_fresh AS INTEGER) + CAST(quality_passed AS INTEGER)
          + CAST(has_lineage AS INTEGER) + CAST(has_contract AS INTEGER) AS score
FROM points""")
def product_scorecard(spark, folder):
    registry = governed.registry(spark, folder)
    orders = scan(spark, folder, "orders")
    dataset = F.concat(F.lit("ds_"), F.col("o_custkey").cast("string")).alias("dataset")
    status = orders.groupBy(dataset).agg(
        F.when(F.count_if(F.col("o_totalprice") > 480000) > 0, "failed").otherwise("passed")
        .alias("quality_status"))
    as_of = F.lit(governed.AS_OF.isoformat(sep=" ")).cast("timestamp_ntz")
    oldest = F.when(F.col("quality_checked_at").isNotNull() & F.col("snapshot_at").isNotNull(),
                    F.least("quality_checked_at", "snapshot_at"))
    freshness = registry.select("dataset", (
        (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(oldest.cast("timestamp"))) / 60
    ).alias("freshness_minutes"))
    traced = orders.filter(F.col("o_orderpriority") == "1-URGENT").select(dataset)
    return products.product_scorecard(
        registry.select("dataset", "owner", "contract"), status, governed.gaps(spark, folder),
        freshness, traced, governed.QUARTER_MINUTES)
