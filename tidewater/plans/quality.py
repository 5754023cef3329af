"""Quality rules, reconciliation and parity."""

from pyspark.sql import functions as F

from tidewater.operators import parity
from tidewater.operators import quality as dq
from tidewater.operators.products import materialise
from tidewater.plans.gold import ROLLUP, ROLLUP_TABLES
from tidewater.plans.inputs import AS_OF, EVIDENCE, at, evidence
from tidewater.plans.registry import query
from tidewater.session import scratch_path, written
from tidewater.sources.extract import scan

RUN = "run-2024-02-01"


def row(source, dataset, kind, name, ok, metric, threshold, detail, severity="blocking"):
    """The evidence row of one rule as SQL; `ok`, `metric`, `detail` read `m` and `total`."""
    namespace, table = dataset.split(".")
    fails_as = "FAILED" if severity == "blocking" else "WARNING"
    return f"""
SELECT '{RUN}' AS run_id, '{namespace}' AS dataset_namespace, '{table}' AS dataset_name,
       '{namespace}' AS zone, '{kind}' AS check_type, '{name}' AS check_name,
       '{severity}' AS severity, CASE WHEN {ok} THEN 'PASSED' ELSE '{fails_as}' END AS status,
       CAST({metric} AS DOUBLE) AS metric_value, CAST({threshold} AS DOUBLE) AS threshold,
       CASE WHEN NOT ({ok}) THEN {detail} END AS failure_detail,
       CAST(NULL AS VARCHAR) AS pipeline_run_id, TIMESTAMP '2024-02-01 00:00:00' AS checked_at,
       CAST(NULL AS BIGINT) AS snapshot_id
FROM ({source})"""


def suite(df, rules, dataset, refs=None):
    return dq.quality_suite(df, rules, RUN, dataset, AS_OF, refs)


def dirty_orders(spark, folder):
    """Orders in which an unspecified priority is missing."""
    priority = F.col("o_orderpriority")
    return scan(spark, folder, "orders").withColumn(
        "o_orderpriority", F.when(priority != "4-NOT SPECIFIED", priority))


def solvent_customers(spark, folder):
    return scan(spark, folder, "customer").filter(F.col("c_acctbal") >= 0)


SCHEMA_RULE = {"type": "schema_conformance", "name": "order_columns",
               "columns": ["o_orderkey", "o_custkey", "o_comment"]}
TYPED_RULE = {"type": "schema_conformance", "name": "order_types", "severity": "warning",
              "types": {"o_orderkey": "bigint", "o_totalprice": "decimal(12,2)"}}
PRIORITY_RULE = {"type": "completeness", "name": "priority_present", "column": "o_orderpriority",
                 "maxNullRate": 0.1}
CUSTOMER_RULE = {"type": "completeness", "name": "customer_present", "column": "o_custkey"}
KEY_RULE = {"type": "uniqueness", "name": "order_key_unique", "columns": ["o_orderkey"]}
FRESH_RULE = {"type": "freshness", "name": "orders_recent", "severity": "warning",
              "column": "o_orderdate", "maxAgeMinutes": 1440}
REFERENCE_RULE = {"type": "referential_integrity", "name": "customer_known", "column": "o_custkey",
                  "referenceTable": "silver.customer", "referenceColumn": "c_custkey"}
COUNT_RULE = {"type": "row_count_min", "name": "enough_orders", "minRows": 1000}
PRICE_RULE = {"type": "business_rule", "name": "price_positive", "severity": "warning",
              "predicate": "o_totalprice > 5000", "maxViolationRate": 0.001}
STATUS_RULE = {"type": "business_rule", "name": "status_known",
               "predicate": "o_orderstatus IN ('F', 'O', 'P')"}

ORDER_ROWS = {
    "order_columns": row(
        "SELECT count(*) AS total FROM orders", "bronze.orders", "schema_conformance",
        "order_columns", "total < 0", "2", "3", "'missing columns: o_comment'"),
    "order_types": row(
        "SELECT count(*) AS total FROM orders", "bronze.orders", "schema_conformance",
        "order_types", "total < 0", "1", "2",
        "'wrong types: o_totalprice: double instead of decimal(12,2)'", "warning"),
    "priority_present": row(
        "SELECT avg(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1.0 ELSE 0.0 END) AS m FROM orders",
        "bronze.orders", "completeness", "priority_present", "m <= 0.1", "m", "0.1",
        "'null rate ' || printf('%.4f', m) || ' exceeds 0.1000 for column o_orderpriority'"),
    "customer_present": row(
        "SELECT avg(CASE WHEN o_custkey IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM orders",
        "bronze.orders", "completeness", "customer_present", "m <= 0", "m", "0", "''"),
    "order_key_unique": row(
        "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders)) AS m FROM orders",
        "bronze.orders", "uniqueness", "order_key_unique", "m = 0", "m", "0",
        "m || ' duplicate rows on key o_orderkey'"),
    "orders_recent": row(
        "SELECT (epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(max(o_orderdate))) / 60000.0 AS m FROM orders",
        "bronze.orders", "freshness", "orders_recent", "m <= 1440", "m", "1440",
        "'latest record is ' || printf('%.1f', CAST(m AS DOUBLE)) || ' minutes old, SLA is 1440.0'", "warning"),
    "customer_known": row(
        "SELECT count(*) AS m FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN "
        "(SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
        "bronze.orders", "referential_integrity", "customer_known", "m = 0", "m", "0",
        "m || ' values in o_custkey are absent from silver.customer'"),
    "enough_orders": row(
        "SELECT count(*) AS m FROM orders", "bronze.orders", "row_count_min", "enough_orders",
        "m >= 1000", "m", "1000", "m || ' rows is below the minimum of 1000'"),
    "price_positive": row(
        "SELECT count(*) FILTER (NOT coalesce(o_totalprice > 5000, FALSE)) AS n, "
        "n / count(*) AS m FROM orders",
        "bronze.orders", "business_rule", "price_positive", "m <= 0.001", "m", "0.001",
        "n || ' rows violate: o_totalprice > 5000'", "warning"),
    "status_known": row(
        "SELECT count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) AS m FROM orders",
        "bronze.orders", "business_rule", "status_known", "m <= 0", "m", "0", "''"),
}
UNION = "\nUNION ALL\n"


@query("dq_schema", ORDER_ROWS["order_columns"] + UNION + ORDER_ROWS["order_types"])
def dq_schema(spark, folder):
    return suite(scan(spark, folder, "orders"), [SCHEMA_RULE, TYPED_RULE], "bronze.orders")


@query("dq_completeness", ORDER_ROWS["priority_present"] + UNION + ORDER_ROWS["customer_present"])
def dq_completeness(spark, folder):
    return suite(dirty_orders(spark, folder), [PRIORITY_RULE, CUSTOMER_RULE], "bronze.orders")


LINE_KEY_RULE = {"type": "uniqueness", "name": "line_key", "columns": ["l_orderkey", "l_linenumber"]}


@query("dq_uniqueness", row(
    "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS m "
    "FROM lineitem", "bronze.lineitem", "uniqueness", "line_key", "m = 0", "m", "0",
    "m || ' duplicate rows on key l_orderkey,l_linenumber'"))
def dq_uniqueness(spark, folder):
    return suite(scan(spark, folder, "lineitem"), [LINE_KEY_RULE], "bronze.lineitem")


EVENT_FRESH_RULE = {"type": "freshness", "name": "events_recent", "column": "ts", "maxAgeMinutes": 2880}


@query("dq_freshness", ORDER_ROWS["orders_recent"])
def dq_freshness(spark, folder):
    return suite(scan(spark, folder, "orders"), [FRESH_RULE], "bronze.orders")


@query("dq_referential", ORDER_ROWS["customer_known"])
def dq_referential(spark, folder):
    return suite(scan(spark, folder, "orders"), [REFERENCE_RULE], "bronze.orders",
                 {"silver.customer": solvent_customers(spark, folder)})


@query("dq_row_count", ORDER_ROWS["enough_orders"])
def dq_row_count(spark, folder):
    return suite(scan(spark, folder, "orders"), [COUNT_RULE], "bronze.orders")


@query("dq_business_rule", ORDER_ROWS["price_positive"] + UNION + ORDER_ROWS["status_known"])
def dq_business_rule(spark, folder):
    return suite(scan(spark, folder, "orders"), [PRICE_RULE, STATUS_RULE], "bronze.orders")


@query("quality_suite", UNION.join(
    ORDER_ROWS[r] for r in ("order_columns", "order_types", "priority_present", "customer_present",
                            "order_key_unique", "orders_recent", "customer_known", "enough_orders",
                            "price_positive", "status_known")))
def quality_suite(spark, folder):
    rules = [SCHEMA_RULE, TYPED_RULE, PRIORITY_RULE, CUSTOMER_RULE, KEY_RULE, FRESH_RULE,
             REFERENCE_RULE, COUNT_RULE, PRICE_RULE, STATUS_RULE]
    return suite(dirty_orders(spark, folder), rules, "bronze.orders",
                 {"silver.customer": solvent_customers(spark, folder)})


@query("quality_summary", "WITH" + EVIDENCE + """
SELECT run_id, count(*) FILTER (status IN ('PASSED', 'FAILED', 'WARNING')) AS checks,
       count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'FAILED') AS failed,
       count(*) FILTER (status = 'WARNING') AS warnings
FROM evidence GROUP BY run_id""")
def quality_summary(spark, folder):
    return dq.quality_summary(evidence(spark, folder))


@query("reconcile_batches", """
WITH counted AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS batch,
         count(*) FILTER (o_orderdate < '2001-01-01') AS landed_rows,
         count(*) FILTER (NOT (o_orderstatus = 'P' AND o_totalprice > 300000)
                          AND o_orderdate >= '1995-03-01') AS written_rows
  FROM orders GROUP BY 1)
SELECT *, landed_rows - written_rows AS missing_rows, landed_rows = written_rows AS reconciled
FROM counted WHERE landed_rows > 0 OR written_rows > 0""")
def reconcile_batches(spark, folder):
    orders = scan(spark, folder, "orders").withColumn("batch", F.date_format("o_orderdate", "yyyy-MM"))
    lost = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000)
    return dq.reconcile_batches(orders.filter(F.col("o_orderdate") < at("2001-01-01")),
                                orders.filter(~lost & (F.col("o_orderdate") >= at("1995-03-01"))), "batch")


DECIMAL_TOTAL = "CAST(sum(CAST(o_totalprice AS DECIMAL(14, 2))) AS DOUBLE)"


@query("parity_ranges", """
WITH changed AS (
  SELECT * REPLACE (CASE WHEN o_orderkey % 101 = 1 THEN NULL ELSE o_orderstatus END AS o_orderstatus)
  FROM orders WHERE o_orderkey % 97 <> 5
  UNION ALL SELECT * FROM orders WHERE o_orderkey % 89 = 3 AND o_orderkey % 97 <> 5 AND o_orderkey % 101 <> 1)
SELECT *, 'left' AS side, CAST(1 AS BIGINT) AS rows FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM changed)
UNION ALL SELECT *, 'right', 1 FROM (SELECT * FROM changed EXCEPT ALL SELECT * FROM orders)""")
def parity_ranges(spark, folder):
    """Orders against a copy with lost, changed and repeated rows."""
    orders, key = scan(spark, folder, "orders"), F.col("o_orderkey")
    status = F.when(key % 101 == 1, F.lit(None)).otherwise(F.col("o_orderstatus"))
    kept = orders.filter(key % 97 != 5)
    twice = kept.filter((key % 89 == 3) & (key % 101 != 1))
    return parity.parity_ranges(orders, kept.withColumn("o_orderstatus", status).unionByName(twice), ["o_orderkey"])


@query("dataset_parity", f"""
WITH a AS (SELECT * FROM orders),
b AS (SELECT * REPLACE (CASE WHEN o_orderdate >= '2001-06-01' AND o_orderstatus = 'F' THEN 'C'
                             ELSE o_orderstatus END AS o_orderstatus)
      FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_totalprice > 480000)),
measures AS (
  SELECT 'rows' AS measure, (SELECT count(*) FROM a) AS l, (SELECT count(*) FROM b) AS r
  UNION ALL SELECT 'schema', 1, 1
  UNION ALL SELECT 'total', (SELECT {DECIMAL_TOTAL} FROM a), (SELECT {DECIMAL_TOTAL} FROM b)
  UNION ALL SELECT 'rows_on_one_side_only',
    (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)),
    (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)))
SELECT measure, CAST(l AS DOUBLE) AS left_value, CAST(r AS DOUBLE) AS right_value,
       CASE WHEN measure = 'rows_on_one_side_only' THEN l = 0 AND r = 0 ELSE l = r END AS agrees
FROM measures""")
def dataset_parity(spark, folder):
    orders = scan(spark, folder, "orders")
    late = (F.col("o_orderdate") >= at("2001-06-01")) & (F.col("o_orderstatus") == "F")
    lost = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 480000)
    other = orders.filter(~lost).withColumn(
        "o_orderstatus", F.when(late, "C").otherwise(F.col("o_orderstatus")))
    return dq.dataset_parity(orders, other, {"total": F.expr(DECIMAL_TOTAL)})


MART_CHECK_ROWS = UNION.join([
    row("SELECT count(*) AS m FROM mart", "mart.revenue", "row_count_min", "has_rows", "m >= 100",
        "m", "100", "''"),
    row("SELECT avg(CASE WHEN n_name IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM mart", "mart.revenue",
        "completeness", "nation_present", "m <= 0", "m", "0", "''"),
    row("SELECT count(*) AS m FROM mart WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey <> 2)",
        "mart.revenue", "referential_integrity", "nation_known", "m = 0", "m", "0",
        "m || ' values in n_name are absent from gold.nation'"),
    row("SELECT abs((SELECT sum(line_count) FROM mart) - (SELECT count(*) FROM lineitem)) AS m",
        "mart.revenue", "aggregate_parity", "parity_lines", "m = 0", "m", "0",
        "'lines differs between mart and gold'"),
])


@query("mart_checks", "WITH mart AS (" + ROLLUP.format(**{t: t for t in ROLLUP_TABLES}) + ")"
       + MART_CHECK_ROWS)
def mart_checks(spark, folder):
    """The mart is stored first: its rules read the stored rows, not the joins behind them."""
    mart = materialise(spark, ROLLUP, {t: scan(spark, folder, t) for t in ROLLUP_TABLES})
    mart = written(spark, mart, scratch_path(spark, "mart"))
    rules = [
        {"type": "row_count_min", "name": "has_rows", "minRows": 100},
        {"type": "completeness", "name": "nation_present", "column": "n_name"},
        {"type": "referential_integrity", "name": "nation_known", "column": "n_name",
         "referenceTable": "gold.nation"},
    ]
    nations = scan(spark, folder, "nation").filter(F.col("n_regionkey") != 2)
    return dq.mart_checks(
        mart, scan(spark, folder, "lineitem"), rules, RUN, "mart.revenue", AS_OF,
        {"lines": (F.sum("line_count"), F.count("*"))}, {"gold.nation": nations})
