"""Inputs several queries share, each with the SQL that derives the same rows.

The given tables stand in for lakehouse material: orders are deliveries and commits,
lineitem rows are files and tasks, events are evidence records and topic rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.conform import stamp
from tidewater.sources.extract import scan
from tidewater.streaming.cdc import CdcRules, envelope

NOW = datetime(2026, 8, 1, 9, 0, 0)
AS_OF = datetime(2024, 2, 1, 0, 0, 0)


def at(text: str):
    """A zone-less timestamp literal."""
    return F.lit(text).cast("timestamp_ntz")


# Orders stamped with the month they were delivered in.
def bronze_orders(spark: SparkSession, folder: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM")
    return stamp(scan(spark, folder, "orders"), month,
                 F.concat(F.lit("s3://landing/orders/"), month, F.lit(".csv")), NOW)


BRONZE_ORDERS = """
bronze_orders AS (
  SELECT *, strftime(o_orderdate, '%Y-%m') AS _batch_id,
         TIMESTAMP '2026-08-01 09:00:00' AS _ingested_at,
         's3://landing/orders/' || strftime(o_orderdate, '%Y-%m') || '.csv' AS _source_file
  FROM orders)
"""


# Quality evidence: one record per event.
def evidence(spark: SparkSession, folder: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    bad = F.col("value") >= 130
    override = F.col("value") >= 280
    return scan(spark, folder, "events").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.lit("bronze").alias("dataset_namespace"), F.col("event_type").alias("dataset_name"),
        F.lit("bronze").alias("zone"),
        F.when(override, "promotion_override").otherwise("completeness").alias("check_type"),
        F.when(override, "promotion_override").otherwise(
            F.concat(F.lit("rule_"), k.cast("string"))).alias("check_name"),
        F.when(k < 70, "blocking").otherwise("warning").alias("severity"),
        F.when(override, "overridden").when(~bad, "PASSED").when(k < 70, "FAILED")
        .otherwise("WARNING").alias("status"),
        F.col("value").alias("metric_value"), F.lit(130.0).alias("threshold"),
        F.when(bad, F.concat(F.lit("above the threshold in "), F.col("event_type")))
        .alias("failure_detail"),
        F.concat(F.lit("pipe-"), F.col("user_id").cast("string")).alias("pipeline_run_id"),
        F.col("ts").alias("checked_at"), F.col("event_id").alias("snapshot_id"))


EVIDENCE = """
evidence AS (
  SELECT 'run-' || user_id AS run_id, 'bronze' AS dataset_namespace,
         event_type AS dataset_name, 'bronze' AS zone,
         CASE WHEN value >= 280 THEN 'promotion_override' ELSE 'completeness' END AS check_type,
         CASE WHEN value >= 280 THEN 'promotion_override' ELSE 'rule_' || k END AS check_name,
         CASE WHEN k < 70 THEN 'blocking' ELSE 'warning' END AS severity,
         CASE WHEN value >= 280 THEN 'overridden' WHEN value < 130 THEN 'PASSED'
              WHEN k < 70 THEN 'FAILED' ELSE 'WARNING' END AS status,
         value AS metric_value, CAST(130 AS DOUBLE) AS threshold,
         CASE WHEN value >= 130 THEN 'above the threshold in ' || event_type END AS failure_detail,
         'pipe-' || user_id AS pipeline_run_id, ts AS checked_at, event_id AS snapshot_id
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events))
"""


# Promotions asked for: every run with evidence, and one per customer, most without any.
def requested(spark: SparkSession, folder: str) -> DataFrame:
    scope = ["run_id", "dataset_namespace", "dataset_name"]
    asked = scan(spark, folder, "customer").select(
        F.concat(F.lit("run-"), F.col("c_custkey").cast("string")).alias("run_id"),
        F.lit("bronze").alias("dataset_namespace"), F.lit("click").alias("dataset_name"))
    return evidence(spark, folder).select(*scope).unionByName(asked).distinct()


REQUESTED = """
requested AS (
  SELECT run_id, dataset_namespace, dataset_name FROM evidence
  UNION SELECT 'run-' || c_custkey, 'bronze', 'click' FROM customer)
"""

DECISIONS = EVIDENCE + "," + REQUESTED + """,
decisions AS (
  SELECT r.run_id, r.dataset_namespace, r.dataset_name,
         count(e.run_id) = 0
           OR (count(*) FILTER (e.status = 'FAILED') > 0
               AND count(*) FILTER (e.status = 'overridden') = 0) AS blocked,
         count(e.run_id) AS examined,
         count(*) FILTER (e.status = 'FAILED') AS failing_rows,
         count(*) FILTER (e.status = 'WARNING') AS warning_rows,
         coalesce(string_agg(DISTINCT e.check_name, ',' ORDER BY e.check_name)
                  FILTER (e.status = 'FAILED'), '') AS failing,
         coalesce(string_agg(DISTINCT e.check_name, ',' ORDER BY e.check_name)
                  FILTER (e.status = 'WARNING'), '') AS warnings,
         count(*) FILTER (e.status = 'overridden') > 0 AS overridden
  FROM requested r LEFT JOIN evidence e USING (run_id, dataset_namespace, dataset_name)
  GROUP BY ALL)
"""


# Orders as commits of five tables, lineitem rows as the files they added.
def versions(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "orders").select(
        F.concat(F.lit("table_"), (F.col("o_orderkey") % 5).cast("string")).alias("table_name"),
        F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("committed_at"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("committed").alias("status"),
        F.expr("CAST(o_totalprice AS BIGINT) div 100000 + 1").alias("manifest_count"))


VERSIONS = """
versions AS (
  SELECT 'table_' || (o_orderkey % 5) AS table_name, o_orderkey AS snapshot_id,
         o_orderdate AS committed_at,
         CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'committed' END AS status,
         CAST(trunc(o_totalprice) AS BIGINT) // 100000 + 1 AS manifest_count
  FROM orders)
"""


def files(spark: SparkSession, folder: str, scheme: str = "s3://") -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    table = F.concat(F.lit("table_"), (F.col("l_orderkey") % 5).cast("string"))
    size = F.round(F.col("l_extendedprice") * 1000).cast("bigint")
    return scan(spark, folder, "lineitem").select(
        table.alias("table_name"), F.col("l_orderkey").alias("snapshot_id"),
        F.concat_ws("-", F.concat(F.lit(scheme + "lake/"), table, F.lit("/f")),
                    text("l_orderkey"), text("l_linenumber"), text("l_partkey"),
                    text("l_suppkey"), size.cast("string")).alias("path"),
        size.alias("size_bytes"), F.col("l_shipdate").alias("created_at"),
        F.col("l_returnflag").alias("flag"))


FILES = """
files AS (
  SELECT 'table_' || (l_orderkey % 5) AS table_name, l_orderkey AS snapshot_id,
         's3://lake/table_' || (l_orderkey % 5) || '/f-' || l_orderkey || '-' || l_linenumber
           || '-' || l_partkey || '-' || l_suppkey || '-'
           || CAST(round(l_extendedprice * 1000) AS BIGINT) AS path,
         CAST(round(l_extendedprice * 1000) AS BIGINT) AS size_bytes,
         l_shipdate AS created_at, l_returnflag AS flag
  FROM lineitem)
"""


# Events as rows of a change topic. Purchases are delivered twice.
IMAGE = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("email", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("amount", T.DoubleType())])
ENVELOPE = envelope(IMAGE)
RULES = CdcRules(
    key="user_id", allowed_ops=("c", "r", "u", "d"),
    warnings={"active_has_email": "status <> 'active' OR email IS NOT NULL"})


def topic_rows(events: DataFrame, redeliver: bool = True) -> DataFrame:
    """Works on the events table and on a stream of it."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    op = (F.when(F.col("value") >= 250, "x").when(F.col("event_type") == "signup", "c")
          .when(F.col("event_type") == "view", "r").when(F.col("event_type") == "error", "d")
          .otherwise("u"))
    image = F.struct(
        F.when(k != 0, F.col("user_id")).alias("user_id"),
        F.when(k >= 10, F.concat(F.lit("u"), F.col("user_id").cast("string"),
                                 F.lit("@example.com"))).alias("email"),
        F.when(F.col("event_type").isin("purchase", "click"), "active").otherwise("inactive")
        .alias("status"),
        F.col("value").alias("amount"))
    gone = F.col("event_type") == "error"
    source = F.struct(F.when(k != 1, F.unix_micros(F.col("ts").cast("timestamp"))).alias("ts_us"))
    value = F.to_json(F.struct(
        op.alias("op"), F.when(gone, image).alias("before"), F.when(~gone, image).alias("after"),
        source.alias("source")))
    first = F.col("ts").cast("timestamp")
    times = F.when(
        (F.col("event_type") == "purchase") & F.lit(redeliver),
        F.array(first, first + F.expr("INTERVAL 1 HOUR"))).otherwise(F.array(first))
    return events.select(
        F.lit("app.events").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"), F.col("user_id").cast("string").alias("key"),
        value.alias("value"), F.explode(times).alias("timestamp"))


DECODED = """
decoded AS (
  SELECT 'app.events-' || (user_id % 3) || '-' || event_id AS event_id,
         'app.events' AS source_topic, CAST(user_id % 3 AS INTEGER) AS source_partition,
         event_id AS source_offset,
         CASE WHEN value >= 250 THEN 'x' WHEN event_type = 'signup' THEN 'c'
              WHEN event_type = 'view' THEN 'r' WHEN event_type = 'error' THEN 'd'
              ELSE 'u' END AS operation,
         CASE WHEN k <> 0 THEN user_id END AS user_id,
         CASE WHEN k >= 10 THEN 'u' || user_id || '@example.com' END AS email,
         CASE WHEN event_type IN ('purchase', 'click') THEN 'active' ELSE 'inactive' END AS status,
         value AS amount, CASE WHEN k <> 1 THEN ts END AS event_time, ts AS received_at,
         CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS copies
  FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events)),
judged AS (
  SELECT *, concat_ws(',', CASE WHEN user_id IS NULL THEN 'key_present' END,
                      CASE WHEN operation = 'x' THEN 'operation_allowed' END) AS reason,
         email IS NULL AND status = 'active' AS no_email
  FROM decoded),
accepted AS (
  SELECT * EXCLUDE (event_time), coalesce(event_time, TIMESTAMP '2024-02-01 00:00:00') AS event_time
  FROM judged WHERE reason = '')
"""
