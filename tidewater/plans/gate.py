"""Promotion decisions over recorded evidence."""

from pyspark.sql import functions as F

from tidewater.functions.text import joined
from tidewater.operators import gate
from tidewater.operators.gate import RUN_SCOPE
from tidewater.operators.quality import RESULT_COLUMNS
from tidewater.plans.inputs import (
    BRONZE_ORDERS, DECISIONS, EVIDENCE, at, bronze_orders, evidence, requested,
)
from tidewater.plans.registry import query
from tidewater.sources.extract import scan


def _decisions(spark, folder):
    return gate.gate_decision(evidence(spark, folder), requested(spark, folder))


@query("gate_decision", "WITH" + DECISIONS + "SELECT * FROM decisions")
def gate_decision(spark, folder):
    return _decisions(spark, folder).withColumns(
        {"failing": joined(F.col("failing")), "warnings": joined(F.col("warnings"))})


@query("gate_decision_run_only", "WITH" + EVIDENCE + """,
runs AS (
  SELECT 'run-' || c_custkey AS run_id FROM customer UNION SELECT run_id FROM evidence)
SELECT r.run_id, count(e.run_id) = 0 OR (count(*) FILTER (e.status = 'FAILED') > 0
         AND count(*) FILTER (e.status = 'overridden') = 0) AS blocked, count(e.run_id) AS examined
FROM runs r LEFT JOIN evidence e USING (run_id) GROUP BY r.run_id""")
def gate_decision_run_only(spark, folder):
    """Evidence matched on the run alone, whatever dataset it was recorded for."""
    asked = requested(spark, folder).select("run_id").distinct().select(
        "run_id", F.lit("bronze").alias("dataset_namespace"), F.lit("all").alias("dataset_name"))
    return gate.gate_decision(evidence(spark, folder), asked, run_only=True).select(
        "run_id", "blocked", "examined")


def _override_requests(spark, folder):
    return scan(spark, folder, "customer").select(
        F.concat(F.lit("run-"), F.col("c_custkey").cast("string")).alias("run_id"),
        F.lit("bronze").alias("dataset_namespace"), F.lit("click").alias("dataset_name"),
        F.concat(F.lit("steward-"), F.col("c_nationkey").cast("string")).alias("principal"),
        F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise("known upstream defect")
        .alias("reason"))


@query("gate_override", "WITH" + DECISIONS + f"""
SELECT * FROM evidence
UNION ALL
SELECT run_id, dataset_namespace, dataset_name, dataset_namespace, 'promotion_override',
       'promotion_override', 'blocking', 'overridden', NULL, NULL,
       'overridden by steward-' || c_nationkey || ': known upstream defect (failing: ' || failing || ')',
       NULL, TIMESTAMP '2024-02-01 00:00:00', NULL
FROM decisions JOIN customer ON run_id = 'run-' || c_custkey
WHERE blocked AND dataset_name = 'click' AND c_mktsegment <> 'BUILDING'""")
def gate_override(spark, folder):
    return gate.gate_override(evidence(spark, folder), _override_requests(spark, folder),
                              "2024-02-01 00:00:00").select(*RESULT_COLUMNS)


@query("gated_promote", "WITH" + DECISIONS + """
SELECT e.* FROM events e JOIN decisions d ON d.run_id = 'run-' || e.user_id
  AND d.dataset_name = e.event_type
WHERE NOT d.blocked""")
def gated_promote(spark, folder):
    rows = scan(spark, folder, "events").withColumns({
        "run_id": F.concat(F.lit("run-"), F.col("user_id").cast("string")),
        "dataset_name": F.col("event_type")})
    promoted = gate.gated_promote(rows, _decisions(spark, folder), ["run_id", "dataset_name"])
    return promoted.drop("run_id", "dataset_name")


STATUS = EVIDENCE + """,
runs AS (
  SELECT dataset_namespace, dataset_name, run_id, max(checked_at) AS last_checked,
         count(*) FILTER (status = 'FAILED') AS blocking_failures,
         count(*) FILTER (status = 'WARNING') AS warnings
  FROM evidence GROUP BY ALL),
status AS (
  SELECT dataset_namespace, dataset_name, run_id, last_checked, blocking_failures,
         CASE WHEN blocking_failures > 0 THEN 'failed' WHEN warnings > 0 THEN 'warning'
              ELSE 'passed' END AS quality_status
  FROM runs QUALIFY row_number() OVER (PARTITION BY dataset_namespace, dataset_name
                                       ORDER BY last_checked DESC, run_id) = 1)
"""


@query("quality_status", "WITH" + STATUS + "SELECT * FROM status")
def quality_status(spark, folder):
    return gate.quality_status(evidence(spark, folder))


@query("gate_rates", "WITH" + DECISIONS + """,
days AS (SELECT run_id, dataset_namespace, dataset_name, CAST(max(checked_at) AS DATE) AS decided_on
         FROM evidence GROUP BY ALL)
SELECT decided_on, count(*) AS decisions, count(*) FILTER (blocked) AS blocked_count,
       count(*) FILTER (overridden) AS override_count,
       avg(CASE WHEN blocked THEN 1.0 ELSE 0.0 END) AS block_rate,
       avg(CASE WHEN overridden THEN 1.0 ELSE 0.0 END) AS override_rate
FROM decisions JOIN days USING (run_id, dataset_namespace, dataset_name) GROUP BY decided_on""")
def gate_rates(spark, folder):
    days = evidence(spark, folder).groupBy(*RUN_SCOPE).agg(
        F.to_date(F.max("checked_at")).alias("decided_on"))
    return gate.gate_rates(_decisions(spark, folder).join(days, RUN_SCOPE), "decided_on")


@query("verify_pipeline", "WITH" + BRONZE_ORDERS + """,
batches AS (SELECT _batch_id, count(*) AS n FROM bronze_orders GROUP BY _batch_id),
checked AS (
  SELECT _batch_id, n AS batch_rows, CASE WHEN _batch_id LIKE '%-07' THEN n + 1 ELSE n END AS expected_rows,
         CAST(CASE WHEN n < 20 THEN 0 WHEN _batch_id LIKE '%-03' THEN 2 ELSE 1 END AS BIGINT) AS passing_results
  FROM batches),
commits AS (
  SELECT strftime(o_orderdate, '%Y') AS year, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS snapshot_id
  FROM orders WHERE o_orderdate < '2001-01-01' GROUP BY 1)
SELECT 'bronze' AS dataset_namespace, 'orders_' || _batch_id[:4] AS dataset_name, 'pipe-' || _batch_id AS pipeline_run_id,
       _batch_id, expected_rows, batch_rows, passing_results,
       snapshot_id,
       CASE WHEN batch_rows <> expected_rows THEN 'row count'
            WHEN passing_results <> 1 THEN 'quality result'
            WHEN snapshot_id IS NULL THEN 'snapshot' END AS problem,
       batch_rows = expected_rows AND passing_results = 1 AND snapshot_id IS NOT NULL AS verified
FROM checked LEFT JOIN commits ON year = _batch_id[:4]""")
def verify_pipeline(spark, folder):
    orders = bronze_orders(spark, folder)
    batch, run = F.col("_batch_id"), F.concat(F.lit("pipe-"), F.col("_batch_id"))
    counted = orders.groupBy("_batch_id").agg(F.count("*").alias("n"))
    dataset = F.concat(F.lit("orders_"), F.substring("_batch_id", 1, 4)).alias("dataset_name")
    expected = counted.select(
        run.alias("pipeline_run_id"), F.lit("bronze").alias("dataset_namespace"),
        dataset, batch,
        (F.col("n") + F.when(batch.like("%-07"), 1).otherwise(0)).alias("expected_rows"))
    copies = F.when(batch.like("%-03"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    results = counted.select(
        run.alias("run_id"), run.alias("pipeline_run_id"), F.lit("bronze").alias("dataset_namespace"),
        dataset, F.lit("row_count_min").alias("check_type"),
        F.when(F.col("n") >= 20, "PASSED").otherwise("FAILED").alias("status"), F.explode(copies))
    commits = orders.filter(F.col("o_orderdate") < at("2001-01-01")).select(
        F.lit("bronze").alias("dataset_namespace"), dataset,
        F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("committed_at"))
    return gate.verify_pipeline(orders, results, commits, expected)
