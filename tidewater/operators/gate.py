"""Promotion decided from recorded evidence, for many runs at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.names import col
from tidewater.functions.time import instant
from tidewater.operators.conform import latest_by_key
from tidewater.operators.quality import BLOCKING, FAILED, RESULT_COLUMNS, WARNING

OVERRIDDEN = "overridden"
OVERRIDE_CHECK = "promotion_override"
RUN_SCOPE = ["run_id", "dataset_namespace", "dataset_name"]


def gate_decision(results: DataFrame, requested: DataFrame, run_only: bool = False) -> DataFrame:
    """One decision per requested (run_id, dataset_namespace, dataset_name).

    Blocked when there is no evidence, or when a check FAILED and nothing in the run
    overrides it; warnings never block. With `run_only` evidence is matched on the run
    alone. Evidence is first reduced to one row per check and status, so a run with
    very many records still yields lists no longer than its set of checks;
    `failing_rows` and `warning_rows` keep the number of records behind them.
    """
    scope = ["run_id"] if run_only else RUN_SCOPE
    status = F.col("status")
    per_check = results.groupBy(*scope, "check_name", "status").agg(F.count("*").alias("_n"))
    evidence = per_check.groupBy(*scope).agg(
        F.sum("_n").alias("examined"),
        F.sum(F.when(status == FAILED, F.col("_n")).otherwise(0)).alias("failing_rows"),
        F.sum(F.when(status == WARNING, F.col("_n")).otherwise(0)).alias("warning_rows"),
        F.sort_array(F.collect_list(F.when(status == FAILED, F.col("check_name")))).alias("failing"),
        F.sort_array(F.collect_list(F.when(status == WARNING, F.col("check_name")))).alias("warnings"),
        F.bool_or(status == OVERRIDDEN).alias("overridden"))
    decided = requested.select(*RUN_SCOPE).distinct().join(evidence, scope, "left")
    nothing = F.array().cast("array<string>")
    return decided.select(
        *RUN_SCOPE,
        (F.col("examined").isNull()
         | ((F.col("failing_rows") > 0) & ~F.col("overridden"))).alias("blocked"),
        F.coalesce("examined", F.lit(0)).alias("examined"),
        F.coalesce("failing_rows", F.lit(0)).alias("failing_rows"),
        F.coalesce("warning_rows", F.lit(0)).alias("warning_rows"),
        F.coalesce("failing", nothing).alias("failing"),
        F.coalesce("warnings", nothing).alias("warnings"),
        F.coalesce("overridden", F.lit(False)).alias("overridden"))


def override_records(results: DataFrame, requests: DataFrame, now: datetime | str,
                     run_only: bool = False) -> DataFrame:
    """One override record per blocked request.

    `requests` carries run, dataset, `principal` and `reason`; both must be non-blank
    or the request is passed over (see `invalid_overrides`). A run that is not blocked
    gets no record.
    """
    valid = requests.filter(_names_and_reasons())
    blocked = gate_decision(results, valid, run_only).filter("blocked")
    return blocked.join(valid, RUN_SCOPE).select(
        *RUN_SCOPE, F.col("dataset_namespace").alias("zone"),
        F.lit(OVERRIDE_CHECK).alias("check_type"), F.lit(OVERRIDE_CHECK).alias("check_name"),
        F.lit(BLOCKING).alias("severity"), F.lit(OVERRIDDEN).alias("status"),
        F.lit(None).cast("double").alias("metric_value"),
        F.lit(None).cast("double").alias("threshold"),
        F.concat(F.lit("overridden by "), F.col("principal"), F.lit(": "), F.col("reason"),
                 F.lit(" (failing: "), F.array_join("failing", ","), F.lit(")")
                 ).alias("failure_detail"),
        F.lit(None).cast("string").alias("pipeline_run_id"),
        instant(now).cast(results.schema["checked_at"].dataType).alias("checked_at"),
        F.lit(None).cast("bigint").alias("snapshot_id")).select(*RESULT_COLUMNS)


def gate_override(results: DataFrame, requests: DataFrame, now: datetime | str,
                  run_only: bool = False) -> DataFrame:
    """Evidence with the override records added; recorded verdicts stay as they are."""
    return results.select(*RESULT_COLUMNS).unionByName(
        override_records(results, requests, now, run_only))


def _names_and_reasons():
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return said("principal") & said("reason")


def invalid_overrides(requests: DataFrame) -> DataFrame:
    """Requests without a principal or a reason."""
    return requests.filter(~_names_and_reasons())


def gated_promote(df: DataFrame, decisions: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose run, batch or dataset (`on`) the gate lets through; the rest is held back.

    What no decision names is held back too. Where several decisions share the `on`
    values, one that blocks is enough.
    """
    names = [col(c) for c in on]
    passed = (decisions.groupBy(*names).agg(F.bool_or("blocked").alias("_blocked"))
              .filter(~F.col("_blocked")).select(*names))
    return df.join(passed, on, "left_semi").select(*[col(c) for c in df.columns])


def quality_status(results: DataFrame) -> DataFrame:
    """Where each dataset stands: status, time, run and blocking failures of its last run."""
    runs = results.groupBy("dataset_namespace", "dataset_name", "run_id").agg(
        F.max("checked_at").alias("last_checked"),
        F.count_if(F.col("status") == FAILED).alias("blocking_failures"),
        F.count_if(F.col("status") == WARNING).alias("warnings"))
    last = latest_by_key(runs, ["dataset_namespace", "dataset_name"], "last_checked", ["run_id"])
    return last.select(
        "dataset_namespace", "dataset_name", "run_id", "last_checked", "blocking_failures",
        F.when(F.col("blocking_failures") > 0, "failed")
        .when(F.col("warnings") > 0, "warning").otherwise("passed").alias("quality_status"))


def gate_rates(decisions: DataFrame, period: str) -> DataFrame:
    """Share of blocked and of overridden decisions per value of `period`."""
    return decisions.groupBy(col(period)).agg(
        F.count("*").alias("decisions"),
        F.count_if("blocked").alias("blocked_count"),
        F.count_if("overridden").alias("override_count"),
        F.avg(F.col("blocked").cast("double")).alias("block_rate"),
        F.avg(F.col("overridden").cast("double")).alias("override_rate"))


def verify_pipeline(bronze: DataFrame, results: DataFrame, versions: DataFrame,
                    expected: DataFrame) -> DataFrame:
    """Did each pipeline run leave what it should have.

    `expected` holds (pipeline_run_id, dataset_namespace, dataset_name, _batch_id,
    expected_rows). A run is verified when its batch has that many rows, exactly one
    passing row-count record carries its id, and the dataset has a version.
    """
    rows = bronze.groupBy("_batch_id").agg(F.count("*").alias("batch_rows"))
    passing = (results
               .filter((F.col("check_type") == "row_count_min") & (F.col("status") == "PASSED")
                       & (F.col("run_id") == F.col("pipeline_run_id")))
               .groupBy("pipeline_run_id", "dataset_namespace", "dataset_name")
               .agg(F.count("*").alias("passing_results")))
    newest = (versions.groupBy("dataset_namespace", "dataset_name")
              .agg(F.max_by("snapshot_id", F.struct("committed_at", "snapshot_id"))
                   .alias("snapshot_id")))
    joined = (expected.join(rows, "_batch_id", "left")
              .join(passing, ["pipeline_run_id", "dataset_namespace", "dataset_name"], "left")
              .join(newest, ["dataset_namespace", "dataset_name"], "left")
              .na.fill(0, ["batch_rows", "passing_results"]))
    problem = (
        F.when(F.col("batch_rows") != F.col("expected_rows"), "row count")
        .when(F.col("passing_results") != 1, "quality result")
        .when(F.col("snapshot_id").isNull(), "snapshot"))
    return joined.withColumn("problem", problem).withColumn("verified", F.col("problem").isNull())
