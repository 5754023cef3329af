"""Recorded data-quality rules.

A suite turns N rules into N evidence rows. Everything that is a plain aggregate
(row counts, null rates, newest times, business predicates) shares one pass over the
table; each distinct key set and each reference adds one aggregated pass over the
columns it needs. Nothing is brought to the driver.
"""

from __future__ import annotations

import sys
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.names import col
from tidewater.functions.time import age_minutes, instant
from tidewater.operators.relational import orphan_counts

# Fixed values of the evidence rows.
PASSED, FAILED, WARNING = "PASSED", "FAILED", "WARNING"
BLOCKING = "blocking"
SEVERITIES = ("blocking", "warning")

RESULT_DDL = (
    "run_id string NOT NULL, dataset_namespace string NOT NULL, dataset_name string NOT NULL, "
    "zone string NOT NULL, check_type string NOT NULL, check_name string NOT NULL, "
    "severity string NOT NULL, status string NOT NULL, metric_value double, threshold double, "
    "failure_detail string, pipeline_run_id string, checked_at timestamp NOT NULL, "
    "snapshot_id bigint"
)
RESULT_COLUMNS = [part.split()[0] for part in RESULT_DDL.split(", ")]
REQUIRED_RESULT_COLUMNS = [p.split()[0] for p in RESULT_DDL.split(", ") if p.endswith("NOT NULL")]

COMMON_FIELDS = {"type", "name", "severity"}
RULE_FIELDS = {
    "schema_conformance": {"columns", "types"},
    "completeness": {"column", "maxNullRate"},
    "uniqueness": {"columns"},
    "freshness": {"column", "maxAgeMinutes"},
    "referential_integrity": {"column", "referenceTable", "referenceColumn"},
    "row_count_min": {"minRows"},
    "business_rule": {"predicate", "maxViolations", "maxViolationRate"},
}
REQUIRED_FIELDS = {
    "completeness": ("column",),
    "uniqueness": ("columns",),
    "freshness": ("column",),
    "referential_integrity": ("column", "referenceTable"),
    "business_rule": ("predicate",),
}


def check_rules(rules: list[dict]) -> None:
    """Refuse a faulty definition before any job runs."""
    if not rules:
        raise ValueError("a quality suite needs at least one rule")
    for rule in rules:
        kind = rule.get("type")
        if kind not in RULE_FIELDS:
            raise ValueError(f"unsupported check type: {kind}")
        unknown = set(rule) - COMMON_FIELDS - RULE_FIELDS[kind]
        if unknown:
            raise ValueError(f"{kind} does not take {sorted(unknown)}")
        missing = [f for f in REQUIRED_FIELDS.get(kind, ()) if not rule.get(f)]
        if kind == "schema_conformance" and not (rule.get("columns") or rule.get("types")):
            missing = ["columns or types"]
        if missing:
            raise ValueError(f"{kind} needs {missing}")
        if str(rule.get("severity", BLOCKING)).lower() not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}: {rule['severity']}")


def _head(rule: dict) -> list[Column]:
    return [
        F.lit(rule["type"]).alias("check_type"),
        F.lit(rule.get("name", rule["type"])).alias("check_name"),
        F.lit(rule.get("severity", BLOCKING)).alias("severity"),
    ]


def _outcome(rule: dict, ok: Column, metric: Column, threshold: float, detail: Column) -> Column:
    """One rule's verdict as a struct of fixed shape."""
    fails_as = FAILED if rule.get("severity", BLOCKING).lower() == BLOCKING else WARNING
    return F.struct(
        *_head(rule),
        F.when(ok, PASSED).otherwise(fails_as).alias("status"),
        metric.cast("double").alias("metric_value"),
        F.lit(float(threshold)).alias("threshold"),
        F.when(~ok, detail).alias("failure_detail"),
    )


def _schema_outcome(df: DataFrame, rule: dict) -> Column:
    """Column names as listed; with `types`, names and types."""
    types = rule.get("types") or {}
    expected = list(rule.get("columns") or types)
    missing = [c for c in expected if c not in df.columns]
    wrong = [
        f"{c}: {df.schema[c].dataType.simpleString()} instead of {t}"
        for c, t in types.items()
        if c in df.columns and df.schema[c].dataType.simpleString() != t
    ]
    parts = ["missing columns: " + ",".join(missing)] if missing else []
    parts += ["wrong types: " + ", ".join(wrong)] if wrong else []
    found = len(expected) - len(missing) - len(wrong)
    return _outcome(rule, F.lit(not parts), F.lit(found), len(expected), F.lit("; ".join(parts)))


SHARED_PASS = ("row_count_min", "schema_conformance", "completeness", "freshness",
               "business_rule")


def _shared_metric(rule: dict) -> Column | None:
    """The aggregate a rule adds to the shared pass, if it needs more than the row count."""
    kind = rule["type"]
    if kind == "completeness":
        return F.count_if(col(rule["column"]).isNull())
    if kind == "freshness":
        return F.max(col(rule["column"]))
    if kind == "business_rule":
        return F.count_if(~F.coalesce(F.expr(rule["predicate"]), F.lit(False)))
    return None


def _shared_outcome(df: DataFrame, rule: dict, metric: Column, as_of: datetime | str) -> Column:
    kind, total = rule["type"], F.col("_total")
    if kind == "schema_conformance":
        return _schema_outcome(df, rule)
    if kind == "row_count_min":
        least = int(rule.get("minRows", 1))
        return _outcome(rule, total >= least, total, least, F.concat(
            total.cast("string"), F.lit(f" rows is below the minimum of {least}")))
    if kind == "completeness":
        limit = float(rule.get("maxNullRate", 0.0))
        rate = F.when(total == 0, F.lit(0.0)).otherwise(metric / total)
        return _outcome(rule, rate <= limit, rate, limit, F.format_string(
            "null rate %.4f exceeds %.4f for column %s", rate, F.lit(limit), F.lit(rule["column"])))
    if kind == "freshness":
        limit = float(rule.get("maxAgeMinutes", sys.float_info.max))
        age = age_minutes(metric, as_of)
        ok = F.coalesce(age <= limit, F.lit(False))
        detail = F.when(
            metric.isNull(), F.lit(f"no timestamp found in column {rule['column']}")
        ).otherwise(F.format_string(
            "latest record is %.1f minutes old, SLA is %.1f", age, F.lit(limit)))
        return _outcome(rule, ok, age, limit, detail)
    by_rate = "maxViolationRate" in rule
    limit = float(rule["maxViolationRate"] if by_rate else rule.get("maxViolations", 0))
    value = F.when(total == 0, F.lit(0.0)).otherwise(metric / total) if by_rate else metric
    return _outcome(rule, value <= limit, value, limit, F.concat(
        metric.cast("string"), F.lit(" rows violate: " + rule["predicate"])))


def _uniqueness(df: DataFrame, rule: dict) -> DataFrame:
    """Surplus rows on the key; two-level aggregation, so a hot key stays cheap."""
    columns = rule["columns"]
    copies = df.groupBy(*[col(c) for c in columns]).agg(F.count("*").alias("_n"))
    surplus = copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("_surplus"))
    n = F.col("_surplus")
    return surplus.select(_outcome(rule, n == 0, n, 0.0, F.concat(
        n.cast("string"), F.lit(" duplicate rows on key " + ",".join(columns)))).alias("o"))


def _referential(df: DataFrame, rule: dict, refs: dict[str, DataFrame]) -> DataFrame:
    column, table = rule["column"], rule["referenceTable"]
    orphans = orphan_counts(df, column, refs[table], rule.get("referenceColumn", column))
    total = orphans.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("_orphans"))
    n = F.col("_orphans")
    return total.select(_outcome(rule, n == 0, n, 0.0, F.concat(
        n.cast("string"), F.lit(f" values in {column} are absent from {table}"))).alias("o"))


def quality_suite(df: DataFrame, rules: list[dict], run_id: str, dataset: str,
                  as_of: datetime | str, refs: dict[str, DataFrame] | None = None,
                  snapshot_id: int | None = None,
                  pipeline_run_id: str | None = None) -> DataFrame:
    """One evidence row per rule for `dataset` ("namespace.table"), pass or fail.

    `refs` holds the reference tables by the name the rules use.
    """
    check_rules(rules)
    refs = refs or {}
    absent = {r["referenceTable"] for r in rules if r["type"] == "referential_integrity"} - set(refs)
    if absent:
        raise ValueError(f"reference tables not given: {sorted(absent)}")
    if dataset.count(".") != 1:
        raise ValueError(f"dataset must be namespace.table: {dataset}")
    namespace, name = dataset.split(".")

    parts = []
    shared = [(f"_m{i}", r) for i, r in enumerate(rules) if r["type"] in SHARED_PASS]
    if shared:
        metrics = [(name, _shared_metric(r)) for name, r in shared]
        totals = df.agg(F.count("*").alias("_total"),
                        *[m.alias(name) for name, m in metrics if m is not None])
        verdicts = F.array(*[_shared_outcome(df, r, F.col(name), as_of) for name, r in shared])
        parts.append(totals.select(F.inline(verdicts)))
    for rule in rules:
        if rule["type"] == "uniqueness":
            parts.append(_uniqueness(df, rule).select("o.*"))
        elif rule["type"] == "referential_integrity":
            parts.append(_referential(df, rule, refs).select("o.*"))
    outcomes = reduce(DataFrame.unionByName, parts)
    return outcomes.select(
        F.lit(run_id).alias("run_id"), F.lit(namespace).alias("dataset_namespace"),
        F.lit(name).alias("dataset_name"), F.lit(namespace).alias("zone"),
        "check_type", "check_name", "severity", "status", "metric_value", "threshold",
        "failure_detail", F.lit(pipeline_run_id).cast("string").alias("pipeline_run_id"),
        instant(as_of).alias("checked_at"), F.lit(snapshot_id).cast("bigint").alias("snapshot_id"))


def quality_summary(results: DataFrame) -> DataFrame:
    """Checks, passed, failed and warnings per run."""
    is_check = F.col("status").isin(PASSED, FAILED, WARNING)
    return results.groupBy("run_id").agg(
        F.count_if(is_check).alias("checks"),
        F.count_if(F.col("status") == PASSED).alias("passed"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
        F.count_if(F.col("status") == WARNING).alias("warnings"))


def reconcile_batches(landed: DataFrame, written: DataFrame, batch_col: str) -> DataFrame:
    """Landed against written rows per batch, batches of either side included."""
    count = lambda df, name: df.groupBy(
        col(batch_col).alias("batch")).agg(F.count("*").alias(name))
    both = count(landed, "landed_rows").join(count(written, "written_rows"), "batch", "full_outer")
    both = both.na.fill(0, ["landed_rows", "written_rows"])
    missing = F.col("landed_rows") - F.col("written_rows")
    return both.withColumn("missing_rows", missing).withColumn("reconciled", missing == 0)


def _measures(df: DataFrame, aggs: dict[str, Column], side: str) -> DataFrame:
    """One aggregate pass as rows of (measure, value of this side)."""
    totals = df.agg(*[x.cast("double").alias(n) for n, x in aggs.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("measure"), col(n).alias(side)) for n in aggs])
    return totals.select(F.inline(rows))


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides' measures in one row each; a few rows, brought together by name."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy("measure").agg(
        F.max("left_value").alias("left_value"), F.max("right_value").alias("right_value"))


def dataset_parity(a: DataFrame, b: DataFrame, aggs: dict[str, Column] | None = None) -> DataFrame:
    """Do two answers agree: one row per measure with both values.

    Contents are compared as bags in a single aggregation: rows of `a` count +1, rows
    of `b` count -1, and what does not cancel out is on one side only.
    """
    types = lambda df: {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same_schema = types(a) == types(b)
    wanted = {"rows": F.count("*"), **(aggs or {})}
    left = _measures(a, {**wanted, "schema": F.lit(1)}, "left_value")
    right = _measures(b, {**wanted, "schema": F.lit(int(same_schema))}, "right_value")
    parts = _side_by_side(left, right)
    if same_schema:
        columns = [col(c) for c in a.columns]
        signed = a.select(*columns, F.lit(1).alias("_sign")).unionByName(
            b.select(*columns, F.lit(-1).alias("_sign")))
        surplus = signed.groupBy(*columns).agg(F.sum("_sign").alias("_d"))
        one_sided = lambda d: F.coalesce(
            F.sum(F.greatest(d, F.lit(0))), F.lit(0)).cast("double")
        parts = parts.unionByName(surplus.agg(
            F.lit("rows_on_one_side_only").alias("measure"),
            one_sided(F.col("_d")).alias("left_value"), one_sided(-F.col("_d")).alias("right_value")))
    none_left = (F.col("left_value") == 0) & (F.col("right_value") == 0)
    return parts.withColumn("agrees", F.when(
        F.col("measure") == "rows_on_one_side_only", none_left
    ).otherwise(F.col("left_value").eqNullSafe(F.col("right_value"))))


def mart_checks(mart: DataFrame, gold: DataFrame, rules: list[dict], run_id: str, dataset: str,
                as_of: datetime | str, parity: dict[str, tuple[Column, Column]],
                refs: dict[str, DataFrame] | None = None) -> DataFrame:
    """A mart's own rules plus one blocking check per aggregate it must share with gold.

    `parity` maps a measure name to (expression over the mart, expression over gold).
    """
    evidence = quality_suite(mart, rules, run_id, dataset, as_of, refs)
    values = _side_by_side(
        _measures(mart, {n: m for n, (m, _) in parity.items()}, "left_value"),
        _measures(gold, {n: g for n, (_, g) in parity.items()}, "right_value"))
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    agrees = F.coalesce(gap == 0, F.lit(False))
    namespace, name = dataset.split(".")
    return evidence.unionByName(values.select(
        F.lit(run_id).alias("run_id"), F.lit(namespace).alias("dataset_namespace"),
        F.lit(name).alias("dataset_name"), F.lit(namespace).alias("zone"),
        F.lit("aggregate_parity").alias("check_type"),
        F.concat(F.lit("parity_"), "measure").alias("check_name"),
        F.lit(BLOCKING).alias("severity"),
        F.when(agrees, PASSED).otherwise(FAILED).alias("status"), gap.alias("metric_value"),
        F.lit(0.0).alias("threshold"),
        F.when(~agrees, F.concat("measure", F.lit(" differs between mart and gold")))
        .alias("failure_detail"),
        F.lit(None).cast("string").alias("pipeline_run_id"), instant(as_of).alias("checked_at"),
        F.lit(None).cast("bigint").alias("snapshot_id")))
