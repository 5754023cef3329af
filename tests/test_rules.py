"""Quality rules, gate and override: boundaries and refusals."""

import pytest
from pyspark.sql import functions as F

from tests.compare import plan
from tidewater.operators import gate, parity, telemetry
from tidewater.operators.quality import RESULT_COLUMNS, quality_suite, reconcile_batches

AS_OF = "2026-08-02 00:00:00"


def outcome(df, rule, **options):
    return quality_suite(df, [rule], "r", "bronze.t", AS_OF, **options).first()


def test_unknown_fields_types_and_severities_are_refused(spark):
    df = spark.range(1)
    for rule in ({"type": "row_count_min", "threshold": 5}, {"type": "magic"},
                 {"type": "row_count_min", "severity": "fatal"}, {"type": "completeness"},
                 {"type": "schema_conformance"}):
        with pytest.raises(ValueError):
            quality_suite(df, [rule], "r", "bronze.t", AS_OF)
    with pytest.raises(ValueError):
        quality_suite(df, [], "r", "bronze.t", AS_OF)
    with pytest.raises(ValueError, match="not given"):
        outcome(df, {"type": "referential_integrity", "column": "id", "referenceTable": "x.y"})


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a int, t timestamp")
    assert outcome(empty, {"type": "completeness", "column": "a"})["status"] == "PASSED"
    assert outcome(empty, {"type": "uniqueness", "columns": ["a"]})["status"] == "PASSED"
    assert outcome(empty, {"type": "row_count_min"})["failure_detail"] == "0 rows is below the minimum of 1"
    stale = outcome(empty, {"type": "freshness", "column": "t", "maxAgeMinutes": 5})
    assert (stale["status"], stale["metric_value"]) == ("FAILED", None)
    assert stale["failure_detail"] == "no timestamp found in column t"
    rate = outcome(empty, {"type": "business_rule", "predicate": "a > 0", "maxViolationRate": 0.0})
    assert rate["status"] == "PASSED"


def test_uniqueness_counts_null_keys_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, 1)], "a int, b int")
    row = outcome(df, {"type": "uniqueness", "columns": ["a", "b"]})
    assert (row["metric_value"], row["failure_detail"]) == (1.0, "1 duplicate rows on key a,b")


def test_referential_counts_rows_and_skips_nulls(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    refs = {"ref.t": spark.createDataFrame([("y",), ("y",)], "c string")}
    row = outcome(df, {"type": "referential_integrity", "column": "c", "referenceTable": "ref.t"}, refs=refs)
    assert (row["metric_value"], row["failure_detail"]) == (2.0, "2 values in c are absent from ref.t")


def test_completeness_boundary(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert outcome(df, {"type": "completeness", "column": "a", "maxNullRate": 0.5})["status"] == "PASSED"
    assert outcome(df, {"type": "completeness", "column": "a", "maxNullRate": 0.49})["status"] == "FAILED"


def test_schema_names_are_case_sensitive_and_types_optional(spark):
    df = spark.createDataFrame([(1,)], "a int")
    row = outcome(df, {"type": "schema_conformance", "columns": ["A", "a"]})
    assert (row["metric_value"], row["threshold"], row["failure_detail"]) == (1.0, 2.0, "missing columns: A")
    typed = outcome(df, {"type": "schema_conformance", "types": {"a": "bigint"}, "severity": "warning"})
    assert typed["status"] == "WARNING"


def test_business_rule_counts_unknown_as_violation(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "a int")
    row = outcome(df, {"type": "business_rule", "predicate": "a > 0", "maxViolations": 1})
    assert (row["status"], row["metric_value"]) == ("FAILED", 2.0)


def test_result_columns_and_ids(spark):
    row = outcome(spark.range(1), {"type": "row_count_min"}, snapshot_id=7, pipeline_run_id="p")
    assert list(row.asDict()) == RESULT_COLUMNS
    assert (row["snapshot_id"], row["pipeline_run_id"], row["check_name"]) == (7, "p", "row_count_min")


def evidence(spark, rows):
    df = spark.createDataFrame(rows, "run_id string, check_name string, status string")
    return df.select(
        "run_id", F.lit("bronze").alias("dataset_namespace"), F.lit("t").alias("dataset_name"),
        F.lit("bronze").alias("zone"), F.lit("x").alias("check_type"), "check_name",
        F.lit("blocking").alias("severity"), "status", F.lit(0.0).alias("metric_value"),
        F.lit(0.0).alias("threshold"), F.lit(None).cast("string").alias("failure_detail"),
        F.lit(None).cast("string").alias("pipeline_run_id"),
        F.lit("2026-08-01").cast("timestamp").alias("checked_at"),
        F.lit(1).cast("bigint").alias("snapshot_id"))


def ask(spark, *runs):
    return spark.createDataFrame([(r, "bronze", "t") for r in runs],
                                 "run_id string, dataset_namespace string, dataset_name string")


def test_gate(spark):
    held = evidence(spark, [("ok", "a", "PASSED"), ("ok", "b", "WARNING"), ("bad", "a", "FAILED"),
                            ("bad", "a", "FAILED"), ("let", "a", "FAILED"), ("let", "o", "overridden")])
    seen = {r["run_id"]: r for r in gate.gate_decision(held, ask(spark, "ok", "bad", "let", "none")).collect()}
    assert {k: v["blocked"] for k, v in seen.items()} == {
        "ok": False, "bad": True, "let": False, "none": True}
    assert seen["bad"]["failing"] == ["a"] and seen["bad"]["failing_rows"] == 2
    assert seen["ok"]["warnings"] == ["b"] and seen["none"]["examined"] == 0


def test_override_needs_names_and_a_block(spark):
    held = evidence(spark, [("ok", "a", "PASSED"), ("bad", "a", "FAILED"), ("bad2", "a", "FAILED")])
    asked = spark.createDataFrame(
        [("ok", "bronze", "t", "p", "r"), ("bad", "bronze", "t", "p", "r"), ("bad2", "bronze", "t", " ", "r"),
         ("none", "bronze", "t", "p", "no evidence")],
        "run_id string, dataset_namespace string, dataset_name string, principal string, reason string")
    after = gate.gate_override(held, asked, "2026-08-03")
    added = after.filter(F.col("status") == "overridden").collect()
    assert sorted(r["run_id"] for r in added) == ["bad", "none"]
    assert after.count() == 5
    assert [r["run_id"] for r in gate.invalid_overrides(asked).collect()] == ["bad2"]
    decided = {r["run_id"]: r["blocked"] for r in gate.gate_decision(
        after, ask(spark, "bad", "bad2", "none")).collect()}
    assert decided == {"bad": False, "bad2": True, "none": False}


def test_gated_promote_holds_back_blocked_and_unjudged(spark):
    rows = spark.createDataFrame([("ok", 1), ("bad", 2), ("unjudged", 3)], "run_id string, v int")
    decisions = spark.createDataFrame([("ok", False), ("bad", True), ("bad", False)], "run_id string, blocked boolean")
    assert [r["v"] for r in gate.gated_promote(rows, decisions, ["run_id"]).collect()] == [1]


def test_reconcile_sees_both_sides(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "b string")
    b = spark.createDataFrame([("x",), ("z",)], "b string")
    seen = {r["batch"]: (r["landed_rows"], r["written_rows"], r["reconciled"])
            for r in reconcile_batches(a, b, "b").collect()}
    assert seen == {"x": (2, 1, False), "y": (1, 0, False), "z": (0, 1, False)}


def test_parity_by_ranges_names_the_rows_and_moves_little(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("b"))
    other = rows.filter("id <> 5").withColumn("a", F.when(F.col("id") == 77, F.lit(None)).otherwise(F.col("a")))
    other = other.unionByName(rows.filter("id = 9")).select("b", "a", "id")
    got = {(r["id"], r["a"], r["b"], r["side"], r["rows"]) for r in parity.parity_ranges(rows, other, ["id"]).collect()}
    assert got == {(5, 5, "x", "left", 1), (9, 2, None, "right", 1), (77, 0, "x", "left", 1), (77, None, "x", "right", 1)}
    ranges = parity.differing_ranges(rows, other.select(*rows.columns), ["id"], 16)
    assert ranges.count() == 3
    moved = parity._within(rows, ["id"], 16, [r["_range"] for r in ranges.collect()])
    assert moved.count() < 20
    many = parity._within(rows, ["id"], 16, list(range(0, 65536, 2)))
    assert 9_000 < many.count() < 11_000 and "BroadcastHashJoin" in plan(many)
    assert parity.parity_ranges(rows, rows, ["id"]).isEmpty()
    # Nulls that change places, and rows of a null key.
    left = spark.createDataFrame([(None, "a", None), (1, None, "b")], "k int, x string, y string")
    right = spark.createDataFrame([(None, None, "a"), (1, "b", None)], "k int, x string, y string")
    assert parity.parity_ranges(left, right, ["k"], (4,)).count() == 4
    with pytest.raises(ValueError, match="columns differ"):
        parity.parity_ranges(left, right.drop("y"), ["k"])
    with pytest.raises(ValueError, match="levels"):
        parity.parity_ranges(left, right, ["k"], (8, 30))


def test_timing_states_merge_like_one_sketch(spark):
    rows = spark.range(30_000).select(
        (F.col("id") % 2).cast("string").alias("m"), (F.col("id") % 9).alias("day"), F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("ns"))
    rows = rows.unionByName(spark.createDataFrame([("0", 1, None), ("2", 1, 5)], "m string, day bigint, ns bigint"))
    states = telemetry.timing_states(rows, "m", "ns", "day")
    merged = telemetry.timing_quantiles(telemetry.merged_timings(states, ["m"]), {"p50": 0.5, "p99": 0.99})
    exact = {r["m"]: r for r in rows.filter("ns IS NOT NULL").groupBy("m").agg(
        F.count("*").alias("n"), F.sum("ns").alias("total"), F.min("ns").alias("low"), F.max("ns").alias("high")).collect()}
    for r in merged.collect():
        own = exact[r["m"]]
        assert (r["samples"], r["total"], r["lowest"], r["highest"]) == (own["n"], own["total"], own["low"], own["high"])
        for name, q in (("p50", 0.5), ("p99", 0.99)) if r["m"] != "2" else ():
            below = rows.filter((F.col("m") == r["m"]) & (F.col("ns") <= r[name])).count()
            assert abs(below / own["n"] - q) < 0.02
