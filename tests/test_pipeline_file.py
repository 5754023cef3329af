"""One file through ingest, rules, gate, silver and gold."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators.conform import conform, normalise, stamp
from tidewater.operators.gate import gate_decision
from tidewater.operators.products import materialise
from tidewater.operators.quality import quality_suite, quality_summary
from tidewater.sources.landing import read_landing

CSV = "\n".join([
    "meter_id,reading,region,read_at",
    "11,kwh 80.5,north,2025-11-03T00:15:00Z",
    "12,kwh 14.0,south,2025-11-03T00:15:00Z",
    "12,kwh 14.9,east,2025-11-03T00:45:00Z",
    "13, ,east,2025-11-03T00:15:00Z",
    "14,kwh 7.25,north,2025-11-03T00:30:00Z", ""])
RULES = [
    {"type": "row_count_min", "name": "has_rows", "minRows": 1},
    {"type": "schema_conformance", "name": "columns", "columns": ["meter_id", "reading"]},
    {"type": "completeness", "name": "reading_mandatory", "column": "reading"},
    {"type": "completeness", "name": "reading_mostly", "column": "reading", "severity": "warning",
     "maxNullRate": 0.1},
    {"type": "uniqueness", "name": "meter_unique", "columns": ["meter_id"]},
]


@pytest.fixture(scope="module")
def bronze(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("landing") / "meters.csv"
    path.write_text(CSV)
    ddl = "meter_id int, reading string, region string, read_at timestamp"
    return stamp(normalise(read_landing(spark, str(path), ddl)), "b1", str(path), "2025-11-04")


def test_bronze_keeps_every_row(bronze):
    assert bronze.count() == 5
    assert bronze.filter(F.col("reading").isNull()).count() == 1


def test_rules_and_gate(spark, bronze):
    evidence = quality_suite(bronze, RULES, "run", "bronze.meters", "2025-11-04")
    status = {r["check_name"]: (r["status"], r["metric_value"], r["failure_detail"])
              for r in evidence.collect()}
    assert status == {
        "has_rows": ("PASSED", 5.0, None),
        "columns": ("PASSED", 2.0, None),
        "reading_mandatory": ("FAILED", 0.2, "null rate 0.2000 exceeds 0.0000 for column reading"),
        "reading_mostly": ("WARNING", 0.2, "null rate 0.2000 exceeds 0.1000 for column reading"),
        "meter_unique": ("FAILED", 1.0, "1 duplicate rows on key meter_id"),
    }
    assert tuple(quality_summary(evidence).first()) == ("run", 5, 2, 2, 1)
    asked = evidence.select("run_id", "dataset_namespace", "dataset_name")
    decision = gate_decision(evidence, asked).first()
    assert decision["blocked"] and decision["failing"] == ["meter_unique", "reading_mandatory"]
    assert decision["warnings"] == ["reading_mostly"]


def test_silver_and_gold(spark, bronze):
    silver = conform(bronze, ["meter_id"], "read_at", "b1")
    assert silver.count() == 4
    gold = materialise(spark, "SELECT region, count(*) AS n FROM {meters} GROUP BY region",
                       {"meters": silver})
    assert {r["region"]: r["n"] for r in gold.collect()} == {"north": 2, "east": 2}


def test_empty_batch_is_refused(bronze):
    with pytest.raises(ValueError, match="no rows"):
        conform(bronze, ["meter_id"], "read_at", "mistyped")


def test_missing_column_is_named(bronze):
    with pytest.raises(ValueError, match="sequence column"):
        conform(bronze, ["meter_id"], "version")
    with pytest.raises(ValueError, match="business key"):
        conform(bronze, ["id"], "read_at")


def test_gold_reads_only_its_sources(spark, bronze):
    with pytest.raises(ValueError, match="not given"):
        materialise(spark, "SELECT * FROM {orders}", {})
    with pytest.raises(ValueError, match="never read"):
        materialise(spark, "SELECT 1", {"meters": bronze})
