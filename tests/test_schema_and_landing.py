"""Drift, merged schemas, stored evolution, landing files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.compare import plan
from tidewater.operators import schema
from tidewater.operators.quality import RESULT_DDL, quality_suite
from tidewater.operators.bronze import append_batch, replace_batch
from tidewater.operators.conform import align_schema, normalise
from tidewater.sources import extract, landing, zones

ddl = T.StructType.fromDDL


def test_promotions():
    held = ddl("a int, b float, c decimal(10,2), d string")
    assert schema.conflicts(held, ddl("A bigint, b double, c decimal(12,2), e int")) == []
    assert schema.conflicts(held, ddl("a string, b int, c decimal(12,3), d string")) == [
        "a: table holds int, batch carries string", "b: table holds float, batch carries int",
        "c: table holds decimal(10,2), batch carries decimal(12,3)"]
    assert schema.conflicts(ddl("a bigint"), ddl("a int")) == ["a: table holds bigint, batch carries int"]
    nested = ddl("s struct<x:int>")
    assert schema.conflicts(nested, ddl("s struct<x:int,y:int>")) != []


def test_drift_report_agrees_with_the_plan_time_check(spark):
    held = ddl("a int, b float, c decimal(10,2), d string, gone int")
    new = ddl("A bigint, b int, c decimal(9,2), d string, extra date")
    report = schema.schema_drift(schema.field_rows(spark, "t", held), schema.field_rows(spark, "t", new))
    seen = {r["column_name"]: r["change"] for r in report.collect()}
    assert seen == {"a": "widened", "b": "conflict", "c": "conflict", "d": "same", "gone": "missing",
                    "extra": "added"}
    texts = sorted(r["conflict"] for r in report.filter("conflict IS NOT NULL").collect())
    assert texts == sorted(schema.conflicts(held, new))


def test_merged_schema_order():
    merged = schema.merged_schema(ddl("a int, b string"), ddl("c date, A bigint"))
    assert merged.simpleString() == "struct<a:bigint,b:string,c:date>"


def test_stored_files_read_under_a_wider_schema(spark, tmp_path):
    table = str(tmp_path / "t")
    stored = lambda d, rows: spark.createDataFrame(rows, d)
    zones.land_batch(stored("_batch_id string, a int, x float", [("1", 1, 0.5)]), table, "1", "2026-01-01")
    zones.land_batch(stored("_batch_id string, a bigint, x double, n string", [("2", 2**40, 0.25, "z")]),
                     table, "2", "2026-01-02")
    seen = sorted(tuple(r) for r in zones.read_table(spark, table).collect())
    assert seen == [("1", 1, 0.5, None), ("2", 2**40, 0.25, "z")]
    with pytest.raises(LookupError):
        zones.read_table(spark, str(tmp_path / "absent"))


def test_refused_delivery_writes_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    zones.land_batch(spark.createDataFrame([("1", 1)], "_batch_id string, a int"), table, "1", "2026-01-01")
    with pytest.raises(schema.SchemaConflict):
        zones.land_batch(spark.createDataFrame([("2", "x")], "_batch_id string, a string"), table, "2", "2026-01-02")
    assert zones.version_log(spark, table).count() == 1
    assert zones.read_table(spark, table).count() == 1


def test_a_write_that_never_reached_the_log_is_not_read(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.createDataFrame([("1", 1)], "_batch_id string, a int")
    zones.land_batch(rows, table, "1", "2026-01-01")
    rows.write.parquet(f"{table}/data/v=2")
    assert zones.read_table(spark, table).count() == 1
    zones.land_batch(rows.withColumn("_batch_id", F.lit("2")), table, "2", "2026-01-02")
    assert zones.read_table(spark, table).count() == 2


def test_results_table_must_exist(spark, tmp_path):
    with pytest.raises(LookupError, match="provision"):
        zones.append_results(spark.range(1), str(tmp_path / "none"))


def test_null_in_a_required_column_leaves_the_table_unmoved(spark, tmp_path):
    table = str(tmp_path / "results")
    zones.create_results(spark, table, RESULT_DDL)
    good = quality_suite(spark.range(1), [{"type": "row_count_min"}], "r", "bronze.t", "2026-01-01")
    bad = good.withColumn("severity", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="null in required column severity"):
        zones.append_results(bad, table)
    assert zones.read_results(spark, table, RESULT_DDL).isEmpty()
    zones.append_results(good, table)
    zones.create_results(spark, table, RESULT_DDL)  # provisioning again leaves held evidence alone
    assert zones.read_results(spark, table, RESULT_DDL).count() == 1
    asked = zones.read_results(spark, table, RESULT_DDL).filter("zone = 'silver' AND checked_day = DATE'2026-01-01'")
    assert "PartitionFilters: [isnotnull(zone" in plan(asked) and asked.isEmpty()


def test_dropping_is_limited_to_the_named_pattern(spark):
    with pytest.raises(ValueError, match="refusing"):
        zones.drop_probe_table(spark, "silver.customers", r"probe_[a-z0-9]+")
    spark.sql("CREATE TABLE probe_1 USING parquet AS SELECT 1 AS x")
    zones.drop_probe_table(spark, "probe_1", r"probe_[a-z0-9]+")
    assert not spark.catalog.tableExists("probe_1")


def test_zone_options():
    assert zones.zone_options("silver")["write.distribution-mode"] == "hash"
    assert "append-only" not in zones.zone_options("silver")
    assert zones.zone_options("bronze")["accept-any-schema"] == "true"
    with pytest.raises(ValueError):
        zones.zone_options("platinum")


def test_append_and_replace_on_frames(spark):
    held = spark.createDataFrame([("1", 1), ("2", 2), (None, 3)], "_batch_id string, a int")
    again = spark.createDataFrame([("2", 20)], "_batch_id string, a int")
    assert sorted(r["a"] for r in replace_batch(held, again, "2").collect()) == [1, 3, 20]
    assert append_batch(held, again).count() == 4


def test_align_ignores_case_and_keeps_extras_last(spark):
    batch = spark.createDataFrame([(1, "x", 2)], "EXTRA int, B string, a int")
    aligned = align_schema(batch, ddl("a int, b string, c date"))
    assert aligned.columns == ["a", "b", "c", "EXTRA"] and aligned.first()["c"] is None


def test_normalise_trims_spaces_only(spark):
    df = spark.createDataFrame([("  a ", "  ", "\t", 1)], "x string, y string, z string, n int")
    assert tuple(normalise(df).first()) == ("a", None, "\t", 1)


def test_landing_extension_decides(spark, tmp_path):
    with pytest.raises(ValueError, match="must end in"):
        landing.read_landing(spark, str(tmp_path / "a.txt"))
    (tmp_path / "a.CSV").write_text("x,y\n1,b\n")
    assert landing.read_landing(spark, str(tmp_path / "a.CSV")).dtypes == [("x", "int"), ("y", "string")]


def test_checked_landing_keeps_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,at,n\n1,2026-01-01T00:00:00Z,5\nA-9,2026-01-01T00:00:00Z,x\n3,,\n4\n")
    fits, rejects = landing.read_landing_checked(spark, str(tmp_path / "a.csv"), "id int, at timestamp, n int")
    assert [r["id"] for r in fits.collect()] == [1, 3]
    seen = {r["id"]: (r["_rejected"], r[landing.CORRUPT]) for r in rejects.collect()}
    assert seen["A-9"][0] == ["id", "n"] and seen["4"][1] == "4"
    (tmp_path / "a.ndjson").write_text('{"id": 1, "n": 2}\n{"id": "x", "n": 2}\n{broken\n')
    fits, rejects = landing.read_landing_checked(spark, str(tmp_path / "a.ndjson"), "id int, n int")
    assert [r["id"] for r in fits.collect()] == [1] and rejects.count() == 2


@pytest.mark.parametrize("share", [0, 3])
def test_balanced_ranges_of_a_skewed_key(spark, share):
    rows = spark.range(60_000).withColumn("k", F.when(F.col("id") % 3 < share / 3, F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) - 500))
    rows = rows.withColumn("k", F.when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.col("k")))
    tagged = extract.balanced_ranges(rows, "k", 12)
    sizes = {r["_range"]: r for r in tagged.groupBy("_range").agg(
        F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).collect()}
    assert sizes.pop(-1)["n"] == 600 and sum(r["n"] for r in sizes.values()) == 59_400
    assert max(r["n"] for r in sizes.values()) <= 2 * 59_400 / len(sizes) and len(sizes) >= 10
    spans = sorted((r["low"], r["high"]) for r in sizes.values())
    assert all(a[1] < b[0] or a == b == (7, 7) for a, b in zip(spans, spans[1:]))


def test_balanced_ranges_of_odd_columns(spark):
    none = spark.createDataFrame([(None,)], "k int")
    assert [r["_range"] for r in extract.balanced_ranges(none, "k", 4).collect()] == [-1]
    assert extract.balanced_ranges(none.limit(0), "k", 4).count() == 0
    same = spark.createDataFrame([(5, i) for i in range(1000)], "k long, i int")
    sizes = [r["count"] for r in extract.balanced_ranges(same, "k", 4).groupBy("_range").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 500
    assert {r["_range"] for r in extract.balanced_ranges(same, "k", 1).collect()} == {0}
    with pytest.raises(ValueError, match="integer"):
        extract.balanced_ranges(spark.createDataFrame([("a",)], "k string"), "k", 4)
