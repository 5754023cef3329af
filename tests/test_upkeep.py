"""Maintenance triggers, expiry, orphans, bins, lineage, quantiles, text."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.functions.text import path_key, redact
from tidewater.operators import bronze, lineage, maintenance, products, telemetry
from tidewater.operators.bronze import batch_inventory, layout

T0 = datetime(2026, 1, 1)


def test_advice_flips_exactly_at_the_trigger(spark):
    policy = spark.createDataFrame(
        [("t", 100, 3, 2, 1, 4)],
        "table_name string, target_file_bytes bigint, small_file_trigger int, manifest_trigger int, "
        "delete_file_trigger int, retained_snapshots int")
    names = lambda n: spark.range(n).select(F.lit("t").alias("table_name"))
    sizes = lambda *s: spark.createDataFrame([("t", x) for x in s], "table_name string, size_bytes bigint")

    def advice(small, manifests, deletes, snapshots):
        rows = maintenance.maintenance_advice(
            sizes(*[99] * small, 100, 101), names(manifests), names(deletes), names(snapshots), policy)
        return {r["category"]: (r["observed"], r["action_recommended"]) for r in rows.collect()}

    assert advice(2, 1, 0, 4) == {
        "compact_data_files": (2, False), "rewrite_manifests": (1, False),
        "compact_delete_files": (0, False), "expire_snapshots": (0, False)}
    assert advice(3, 2, 1, 5) == {
        "compact_data_files": (3, True), "rewrite_manifests": (2, True),
        "compact_delete_files": (1, True), "expire_snapshots": (1, True)}


def versions(spark, n):
    return spark.createDataFrame([("t", i, T0 + timedelta(days=i)) for i in range(n)],
                                 "table_name string, snapshot_id int, committed_at timestamp")


def test_expiry_keeps_newest_and_young(spark):
    ids = lambda df: sorted(r["snapshot_id"] for r in df.collect())
    assert ids(maintenance.snapshots_to_expire(versions(spark, 5))) == [0, 1, 2]
    assert ids(maintenance.snapshots_to_expire(versions(spark, 5), 1, T0 + timedelta(days=2))) == [0, 1]
    assert ids(maintenance.snapshots_to_expire(versions(spark, 2))) == []
    with pytest.raises(ValueError):
        maintenance.snapshots_to_expire(versions(spark, 2), 0)


def test_shared_file_is_not_freed(spark):
    refs = spark.createDataFrame([("t", 0, "a"), ("t", 0, "b"), ("t", 9, "b")],
                                 "table_name string, snapshot_id int, path string")
    freed = maintenance.files_freed(refs, versions(spark, 1))
    assert [r["path"] for r in freed.collect()] == ["a"]


def test_orphans_ignore_how_a_path_is_spelt(spark):
    ddl = "path string, created_at timestamp, size_bytes bigint"
    listed = spark.createDataFrame([
        ("s3a://b/live", T0, 1), (" /b/live2", T0, 1), ("s3a://b/old", T0, 1),
        ("s3a://b/edge", T0 + timedelta(days=5), 1), ("s3a://b/young", T0 + timedelta(days=5, seconds=1), 1)], ddl)
    known = spark.createDataFrame([("s3://b/live",), ("b/live2",), ("s3://b/live",)], "path string")
    found = maintenance.orphan_files(listed, known, T0 + timedelta(days=5), T0 + timedelta(days=6))
    assert {r["path"]: r["verdict"] for r in found.collect()} == {
        "s3a://b/old": "orphan", "s3a://b/edge": "orphan", "s3a://b/young": "within_minimum_age"}
    with pytest.raises(ValueError):
        maintenance.orphan_files(listed, known, T0 + timedelta(days=5), T0 + timedelta(days=5, hours=23))
    with pytest.raises(ValueError):
        maintenance.orphan_files(listed, known, None, T0)


def test_path_key(spark):
    paths = [("s3://b/k",), ("s3a:///b/k",), ("\t//b/k ",), ("b/k",), ("file:/b/k",)]
    df = spark.createDataFrame(paths, "p string").select(path_key(F.col("p")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["b/k"] * 4 + ["file:/b/k"]


def test_bins_follow_the_running_total_of_a_hot_table(spark):
    rng = random.Random(3)
    data = [("hot", f"p{i:04d}", rng.randint(1, 90), T0 + timedelta(minutes=rng.randint(0, 3000)))
            for i in range(400)] + [("cold", "q", 5, T0)]
    files = spark.createDataFrame(data, "table_name string, path string, size_bytes bigint, created_at timestamp")
    seen = {(r["table_name"], r["path"]): r["bin"] for r in maintenance.compaction_plan(files, 100).collect()}
    expected, total = {("cold", "q"): 0}, 0
    day = lambda d: (d[3].date(), hashlib.md5(d[1].encode()).hexdigest())
    for row in sorted((d for d in data if d[0] == "hot"), key=day):
        expected[("hot", row[1])] = total // 100
        total += row[2]
    assert seen == expected


def test_closure_survives_cycles_and_finds_shortest(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "d"), ("a", "b")],
        "source string, target string")
    seen = {(r["source"], r["target"]): r["depth"] for r in lineage.lineage_closure(edges, 5).collect()}
    assert seen == {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("a", "c"): 1, ("c", "d"): 1,
                    ("b", "a"): 2, ("b", "d"): 2, ("c", "b"): 2, ("a", "d"): 2}
    with pytest.raises(ValueError, match="deeper"):
        lineage.lineage_closure(edges, 1)


def test_event_text_is_valid_json_and_splits_into_edges(spark):
    runs = spark.createDataFrame(
        [("MATERIALISATION", 'a"b\\c,d', "gold.t\n", "r1", T0), ("MATERIALISATION", "d", "gold.t\n", "r2", T0)],
        "type string, source string, target string, run_id string, finished_at timestamp")
    events = lineage.lineage_events(runs)
    assert events.first()["payload"] == (
        '{"type":"MATERIALISATION","source":"a\\"b\\\\c,d","target":"gold.t\\n","run_id":"r1",'
        '"timestamp":"2026-01-01T00:00:00.000000Z"}')
    seen = {(r["source"], r["target"]): r["runs"] for r in lineage.lineage_edges(events).collect()}
    assert seen == {('a"b\\c', "gold.t\n"): 1, ("d", "gold.t\n"): 2}


def test_nearest_rank_against_brute_force(spark):
    rng = random.Random(7)
    data = [("hot", rng.choice([0, 1, 5, -3, 10**12, rng.randint(-10**6, 10**9)])) for _ in range(3000)]
    data += [("one", 42)] + [("two", 1), ("two", 2)]
    df = spark.createDataFrame(data, "m string, v bigint")
    wanted = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    seen = {r["m"]: r.asDict() for r in telemetry.nearest_rank(df, "m", "v", wanted).collect()}
    for metric in ("hot", "one", "two"):
        ordered = sorted(v for m, v in data if m == metric)
        for name, q in wanted.items():
            assert seen[metric][name] == ordered[max(0, math.ceil(q * len(ordered)) - 1)]


def test_timing_summary(spark):
    df = spark.createDataFrame([("m", n * 1_000_000) for n in range(1, 101)], "m string, ns bigint")
    assert tuple(telemetry.timing_summary(df, "m", "ns").first()) == ("m", 100, 5050, 50, 1, 50, 95, 100)


@pytest.mark.parametrize("text, wanted", [
    ("Authorization: Bearer abc.def, next", "Authorization: <redacted> <redacted>, next"),
    ('{"password": "p w", "x": 1}', '{"password": <redacted>, "x": 1}'),
    ("api_key=abc;token='t t' ok", "api_key=<redacted>;token=<redacted> ok"),
    ("ALTER USER x password 'p';", "ALTER USER x password <redacted>;"),
    ("jdbc://user:pw@host/db", "jdbc://<redacted>@host/db"),
    ("s3://bucket/a@b https://me@h/x@y", "s3://bucket/a@b https://<redacted>@h/x@y"),
    ("[private-key: 'a ]' , credential=b]", "[private-key: <redacted> , credential=<redacted>]"),
    ("{secret:x} (bearer t;u) passwords stay", "{secret:<redacted>} (bearer <redacted>;u) passwords stay"),
    ('access.key="half', 'access.key=<redacted>'),
    ("one\ntwo\tthree\r", "one_two_three_"),
    ("nothing here", "nothing here"),
    (None, None),
])
def test_redaction(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "t string").select(redact(F.col("t")).alias("t"))
    assert df.first()["t"] == wanted


def test_plain_words_are_taken_as_one_part(spark):
    words = "plain, words; of text] " * 100_000
    df = spark.createDataFrame([(f"{words}password: x{words} 'q' {words}",)], "t string")
    parts = df.select(F.size(F.regexp_extract_all("t", F.lit(text._PARTS), F.lit(0)))).first()[0]
    assert parts == 5
    assert df.select(redact(F.col("t")).alias("t")).first()["t"] == f"{words}password: <redacted>{words[5:]} 'q' {words}"


@pytest.mark.parametrize("text, wanted", [
    ("token : x y", "token : <redacted> y"), ("token = =x y", "token = =<redacted> y"), ("token : : x", "token : : x"),
    ("token :x y", "token :<redacted> y"), ("token , x", "token , x"), ("my api.key  secret= 'a b' c", "my api.key  <redacted> <redacted> c"),
])
def test_redaction_of_values_in_plain_words(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(redact(F.col("t")).alias("t")).first()["t"] == wanted


def test_cap_applies_after_masking(spark):
    df = spark.createDataFrame([("token=abcdefghij rest",)], "t string")
    assert df.select(redact(F.col("t"), 12).alias("t")).first()["t"] == "token=<redac"


def test_layout_orders_rows_and_inventory_counts_files(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    laid = layout(events, "event_type", "ts", [("ts", True), ("event_id", False)])
    path = str(tmp_path / "laid")
    laid.write.partitionBy("event_type", "_day").parquet(path)
    back = spark.read.parquet(path)
    assert back.count() == events.count()
    counts = batch_inventory(back, "event_type", files=True).agg(F.sum("row_count"), F.min("file_count")).first()
    assert counts[0] == events.count() and counts[1] >= 1


def test_clustered_files_are_skipped_by_either_column(spark, tmp_path):
    rows = spark.range(40_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("x"), F.timestamp_seconds(
        F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(86_400))).alias("t"), F.when(F.col("id") % 5 > 0, F.lit(1)).alias("same"))
    path = str(tmp_path / "clustered")
    bronze.layout_clustered(rows, ["x", "t", "same"], 64, bits=4).write.parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    assert stored.exceptAll(rows).isEmpty() and stored.count() == 40_000
    spans = bronze.file_spans(stored, ["x", "t"]).collect()
    assert 30 <= len(spans) <= 64 and max(r["rows"] for r in spans) < 5 * 40_000 / len(spans)
    assert sum(r["low_x"] <= 70 <= r["high_x"] for r in spans) <= len(spans) / 2
    noon = datetime(1970, 1, 1, 12)
    assert sum(r["low_t"] <= noon <= r["high_t"] for r in spans) <= len(spans) / 2
    with pytest.raises(ValueError, match="1 to 60"):
        bronze.layout_clustered(rows, ["x"], 4, bits=61)
    empty = bronze.layout_clustered(rows.limit(0), ["x", "same"], 4)
    assert empty.columns == rows.columns and empty.isEmpty()


def test_states_roll_up_to_any_dimensions(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 700).alias("who"),
                                      F.col("id").cast("decimal(12,2)").alias("v"))
    states = products.metric_states(rows, ["a", "b"], {"v": "v"}, {"people": "who"})
    assert states.count() == 15
    for dims in (["a"], ["b"], ["a", "b"], []):
        got = {tuple(r[d] for d in dims): r for r in products.rolled_up(states, dims, ["v"], ["people"]).collect()}
        for r in rows.groupBy(*dims).agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.count_distinct("who").alias("p")).collect():
            own = got.pop(tuple(r[d] for d in dims))
            assert (own["rows"], own["v"]) == (r["n"], r["v"]) and abs(own["people"] / r["p"] - 1) < 0.05
        assert not got
    with pytest.raises(ValueError, match="named like"):
        products.metric_states(rows, ["a"], {"a": "v"})
