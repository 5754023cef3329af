"""Streams: restart, replayed batches, duplicates, late rows, counts."""

import dataclasses
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.compare import plan
from tidewater.streaming import cdc, joins, queries, rotation

IMAGE = T.StructType([T.StructField("customer_id", T.LongType()), T.StructField("email", T.StringType()),
                      T.StructField("status", T.StringType())])
RULES = cdc.CdcRules("customer_id", ("c", "u", "d", "r"),
                     {"active_has_email": "status <> 'active' OR email IS NOT NULL"})
TOPIC_DDL = ("topic string, partition int, offset bigint, key string, value string, timestamp timestamp")
NOW = datetime(2026, 8, 2)
T0 = datetime(2026, 8, 1)


def message(offset, op, key, email="e@x", status="active", at=0, partition=0, topic="t"):
    image = "null" if key is None and email is None else (
        f'{{"customer_id": {key if key is not None else "null"}, "email": '
        f'{"null" if email is None else chr(34) + email + chr(34)}, "status": "{status}"}}')
    micros = int((T0 + timedelta(minutes=at) - datetime(1970, 1, 1)).total_seconds() * 1e6) if at is not None else "null"
    before, after = (image, "null") if op == "d" else ("null", image)
    value = f'{{"op": "{op}", "before": {before}, "after": {after}, "source": {{"ts_us": {micros}}}}}'
    return (topic, partition, offset, str(key), value, T0 + timedelta(minutes=at or 0))


def log(spark, rows):
    return spark.createDataFrame(rows, TOPIC_DDL)


def spec(root, name="s"):
    return queries.BronzeStream(name, f"{root}/t", f"{root}/results", f"{root}/rejects", f"{root}/lineage",
                                "bronze.t", cdc.envelope(IMAGE), RULES)


def drop(spark, source, n, rows):
    log(spark, rows).coalesce(1).write.parquet(f"{source}/f={n}")


def run(spark, source, root, checkpoint="checkpoint", name="s"):
    stream = spark.readStream.schema(TOPIC_DDL).parquet(f"{source}/f=*")
    query = queries.start_bronze(stream, spec(root, name), f"{root}/{checkpoint}", lambda _: NOW, trigger=None)
    query.awaitTermination()
    return query


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "source"), str(tmp_path / "lake")


def offsets(spark, root):
    rows = queries.read_stream_table(spark, f"{root}/t", queries.bronze_schema(spark, spec(root)))
    return sorted(r["source_offset"] for r in rows.collect())


def test_restart_resumes_and_duplicates_across_batches_are_refused(spark, place):
    source, root = place
    drop(spark, source, 1, [message(0, "c", 1), message(1, "u", 1, at=1), message(1, "u", 1, at=1)])
    run(spark, source, root)
    assert offsets(spark, root) == [0, 1]
    drop(spark, source, 2, [message(1, "u", 1, at=2), message(2, "u", 2, at=3)])
    query = run(spark, source, root)
    assert query.lastProgress["numInputRows"] == 2
    assert offsets(spark, root) == [0, 1, 2]
    rejects = queries.read_stream_table(spark, f"{root}/rejects").collect()
    assert sorted((r["source_offset"], r["reason"], r["records"]) for r in rejects) == [
        (1, "offset_not_duplicate", 1), (1, "offset_not_duplicate", 1)]
    lineage = sorted((r["run_id"], r["offset_min"], r["offset_max"])
                     for r in queries.read_stream_table(spark, f"{root}/lineage").collect())
    assert lineage == [(f"s/{query.id}/0", 0, 1), (f"s/{query.id}/1", 2, 2)]


def test_a_second_checkpoint_on_the_same_table_loses_nothing(spark, place):
    source, root = place
    drop(spark, source, 1, [message(0, "c", 1), message(1, "u", 1, at=1)])
    run(spark, source, root)
    drop(spark, source, 2, [message(2, "u", 2, at=3)])
    run(spark, source, root, "another-checkpoint")
    assert offsets(spark, root) == [0, 1, 2]


def test_two_streams_share_evidence_and_lineage(spark, place, tmp_path):
    source, root = place
    for n, name in enumerate(("one", "two")):
        drop(spark, f"{source}-{name}", 1, [message(0, "c", 1, topic=name), message(1, "x", 1, topic=name)])
        run(spark, f"{source}-{name}", root, f"checkpoint-{name}", name)
    counts = {r["stream"]: (r["committed"], r["failed"]) for r in queries.record_counts(spark, spec(root)).collect()}
    assert counts == {"one": (1, 1), "two": (1, 1)}
    traced = queries.read_stream_table(spark, f"{root}/lineage").collect()
    assert {(r["job_name"], r["quality_status"], r["rejected_records"]) for r in traced} == {
        ("one", "FAILED", 1), ("two", "FAILED", 1)}
    assert queries.read_stream_table(spark, f"{root}/results").select("run_id").distinct().count() == 2


def test_held_positions_skip_other_partitions_files(spark, place):
    source, root = place
    drop(spark, source, 1, [message(i, "c", 1) for i in range(50)])
    drop(spark, source, 2, [message(1000 + i, "c", 1, partition=1) for i in range(50)])
    run(spark, source, root)
    decoded = cdc.cdc_decode(log(spark, [message(60, "c", 1), message(1049, "c", 1, partition=1)]), cdc.envelope(IMAGE))
    held = queries._held_positions(spark, spec(root), queries._offset_spans(spec(root), decoded))
    assert [r["source_offset"] for r in held.collect()] == [1049]
    pushed = plan(held).partition("PushedFilters: ")[2].partition("\n")[0]
    assert "source_partition" in pushed and "source_offset" in pushed and "Or(" in pushed, pushed


def test_a_batch_that_runs_again_changes_nothing(spark, place):
    _, root = place
    rows = log(spark, [message(0, "c", 1), message(1, "x", 2), message(2, "d", 1, at=3)])
    write = queries.bronze_batch_writer(spec(root), lambda _: NOW, "c")
    write(rows, 0)
    tables = ("t", "rejects", "results", "lineage")
    snapshot = lambda: {t: sorted(map(str, queries.read_stream_table(spark, f"{root}/{t}").collect())) for t in tables}
    first = snapshot()
    write(rows, 0)
    assert snapshot() == first
    with pytest.raises(ValueError, match="checkpoint must be named"):
        queries.bronze_batch_writer(spec(root), lambda _: NOW)(rows, 0)


def test_a_crash_between_data_and_lineage_is_finished_by_the_rerun(spark, place):
    _, root = place
    rows = log(spark, [message(0, "c", 1), message(1, "u", 1, at=1)])
    full = spec(root)
    accepted = cdc.accepted_records(cdc.cdc_check(cdc.cdc_decode(rows, full.envelope), RULES), NOW, "batch-0")
    queries._announce(spark, full, queries._offset_spans(full, cdc.cdc_decode(rows, full.envelope)), "c", 0, NOW)
    accepted.withColumn("event_day", F.to_date("event_time")).write.partitionBy("event_day").parquet(
        f"{full.table}/stream=s/checkpoint=c/batch=0")
    queries.bronze_batch_writer(full, lambda _: NOW, "c")(rows, 0)
    assert offsets(spark, root) == [0, 1]
    assert queries.read_stream_table(spark, full.rejects_table).count() == 0
    assert queries.read_stream_table(spark, full.lineage_table).first()["row_count"] == 2


def test_replay_equals_stream(spark, place):
    source, root = place
    rows = [message(i, "cud"[i % 3], i % 4, at=i) for i in range(20)]
    drop(spark, source, 1, rows[:11])
    run(spark, source, root)
    drop(spark, source, 2, rows[9:])
    run(spark, source, root)
    rebuilt = queries.replay_rebuild(log(spark, rows), spec(root), NOW).drop("pipeline_run_id")
    streamed = queries.read_stream_table(
        spark, f"{root}/t", queries.bronze_schema(spark, spec(root))).select(*rebuilt.columns)
    assert streamed.exceptAll(rebuilt).isEmpty() and rebuilt.exceptAll(streamed).isEmpty()


def test_record_rules(spark):
    rows = log(spark, [
        message(0, "c", 1), message(1, "c", None), message(2, "x", 2), message(3, "u", 3, at=None),
        message(4, "u", 4, email=None), message(5, "u", 5, email=None, status="closed"),
        message(6, "d", 6), message(6, "d", 6), ("t", 0, 7, "k", "{broken", T0)])
    accepted, rejected, results = cdc.cdc_split(
        cdc.cdc_decode(rows, cdc.envelope(IMAGE)), RULES, NOW, "bronze.t", "r")
    kept = {r["source_offset"]: r for r in accepted.collect()}
    assert sorted(kept) == [0, 3, 4, 5, 6]
    assert kept[3]["event_time"] == NOW and kept[6]["customer_id"] == 6
    assert kept[0]["event_id"] == "t-0-0"
    reasons = sorted((r["source_offset"], r["reason"], r["records"]) for r in rejected.collect())
    assert reasons == [(1, "key_present", 1), (2, "operation_allowed", 1), (6, "offset_not_duplicate", 1),
                       (7, "key_present,operation_allowed", 1)]
    seen = {r["check_name"]: (r["status"], r["metric_value"]) for r in results.collect()}
    assert seen == {"key_present": ("FAILED", 2.0), "operation_allowed": ("FAILED", 2.0),
                    "offset_not_duplicate": ("FAILED", 1.0), "event_time_present": ("WARNING", 2.0),
                    "active_has_email": ("WARNING", 2.0)}


def test_a_position_delivered_very_often_is_one_row(spark):
    rows = spark.range(5000).select(
        *[F.lit(v).alias(c) for c, v in zip(("topic", "partition", "offset", "key", "value"),
                                            message(3, "c", 1)[:5])],
        F.timestamp_micros(F.col("id")).alias("timestamp"))
    checked = cdc.cdc_check(cdc.cdc_decode(rows, cdc.envelope(IMAGE)), RULES)
    assert cdc.accepted_records(checked, NOW).count() == 1
    assert [r["records"] for r in cdc.rejected_records(checked).collect()] == [4999]


def test_current_state_and_lag(spark):
    decoded = cdc.cdc_decode(log(spark, [
        message(0, "c", 1, "a@x", at=0), message(1, "u", 1, "b@x", at=5), message(2, "u", 1, "late@x", at=3),
        message(3, "d", 2, at=4), message(4, "u", 2, "late@x", at=2), message(5, "c", 3, at=1, partition=1)]),
        cdc.envelope(IMAGE))
    changes = cdc.accepted_records(cdc.cdc_check(decoded, RULES), NOW)
    target = spark.createDataFrame([], "customer_id bigint, email string, status string, "
                                       "last_operation string, event_time timestamp, is_deleted boolean")
    state = cdc.cdc_current_state(target, changes, ["customer_id"], "event_time", ("d",))
    seen = {r["customer_id"]: (r["email"], r["last_operation"], r["is_deleted"]) for r in state.collect()}
    assert seen == {1: ("b@x", "u", False), 2: (None, "d", True), 3: ("e@x", "c", False)}
    lag = {r["source_partition"]: (r["offset_lag"], r["lag_seconds"]) for r in cdc.consumer_lag(
        decoded, changes.filter(F.col("source_offset") < 1)).collect()}
    assert lag == {0: (4, 300.0), 1: (6, None)}


def test_late_rows_are_dropped_and_counted(spark, place):
    source, root = place
    events = lambda *minutes: spark.createDataFrame(
        [("k", T0 + timedelta(minutes=m)) for m in minutes], "key string, ts timestamp")
    counts = lambda: queries.stream_key_counts(
        spark.readStream.schema("key string, ts timestamp").parquet(f"{source}/f=*"),
        "ts", "10 minutes", "key", "5 minutes")

    def step(n, *minutes):
        events(*minutes).coalesce(1).write.parquet(f"{source}/f={n}")
        frame = counts()
        query = queries.start_counts(frame, f"{root}/out", f"{root}/checkpoint")
        query.awaitTermination()
        return query, frame.schema

    metrics = queries.StreamMetrics()
    spark.streams.addListener(metrics)
    step(1, 1, 2, 60)
    query, schema = step(2, 3, 61)
    seen = metrics.of(query)
    spark.streams.removeListener(metrics)
    assert (seen["processed"], seen["late"]) == (5, 1) and seen["batches"] >= 2
    before = queries.read_counts(spark, f"{root}/out", ["key", "window_start"], schema).collect()
    queries.fold_counts(spark, f"{root}/out", ["key", "window_start"], schema)
    folded = queries.read_counts(spark, f"{root}/out", ["key", "window_start"], schema)
    seen = folded.collect()
    assert sorted(map(tuple, seen)) == sorted(map(tuple, before))
    assert plan(folded).count("PartitionFilters: [isnotnull(_batch") == 2
    assert sorted((r["window_start"].minute, r["window_start"].hour, r["event_count"]) for r in seen) == [
        (0, 0, 2), (0, 1, 2)]


def test_positions_seen_within_the_watermark_are_dropped_in_the_stream(spark, place):
    source, root = place
    drop(spark, source, 1, [message(0, "c", 1), message(0, "c", 1), message(1, "c", 2)])
    stream = spark.readStream.schema(TOPIC_DDL).parquet(f"{source}/f=*")
    query = (queries.deduplicated_stream(stream, "1 hour").writeStream.format("parquet")
             .option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == 2


def test_held_positions_cost_the_batches_of_their_offsets_only(spark, place):
    """Fifty micro-batches; each opens the few that share its span of offsets, found before or after a rotation."""
    source, root = place
    narrow = dataclasses.replace(spec(root), offset_span=4)
    write = queries.bronze_batch_writer(narrow, lambda _: NOW, "c")
    opened = []
    for n in range(50):
        rows = log(spark, [message(2 * n, "c", 1, at=n), message(2 * n + 1, "u", 1, at=n)])
        if n % 12 == 0:
            spans = queries._offset_spans(narrow, cdc.cdc_decode(rows, narrow.envelope))
            held = queries._held_positions(spark, narrow, spans)
            opened.append(0 if held is None else len(held.inputFiles()))
        write(rows, n)
    assert max(opened) <= 2, opened
    again = cdc.cdc_decode(log(spark, [message(17, "u", 1, at=70), message(200, "u", 1, at=70)]), narrow.envelope)
    spans = queries._offset_spans(narrow, again)
    assert [r["source_offset"] for r in queries._held_positions(spark, narrow, spans).collect()] == [17]
    assert rotation.rotate(spark, narrow, "c", 48) == 49
    assert [r["source_offset"] for r in queries._held_positions(spark, narrow, spans).collect()] == [17]
    rows = rotation.read_bronze(spark, narrow)
    assert sorted(r["source_offset"] for r in rows.collect()) == list(range(100))


def test_rotation_shows_rows_once_in_either_form(spark, place):
    _, root = place
    full = spec(root)
    write = queries.bronze_batch_writer(full, lambda _: NOW, "c")
    seen = lambda: sorted(r["source_offset"] for r in rotation.read_bronze(spark, full).collect())
    assert rotation.rotate(spark, full, "c", 3) == 0 and seen() == []
    for n in range(4):
        write(log(spark, [message(3 * n + i, "c", 1, at=45 * i + n) for i in range(3)]), n)
    assert seen() == list(range(12))
    # A rotation that breaks off before it deletes what it folded.
    kept = rotation.discard
    rotation.discard = lambda *_: None
    try:
        assert rotation.rotate(spark, full, "c", 1) == 2
    finally:
        rotation.discard = kept
    assert seen() == list(range(12))
    assert rotation.rotate(spark, full, "c", 2) == 3 and seen() == list(range(12))
    stored = spark.read.parquet(rotation.rotated_path(full))
    assert stored.count() == 9 and len(stored.inputFiles()) == 2  # one file for each of two hours
    write(log(spark, [message(1, "c", 1, at=45)]), 4)  # delivered again, held by a folded batch
    assert seen() == list(range(12))


def test_interval_join_releases_outer_rows_and_bounds_its_state(spark, place):
    source, root = place
    asked = lambda n, *rows: spark.createDataFrame(rows, "k long, a long, at timestamp").coalesce(1).write.parquet(f"{source}/a{n}")
    answered = lambda n, *rows: spark.createDataFrame(rows, "k long, b long, bt timestamp").coalesce(1).write.parquet(f"{source}/b{n}")
    minute = lambda m: T0 + timedelta(minutes=m)
    for n in range(12):
        asked(n, (1, n, minute(10 * n)), (None, 100 + n, minute(10 * n)))
        answered(n, (1, n, minute(10 * n + (3 if n % 2 else 7))), (2, 200 + n, minute(10 * n)))
    asked(12, (9, 999, minute(1000)))
    answered(12, (9, 999, minute(1000)))
    stream = lambda side, ddl: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{source}/{side}*")
    pairs = joins.interval_join(
        joins.Side(stream("a", "k long, a long, at timestamp"), "at", "5 minutes"),
        joins.Side(stream("b", "k long, b long, bt timestamp"), "bt", "5 minutes"), ["k"], "0 minutes", "5 minutes", "left_outer")
    assert pairs.columns == ["k", "a", "at", "b", "bt"]
    metrics = []
    query = joins.start_pairs(pairs, f"{root}/pairs", f"{root}/checkpoint")
    query.awaitTermination()
    metrics = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(metrics) >= 13 and max(metrics) <= 16, metrics
    got = {r["a"]: r["b"] for r in spark.read.parquet(f"{root}/pairs").collect()}
    assert {a: b for a, b in got.items() if a != 999} == {
        **{n: n if n % 2 else None for n in range(12)}, **{100 + n: None for n in range(12)}}
    with pytest.raises(ValueError, match="columns of both sides"):
        joins.interval_join(joins.Side(stream("a", "k long, a long, at timestamp"), "at", "1 hour"),
                            joins.Side(stream("b", "k long, a long, bt timestamp"), "bt", "1 hour"), ["k"], "0 hours", "1 hour")


def test_neighbouring_spans_are_one_stretch(place):
    """Each held row is compared with every stretch, so a long backlog must not have one for each span."""
    row = lambda part, low, high: {"source_topic": "t", "source_partition": part, "low": low, "high": high}
    narrow = dataclasses.replace(spec(f"{place}/b"), offset_span=10)
    spans = [row(0, n * 10, n * 10 + 9) for n in reversed(range(500))] + [row(0, 9000, 9003), row(1, 0, 9), row(None, 3, 4)]
    assert queries._stretches(narrow, spans) == [("t", 0, 0, 4999), ("t", 0, 9000, 9003), ("t", 1, 0, 9)]
