"""Change-data and event streams; the stream runs, then its sink is read back."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.conform import latest_by_key
from tidewater.operators.merge import live_rows
from tidewater.operators.quality import dataset_parity
from tidewater.plans.inputs import AS_OF, DECODED, ENVELOPE, IMAGE, RULES, at, topic_rows
from tidewater.plans.registry import query
from tidewater.session import scratch_path, written
from tidewater.sources import zones
from tidewater.sources.extract import scan
from tidewater.streaming import cdc, joins, queries, rotation

RUN = "batch-0"
TOPIC_DDL = "topic string, partition int, offset bigint, key string, value string, timestamp timestamp"
STATE = T.StructType([
    *IMAGE.fields, T.StructField("last_operation", T.StringType()), T.StructField("last_event_time", T.TimestampType()),
    T.StructField("source_offset", T.LongType()), T.StructField("is_deleted", T.BooleanType())])
DATASET = "bronze.events_cdc"


def _decoded(spark, folder, redeliver=True):
    return cdc.cdc_decode(topic_rows(scan(spark, folder, "events"), redeliver), ENVELOPE)


def _accepted(spark, folder):
    return cdc.accepted_records(cdc.cdc_check(_decoded(spark, folder), RULES), AS_OF, RUN)


def _keyed(spark, folder, window):
    """Run a counting stream over the events table to its end and read the sink."""
    counts = queries.stream_key_counts(
        queries.stream_table(spark, folder, "events"), "ts", "2 days", "event_type", window)
    path = scratch_path(spark, "counts")
    stream = queries.start_counts(counts, f"{path}/out", f"{path}/checkpoint")
    stream.awaitTermination()
    keys = ["event_type"] if window is None else ["event_type", "window_start"]
    return queries.read_counts(spark, f"{path}/out", keys, counts.schema)


@query("stream_key_counts", """
SELECT event_type, count(*) AS event_count, max(ts) AS last_ts FROM events GROUP BY event_type""")
def stream_key_counts(spark, folder):
    return _keyed(spark, folder, None)


@query("stream_tumbling", """
SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, count(*) AS event_count
FROM events GROUP BY ALL""")
def stream_tumbling(spark, folder):
    return _keyed(spark, folder, "6 hours")


@query("cdc_decode", "WITH" + DECODED + """
SELECT * EXCLUDE (copies) FROM decoded
UNION ALL SELECT * EXCLUDE (copies) REPLACE (received_at + INTERVAL 1 HOUR AS received_at)
FROM decoded WHERE copies = 2""")
def cdc_decode(spark, folder):
    return _decoded(spark, folder)


@query("cdc_dedup", "WITH" + DECODED + """
SELECT * EXCLUDE (copies) FROM decoded WHERE received_at >= '2024-01-05'""")
def cdc_dedup(spark, folder):
    """Copies fold, and positions the target already holds are left out."""
    decoded = _decoded(spark, folder)
    held = decoded.filter(F.col("received_at") < at("2024-01-05").cast("timestamp"))
    return cdc.cdc_dedup(decoded, held)


@query("cdc_split", "WITH" + DECODED + """
SELECT event_id, source_partition, source_offset, operation, NULL AS reason, 1 AS records,
       TRUE AS accepted FROM accepted
UNION ALL SELECT event_id, source_partition, source_offset, operation, reason, 1, FALSE
FROM judged WHERE reason <> ''
UNION ALL SELECT event_id, source_partition, source_offset, operation, 'offset_not_duplicate', 1, FALSE
FROM judged WHERE copies = 2""")
def cdc_split(spark, folder):
    accepted, rejected, _ = cdc.cdc_split(_decoded(spark, folder), RULES, AS_OF, DATASET, RUN,
                                          path=scratch_path(spark, "checked"))
    columns = ["event_id", "source_partition", "source_offset", "operation"]
    return accepted.select(
        *columns, F.lit(None).cast("string").alias("reason"), F.lit(1).alias("records"),
        F.lit(True).alias("accepted")).unionByName(rejected.select(
            *columns, "reason", F.col("records").cast("int"), F.lit(False).alias("accepted")))


@query("cdc_current_state", "WITH" + DECODED + """
SELECT user_id, email, status, amount, operation AS last_operation, event_time AS last_event_time
FROM accepted
QUALIFY operation <> 'd'
  AND row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, source_offset) = 1""")
def cdc_current_state(spark, folder):
    """Two deliveries of stored changes, the newer one first: the older must not undo it."""
    changes = written(spark, _accepted(spark, folder), scratch_path(spark, "changes"))
    changes = changes.withColumnRenamed("event_time", "last_event_time")
    state = spark.createDataFrame([], STATE)
    cut = at("2024-01-15").cast("timestamp")
    for part in (changes.filter(F.col("last_event_time") >= cut),
                 changes.filter(F.col("last_event_time") < cut)):
        state = cdc.cdc_current_state(state, part, ["user_id"], "last_event_time", ("d",),
                                      ["source_offset"])
    return live_rows(state, "is_deleted").drop("source_offset")


# The topic as five files, one micro-batch each; small row groups let all cores read one file. The second
# delivery of a position comes in the same micro-batch for every other run of five, else in the next one.
ROW_GROUP_BYTES = 8 * 1024 * 1024
SAME = "(source_offset // 5) % 2 = 0"


def _topic_files(spark, folder, keep=None):
    rows = topic_rows(scan(spark, folder, "events"))
    first = F.min("timestamp").over(W.partitionBy("offset"))
    again = F.pmod(F.floor(F.col("offset") / 5), F.lit(2)) * (F.col("timestamp") > first).cast("int")
    filed = rows.withColumn("file", F.pmod(F.col("offset") + again, F.lit(5)).cast("int"))
    place = scratch_path(spark, "topic")
    (filed if keep is None else filed.filter(keep)).repartition("file").write.option(
        "parquet.block.size", ROW_GROUP_BYTES).partitionBy("file").parquet(place)
    return place


def _spec(root, name="events"):
    return queries.BronzeStream(
        name=name, table=f"{root}/events_cdc", results_table=f"{root}/results", rejects_table=f"{root}/rejects",
        lineage_table=f"{root}/lineage", dataset=DATASET, envelope=ENVELOPE, rules=RULES,
        source_system="app", connector="files", catalog="lake")


def _stream(spark, place, spec, checkpoint):
    rows = spark.readStream.schema(TOPIC_DDL + ", file int").option("maxFilesPerTrigger", 1).parquet(place).drop("file")
    queries.start_bronze(rows, spec, checkpoint, lambda _: AS_OF, trigger=None).awaitTermination()


def _run_bronze(spark, folder):
    """Stream the change topic into a fresh bronze table, in five micro-batches."""
    root = scratch_path(spark, "bronze")
    spec = _spec(root)
    _stream(spark, _topic_files(spark, folder), spec, f"{root}/checkpoint")
    return spec


def _bronze_rows(spark, spec):
    return queries.read_stream_table(spark, spec.table, queries.bronze_schema(spark, spec))


ACCEPTED_COLUMNS = ["event_id", "source_topic", "source_partition", "source_offset", "operation",
                    "user_id", "email", "status", "amount", "event_time"]


@query("stream_bronze", "WITH" + DECODED + f"""
SELECT {', '.join(ACCEPTED_COLUMNS)}, CAST(event_time AS DATE) AS event_day FROM accepted""")
def stream_bronze(spark, folder):
    spec = _run_bronze(spark, folder)
    return _bronze_rows(spark, spec).select(*ACCEPTED_COLUMNS, "event_day")


@query("stream_rotated", "WITH" + DECODED + f"""
SELECT {', '.join(ACCEPTED_COLUMNS)}, CAST(event_time AS DATE) AS event_day, CAST(hour(event_time) AS INTEGER) AS event_hour
FROM accepted""")
def stream_rotated(spark, folder):
    """Five micro-batches, of which the first four are folded in two rotations; readers see both forms."""
    spec = _run_bronze(spark, folder)
    (checkpoint,) = (r["checkpoint"] for r in _bronze_rows(spark, spec).select("checkpoint").distinct().collect())
    for upto in (1, 3):
        rotation.rotate(spark, spec, checkpoint, upto)
    return rotation.read_bronze(spark, spec).select(*ACCEPTED_COLUMNS, "event_day", "event_hour")


# Event time of the files that a stream takes one by one; both sides of a join move on together.
CUTS = ("2024-01-08", "2024-01-15", "2024-01-22", "2024-02-01")


def _in_order(spark, rows, key, ts, place):
    """One file per stretch of event time, in order, and last a row beyond all others, which releases what waits.

    That row has a key, as rows without one are left out ahead of the watermark.
    """
    low = None
    for n, high in enumerate(CUTS):
        part = rows.filter(F.col(ts) < at(high).cast("timestamp"))
        (part if low is None else part.filter(F.col(ts) >= at(low).cast("timestamp"))).coalesce(1).write.parquet(f"{place}/f={n}")
        low = high
    last = {ts: "2030-01-01 00:00:00", key: "-1"}
    closing = [F.lit(last.get(c)).cast(t).alias(c) for c, t in rows.dtypes]
    spark.range(1).select(*closing).coalesce(1).write.parquet(f"{place}/f={len(CUTS)}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/f=*")


@query("stream_interval_join", """
SELECT c.user_id, c.event_id AS click_id, c.ts AS clicked_at, p.event_id AS purchase_id, p.ts AS purchased_at, p.value AS amount
FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND p.event_type = 'purchase'
  AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR
WHERE c.event_type = 'click'""")
def stream_interval_join(spark, folder):
    """Clicks with the purchases of the six hours after them, both as streams in five micro-batches."""
    events = scan(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    root = scratch_path(spark, "pairs")
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked_at"))
    purchases = events.filter("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchased_at"), F.col("value").alias("amount"))
    pairs = joins.interval_join(
        joins.Side(_in_order(spark, clicks, "user_id", "clicked_at", f"{root}/clicks"), "clicked_at", "1 hour"),
        joins.Side(_in_order(spark, purchases, "user_id", "purchased_at", f"{root}/purchases"), "purchased_at", "1 hour"),
        ["user_id"], "0 hours", "6 hours", "left_outer")
    joins.start_pairs(pairs, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(pairs.schema).parquet(f"{root}/out").select(*pairs.columns).filter("click_id IS NOT NULL")


@query("stream_dead_letters", "WITH" + DECODED + """
SELECT event_id, reason, 1 AS records FROM judged WHERE reason <> ''
UNION ALL SELECT event_id, CASE WHEN """ + SAME + """ OR reason = '' THEN 'offset_not_duplicate' ELSE reason END, 1
FROM judged WHERE copies = 2""")
def stream_dead_letters(spark, folder):
    spec = _run_bronze(spark, folder)
    return queries.read_stream_table(spark, spec.rejects_table).select(
        "event_id", "reason", F.col("records").cast("int").alias("records"))


@query("stream_quality", "WITH" + DECODED + """,
totals AS (  -- a second delivery in another micro-batch is judged again
  SELECT sum(times) FILTER (user_id IS NULL) AS no_key, sum(times) FILTER (operation = 'x') AS bad_op,
         count(*) FILTER (copies = 2 AND (times = 1 OR reason = '')) AS duplicate,
         sum(times) FILTER (event_time IS NULL) AS no_time, sum(times) FILTER (no_email) AS no_email
  FROM (SELECT *, CASE WHEN copies = 2 AND NOT (""" + SAME + """) THEN 2 ELSE 1 END AS times FROM judged)),
checks AS (
  SELECT 'key_present' AS check_name, 'blocking' AS severity, no_key AS n FROM totals
  UNION ALL SELECT 'operation_allowed', 'blocking', bad_op FROM totals
  UNION ALL SELECT 'offset_not_duplicate', 'blocking', duplicate FROM totals
  UNION ALL SELECT 'event_time_present', 'warning', no_time FROM totals
  UNION ALL SELECT 'active_has_email', 'warning', no_email FROM totals)
SELECT check_name, severity, CASE WHEN n = 0 THEN 'PASSED' WHEN severity = 'blocking' THEN 'FAILED'
       ELSE 'WARNING' END AS status, CAST(n AS DOUBLE) AS metric_value
FROM checks""")
def stream_quality(spark, folder):
    """Evidence of all micro-batches, added up per check."""
    spec = _run_bronze(spark, folder)
    batches = queries.read_stream_table(spark, spec.results_table)
    fails_as = F.when(F.col("severity") == "blocking", "FAILED").otherwise("WARNING")
    return batches.groupBy("check_name", "severity").agg(
        F.sum("metric_value").alias("metric_value")
    ).withColumn("status", F.when(F.col("metric_value") > 0, fails_as).otherwise("PASSED"))


@query("stream_lineage", "WITH" + DECODED + """
SELECT source_topic, source_partition, min(source_offset) AS offset_min, max(source_offset) AS offset_max,
       min(event_time) AS event_time_min, max(event_time) AS event_time_max, count(*) AS row_count,
       'bronze.events_cdc' AS target_table, 'events' AS job_name, 'app' AS source_system, 'FAILED' AS quality_status
FROM accepted GROUP BY source_topic, source_partition""")
def stream_lineage(spark, folder):
    """One record per micro-batch and topic partition, here over all batches."""
    spec = _run_bronze(spark, folder)
    return queries.read_stream_table(spark, spec.lineage_table).groupBy(
        "source_topic", "source_partition", "target_table", "job_name", "source_system").agg(
        F.min("quality_status").alias("quality_status"),
        F.min("offset_min").alias("offset_min"), F.max("offset_max").alias("offset_max"),
        F.min("event_time_min").alias("event_time_min"),
        F.max("event_time_max").alias("event_time_max"), F.sum("row_count").alias("row_count"))


@query("replay_rebuild", "WITH" + DECODED + """
SELECT 'rows' AS measure, CAST(count(*) AS DOUBLE) AS left_value,
       CAST(count(*) FILTER (source_partition > 0) AS DOUBLE) AS right_value, FALSE AS agrees FROM accepted
UNION ALL SELECT 'schema', 1, 1, TRUE
UNION ALL SELECT 'highest_offset', max(source_offset), max(source_offset) FILTER (source_partition > 0),
       max(source_offset) = max(source_offset) FILTER (source_partition > 0) FROM accepted
UNION ALL SELECT 'rows_on_one_side_only', count(*) FILTER (source_partition = 0), 0, FALSE FROM accepted""")
def replay_rebuild(spark, folder):
    """A rebuild from retained events against what the stream wrote; one partition is no longer retained."""
    spec = _run_bronze(spark, folder)
    log = topic_rows(scan(spark, folder, "events")).filter("partition > 0")
    rebuilt = queries.replay_rebuild(log, spec, AS_OF).select(*ACCEPTED_COLUMNS)
    streamed = _bronze_rows(spark, spec).select(*ACCEPTED_COLUMNS)
    return dataset_parity(streamed, rebuilt, {"highest_offset": F.max("source_offset")})


@query("stream_two_sources", "WITH" + DECODED + """
SELECT CASE WHEN source_offset % 2 = 0 THEN 'even' ELSE 'odd' END AS stream,
       count(*) FILTER (reason = '') AS committed,
       count(*) FILTER (reason <> '') + count(*) FILTER (copies = 2) AS failed, 5 AS batches
FROM judged GROUP BY 1""")
def stream_two_sources(spark, folder):
    """Two streams that write to the same four tables, each with its own batches 0, 1, 2 ..."""
    root = scratch_path(spark, "shared-bronze")
    for name, rest in (("even", 0), ("odd", 1)):
        _stream(spark, _topic_files(spark, folder, F.col("offset") % 2 == rest), _spec(root, name), f"{root}/checkpoint-{name}")
    spec = _spec(root)
    batches = queries.read_stream_table(spark, spec.results_table).groupBy("stream").agg(
        F.countDistinct("pipeline_run_id").cast("int").alias("batches"))
    return queries.record_counts(spark, spec).join(batches, "stream").select("stream", "committed", "failed", "batches")


@query("stream_restart", "WITH" + DECODED + f"""
SELECT {', '.join(ACCEPTED_COLUMNS)} FROM accepted""")
def stream_restart(spark, folder):
    """A stream that starts over with a new checkpoint on the table it has half filled."""
    root = scratch_path(spark, "restarted-bronze")
    spec = _spec(root)
    _stream(spark, _topic_files(spark, folder, F.col("offset") % 3 > 0), spec, f"{root}/checkpoint-1")
    _stream(spark, _topic_files(spark, folder), spec, f"{root}/checkpoint-2")
    return _bronze_rows(spark, spec).select(*ACCEPTED_COLUMNS)


@query("stream_current_state", "WITH" + DECODED + """
SELECT user_id, email, status, amount, operation AS last_operation, event_time AS last_event_time
FROM accepted
QUALIFY operation <> 'd'
  AND row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, source_offset) = 1""")
def stream_current_state(spark, folder):
    """Accepted changes streamed into silver out of order, in three micro-batches.

    Changes of one instant come together: between micro-batches an equal sequence changes nothing, so
    their order of arrival would decide.
    """
    changes = _accepted(spark, folder).withColumnRenamed("event_time", "last_event_time")
    place, root = scratch_path(spark, "changes"), scratch_path(spark, "state")
    filed = changes.withColumn("file", F.pmod(F.xxhash64("last_event_time"), F.lit(3)).cast("int"))
    filed.repartition("file").write.partitionBy("file").parquet(place)
    rows = spark.readStream.schema(filed.schema).option("maxFilesPerTrigger", 1).parquet(place)
    queries.start_current_state(
        rows, f"{root}/users", f"{root}/checkpoint", STATE, ["user_id"], "last_event_time", ("d",), lambda _: AS_OF,
        ["source_offset"], trigger=None).awaitTermination()
    return live_rows(zones.read_table(spark, f"{root}/users"), "is_deleted").drop("source_offset")


@query("consumer_lag", "WITH" + DECODED + """,
source AS (SELECT source_topic, source_partition, max(source_offset) AS source_offset,
                  max(event_time) AS source_time FROM decoded GROUP BY ALL),
sink AS (SELECT source_topic, source_partition, max(source_offset) AS sink_offset,
                max(event_time) AS sink_time FROM accepted WHERE received_at < '2024-01-28' GROUP BY ALL)
SELECT source_topic, source_partition, source_offset, sink_offset,
       source_offset - coalesce(sink_offset, -1) AS offset_lag,
       (epoch_us(source_time) - epoch_us(sink_time)) / 1000000.0 AS lag_seconds
FROM source LEFT JOIN sink USING (source_topic, source_partition)""")
def consumer_lag(spark, folder):
    source = _decoded(spark, folder)
    seen = source.filter(F.col("received_at") < at("2024-01-28").cast("timestamp"))
    sink = cdc.accepted_records(cdc.cdc_check(seen, RULES), AS_OF)
    return cdc.consumer_lag(source, sink)


@query("outbox_events", """
SELECT 'outbox.orders-0-' || o_orderkey AS event_id, o_custkey AS customer_id, o_orderstatus AS status,
       o_totalprice AS amount, o_orderdate AS event_time FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def outbox_events(spark, folder):
    """Outbox rows written with the order become the stream; the newest per customer stands."""
    image = T.StructType([T.StructField("customer_id", T.LongType()),
                          T.StructField("status", T.StringType()),
                          T.StructField("amount", T.DoubleType())])
    row = F.struct(F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"),
                   F.col("o_totalprice").alias("amount"))
    when = F.col("o_orderdate").cast("timestamp")
    outbox = scan(spark, folder, "orders").select(
        F.lit("outbox.orders").alias("topic"), F.lit(0).alias("partition"),
        F.col("o_orderkey").alias("offset"), F.col("o_custkey").cast("string").alias("key"),
        F.to_json(F.struct(F.lit("c").alias("op"), row.alias("after"), F.struct(
            F.unix_micros(when).alias("ts_us")).alias("source"))).alias("value"),
        when.alias("timestamp"))
    events = cdc.cdc_dedup(cdc.cdc_decode(outbox, cdc.envelope(image)))
    return latest_by_key(events, ["customer_id"], "event_time", ["source_offset"]).select(
        "event_id", "customer_id", "status", "amount", "event_time")
