"""Silver state: deduplication and guarded merges."""

from pyspark.sql import functions as F

from tidewater.operators import conform as conforming
from tidewater.operators import merge
from tidewater.operators.conform import latest_by_key
from tidewater.plans.inputs import BRONZE_ORDERS, at, bronze_orders
from tidewater.plans.registry import query
from tidewater.session import scratch_path, written
from tidewater.sources.extract import scan

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_TIES = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


def _events(spark, folder):
    return scan(spark, folder, "events")


def _state(events, before):
    """State per user after everything before a moment."""
    return latest_by_key(events.filter(F.col("ts") < at(before)), ["user_id"], "ts")


def newest_event(where: str = "TRUE") -> str:
    return f"""
  SELECT * FROM events WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1"""


@query("latest_by_key", f"""
SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                           ORDER BY l_shipdate DESC NULLS LAST, {LINE_TIES}) = 1""")
def latest(spark, folder):
    return latest_by_key(scan(spark, folder, "lineitem"), LINE_KEY, "l_shipdate")


@query("dedupe_exact", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def dedupe_exact(spark, folder):
    return conforming.dedupe_exact(
        scan(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("upsert_guarded", "WITH everything AS (" + newest_event() + ") SELECT * FROM everything")
def upsert_guarded(spark, folder):
    events = _events(spark, folder)
    delivery = events.filter(F.col("ts") >= at("2024-01-18"))
    return merge.upsert(_state(events, "2024-01-20"), delivery, ["user_id"], "ts")


@query("upsert_small_batch", "WITH everything AS (" + newest_event() + ") SELECT * FROM everything")
def upsert_small_batch(spark, folder):
    """The same merge planned so that a broadcastable delivery leaves the target in place."""
    events = _events(spark, folder)
    delivery = events.filter(F.col("ts") >= at("2024-01-18"))
    return merge.upsert(_state(events, "2024-01-20"), delivery, ["user_id"], "ts", small_batch=True)


@query("upsert_stale_replay", "WITH everything AS (" + newest_event() + ") SELECT * FROM everything")
def upsert_stale_replay(spark, folder):
    events = _events(spark, folder)
    stale = events.filter(F.col("ts") < at("2024-01-20")).withColumn("value", F.lit(-1.0))
    return merge.upsert(_state(events, "2024-02-01"), stale, ["user_id"], "ts")


@query("upsert_null_seq", "WITH late AS (" + newest_event() + "), early AS ("
       + newest_event("ts < '2024-01-20'") + """)
SELECT coalesce(l.user_id, e.user_id) AS user_id,
       CASE WHEN l.event_type = 'error' AND e.user_id IS NOT NULL THEN e.event_id ELSE l.event_id END AS event_id,
       CASE WHEN l.event_type = 'error' THEN e.ts ELSE l.ts END AS ts,
       CASE WHEN l.event_type = 'error' AND e.user_id IS NOT NULL THEN e.event_type ELSE l.event_type END AS event_type,
       CASE WHEN l.event_type = 'error' AND e.user_id IS NOT NULL THEN e.value ELSE l.value END AS value,
       CASE WHEN l.event_type = 'error' AND e.user_id IS NOT NULL THEN e.props ELSE l.props END AS props
FROM late l LEFT JOIN early e USING (user_id)""")
def upsert_null_seq(spark, folder):
    """A held row without a sequence is corrected by any delivery of its key."""
    events = _events(spark, folder)
    held = _state(events, "2024-02-01").withColumn(
        "ts", F.when(F.col("event_type") != "error", F.col("ts")))
    return merge.upsert(held, events.filter(F.col("ts") < at("2024-01-20")), ["user_id"], "ts")


@query("upsert_composite", f"""
SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                           ORDER BY l_shipdate DESC NULLS LAST, {LINE_TIES}) = 1""")
def upsert_composite(spark, folder):
    lines = scan(spark, folder, "lineitem")
    held = latest_by_key(lines.filter(F.col("l_shipdate") < at("1998-01-01")), LINE_KEY, "l_shipdate")
    return merge.upsert(held, lines.filter(F.col("l_shipdate") >= at("1997-06-01")),
                        LINE_KEY, "l_shipdate")


STATE_COLUMNS = ["user_id", "ts", "event_id", "value", "is_deleted"]


@query("upsert_with_deletes", "WITH everything AS (" + newest_event() + """)
SELECT user_id, ts, event_id, value FROM everything WHERE event_type <> 'error'""")
def upsert_with_deletes(spark, folder):
    """Errors delete the user; a late, older upsert must not bring the user back."""
    changes = _events(spark, folder).select(
        "user_id", "ts", "event_id", "value", (F.col("event_type") == "error").alias("is_deleted"))
    early = changes.filter(F.col("ts") < at("2024-01-12"))
    late = changes.filter(F.col("ts") >= at("2024-01-10"))
    merged = lambda state, rows: merge.upsert_with_deletes(
        state, rows, ["user_id"], "ts", "is_deleted", null_flag_deletes=False, ties=["event_id"])
    empty = changes.filter(F.lit(False))
    state = merged(merged(empty, late), early)
    return merge.live_rows(state, "is_deleted")


@query("buffer_then_merge", "WITH everything AS (" + newest_event() + ") SELECT * FROM everything")
def buffer_then_merge(spark, folder):
    events = _events(spark, folder)
    staging = events.filter(F.col("ts") >= at("2024-01-08"))
    return merge.buffer_then_merge(_state(events, "2024-01-10"), staging, ["user_id"], "ts")


@query("staging_lag", """
SELECT (SELECT max(ts) FROM events) AS staged_max,
       (SELECT max(ts) FROM events WHERE ts < '2024-01-10') AS merged_max,
       count(*) FILTER (ts > (SELECT max(ts) FROM events WHERE ts < '2024-01-10')) AS rows_waiting
FROM events""")
def staging_lag(spark, folder):
    events = _events(spark, folder)
    curated = _state(events, "2024-01-10")
    return merge.staging_lag(curated, events, "ts")


@query("merge_on_read", """
WITH deletes AS (SELECT user_id, max(ts) AS deleted_at FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT e.* FROM events e LEFT JOIN deletes d USING (user_id)
WHERE e.event_type <> 'error' AND (d.deleted_at IS NULL OR d.deleted_at <= e.ts)""")
def merge_on_read(spark, folder):
    events = _events(spark, folder)
    is_delete = F.col("event_type") == "error"
    return merge.merge_on_read(events.filter(~is_delete), events.filter(is_delete).select("user_id", "ts"),
                               ["user_id"], "ts")


@query("merge_on_read_positions", """
SELECT * FROM lineitem WHERE NOT (l_returnflag = 'R' AND EXISTS (
  SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F'))""")
def merge_on_read_positions(spark, folder):
    """Positional deletes: an order is a file, a row inside it a position."""
    lines = scan(spark, folder, "lineitem").withColumn(
        "_pos", F.concat_ws("/", "l_linenumber", "l_returnflag"))
    closed = scan(spark, folder, "orders").filter(F.col("o_orderstatus") == "F")
    dropped = lines.filter(F.col("l_returnflag") == "R").join(
        closed, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return merge.drop_positions(lines, dropped, "l_orderkey", "_pos").drop("_pos")


@query("merge_on_read_bitmap", """
SELECT * FROM lineitem WHERE NOT (l_returnflag = 'R' AND EXISTS (
  SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F'))""")
def merge_on_read_bitmap(spark, folder):
    """Positional deletes in two generations, as bitmaps: a supplier's rows are a file, the order and line a position."""
    lines = scan(spark, folder, "lineitem").withColumn("_file", F.col("l_suppkey") % 7).withColumn(
        "_pos", F.col("l_orderkey") * 32 + F.col("l_linenumber") * 4 + F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    closed = scan(spark, folder, "orders").filter(F.col("o_orderstatus") == "F")
    dropped = lines.filter(F.col("l_returnflag") == "R").join(
        closed, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("_file", "_pos")
    early, late = (merge.deletion_bitmaps(dropped.filter(F.col("_file") % 2 == rest), "_file", "_pos") for rest in (0, 1))
    bitmaps = written(spark, merge.merged_bitmaps(early, late, "_file"), scratch_path(spark, "bitmaps"))
    return merge.drop_bitmap_positions(lines, bitmaps, "_file", "_pos").drop("_file", "_pos")


@query("staged_merges", "WITH everything AS (" + newest_event() + ") SELECT * FROM everything")
def staged_merges(spark, folder):
    """Four deliveries staged, merged in two turns; the first turn once more changes nothing."""
    events, root = _events(spark, folder), scratch_path(spark, "staged")
    staging = merge.Staging(f"{root}/staging", ["user_id"], "ts", ["event_id"])
    days = [at(day) for day in ("2024-01-08", "2024-01-15", "2024-01-22")]
    bounds = [None, *days, None]
    for n, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = events if low is None else events.filter(F.col("ts") >= low)
        staging.stage(part if high is None else part.filter(F.col("ts") < high), n)
    state = events.filter(F.lit(False))
    for turn, upto in enumerate((1, 1, 3)):
        place = f"{root}/state-{turn}"
        if staging.merge(spark, state, upto, lambda merged: merged.write.parquet(place)):
            state = spark.read.schema(events.schema).parquet(place)
    return state


@query("conform", "WITH" + BRONZE_ORDERS + """
SELECT * EXCLUDE (_batch_id, _ingested_at, _source_file) FROM bronze_orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def conform(spark, folder):
    return conforming.conform(bronze_orders(spark, folder), ["o_custkey"], "o_orderdate")


@query("conform_batch", "WITH" + BRONZE_ORDERS + """
SELECT * EXCLUDE (_batch_id, _ingested_at, _source_file) FROM bronze_orders WHERE _batch_id = '1997-07'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def conform_batch(spark, folder):
    return conforming.conform(bronze_orders(spark, folder), ["o_custkey"], "o_orderdate", "1997-07")
