"""Landing, cleaning, and the bronze table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators import bronze, conform
from tidewater.operators.conform import latest_by_key
from tidewater.plans.inputs import (
    BRONZE_ORDERS, EVIDENCE, NOW, at, bronze_orders, evidence,
)
from tidewater.plans.registry import query
from tidewater.session import open_writers, scratch_path, written
from tidewater.sources import extract, landing, zones
from tidewater.sources.extract import scan

CUSTOMER_DDL = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("normalise", """
SELECT doc_id, trim('  ' || source || ' ') AS source,
       CASE WHEN lang = 'en' THEN NULL ELSE trim(lang) END AS lang,
       nullif(trim(text), '') AS text, n_chars
FROM documents""")
def normalise(spark, folder):
    raw = scan(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("  "), "source", F.lit(" ")).alias("source"),
        F.when(F.col("lang") == "en", "   ").otherwise(F.col("lang")).alias("lang"),
        "text", "n_chars")
    return conform.normalise(raw)


@query("stamp", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, '2026-08-01' AS _batch_id,
       TIMESTAMP '2026-08-01 09:00:00' AS _ingested_at,
       's3://landing/customer.csv' AS _source_file
FROM customer""")
def stamp(spark, folder):
    return conform.stamp(scan(spark, folder, "customer"), "2026-08-01",
                         "s3://landing/customer.csv", NOW)


@query("align_schema", """
SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS c_nationkey, c_acctbal,
       CAST(NULL AS VARCHAR) AS c_mktsegment, c_acctbal > 0 AS in_credit
FROM customer""")
def align_schema(spark, folder):
    delivery = scan(spark, folder, "customer").select(
        (F.col("c_acctbal") > 0).alias("in_credit"), F.col("c_name").alias("C_NAME"),
        "c_custkey", "c_acctbal")
    return conform.align_schema(delivery, T.StructType.fromDDL(CUSTOMER_DDL))


RAW_CUSTOMER = """
raw AS (
  SELECT c_custkey,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'N/A' ELSE CAST(c_nationkey AS VARCHAR) END AS nation,
         CASE WHEN c_acctbal < 0 THEN 'overdrawn' WHEN c_mktsegment = 'MACHINERY' THEN NULL
              ELSE CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) END AS balance,
         CASE WHEN c_nationkey < 3 THEN 'soon' ELSE '1996-01-02' END AS opened
  FROM customer)
"""


@query("typed_conform", "WITH" + RAW_CUSTOMER + """
SELECT c_custkey, nation AS nation_text, balance AS balance_text,
       TRY_CAST(nation AS INTEGER) AS nation, TRY_CAST(balance AS DOUBLE) AS balance,
       TRY_CAST(opened AS DATE) AS opened,
       concat_ws(',', CASE WHEN nation = 'N/A' THEN 'nation' END,
                 CASE WHEN balance = 'overdrawn' THEN 'balance' END,
                 CASE WHEN opened = 'soon' THEN 'opened' END) AS rejected_columns
FROM raw""")
def typed_conform(spark, folder):
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    raw = scan(spark, folder, "customer").select(
        "c_custkey",
        F.when(segment == "BUILDING", "N/A").otherwise(F.col("c_nationkey").cast("string")).alias("nation"),
        F.when(balance < 0, "overdrawn").when(segment == "MACHINERY", F.lit(None))
        .otherwise(balance.cast("decimal(12,2)").cast("string")).alias("balance"),
        F.when(F.col("c_nationkey") < 3, "soon").otherwise("1996-01-02").alias("opened"))
    types = {"nation": "int", "balance": "double", "opened": "date"}
    texts = raw.withColumns({"nation_text": F.col("nation"), "balance_text": F.col("balance")})
    accepted, rejected = conform.typed_conform(texts, types)
    names = F.array_join("_rejected", ",").alias("rejected_columns")
    kept = rejected.select("c_custkey", "nation_text", "balance_text", *[
        F.col(c).try_cast(t).alias(c) for c, t in types.items()], names)
    return accepted.select("c_custkey", "nation_text", "balance_text", *types,
                           F.lit("").alias("rejected_columns")).unionByName(kept)


@query("event_time_fallback", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN ts END AS event_time,
       TIMESTAMP '2024-02-01 00:00:00' AS processing_time,
       CASE WHEN event_type <> 'error' THEN ts ELSE TIMESTAMP '2024-02-01 00:00:00' END AS effective_time,
       event_type = 'error' AS event_time_missing
FROM events""")
def event_time_fallback(spark, folder):
    rows = scan(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("event_time"))
    return conform.event_time_fallback(rows, "event_time", datetime(2024, 2, 1))


@query("bronze_accumulate", "WITH" + BRONZE_ORDERS + "SELECT * FROM bronze_orders")
def bronze_accumulate(spark, folder):
    rows = bronze_orders(spark, folder)
    held = rows.filter(F.col("o_orderdate") < at("1998-01-01"))
    delivered = rows.filter(F.col("o_orderdate") >= at("1998-01-01"))
    return bronze.append_batch(held, delivered)


@query("bronze_replay", "WITH" + BRONZE_ORDERS + """
SELECT * REPLACE (CASE WHEN _batch_id = '1997-07' THEN 'C' ELSE o_orderstatus END AS o_orderstatus)
FROM bronze_orders""")
def bronze_replay(spark, folder):
    held = bronze_orders(spark, folder)
    corrected = conform.batch_filter(held, "1997-07").withColumn("o_orderstatus", F.lit("C"))
    return bronze.replace_batch(held, corrected, "1997-07")


@query("bronze_evolve", """
SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CASE WHEN l_shipdate < '1998-01-01' THEN CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE)
            ELSE l_extendedprice END AS l_extendedprice,
       CASE WHEN l_shipdate >= '1998-01-01' THEN l_linestatus END AS l_linestatus
FROM lineitem""")
def bronze_evolve(spark, folder):
    rows = scan(spark, folder, "lineitem")
    held = rows.filter(F.col("l_shipdate") < at("1998-01-01")).select(
        F.col("l_linenumber").cast("int"), F.col("l_extendedprice").cast("float"))
    wider = rows.filter(F.col("l_shipdate") >= at("1998-01-01")).select(
        "l_extendedprice", "l_linestatus", F.col("l_linenumber").cast("bigint"))
    return bronze.append_batch(held, wider)


@query("batch_filter", "WITH" + BRONZE_ORDERS + "SELECT * FROM bronze_orders WHERE _batch_id = '1997-07'")
def batch_filter(spark, folder):
    return conform.batch_filter(bronze_orders(spark, folder), "1997-07")


@query("batch_conflicts", "WITH" + BRONZE_ORDERS + """
SELECT _batch_id, count(*) FILTER (o_orderdate >= '1997-01-15') AS incoming_rows,
       count(*) FILTER (o_orderdate < '1999-01-01') AS held_rows
FROM bronze_orders GROUP BY _batch_id HAVING incoming_rows > 0 AND held_rows > 0""")
def batch_conflicts(spark, folder):
    rows = bronze_orders(spark, folder)
    return conform.batch_conflicts(rows.filter(F.col("o_orderdate") < at("1999-01-01")),
                                   rows.filter(F.col("o_orderdate") >= at("1997-01-15")))


@query("batch_inventory", "WITH" + BRONZE_ORDERS + """
SELECT _batch_id, count(*) AS row_count FROM bronze_orders GROUP BY _batch_id""")
def batch_inventory(spark, folder):
    return bronze.batch_inventory(bronze_orders(spark, folder))


@query("partition_layout", """
SELECT event_type, CAST(ts AS DATE) AS _day, count(*) AS row_count,
       min(ts) AS first_ts, max(ts) AS last_ts
FROM events GROUP BY ALL""")
def partition_layout(spark, folder):
    """Written in the declared order below zone and day, then counted from what is stored."""
    path = scratch_path(spark, "layout")
    laid = bronze.layout(scan(spark, folder, "events"), "event_type", "ts",
                         [("ts", True), ("event_id", False)])
    laid.write.partitionBy("event_type", "_day").parquet(path)
    stored = spark.read.schema(laid.schema).parquet(path)
    return bronze.partition_counts(stored, "event_type", "ts")


@query("layout_clustered", """
SELECT event_type, count(*) AS row_count, min(ts) AS first_ts, max(user_id) AS last_user, TRUE AS skips FROM events GROUP BY event_type""")
def layout_clustered(spark, folder):
    """Events laid out by time and user at once, read back; whether a slice of either column opens at most half of the files."""
    path, events = scratch_path(spark, "clustered"), scan(spark, folder, "events")
    bronze.layout_clustered(events, ["ts", "user_id"], 64).write.parquet(path)
    stored = spark.read.schema(events.schema).parquet(path)
    spans = written(spark, bronze.file_spans(stored, ["ts", "user_id"]), scratch_path(spark, "spans"))
    users = events.agg(F.percentile_approx("user_id", [0.5, 0.55])).first()[0]
    met = spans.agg(
        F.avg(F.expr("low_ts < timestamp_ntz '2024-01-17' AND high_ts >= timestamp_ntz '2024-01-16'").cast("int")).alias("by_time"),
        F.avg(((F.col("low_user_id") <= users[1]) & (F.col("high_user_id") >= users[0])).cast("int")).alias("by_user")).first()
    return stored.groupBy("event_type").agg(
        F.count("*").alias("row_count"), F.min("ts").alias("first_ts"), F.max("user_id").alias("last_user")).withColumn(
        "skips", F.lit(bool(met["by_time"] <= 0.5 and met["by_user"] <= 0.5)))


@query("empty_clone", """
SELECT * FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT * FROM (SELECT * FROM customer WHERE 1 = 0)""")
def empty_clone(spark, folder):
    customer = scan(spark, folder, "customer")
    return bronze.empty_like(customer).unionByName(customer.filter(F.col("c_acctbal") >= 0))


@query("purge_run", "WITH" + EVIDENCE + "SELECT * FROM evidence WHERE run_id <> 'run-7' OR run_id IS NULL")
def purge_run(spark, folder):
    return bronze.purge_run(evidence(spark, folder), "run-7")


@query("balanced_extract", """
SELECT CASE WHEN l_orderkey % 3 = 0 THEN 7 WHEN l_orderkey % 50 = 1 THEN NULL ELSE l_suppkey END AS l_suppkey,
       count(*) AS row_count, TRUE AS balanced
FROM lineitem GROUP BY 1""")
def balanced_extract(spark, folder):
    """Rows per key over all ranges of a key that a third of them share, and whether the largest range is at most twice the mean."""
    lines = scan(spark, folder, "lineitem")
    key = F.when(F.col("l_orderkey") % 3 == 0, 7).when(F.col("l_orderkey") % 50 == 1, F.lit(None)).otherwise(F.col("l_suppkey"))
    tagged = extract.balanced_ranges(lines.withColumn("l_suppkey", key.cast("bigint")), "l_suppkey", 16)
    counts = written(spark, tagged.groupBy("_range", "l_suppkey").agg(F.count("*").alias("n")), scratch_path(spark, "ranges"))
    sizes = counts.filter("_range >= 0").groupBy("_range").agg(F.sum("n").alias("size"))
    balanced = sizes.agg(F.max("size") <= 2 * F.avg("size")).first()[0]
    return counts.groupBy("l_suppkey").agg(F.sum("n").alias("row_count")).withColumn("balanced", F.lit(balanced))


@query("incremental_extract", """
SELECT * FROM events WHERE ts >= '2024-01-19'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def incremental_extract(spark, folder):
    return extract.incremental_extract(
        scan(spark, folder, "events"), "ts", datetime(2024, 1, 20), timedelta(days=1), ["user_id"])


@query("snapshot_extract", """
WITH bounds AS (SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders)
SELECT CAST((o_orderkey - low) * 16 // (high - low + 1) AS INTEGER) AS _range, count(*) AS row_count,
       min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM orders, bounds GROUP BY 1""")
def snapshot_extract(spark, folder):
    ranged = extract.snapshot_extract(scan(spark, folder, "orders"), "o_orderkey", 16)
    return ranged.groupBy("_range").agg(
        F.count("*").alias("row_count"), F.min("o_orderkey").alias("first_key"),
        F.max("o_orderkey").alias("last_key"))


@query("bootstrap_tail", """
SELECT * FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def bootstrap_tail(spark, folder):
    events = scan(spark, folder, "events")
    snapshot = latest_by_key(events.filter(F.col("ts") < at("2024-01-15")), ["user_id"], "ts")
    log = events.filter(F.col("ts") >= at("2024-01-14"))
    return extract.bootstrap_with_tail(snapshot, log, ["user_id"], "ts")


EVENT_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("landing_csv", "SELECT * FROM customer")
def landing_csv(spark, folder):
    path = scratch_path(spark, "landing") + "/customer.csv"
    landing.export_csv(scan(spark, folder, "customer"), path)
    return landing.read_landing(spark, path, CUSTOMER_DDL)


@query("landing_ndjson", "SELECT * FROM events")
def landing_ndjson(spark, folder):
    path = scratch_path(spark, "landing") + "/events.ndjson"
    scan(spark, folder, "events").write.option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return landing.read_landing(spark, path, EVENT_DDL)


@query("export_csv", "SELECT CAST(c_custkey AS VARCHAR) AS _c0, c_mktsegment AS _c1 FROM customer")
def export_csv(spark, folder):
    path = scratch_path(spark, "export") + "/out"
    landing.export_csv(scan(spark, folder, "customer").select("c_custkey", "c_mktsegment"),
                       path, header=False)
    return spark.sql(f"SELECT _c0, _c1 FROM csv.`{path}`")


@query("landing_rejects", "WITH" + RAW_CUSTOMER + """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, nation = 'N/A' AS rejected FROM raw""")
def landing_rejects(spark, folder):
    """Lines that do not fit the declared types are kept apart instead of becoming nulls."""
    path = scratch_path(spark, "landing") + "/nations.csv"
    scan(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "N/A").otherwise(
            F.col("c_nationkey").cast("string")).alias("nation")).write.option("header", True).csv(path)
    fits, rejects = landing.read_landing_checked(spark, path, "c_custkey bigint, nation int")
    return fits.select("c_custkey", F.lit(False).alias("rejected")).unionByName(
        rejects.select(F.col("c_custkey").cast("bigint"), F.lit(True).alias("rejected")))


def _stored_bronze(spark, folder):
    """Three yearly deliveries on disk: one replayed, then compacted, then one more."""
    table = scratch_path(spark, "bronze") + "/orders"
    rows = bronze_orders(spark, folder)
    part = lambda name, since, until: rows.filter(
        (F.col("o_orderdate") >= at(since)) & (F.col("o_orderdate") < at(until))
    ).withColumn("_batch_id", F.lit(name))
    early, middle, late = (part("early", "1900-01-01", "1997-01-01"),
                           part("middle", "1997-01-01", "2000-01-01"),
                           part("late", "2000-01-01", "2100-01-01"))
    zones.land_batch(early.withColumn("o_orderstatus", F.lit("?")), table, "early", NOW)
    zones.land_batch(middle, table, "middle", NOW)
    zones.land_batch(early, table, "early", NOW, on_existing="replace")
    zones.compact_table(spark, table, NOW, "bronze")
    zones.land_batch(late, table, "late", NOW)
    return table


@query("bronze_table", "WITH" + BRONZE_ORDERS + """
SELECT * REPLACE (CASE WHEN o_orderdate < '1997-01-01' THEN 'early'
                       WHEN o_orderdate < '2000-01-01' THEN 'middle' ELSE 'late' END AS _batch_id)
FROM bronze_orders""")
def bronze_table(spark, folder):
    return zones.read_table(spark, _stored_bronze(spark, folder))


@query("version_log", """
WITH log(version, unit, operation) AS (
  VALUES (1, 'early', 'create'), (2, 'middle', 'append'), (3, 'early', 'replace'), (4, '*', 'compact'),
         (5, 'late', 'append'))
SELECT CAST(version AS BIGINT) AS version, unit, operation,
       CASE unit WHEN 'early' THEN (SELECT count(*) FROM orders WHERE o_orderdate < '1997-01-01')
         WHEN 'middle' THEN (SELECT count(*) FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '2000-01-01')
         WHEN 'late' THEN (SELECT count(*) FROM orders WHERE o_orderdate >= '2000-01-01')
         ELSE (SELECT count(*) FROM orders WHERE o_orderdate < '2000-01-01') END AS row_count
FROM log""")
def version_log(spark, folder):
    """Every commit with the rows its directory holds."""
    table = _stored_bronze(spark, folder)
    rows = spark.read.parquet(f"{table}/data").groupBy(
        F.concat(F.lit("data/_version="), F.col("_version").cast("string")).alias("directory")).agg(
        F.count("*").alias("row_count"))
    return zones.version_log(spark, table).join(rows, "directory").select(
        "version", "unit", "operation", "row_count")


@query("file_inventory", """
SELECT l_returnflag, count(*) AS row_count, 1 AS files, FALSE AS has_empty_file FROM lineitem GROUP BY l_returnflag""")
def file_inventory(spark, folder):
    """A table of several files: one per return flag, counted file by file."""
    place = scratch_path(spark, "by-flag")
    rows = scan(spark, folder, "lineitem").select("l_orderkey", "l_returnflag").repartition("l_returnflag")
    with open_writers(spark, 16):
        rows.write.partitionBy("l_returnflag").parquet(place)
    inventory = zones.file_inventory(spark.read.parquet(place))
    flag = F.url_decode(F.regexp_extract("file_path", "l_returnflag=([^/]+)/", 1)).alias("l_returnflag")
    return inventory.groupBy(flag).agg(
        F.sum("row_count").alias("row_count"), F.count("*").cast("int").alias("files"),
        F.bool_or(F.col("size_bytes") <= 0).alias("has_empty_file"))
