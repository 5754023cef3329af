"""Lineage events, edges and closure; metadata gaps and freshness."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.names import col
from tidewater.functions.time import age_minutes, as_instant, instant
from tidewater.session import scratch_path, written

# Fixed value: how an instant is written into a lineage payload.
PAYLOAD_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
# Pairs that one task of the closure's last step holds in memory, about 150 bytes each.
TASK_ROWS = 500_000
EVENT_DDL = "type string, source string, target string, run_id string, timestamp string"


def lineage_events(runs: DataFrame) -> DataFrame:
    """One JSON payload per job run (`type, source, target, run_id, finished_at`)."""
    payload = F.struct(
        F.col("type"), F.col("source"), F.col("target"), F.col("run_id"),
        F.date_format(as_instant(F.col("finished_at")), PAYLOAD_TIME).alias("timestamp"))
    return runs.select("run_id", F.to_json(payload).alias("payload"))


def lineage_edges(events: DataFrame) -> DataFrame:
    """Edges from payloads: multi-source events are split, retries and replays folded."""
    fields = F.from_json("payload", EVENT_DDL).alias("e")
    single = events.select(fields).select(
        F.col("e.type").alias("type"), F.explode(F.split("e.source", ",")).alias("source"),
        F.col("e.target").alias("target"),
        F.col("e.timestamp").cast("timestamp").alias("_seen"))
    spelt = lambda moment: F.date_format(moment, PAYLOAD_TIME)
    return single.groupBy("type", F.trim("source").alias("source"), "target").agg(
        F.count("*").alias("runs"), spelt(F.min("_seen")).alias("first_seen"),
        spelt(F.max("_seen")).alias("last_seen"))


def lineage_closure(edges: DataFrame, max_depth: int) -> DataFrame:
    """Every (source, target) reachable along edges, with the shortest distance.

    Nearly all nodes are landing objects, which nothing leads to. The search starts from the other
    nodes only, breadth first: each round joins the newly reached pairs to the edges and keeps those
    not seen before, so cycles end by themselves. Landing objects reach what their targets reach, which
    is one join at the end. Rounds are written to the shared folder, and the loop stops when one adds
    nothing. A path longer than `max_depth` is an error, not a silent cut.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "closure")
    links = written(spark, edges.select("source", "target").filter("source <> target").distinct(),
                    f"{root}/links")
    led_to = links.select(F.col("target").alias("source")).distinct()
    inner = written(spark, links.join(led_to, "source", "left_semi"), f"{root}/inner")
    step = inner.select(F.col("source").alias("target"), F.col("target").alias("_next"))
    paths = [f"{root}/depth-1"]
    frontier = written(spark, inner.withColumn("depth", F.lit(1)), paths[0])
    while not frontier.isEmpty():
        depth = len(paths) + 1
        seen = spark.read.schema(frontier.schema).parquet(*paths).select("source", "target")
        # Few nodes that many lead to end as few steps, which are sent to all tasks instead of sorting all rows of a node in one.
        ahead = written(spark, step.join(frontier.select("target").distinct(), "target", "left_semi"), f"{root}/ahead-{depth}")
        found = (frontier.join(ahead, "target")
                 .select("source", F.col("_next").alias("target"))
                 .filter("source <> target").distinct()
                 .join(seen, ["source", "target"], "left_anti")
                 .withColumn("depth", F.lit(depth)))
        paths.append(f"{root}/depth-{depth}")
        frontier = written(spark, found, paths[-1])
        if depth > max_depth and not frontier.isEmpty():
            raise ValueError(f"lineage reaches deeper than max_depth={max_depth}")
    reached = spark.read.schema(frontier.schema).parquet(*paths)
    landing = links.join(led_to, "source", "left_anti")
    onward = reached.select(F.col("source").alias("_by"), F.col("target").alias("_next"), "depth")
    # Stored first: its rows are counted, so the smallest depths are taken in tasks of a fixed number of rows.
    ways = written(spark, landing.join(onward, landing.target == onward._by)
                   .select("source", F.col("_next").alias("target"), (F.col("depth") + 1).alias("depth"))
                   .unionByName(landing.withColumn("depth", F.lit(1))), f"{root}/ways")
    beyond = (ways.repartition(-(-ways.count() // TASK_ROWS) or 1, "source", "target")
              .groupBy("source", "target").agg(F.min("depth").alias("depth")))
    if len(paths) > max_depth and not beyond.filter(F.col("depth") > max_depth).isEmpty():
        raise ValueError(f"lineage reaches deeper than max_depth={max_depth}")
    return reached.unionByName(beyond)


def stream_lineage(accepted: DataFrame, rejected: DataFrame, run_id: str, batch_id: int, target: str,
                   now: datetime | str, facts: dict[str, str]) -> DataFrame:
    """What one committed micro-batch took from each topic partition, and whether all of it was fit.

    `facts` are constants of the stream, such as job name and version, source system, connector and
    target catalog.
    """
    place = ["source_topic", "source_partition"]
    refused = rejected.groupBy(*place).agg(F.sum("records").alias("rejected_records"))
    return accepted.groupBy(*place).agg(
        F.min("source_offset").alias("offset_min"), F.max("source_offset").alias("offset_max"),
        F.min("event_time").alias("event_time_min"), F.max("event_time").alias("event_time_max"),
        F.count("*").alias("row_count"),
    ).join(refused, place, "left").withColumns({
        "rejected_records": F.coalesce("rejected_records", F.lit(0)).cast("long"),
        "quality_status": F.when(F.col("rejected_records") > 0, "FAILED").otherwise("PASSED"),
        "run_id": F.lit(run_id), "target_table": F.lit(target),
        "target_snapshot_id": F.lit(batch_id).cast("bigint"), "published_at": instant(now),
        **{name: F.lit(value) for name, value in facts.items()}})


def metadata_gaps(registry: DataFrame, tables: DataFrame, owners: DataFrame,
                  required: list[str], max_age_minutes: float, as_of: datetime | str) -> DataFrame:
    """One row per dataset and gap.

    Gaps: `unregistered`, `missing:<attribute>`, `stale_quality`, `stale_snapshot`,
    `orphaned_owner`. `registry` carries `dataset`, the required attributes, `owner`,
    `quality_checked_at` and `snapshot_at`; `tables` lists what exists; `owners` who.
    """
    known = owners.select(F.col("owner")).distinct().withColumn("_employed", F.lit(True))
    checked = registry.join(known, "owner", "left")
    stale = lambda c: F.coalesce(
        age_minutes(F.col(c), as_of) > F.lit(float(max_age_minutes)), F.lit(True))
    gaps = F.array(
        *[F.when(col(a).isNull(), F.lit(f"missing:{a}")) for a in required],
        F.when(stale("quality_checked_at"), "stale_quality"),
        F.when(stale("snapshot_at"), "stale_snapshot"),
        F.when(F.col("owner").isNotNull() & F.col("_employed").isNull(), "orphaned_owner"))
    found = checked.select("dataset", F.explode(gaps).alias("gap")).filter("gap IS NOT NULL")
    unregistered = (tables.select("dataset").distinct()
                    .join(registry.select("dataset"), "dataset", "left_anti")
                    .withColumn("gap", F.lit("unregistered")))
    return found.unionByName(unregistered)


def dataset_freshness(status: DataFrame, versions: DataFrame, as_of: datetime | str) -> DataFrame:
    """Minutes since each dataset was last checked and last committed, and the worse one."""
    scope = ["dataset_namespace", "dataset_name"]
    newest = lambda df, c, name: df.groupBy(*scope).agg(F.max(c).alias(name))
    both = newest(status, "last_checked", "last_checked").join(
        newest(versions, "committed_at", "last_committed"), scope, "full_outer")
    aged = both.withColumns({
        "check_age_minutes": age_minutes(F.col("last_checked"), as_of),
        "commit_age_minutes": age_minutes(F.col("last_committed"), as_of)})
    return aged.withColumn(
        "freshness_minutes", F.greatest("check_age_minutes", "commit_age_minutes"))
