"""Lineage events, edges and closure; governance of a dataset registry."""

from datetime import datetime

from pyspark.sql import functions as F

from tidewater.operators import gate, lineage, upstream
from tidewater.plans.gate import STATUS
from tidewater.plans.inputs import evidence
from tidewater.plans.registry import query
from tidewater.sources.extract import scan


def runs(spark, folder):
    """Every event is a job run between the zones of its user and segment."""
    user = F.col("user_id").cast("string")
    segment = (F.col("user_id") % 7).cast("string")
    ingest = F.col("event_type").isin("click", "view")
    transform = F.col("event_type").isin("purchase", "signup")
    return scan(spark, folder, "events").select(
        F.when(ingest, "INGESTION").when(transform, "TRANSFORM").otherwise("MATERIALISATION").alias("type"),
        F.when(ingest, F.concat(F.lit('external:app/"u'), user, F.lit('".json')))
        .when(transform, F.concat(F.lit("bronze.user_"), user))
        .otherwise(F.concat(F.lit("silver.user_"), user, F.lit(",silver.segment_"), segment)).alias("source"),
        F.when(ingest, F.concat(F.lit("bronze.user_"), user))
        .when(transform, F.concat(F.lit("silver.user_"), user))
        .otherwise(F.concat(F.lit("gold.segment_"), segment)).alias("target"),
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
        F.col("ts").alias("finished_at"))


RUNS = """
runs AS (
  SELECT CASE WHEN event_type IN ('click', 'view') THEN 'INGESTION'
              WHEN event_type IN ('purchase', 'signup') THEN 'TRANSFORM' ELSE 'MATERIALISATION' END AS type,
         CASE WHEN event_type IN ('click', 'view') THEN 'external:app/"u' || user_id || '".json'
              WHEN event_type IN ('purchase', 'signup') THEN 'bronze.user_' || user_id
              ELSE 'silver.user_' || user_id || ',silver.segment_' || (user_id % 7) END AS source,
         CASE WHEN event_type IN ('click', 'view') THEN 'bronze.user_' || user_id
              WHEN event_type IN ('purchase', 'signup') THEN 'silver.user_' || user_id
              ELSE 'gold.segment_' || (user_id % 7) END AS target,
         'run-' || event_id AS run_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS finished_at
  FROM events)
"""


@query("lineage_event", "WITH" + RUNS + """
SELECT run_id, '{"type":"' || type || '","source":"' || replace(source, '"', '\\"') || '","target":"'
       || target || '","run_id":"' || run_id || '","timestamp":"' || finished_at || '"}' AS payload
FROM runs""")
def lineage_event(spark, folder):
    return lineage.lineage_events(runs(spark, folder))


@query("lineage_edges", "WITH" + RUNS + """
SELECT type, source, target, count(*) AS runs, min(finished_at) AS first_seen,
       max(finished_at) AS last_seen
FROM (SELECT type, unnest(string_split(source, ',')) AS source, target, finished_at FROM runs)
GROUP BY type, source, target""")
def lineage_edges(spark, folder):
    return lineage.lineage_edges(lineage.lineage_events(runs(spark, folder)))


def zone_edges(spark, folder):
    """Landing file to bronze to silver to gold: order, customer, nation, region."""
    name = lambda zone, c: F.concat(F.lit(zone), F.col(c).cast("string"))
    edge = lambda table, a, b: scan(spark, folder, table).select(
        a.alias("source"), b.alias("target"))
    return (edge("orders", name("landing.order_", "o_orderkey"), name("bronze.customer_", "o_custkey"))
            .unionByName(edge("customer", name("bronze.customer_", "c_custkey"),
                              name("silver.nation_", "c_nationkey")))
            .unionByName(edge("nation", name("silver.nation_", "n_nationkey"),
                              name("gold.region_", "n_regionkey")))
            .unionByName(edge("region", name("gold.region_", "r_regionkey"),
                              F.lit("gold.region_0"))))


@query("lineage_closure", """
WITH RECURSIVE edges AS (
  SELECT 'landing.order_' || o_orderkey AS source, 'bronze.customer_' || o_custkey AS target FROM orders
  UNION SELECT 'bronze.customer_' || c_custkey, 'silver.nation_' || c_nationkey FROM customer
  UNION SELECT 'silver.nation_' || n_nationkey, 'gold.region_' || n_regionkey FROM nation
  UNION SELECT 'gold.region_' || r_regionkey, 'gold.region_0' FROM region),
reach AS (
  SELECT source, target, 1 AS depth FROM edges WHERE source <> target
  UNION SELECT r.source, e.target, r.depth + 1 FROM reach r JOIN edges e ON e.source = r.target
  WHERE r.depth < 8 AND r.source <> e.target)
SELECT source, target, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY source, target""")
def lineage_closure(spark, folder):
    """The last edge is a loop, which the closure must survive."""
    return lineage.lineage_closure(zone_edges(spark, folder), 8)


@query("lineage_upstream", """
WITH RECURSIVE edges AS (
  SELECT 'landing.order_' || o_orderkey AS source, 'bronze.customer_' || o_custkey AS target FROM orders
  UNION SELECT 'bronze.customer_' || c_custkey, 'silver.nation_' || c_nationkey FROM customer
  UNION SELECT 'silver.nation_' || n_nationkey, 'gold.region_' || n_regionkey FROM nation
  UNION SELECT 'gold.region_' || r_regionkey, 'gold.region_0' FROM region
  UNION SELECT 'gold.region_0', 'gold.region_' || r_regionkey FROM region WHERE r_regionkey = 1),
back AS (
  SELECT 'gold.region_' || r_regionkey AS asked, 'gold.region_' || r_regionkey AS node FROM region
  UNION SELECT 'silver.nation_' || n_nationkey, 'silver.nation_' || n_nationkey FROM nation
  UNION SELECT b.asked, e.source FROM back b JOIN edges e ON e.target = b.node)
SELECT asked, node AS upstream FROM back WHERE asked <> node""")
def lineage_upstream(spark, folder):
    """Orders and customers are indexed first and nations and regions come later, two regions as a cycle."""
    edges = zone_edges(spark, folder)
    late = F.col("source").startswith("silver.") | F.col("source").startswith("gold.")
    cycle = scan(spark, folder, "region").filter("r_regionkey = 1").select(
        F.lit("gold.region_0").alias("source"), F.concat(F.lit("gold.region_"), F.col("r_regionkey").cast("string")).alias("target"))
    index = upstream.extend_index(upstream.upstream_index(edges.filter(~late)), edges.filter(late).unionByName(cycle))
    asked = edges.filter(late).select(F.col("source").alias("node"))
    return upstream.upstream(index, asked)


AS_OF = datetime(2001, 8, 2)
QUARTER_MINUTES = 90 * 1440


def registry(spark, folder):
    """Customers as registered datasets; their orders date the checks and versions."""
    dates = scan(spark, folder, "orders").groupBy("o_custkey").agg(
        F.max("o_orderdate").alias("snapshot_at"),
        F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))).alias("quality_checked_at"))
    segment = F.col("c_mktsegment")
    return scan(spark, folder, "customer").join(
        dates, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.lit("ds_"), F.col("c_custkey").cast("string")).alias("dataset"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("owner_"), F.col("c_nationkey").cast("string")))
        .alias("owner"),
        F.when(segment != "MACHINERY", segment).alias("domain"),
        F.when(segment != "BUILDING", F.lit("standard")).alias("contract"),
        "quality_checked_at", "snapshot_at")


def owners(spark, folder):
    return scan(spark, folder, "nation").filter(F.col("n_regionkey") != 3).select(
        F.concat(F.lit("owner_"), F.col("n_nationkey").cast("string")).alias("owner"))


def existing_tables(spark, folder):
    return scan(spark, folder, "customer").select(
        F.concat(F.lit("ds_"), F.col("c_custkey").cast("string")).alias("dataset")).unionByName(
        scan(spark, folder, "supplier").select(
            F.concat(F.lit("ds_s"), F.col("s_suppkey").cast("string")).alias("dataset")))


def gaps(spark, folder):
    return lineage.metadata_gaps(
        registry(spark, folder), existing_tables(spark, folder), owners(spark, folder),
        ["owner", "domain"], QUARTER_MINUTES, AS_OF)


REGISTRY = f"""
registry AS (
  SELECT 'ds_' || c_custkey AS dataset,
         CASE WHEN c_acctbal >= 0 THEN 'owner_' || c_nationkey END AS owner,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS domain,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN 'standard' END AS contract,
         max(o_orderdate) FILTER (o_orderstatus <> 'P') AS quality_checked_at,
         max(o_orderdate) AS snapshot_at
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
gaps AS (
  SELECT dataset, 'missing:owner' AS gap FROM registry WHERE owner IS NULL
  UNION ALL SELECT dataset, 'missing:domain' FROM registry WHERE domain IS NULL
  UNION ALL SELECT dataset, 'stale_quality' FROM registry
    WHERE coalesce(quality_checked_at < TIMESTAMP '2001-08-02' - INTERVAL 90 DAY, TRUE)
  UNION ALL SELECT dataset, 'stale_snapshot' FROM registry
    WHERE coalesce(snapshot_at < TIMESTAMP '2001-08-02' - INTERVAL 90 DAY, TRUE)
  UNION ALL SELECT dataset, 'orphaned_owner' FROM registry
    WHERE owner NOT IN (SELECT 'owner_' || n_nationkey FROM nation WHERE n_regionkey <> 3)
  UNION ALL SELECT 'ds_s' || s_suppkey, 'unregistered' FROM supplier)
"""


@query("metadata_gaps", "WITH" + REGISTRY + "SELECT * FROM gaps")
def metadata_gaps(spark, folder):
    return gaps(spark, folder)


@query("dataset_freshness", "WITH" + STATUS + """,
commits AS (
  SELECT 'bronze' AS dataset_namespace, event_type AS dataset_name, max(ts) AS last_committed
  FROM events WHERE value < 100 GROUP BY event_type),
aged AS (
  SELECT dataset_namespace, dataset_name, last_checked, last_committed,
         (epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(last_checked) // 1000) / 60000.0 AS check_age_minutes,
         (epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(last_committed) // 1000) / 60000.0 AS commit_age_minutes
  FROM status FULL JOIN commits USING (dataset_namespace, dataset_name))
SELECT *, greatest(check_age_minutes, commit_age_minutes) AS freshness_minutes FROM aged""")
def dataset_freshness(spark, folder):
    commits = scan(spark, folder, "events").filter(F.col("value") < 100).select(
        F.lit("bronze").alias("dataset_namespace"), F.col("event_type").alias("dataset_name"),
        F.col("ts").alias("committed_at"))
    status = gate.quality_status(evidence(spark, folder))
    return lineage.dataset_freshness(status, commits, datetime(2024, 2, 1))
