"""Maintenance decisions over file and version inventories."""

from datetime import datetime

from pyspark.sql import functions as F

from tidewater.operators import maintenance
from tidewater.plans.inputs import FILES, VERSIONS, files, versions
from tidewater.plans.registry import query
from tidewater.sources.extract import scan


def _policy(spark, folder):
    key = F.col("r_regionkey")
    return scan(spark, folder, "region").select(
        F.concat(F.lit("table_"), key.cast("string")).alias("table_name"),
        (F.lit(30_000_000) + key * 5_000_000).cast("bigint").alias("target_file_bytes"),
        F.lit(500).alias("small_file_trigger"), F.lit(3_000).alias("manifest_trigger"),
        F.lit(4_000).alias("delete_file_trigger"),
        (F.lit(10) + key * 200).alias("retained_snapshots"))


@query("maintenance_advice", "WITH" + VERSIONS + "," + FILES + """,
seen AS (
  SELECT 'table_' || r_regionkey AS table_name, 30000000 + r_regionkey * 5000000 AS target,
         10 + r_regionkey * 200 AS retained,
         (SELECT count(*) FROM files f WHERE f.table_name = 'table_' || r_regionkey
            AND f.size_bytes < 30000000 + r_regionkey * 5000000) AS small_files,
         (SELECT count(*) FROM versions v WHERE v.table_name = 'table_' || r_regionkey
            AND v.status = 'committed') AS manifests,
         (SELECT count(*) FROM files f WHERE f.table_name = 'table_' || r_regionkey
            AND f.flag = 'R') AS delete_files,
         (SELECT count(*) FROM versions v WHERE v.table_name = 'table_' || r_regionkey) AS snapshots
  FROM region),
decided AS (
  SELECT table_name, 'compact_data_files' AS category, 'files' AS metadata_table,
         small_files AS observed, 500 AS threshold,
         'data files smaller than ' || target || ' bytes' AS detail FROM seen
  UNION ALL SELECT table_name, 'rewrite_manifests', 'manifests', manifests, 3000,
         'manifests tracked by the current snapshot' FROM seen
  UNION ALL SELECT table_name, 'compact_delete_files', 'delete_files', delete_files, 4000,
         'delete files applied on read' FROM seen
  UNION ALL SELECT table_name, 'expire_snapshots', 'snapshots', greatest(snapshots - retained, 0), 1,
         snapshots || ' snapshots against a retention of ' || retained FROM seen)
SELECT table_name, category, metadata_table, CAST(observed AS BIGINT) AS observed,
       CAST(threshold AS BIGINT) AS threshold, observed >= threshold AS action_recommended, detail
FROM decided""")
def maintenance_advice(spark, folder):
    commits, stored = versions(spark, folder), files(spark, folder)
    return maintenance.maintenance_advice(
        stored, commits.filter(F.col("status") == "committed"),
        stored.filter(F.col("flag") == "R"), commits, _policy(spark, folder))


EXPIRED = VERSIONS + """,
expired AS (
  SELECT * EXCLUDE (rank) FROM (
    SELECT *, row_number() OVER (PARTITION BY table_name
                                 ORDER BY committed_at DESC, snapshot_id DESC) AS rank FROM versions)
  WHERE rank > 50 AND committed_at < '2000-01-01')
"""


@query("snapshots_to_expire", "WITH" + EXPIRED + "SELECT * FROM expired")
def snapshots_to_expire(spark, folder):
    return maintenance.snapshots_to_expire(versions(spark, folder), 50, datetime(2000, 1, 1))


@query("files_freed", "WITH" + EXPIRED + "," + FILES + """,
refs AS (
  SELECT table_name, snapshot_id, path FROM files
  UNION ALL SELECT 'table_' || (o_orderkey % 5), o_orderkey, f.path
  FROM files f JOIN orders o ON o.o_orderkey = f.snapshot_id + 5 WHERE f.flag = 'N')
SELECT r.table_name, r.path FROM refs r LEFT JOIN expired e USING (table_name, snapshot_id)
GROUP BY r.table_name, r.path HAVING bool_and(e.snapshot_id IS NOT NULL)""")
def files_freed(spark, folder):
    """A file may be referenced by its own commit and by the table's next one."""
    added = files(spark, folder).select("table_name", "snapshot_id", "path", "flag")
    commits = versions(spark, folder)
    carried = (added.filter(F.col("flag") == "N")
               .withColumn("snapshot_id", F.col("snapshot_id") + 5)
               .join(commits, ["table_name", "snapshot_id"], "left_semi"))
    expired = maintenance.snapshots_to_expire(commits, 50, datetime(2000, 1, 1))
    return maintenance.files_freed(added.drop("flag").unionByName(carried.drop("flag").select(
        "table_name", "snapshot_id", "path")), expired)


@query("orphan_files", "WITH" + FILES + """
SELECT replace(path, 's3://', 's3a:///') AS path, size_bytes, created_at,
       CASE WHEN created_at > '2000-06-01' THEN 'within_minimum_age' ELSE 'orphan' END AS verdict
FROM files WHERE flag = 'R'""")
def orphan_files(spark, folder):
    listed = files(spark, folder, "s3a:///").select("path", "size_bytes", "created_at")
    referenced = files(spark, folder).filter(F.col("flag") != "R")
    return maintenance.orphan_files(listed, referenced, datetime(2000, 6, 1), datetime(2002, 1, 1))


TARGET = 64_000_000


@query("compaction_plan", "WITH" + FILES + f"""
SELECT *, CAST(coalesce(sum(size_bytes) OVER (
         PARTITION BY table_name ORDER BY date_trunc('month', created_at), md5(path), path
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {TARGET} AS bin
FROM files WHERE size_bytes < {TARGET}""")
def compaction_plan(spark, folder):
    return maintenance.compaction_plan(files(spark, folder), TARGET, "month")


@query("file_health", "WITH" + VERSIONS + "," + FILES + """,
per_version AS (
  SELECT table_name, snapshot_id, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes
  FROM files GROUP BY ALL)
SELECT table_name, date_trunc('month', committed_at) AS period_start,
       count(*) FILTER (status = 'committed') AS snapshots,
       count(*) FILTER (status = 'failed') AS failed_commits,
       CAST(coalesce(sum(manifest_count) FILTER (status = 'committed'), 0) AS BIGINT) AS manifests,
       CAST(coalesce(sum(n) FILTER (status = 'committed'), 0) AS BIGINT) AS data_files,
       CAST(coalesce(sum(n) FILTER (status = 'committed'), 0) AS DOUBLE)
         / nullif(count(*) FILTER (status = 'committed'), 0) AS files_per_snapshot,
       CAST(coalesce(sum(bytes) FILTER (status = 'committed'), 0) AS DOUBLE)
         / nullif(sum(n) FILTER (status = 'committed'), 0) AS average_file_bytes
FROM versions LEFT JOIN per_version USING (table_name, snapshot_id)
GROUP BY 1, 2""")
def file_health(spark, folder):
    return maintenance.file_health(versions(spark, folder), files(spark, folder), "month")
