"""Table maintenance as decisions over inventories of files and versions."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.names import col
from tidewater.functions.text import path_key
from tidewater.functions.time import instant

MINIMUM_ORPHAN_AGE = timedelta(hours=24)


def maintenance_advice(files: DataFrame, manifests: DataFrame, delete_files: DataFrame,
                       versions: DataFrame, policy: DataFrame) -> DataFrame:
    """Four decisions per table of `policy`, each with what was seen and the trigger.

    `policy` has one row per table: `target_file_bytes, small_file_trigger,
    manifest_trigger, delete_file_trigger, retained_snapshots`. All inventories carry
    `table_name`; files also `size_bytes`. Every inventory is counted per table before
    anything is joined, so a table with most of the files costs no more than another.
    """
    count = lambda df, what: df.groupBy("table_name").agg(F.count("*").alias(what))
    targets = policy.select("table_name", "target_file_bytes")
    small = files.join(targets, "table_name").groupBy("table_name").agg(
        F.count_if(F.col("size_bytes") < F.col("target_file_bytes")).alias("small_files"))
    seen = policy
    for part in (small, count(manifests, "manifests"), count(delete_files, "delete_files"),
                 count(versions, "snapshots")):
        seen = seen.join(part, "table_name", "left")
    seen = seen.na.fill(0, ["small_files", "manifests", "delete_files", "snapshots"])

    beyond = F.greatest(F.col("snapshots") - F.col("retained_snapshots"), F.lit(0))
    text = lambda c: F.col(c).cast("string")

    def decision(category: str, listing: str, observed: Column, trigger: Column,
                 detail: Column) -> Column:
        return F.struct(
            F.lit(category).alias("category"), F.lit(listing).alias("metadata_table"),
            observed.cast("bigint").alias("observed"), trigger.cast("bigint").alias("threshold"),
            (observed >= trigger).alias("action_recommended"), detail.alias("detail"))

    decisions = F.array(
        decision("compact_data_files", "files", F.col("small_files"), F.col("small_file_trigger"),
                 F.concat(F.lit("data files smaller than "), text("target_file_bytes"),
                          F.lit(" bytes"))),
        decision("rewrite_manifests", "manifests", F.col("manifests"), F.col("manifest_trigger"),
                 F.lit("manifests tracked by the current snapshot")),
        decision("compact_delete_files", "delete_files", F.col("delete_files"),
                 F.col("delete_file_trigger"), F.lit("delete files applied on read")),
        decision("expire_snapshots", "snapshots", beyond, F.lit(1),
                 F.concat(text("snapshots"), F.lit(" snapshots against a retention of "),
                          text("retained_snapshots"))))
    return seen.select("table_name", F.inline(decisions))


def snapshots_to_expire(versions: DataFrame, retain_last: int = 2,
                        older_than: datetime | str | None = None) -> DataFrame:
    """Versions outside the newest `retain_last` of their table and older than the cut-off.

    Only the few kept versions are ranked (the rank limit runs before the shuffle);
    the rest falls out of an anti-join, so a table with a very long history is not
    sorted in one task.
    """
    if retain_last < 1:
        raise ValueError("retain_last must be at least 1")
    newest = Window.partitionBy("table_name").orderBy(
        F.col("committed_at").desc(), F.col("snapshot_id").desc())
    kept = (versions.select("table_name", "committed_at", "snapshot_id")
            .withColumn("_rank", F.row_number().over(newest))
            .filter(F.col("_rank") <= retain_last).select("table_name", "snapshot_id"))
    old = versions if older_than is None else versions.filter(
        F.col("committed_at").cast("timestamp") < instant(older_than))
    return old.join(kept, ["table_name", "snapshot_id"], "left_anti").select(
        *[col(c) for c in versions.columns])


def files_freed(references: DataFrame, expired: DataFrame) -> DataFrame:
    """Files that only expired versions refer to.

    `references` holds one row per (table_name, snapshot_id, path).
    """
    gone = expired.select("table_name", "snapshot_id").distinct().withColumn("_gone", F.lit(True))
    marked = references.join(gone, ["table_name", "snapshot_id"], "left")
    return (marked.groupBy("table_name", "path")
            .agg(F.bool_and(F.col("_gone").isNotNull()).alias("_free"))
            .filter("_free").drop("_free"))


def orphan_files(listed: DataFrame, referenced: DataFrame, older_than: datetime,
                 now: datetime) -> DataFrame:
    """Listed files no retained version refers to; young ones are set apart.

    Paths are compared by bucket and key alone. A file newer than `older_than` may
    belong to a write in flight and is reported as `within_minimum_age`. A cut-off
    less than 24 hours before `now` is refused.
    """
    if older_than is None:
        raise ValueError("orphan detection needs an explicit older_than")
    if now - older_than < MINIMUM_ORPHAN_AGE:
        raise ValueError("older_than is less than 24 hours ago; a live write could lose files")
    known = referenced.select(path_key(F.col("path")).alias("_key")).distinct()
    stray = listed.withColumn("_key", path_key(F.col("path"))).join(known, "_key", "left_anti")
    young = F.col("created_at").cast("timestamp") > instant(older_than)
    return stray.select(
        *[col(c) for c in listed.columns],
        F.when(young, "within_minimum_age").otherwise("orphan").alias("verdict"))


def running_total(df: DataFrame, group: list[str], slice_by: list[Column], order: list[Column],
                  value: str, name: str) -> DataFrame:
    """Sum of `value` over all earlier rows of the group, the row itself excluded.

    Rows are ordered by `slice_by`, then by `order`. Totals per slice are summed first
    and carried into each slice as an offset, so a window holds one slice of a group
    rather than a group: a hot group is spread over its slices.
    """
    sliced = df.withColumn("_slice", F.struct(*slice_by))
    whole = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy(*group, "_slice").agg(F.sum(value).alias("_sum"))
               .withColumn("_before", F.coalesce(F.sum("_sum").over(whole), F.lit(0)))
               .drop("_sum"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    local = sliced.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (local.join(offsets, [*group, "_slice"])
            .withColumn(name, F.col("_before") + F.col("_local"))
            .drop("_before", "_local", "_slice"))


def compaction_plan(files: DataFrame, target_bytes: int, period: str = "day") -> DataFrame:
    """Assign files below the target size to output files of about that size.

    Files of a table are taken period by period, so a bin holds neighbours in time, and
    inside a period in order of a digest of their path. The digest splits a period into
    256 slices of like size, however many files one bulk load left in it. A bin closes
    once the bytes before a file reach the next multiple of the target.
    """
    small = files.filter(F.col("size_bytes") < target_bytes).withColumn("_digest", F.md5("path"))
    placed = running_total(
        small, ["table_name"],
        [F.date_trunc(period, F.col("created_at")), F.substring("_digest", 1, 2)],
        [F.col("_digest"), F.col("path")], "size_bytes", "_before_bytes")
    return placed.select(
        *[col(c) for c in files.columns],
        F.expr(f"_before_bytes div {int(target_bytes)}").alias("bin"))


def compact(df: DataFrame, total_bytes: int, target_bytes: int) -> DataFrame:
    """The same rows in as many partitions as files of the target size are needed."""
    return df.repartition(max(1, -(-total_bytes // target_bytes)))


def compact_within(df: DataFrame, partition_by: list[str], row_bytes: float, target_bytes: int) -> DataFrame:
    """The same rows, each directory's in as many tasks as it needs files of the target size.

    A directory's rows are counted first; a large one is dealt out by a hash of the whole row, so the
    same rows always fall into the same file.
    """
    dirs = df.groupBy(*partition_by).agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") * row_bytes / target_bytes)).cast("int").alias("_files"))
    # A row per directory: the first of its tasks.
    dirs = dirs.withColumn("_start", F.sum("_files").over(Window.orderBy(*partition_by)) - F.col("_files"))
    files = dirs.agg(F.sum("_files")).first()[0] or 1
    same = reduce(lambda a, b: a & b, [col(c, "r").eqNullSafe(col(c, "d")) for c in partition_by])
    dealt = df.alias("r").join(dirs.alias("d"), same).select(
        *[col(c, "r").alias(c) for c in df.columns],
        (F.col("d._start") + F.pmod(F.xxhash64(*[col(c, "r") for c in df.columns]), F.col("d._files")))
        .cast("int").alias("_task"))
    return dealt.repartitionById(files, "_task").drop("_task")


def file_health(versions: DataFrame, files: DataFrame, period: str) -> DataFrame:
    """Commits, failed commits, manifests, files per commit and file size per period.

    `versions` carries `committed_at, status, manifest_count`; `files` carries
    `snapshot_id, size_bytes`. Files are summed per version before the join.
    """
    per_version = files.groupBy("table_name", "snapshot_id").agg(
        F.count("*").alias("_files"), F.sum("size_bytes").alias("_bytes"))
    joined = versions.join(per_version, ["table_name", "snapshot_id"], "left").na.fill(
        0, ["_files", "_bytes"])
    done = F.col("status") == "committed"
    of_done = lambda c: F.sum(F.when(done, F.col(c)).otherwise(0))
    return joined.groupBy(
        "table_name", F.date_trunc(period, F.col("committed_at")).alias("period_start")
    ).agg(
        F.count_if(done).alias("snapshots"),
        F.count_if(~done).alias("failed_commits"),
        of_done("manifest_count").alias("manifests"),
        of_done("_files").alias("data_files"),
        F.try_divide(of_done("_files"), F.count_if(done)).alias("files_per_snapshot"),
        F.try_divide(of_done("_bytes"), of_done("_files")).alias("average_file_bytes"))
