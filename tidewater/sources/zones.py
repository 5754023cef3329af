"""Stored tables: version directories and a version log, nothing more.

    <table>/data/_version=<n>/...     one immutable directory per commit, partitioned below if asked
    <table>/versions/...       one row per commit, written after its data

A commit is visible once its log row exists, so a failed write leaves no trace for
readers. Every row names the `unit` it holds: a delivery (bronze), a bucket of keys
(silver) or `*`, the whole table (gold, evidence, compaction). Live data is the newest `*`
and, after it, the newest version of each unit. One writer per table; where a catalog with its own table format
is deployed, use that instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from contextlib import nullcontext
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.names import BATCH_ID, col
from tidewater.functions.time import instant
from tidewater.operators.bronze import replace_batch
from tidewater.operators.conform import batch_filter, batch_is_held, require_values
from tidewater.operators.maintenance import compact, compact_within
from tidewater.operators.quality import REQUIRED_RESULT_COLUMNS, RESULT_COLUMNS
from tidewater.operators.schema import merged_schema, refuse_conflicts, to_schema
from tidewater.session import discard, open_writers, scratch_path, written

WHOLE, BUCKET = "*", "_bucket"
TARGET_FILE_BYTES = 512 * 1024 * 1024
SHUFFLED_BYTES, SHUFFLED_ROWS = 32 * 1024 * 1024, 250_000  # rows are many times wider in a shuffle than in a file
SCANS_AT_ONCE = 64
LOG_DDL = ("version bigint, unit string, operation string, committed_at timestamp, "
           "directory string, schema_json string, properties map<string,string>")

# How each zone's tables are written.
_SHARED = {
    "write.format.default": "parquet",
    "write.parquet.compression-codec": "zstd",
    "write.target-file-size-bytes": str(TARGET_FILE_BYTES),
    "write.delete.mode": "copy-on-write",
    "write.update.mode": "copy-on-write",
    "write.merge.mode": "copy-on-write",
    "write.delete.isolation-level": "serializable",
    "write.update.isolation-level": "serializable",
    "write.merge.isolation-level": "serializable",
}
_ZONES = {
    "bronze": {"accept-any-schema": "true", "append-only": "true"},
    "silver": {"write.distribution-mode": "hash"},
    "gold": {},
    "platform": {"append-only": "true"},
}


class BatchHeld(ValueError):
    """The delivery is held already and replay was not asked for."""


def zone_options(zone: str) -> dict[str, str]:
    """Properties a zone's tables carry; recorded again with every commit."""
    if zone not in _ZONES:
        raise ValueError(f"zone must be one of {sorted(_ZONES)}: {zone}")
    return {**_SHARED, **_ZONES[zone]}


def version_log(spark: SparkSession, table: str) -> DataFrame:
    """All commits of a table; empty for a table that does not exist."""
    try:
        return spark.read.schema(LOG_DDL).parquet(f"{table}/versions")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_DDL)


def _commits(spark: SparkSession, table: str, back_to: int | None = None) -> list[Row]:
    """The log's rows, in order, that the newest version (and those from `back_to` on) are read by.

    Nothing before the newest `*` matters, so what reaches the driver is a row per delivery since then,
    or per bucket that a merge touched, and not the table's history.
    """
    log = version_log(spark, table)
    whole = log.filter(F.col("unit") == WHOLE)
    if back_to is not None:
        whole = whole.filter(F.col("version") <= back_to)
    since = whole.agg(F.max("version")).first()[0] or 0
    return sorted(log.filter(F.col("version") >= since).collect(), key=lambda r: (r["version"], r["unit"] != WHOLE))


def _live(commits: list[Row]) -> list[Row]:
    """Rows of the live directories: the newest `*`, then the newest version per unit."""
    since = max((i for i, r in enumerate(commits) if r["unit"] == WHOLE), default=0)
    newest = {r["unit"]: r for r in commits[since:]}
    return sorted((r for r in newest.values() if r["directory"]), key=lambda r: r["version"])


def live_directories(spark: SparkSession, table: str, retain_last: int = 1) -> list[str]:
    """Directories that the newest `retain_last` versions are read from."""
    kept = sorted(r["version"] for r in version_log(spark, table).select("version").distinct()
                  .orderBy(F.desc("version")).limit(retain_last).collect())
    commits = _commits(spark, table, kept[0] if kept else None)
    return sorted({r["directory"] for version in kept
                   for r in _live([c for c in commits if c["version"] <= version])})


def exists(spark: SparkSession, table: str) -> bool:
    return not version_log(spark, table).limit(1).isEmpty()


def _schema_of(rows: list) -> T.StructType:
    return T.StructType.fromJson(json.loads(rows[-1]["schema_json"]))


def read_table(spark: SparkSession, table: str, unit: str | None = None) -> DataFrame:
    """Live rows under the newest schema: older files show later columns as null."""
    commits = _commits(spark, table)
    if not commits:
        raise LookupError(f"table not found: {table}")
    return _read(spark, table, commits, unit)


def read_batch(spark: SparkSession, table: str, batch_id: str) -> DataFrame:
    """One delivery: its own directory, or its rows inside a compacted version."""
    commits = _commits(spark, table)
    if not commits:
        raise LookupError(f"table not found: {table}")
    live = {r["unit"] for r in _live(commits)}
    return batch_filter(_read(spark, table, commits, batch_id if batch_id in live else WHOLE), batch_id)


def _read(spark: SparkSession, table: str, commits: list[Row],
          unit: str | set[str] | None = None) -> DataFrame:
    schema = _schema_of(commits)
    units = {unit} if isinstance(unit, str) else unit
    chosen = [r for r in _live(commits) if units is None or r["unit"] in units]
    if not chosen:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{table}/data").schema(schema).parquet(
        *[f"{table}/{r['directory']}" for r in chosen])
    return rows.select(*[col(f) for f in schema.fieldNames()])


def _partitioning(commits: list[Row]) -> list[str]:
    return [c for c in commits[-1]["properties"]["partition-by"].split(",") if c]


def _commit(df: DataFrame | list[DataFrame], table: str, commits: list[Row], unit: str | list[str], operation: str, zone: str,
            now: datetime | str, schema: T.StructType, partition_by: list[str] | None = None,
            notes: dict[str, str] | None = None, dealt: bool = False, resets: bool = False) -> int:
    """Write the data, then its log rows: one, or with a list of bucket units one for each.

    A table stays partitioned as it was unless told otherwise. A write that failed before its
    log rows is overwritten by the next attempt, which gets the same version. `dealt` says that
    rows lie in tasks as they should lie in files, `resets` that earlier versions are all replaced.
    A list of rows is written one after the other into the same version.
    """
    first, *others = df if isinstance(df, list) else [df]
    version = commits[-1]["version"] + 1 if commits else 1
    if commits and partition_by is None:
        partition_by = _partitioning(commits)
    directory = f"data/_version={version}"
    if partition_by and not dealt:
        # Few files per directory; AQE splits a directory that holds most of the rows.
        first, others = first.hint("rebalance", *partition_by), [x.hint("rebalance", *partition_by) for x in others]
    spark = first.sparkSession
    with open_writers(spark, 4) if dealt else nullcontext():  # a task that is one file needs no sort by directory
        for mode, rows in [("overwrite", first), *(("append", x) for x in others)]:
            writer = rows.write.mode(mode).option("compression", "zstd")
            writer.partitionBy(*partition_by or []).parquet(f"{table}/{directory}")
    properties = {**zone_options(zone), "partition-by": ",".join(partition_by or []),
                  **(notes or {})}
    if isinstance(unit, str):
        units = [(unit, directory)]
    else:  # a bucket that lost all its rows has no directory to read
        held = {r[BUCKET] for r in spark.read.parquet(f"{table}/{directory}").select(BUCKET).distinct().collect()}
        units = [(u, f"{directory}/{BUCKET}={k}" if (k := int(u.rpartition("-")[2])) in held else "") for u in unit]
    if resets:
        units.insert(0, (WHOLE, ""))
    named = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(d).alias("directory")) for u, d in units]))
    entry = spark.range(0, 1, 1, 1).select(named.alias("u")).select(
        F.lit(version).cast("bigint").alias("version"), F.col("u.unit").alias("unit"),
        F.lit(operation).alias("operation"), instant(now).alias("committed_at"),
        F.col("u.directory").alias("directory"), F.lit(schema.json()).alias("schema_json"),
        F.create_map(*[F.lit(x) for kv in properties.items() for x in kv]).alias("properties"))
    entry.write.mode("append").parquet(f"{table}/versions")
    return version


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def land_batch(df: DataFrame, table: str, batch_id: str, now: datetime | str,
               on_existing: str = "fail", partition_by: list[str] | None = None,
               notes: dict[str, str] | None = None) -> int:
    """Write one stamped delivery to bronze; returns the version.

    Types are checked against the table before any job. A delivery that is held is
    refused, or with `on_existing="replace"` rewritten alone. `notes` (where it came
    from, which run brought it) are kept with the commit.
    """
    if on_existing not in ("fail", "replace"):
        raise ValueError(f"on_existing must be fail or replace: {on_existing}")
    spark = df.sparkSession
    commits = _commits(spark, table)
    if not commits:
        return _commit(df, table, commits, batch_id, "create", "bronze", now,
                       _nullable(df.schema), [BATCH_ID, *(partition_by or [])], notes)
    held_schema = _schema_of(commits)
    refuse_conflicts(table, held_schema, df.schema)
    schema = merged_schema(held_schema, df.schema)
    live = {r["unit"] for r in _live(commits)}
    named = batch_id in live
    held = named or (WHOLE in live and batch_is_held(
        _read(spark, table, commits, WHOLE), batch_id))
    if held and on_existing == "fail":
        raise BatchHeld(f"batch {batch_id} is already in {table}; replay it with replace")
    if held and not named:
        # The batch sits inside a compacted version: rewrite that version without it.
        whole = replace_batch(_read(spark, table, commits), df, batch_id)
        return _commit(whole, table, commits, WHOLE, "replace", "bronze", now, schema,
                       notes=notes)
    return _commit(to_schema(df, schema), table, commits, batch_id,
                   "replace" if held else "append", "bronze", now, schema, notes=notes)


def publish(df: DataFrame, table: str, zone: str, now: datetime | str,
            keys: list[str] | None = None, partition_by: list[str] | None = None) -> int:
    """Replace a silver or gold table by a new version.

    With `keys` the rows are distributed by them first. A merge result is clustered by its
    keys already and needs none.
    """
    commits = _commits(df.sparkSession, table)
    out = df.repartition(*[col(k) for k in keys]) if keys else df
    if commits and partition_by is None:
        partition_by = [c for c in _partitioning(commits) if c != BUCKET]
    return _commit(out, table, commits, WHOLE, "overwrite" if commits else "create", zone, now,
                   _nullable(df.schema), partition_by or [])


def create_results(spark: SparkSession, table: str, schema: str) -> None:
    """Provision the evidence table, once: quality runs append and never create it.

    Evidence and lineage are plain directories, partitioned by zone and day where they have them, that
    Spark appends to; no log is needed, as nothing in them is ever replaced.
    """
    if not evidence_exists(spark, table):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{table}/{_START}")


_START, _DAY = "zone=__HIVE_DEFAULT_PARTITION__/checked_day=__HIVE_DEFAULT_PARTITION__", "checked_day"


def evidence_exists(spark: SparkSession, table: str) -> bool:
    try:
        spark.read.parquet(f"{table}/{_START}")
        return True
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def read_results(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """All evidence; a filter on zone or checked_day opens only those directories."""
    stored = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(_DAY, T.DateType())])
    return spark.read.schema(stored).parquet(table)


def append_rows(df: DataFrame, table: str) -> None:
    """Append to a platform table of plain rows, such as lineage."""
    df.write.mode("append").parquet(table)


def append_results(df: DataFrame, table: str) -> None:
    """Append one run's evidence; the table must exist, and required columns be filled."""
    if not evidence_exists(df.sparkSession, table):
        raise LookupError(f"{table} does not exist; provision it before running checks")
    rows = require_values(df.select(*RESULT_COLUMNS), REQUIRED_RESULT_COLUMNS)
    rows.withColumn(_DAY, F.to_date("checked_at")).write.mode("append").partitionBy("zone", _DAY).parquet(table)


def current_version(spark: SparkSession, table: str) -> int | None:
    """The newest version, which evidence names as the state it judged."""
    return version_log(spark, table).agg(F.max("version")).first()[0]


def compact_table(spark: SparkSession, table: str, now: datetime | str, zone: str,
                  target_bytes: int = TARGET_FILE_BYTES) -> int:
    """Rewrite the live files to the target size, in a partitioned table per directory; the rows stay."""
    commits = _commits(spark, table)
    if BUCKET in _partitioning(commits):
        return commits[-1]["version"]  # every merge writes the buckets that it touches whole
    live = _read(spark, table, commits)
    totals = file_inventory(live).agg(F.sum("size_bytes").alias("size"), F.sum("row_count").alias("n")).first()
    size, rows = totals["size"] or 0, totals["n"] or 0
    partition_by = _partitioning(commits)
    large = _large_directories(live, partition_by, target_bytes)
    # A large file's rows are not shuffled: its task reads what it writes, in the size it has in files.
    scans = [live.filter(where).coalesce(-(-held // target_bytes)) for where, held in large]
    if large and not partition_by:
        out = scans
    else:
        rest = live.filter(~reduce(lambda a, b: a | b, [where for where, _ in large])) if large else live
        out = [compact_within(rest, partition_by, size / max(rows, 1), target_bytes) if partition_by
               else compact(rest, size, target_bytes)]
        out += [reduce(DataFrame.unionByName, scans[i:i + SCANS_AT_ONCE]) for i in range(0, len(scans), SCANS_AT_ONCE)]
    return _commit(out, table, commits, WHOLE, "compact", zone, now, live.schema, dealt=True)


def _large_directories(live: DataFrame, partition_by: list[str], target_bytes: int) -> list[tuple[Column, int]]:
    """The directories with files of more bytes or rows than a task may read from a shuffle, each by its values and its
    size; a row for each reaches the driver."""
    values = [col(c) for c in partition_by]
    files = live.select(*values, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size"))
    sized = files.groupBy(*values, "_path").agg(F.max("_size").alias("_size"), F.count("*").alias("_rows")).groupBy(*values).agg(
        F.sum("_size").alias("_size"), F.sum("_rows").alias("_rows"))
    share = F.least(F.lit(1.0), F.lit(target_bytes) / F.col("_size"))
    found = sized.filter((F.col("_size") * share > SHUFFLED_BYTES) | (F.col("_rows") * share > SHUFFLED_ROWS))
    same = lambda r: reduce(lambda a, b: a & b, [col(c).eqNullSafe(F.lit(r[c])) for c in partition_by], F.lit(True))
    return [(same(r), r["_size"]) for r in found.collect()]


def merge_buckets(batch: DataFrame, table: str, keys: list[str], zone: str, now: datetime | str,
                  merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64,
                  empty: T.StructType | None = None) -> int:
    """Apply `merge(target, batch)` to the key buckets that the batch touches; the others stay as they are.

    Rows lie in directories by a hash of their key, and a commit writes the touched directories anew.
    The batch is stored first, as it is read for its buckets and for the merge. A table that was
    published whole is bucketed by its first merge. A table that does not exist starts as the batch, or,
    where the schema of its state is given as `empty`, as the batch merged into nothing.
    """
    spark = batch.sparkSession
    commits = _commits(spark, table)
    place = scratch_path(spark, "merge-batch")
    bucketed = written(spark, batch.withColumn(BUCKET, _bucket(keys, buckets)), place)
    live = _live(commits)
    whole = not commits or any(r["unit"] == WHOLE for r in live)
    touched = sorted(r[BUCKET] for r in bucketed.select(BUCKET).distinct().collect())  # `buckets` rows at most
    if commits:
        units = None if whole else {f"bucket-{k}" for k in touched}
        target = _read(spark, table, commits, units)
        out = merge(target, bucketed.drop(BUCKET))
    elif empty is not None:
        out = merge(spark.createDataFrame([], empty), bucketed.drop(BUCKET))
    else:
        out = bucketed.drop(BUCKET)
    schema = _schema_of(commits) if commits else _nullable(out.schema)
    version = _commit(out.withColumn(BUCKET, _bucket(keys, buckets)), table, commits,
                      [f"bucket-{k}" for k in (range(buckets) if whole else touched)], "merge", zone, now, schema,
                      [BUCKET], resets=whole)
    discard(spark, place)
    return version


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(buckets)).cast("int")


def drop_probe_table(spark: SparkSession, table: str, allowed: str) -> None:
    """Drop and purge one catalog table, only if its whole name matches `allowed`."""
    if not re.fullmatch(allowed, table):
        raise ValueError(f"refusing to drop {table}: it does not match {allowed}")
    spark.sql(f"DROP TABLE IF EXISTS {table} PURGE")


def file_inventory(df: DataFrame) -> DataFrame:
    """One row per file behind a DataFrame read from files, with its rows and size."""
    meta = df.select("_metadata.file_path", "_metadata.file_size",
                     "_metadata.file_modification_time")
    return meta.groupBy("file_path").agg(
        F.max("file_size").alias("size_bytes"),
        F.max("file_modification_time").alias("modified_at"), F.count("*").alias("row_count"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path, listed by Spark; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", F.col("modificationTime").alias("created_at"),
                    F.col("length").alias("size_bytes")))
