"""The jobs of the lakehouse over stored tables: ingest, check, gate, transform, gold, upkeep.

Each is a function with an explicit clock. Refusals are exceptions raised before anything is
written; every job that writes leaves a lineage event.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.time import instant
from tidewater.operators import gate
from tidewater.operators.conform import conform, normalise, stamp
from tidewater.operators.lineage import lineage_events
from tidewater.operators.maintenance import orphan_files, snapshots_to_expire
from tidewater.operators.merge import upsert
from tidewater.operators.products import materialise
from tidewater.operators.quality import RESULT_COLUMNS, RESULT_DDL, quality_suite
from tidewater.sources import zones
from tidewater.sources.landing import read_landing

RESULTS, LINEAGE = "platform.quality_check_results", "platform.lineage_events"


class PromotionBlocked(RuntimeError):
    """The recorded evidence does not allow this step; nothing was written."""


@dataclass(frozen=True)
class Lake:
    """Zones below one root; a table is named `zone.table`."""

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        zone, _, name = table.partition(".")
        if not zone or not name or "." in name:
            raise ValueError(f"table must be zone.table: {table}")
        return f"{self.root}/{zone}/{name}"

    def read(self, table: str) -> DataFrame:
        if table == RESULTS:
            return zones.read_results(self.spark, self.path(table), RESULT_DDL).select(*RESULT_COLUMNS)
        if table == LINEAGE:
            return self.spark.read.parquet(self.path(table))
        return zones.read_table(self.spark, self.path(table))

    def bootstrap(self) -> None:
        """Provision the evidence table, which quality runs only append to; held evidence stays."""
        zones.create_results(self.spark, self.path(RESULTS), RESULT_DDL)


def _trace(lake: Lake, kind: str, source: str, target: str, run_id: str, now) -> None:
    run = lake.spark.range(0, 1, 1, 1).select(
        F.lit(kind).alias("type"), F.lit(source).alias("source"), F.lit(target).alias("target"),
        F.lit(run_id).alias("run_id"), instant(now).alias("finished_at"))
    zones.append_rows(lineage_events(run), lake.path(LINEAGE))


def _counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and their number once they are written."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), seen


def ingest(lake: Lake, source_file: str, target: str, source_system: str, batch_id: str,
           run_id: str, now: datetime, schema: str | T.StructType | None = None,
           on_existing: str = "fail") -> int:
    """Landing file to bronze; returns the rows the batch holds afterwards."""
    rows, written = _counted(stamp(normalise(read_landing(lake.spark, source_file, schema)), batch_id,
                                   source_file, now))
    zones.land_batch(rows, lake.path(target), batch_id, now, on_existing, notes={
        "source-system": source_system, "last-source-file": source_file,
        "last-ingestion-run-id": run_id})
    _trace(lake, "INGESTION", f"external:{source_system}/{source_file}", target, run_id, now)
    return written.get["n"]


def check(lake: Lake, target: str, rules: list[dict], run_id: str, now: datetime,
          pipeline_run_id: str | None = None, batch_id: str | None = None) -> DataFrame:
    """Judge a table, or one delivery of it, and record one evidence row per rule.

    Failing rules do not raise.
    """
    judged = (lake.read(target) if batch_id is None
              else zones.read_batch(lake.spark, lake.path(target), batch_id))
    refs = {r["referenceTable"]: lake.read(r["referenceTable"])
            for r in rules if r.get("type") == "referential_integrity"}
    evidence = quality_suite(
        judged, rules, run_id, target, now, refs,
        zones.current_version(lake.spark, lake.path(target)), pipeline_run_id)
    zones.append_results(evidence, lake.path(RESULTS))
    return lake.read(RESULTS).filter(F.col("run_id") == run_id)


def _asked(lake: Lake, run_id: str, target: str) -> DataFrame:
    namespace, _, name = target.partition(".")
    return lake.spark.range(0, 1, 1, 1).select(
        F.lit(run_id).alias("run_id"), F.lit(namespace).alias("dataset_namespace"),
        F.lit(name).alias("dataset_name"))


def _evidence(lake: Lake, run_id: str, target: str) -> DataFrame:
    return lake.read(RESULTS).filter((F.col("zone") == target.partition(".")[0]) & (F.col("run_id") == run_id))


def decide(lake: Lake, run_id: str, target: str) -> Row:
    """The gate's decision for one run and dataset, from the evidence of the dataset's zone alone."""
    results = _evidence(lake, run_id, target)
    return gate.gate_decision(results, _asked(lake, run_id, target)).first()


def override(lake: Lake, run_id: str, target: str, principal: str, reason: str,
             now: datetime) -> Row:
    """Record an override of a blocked decision; returns the decision it overrides."""
    if not (principal or "").strip() or not (reason or "").strip():
        raise ValueError("an override needs a principal and a reason")
    decision = decide(lake, run_id, target)
    if decision["blocked"]:
        held = _evidence(lake, run_id, target)
        asked = _asked(lake, run_id, target).withColumns(
            {"principal": F.lit(principal), "reason": F.lit(reason)})
        added = gate.override_records(held, asked, now)
        zones.append_results(added, lake.path(RESULTS))
    return decision


def _require_promotion(lake: Lake, quality_run: str | None, datasets: list[str]) -> None:
    for dataset in datasets if quality_run else []:
        decision = decide(lake, quality_run, dataset)
        if decision["blocked"]:
            raise PromotionBlocked(f"{dataset} is blocked by run {quality_run}: "
                                   f"{','.join(decision['failing']) or 'no evidence'}")


def transform(lake: Lake, source: str, target: str, keys: list[str], seq: str, run_id: str,
              now: datetime, batch_id: str | None = None, quality_run: str | None = None) -> int:
    """Bronze to silver, gated where a quality run is named; returns the rows written.

    Only the key buckets that the delivery touches are read, merged and written.
    """
    _require_promotion(lake, quality_run, [source])
    held = (lake.read(source) if batch_id is None
            else zones.read_batch(lake.spark, lake.path(source), batch_id))
    rows, written = _counted(conform(held, keys, seq, batch_id))
    zones.merge_buckets(rows, lake.path(target), keys, "silver", now,
                        lambda state, batch: upsert(state, batch, keys, seq))
    _trace(lake, "TRANSFORM", source, target, run_id, now)
    return written.get["n"]


def build_gold(lake: Lake, sources: dict[str, str], target: str, sql: str, run_id: str,
               now: datetime, quality_run: str | None = None) -> int:
    """Rebuild a gold table from named sources (`{name}` in the SQL), every one gated."""
    _require_promotion(lake, quality_run, list(sources.values()))
    rows, written = _counted(materialise(lake.spark, sql, {n: lake.read(t) for n, t in sources.items()}))
    zones.publish(rows, lake.path(target), "gold", now)
    _trace(lake, "MATERIALISATION", ",".join(sources.values()), target, run_id, now)
    return written.get["n"]


def build_mart(lake: Lake, sources: dict[str, str], target: str, sql: str, rules: list[dict], run_id: str,
               now: datetime, quality_run: str | None = None) -> int:
    """Build a mart from gold tables alone, then judge it; the evidence is kept under the mart's run.

    Every source is gated, and lineage names each of them. Readers of the mart ask the gate for its run.
    """
    other = sorted(t for t in sources.values() if not t.startswith("gold."))
    if other:
        raise ValueError(f"a mart reads gold tables only: {other}")
    rows = build_gold(lake, sources, target, sql, run_id, now, quality_run)
    check(lake, target, rules, run_id, now, run_id)
    return rows


def expirable(lake: Lake, table: str, retain_last: int = 2,
              older_than: datetime | str | None = None) -> DataFrame:
    """Versions that may go: past retention and holding nothing that a retained version is read from."""
    path = lake.path(table)
    log = zones.version_log(lake.spark, path).select(
        F.lit(table).alias("table_name"), F.col("version").alias("snapshot_id"), "committed_at",
        _version_directory()).distinct()
    live = lake.spark.createDataFrame(
        [(d,) for d in zones.live_directories(lake.spark, path, retain_last)], "directory string").select(
        _version_directory()).distinct()
    return snapshots_to_expire(log, retain_last, older_than).join(
        live, "directory", "left_anti").filter("directory <> ''")


def _version_directory() -> Column:
    """A version's own directory; buckets lie below it."""
    return F.regexp_extract("directory", r"^(data/_version=\d+)", 1).alias("directory")


def rewrite(lake: Lake, table: str, now: datetime) -> int:
    """Compact a table to the target file size; returns the new version."""
    return zones.compact_table(lake.spark, lake.path(table), now, table.partition(".")[0])


def orphans(lake: Lake, table: str, older_than: datetime, now: datetime) -> DataFrame:
    """Stored files no version refers to; a report, as deletion is the storage owner's step."""
    path = lake.path(table)
    listed = zones.list_files(lake.spark, f"{path}/data")
    inside = F.regexp_extract("path", r"(data/_version=\d+)/", 1)
    known = listed.withColumn("directory", inside).join(
        zones.version_log(lake.spark, path).select(_version_directory()).distinct(),
        "directory", "left_semi")
    return orphan_files(listed, known, older_than, now)
