"""Change records: decode, check, split, deduplicate, fold into current state.

Pure DataFrame functions. A batch replay and a micro-batch inside `foreachBatch` run the
same code. Input rows have the columns of a log topic: `topic, partition, offset, key,
value, timestamp`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.names import col
from tidewater.functions.time import instant
from tidewater.operators.merge import upsert_with_deletes
from tidewater.operators.quality import BLOCKING, FAILED, PASSED, WARNING
from tidewater.session import written

POSITION = ["source_topic", "source_partition", "source_offset"]


@dataclass(frozen=True)
class CdcRules:
    """What makes a change record acceptable.

    `key` must be present and the operation one of `allowed_ops`, else the record is
    rejected. `warnings` maps further check names to SQL predicates that should hold.
    """

    key: str
    allowed_ops: tuple[str, ...]
    warnings: dict[str, str] = field(default_factory=dict)


def envelope(image: T.StructType) -> T.StructType:
    """The change envelope around a row image: op, before, after, source time in micros."""
    source = T.StructType([T.StructField("ts_us", T.LongType())])
    return T.StructType([
        T.StructField("op", T.StringType()), T.StructField("before", image),
        T.StructField("after", image), T.StructField("source", source)])


def cdc_decode(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Parse the value: operation, row image, source event time, deterministic event id.

    A delete has no after-image, so its columns come from the before-image. Text that
    does not parse yields nulls, which the record rules then reject.
    """
    parsed = df.withColumn("_e", F.from_json(F.col("value").cast("string"), schema))
    image = [f.name for f in schema["after"].dataType.fields]
    has_after = F.col("_e.after").isNotNull()
    value = lambda n: F.when(
        has_after, F.col("_e.after").getField(n)).otherwise(F.col("_e.before").getField(n))
    return parsed.select(
        F.concat_ws("-", "topic", "partition", "offset").alias("event_id"),
        F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"), F.col("_e.op").alias("operation"),
        *[value(n).alias(n) for n in image],
        F.timestamp_micros(F.col("_e.source.ts_us")).alias("event_time"),
        F.col("timestamp").alias("received_at"))


def _fold_positions(df: DataFrame, held: DataFrame | None) -> DataFrame:
    """One row per topic position, first received, with its copies and whether it is held.

    A minimum over row structs folds copies on the map side, so a position delivered over
    and over never gathers in one task; ties are settled by the row's own columns.
    """
    rest = [c for c in df.columns if c not in (*POSITION, "received_at")]
    first = F.min(F.struct("received_at", *[col(c) for c in rest])).alias("_first")
    folded = df.groupBy(*POSITION).agg(first, F.count("*").alias("_copies"))
    rows = folded.select(
        *[col(c) if c in POSITION else F.col("_first").getField(c).alias(c) for c in df.columns],
        "_copies")
    if held is None:
        return rows.withColumn("_held", F.lit(False))
    known = held.select(*POSITION).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, POSITION, "left").select(
        *[col(c) for c in df.columns], "_copies", F.col("_known").isNotNull().alias("_held"))


def cdc_dedup(df: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """One row per topic position, first received; positions already held are left out."""
    return _fold_positions(df, held).filter(~F.col("_held")).drop("_held", "_copies")


DUPLICATE = "offset_not_duplicate"


def _checks(rules: CdcRules) -> list[tuple[str, str, Column]]:
    """(name, severity, condition that must hold) in reporting order."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    return [
        ("key_present", BLOCKING, col(rules.key).isNotNull()),
        ("operation_allowed", BLOCKING, holds(F.col("operation").isin(*rules.allowed_ops))),
        (DUPLICATE, BLOCKING, ~F.col("_held")),
        ("event_time_present", "warning", F.col("event_time").isNotNull()),
        *[(n, "warning", holds(F.expr(p))) for n, p in rules.warnings.items()],
    ]


def cdc_check(df: DataFrame, rules: CdcRules, held: DataFrame | None = None) -> DataFrame:
    """Decoded records, one per topic position, with the names of the checks they break.

    `_blocking` and `_warning` are arrays of check names; everything later is a filter on
    them, so the record rules cost one projection. `_copies` counts the deliveries of a
    position; all but the first are duplicates.
    """
    folded = _fold_positions(df, held)
    names = lambda severity: F.filter(F.array(*[
        F.when(~ok, F.lit(name)) for name, s, ok in _checks(rules) if s == severity
    ]), lambda n: n.isNotNull())
    return folded.withColumns({"_blocking": names(BLOCKING), "_warning": names("warning")})


def accepted_records(checked: DataFrame, now: datetime | str, run_id: str | None = None) -> DataFrame:
    """Records without a blocking finding; a missing event time becomes the processing time."""
    kept = checked.filter(F.size("_blocking") == 0)
    return kept.withColumns({
        "event_time": F.coalesce(F.col("event_time"), instant(now)),
        "ingested_at": instant(now),
        "pipeline_run_id": F.lit(run_id).cast("string"),
    }).drop("_blocking", "_warning", "_copies", "_held", "received_at")


def rejected_records(checked: DataFrame) -> DataFrame:
    """Dead letters: topic position, every reason, and how many records they stand for.

    Further deliveries of a position are one row that counts them.
    """
    letter = lambda reason, records: F.struct(
        reason.alias("reason"), records.cast("bigint").alias("records"))
    letters = F.array(
        F.when(F.size("_blocking") > 0, letter(F.array_join("_blocking", ","), F.lit(1))),
        F.when(F.col("_copies") > 1, letter(F.lit(DUPLICATE), F.col("_copies") - 1)))
    return (checked.select(*POSITION, "event_id", "operation", F.explode(letters).alias("l"))
            .filter("l IS NOT NULL").select(*POSITION, "event_id", "operation", "l.*"))


def record_results(checked: DataFrame, rules: CdcRules, dataset: str, run_id: str,
                   now: datetime | str, snapshot_id: int | None = None) -> DataFrame:
    """Quality evidence of a set of records: one row per topic and check, pass or fail."""
    namespace, name = dataset.split(".")
    checks = [(n, s) for n, s, _ in _checks(rules)]
    found = F.array_union("_blocking", "_warning")
    broken = lambda n: F.array_contains(found, n).cast("bigint") + (
        F.col("_copies") - 1 if n == DUPLICATE else F.lit(0))
    counts = checked.groupBy("source_topic").agg(
        F.sum("_copies").alias("_all"), *[F.sum(broken(n)).alias(n) for n, _ in checks])
    verdicts = F.array(*[
        F.struct(
            F.lit(n).alias("check_name"), F.lit(s).alias("severity"),
            F.when(F.col(n) == 0, PASSED).otherwise(FAILED if s == BLOCKING else WARNING)
            .alias("status"),
            F.col(n).cast("double").alias("metric_value"), F.lit(0.0).alias("threshold"),
            F.when(F.col(n) > 0, F.concat(
                F.col(n).cast("string"), F.lit(" of "), F.col("_all").cast("string"),
                F.lit(" records of "), F.col("source_topic"))).alias("failure_detail"))
        for n, s in checks])
    return counts.select(F.inline(verdicts)).select(
        F.lit(run_id).alias("run_id"), F.lit(namespace).alias("dataset_namespace"),
        F.lit(name).alias("dataset_name"), F.lit(namespace).alias("zone"),
        F.lit("streaming_record").alias("check_type"), "check_name", "severity", "status",
        "metric_value", "threshold", "failure_detail", F.lit(run_id).alias("pipeline_run_id"),
        instant(now).alias("checked_at"), F.lit(snapshot_id).cast("bigint").alias("snapshot_id"))


def cdc_split(df: DataFrame, rules: CdcRules, now: datetime | str, dataset: str, run_id: str,
              held: DataFrame | None = None,
              path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, quality evidence) of decoded records.

    With a `path` in the shared folder the checked records are stored there once and all
    three read them back; without it each one is a plan of its own over `df`.
    """
    checked = cdc_check(df, rules, held)
    if path:
        checked = written(df.sparkSession, checked, path)
    return (accepted_records(checked, now, run_id), rejected_records(checked),
            record_results(checked, rules, dataset, run_id, now))


def cdc_current_state(target: DataFrame, changes: DataFrame, keys: list[str], seq: str,
                      delete_ops: tuple[str, ...], ties: list[str] | None = None) -> DataFrame:
    """Newest change per key folded into the state; deletes stay as tombstones.

    `target` has the business columns, `last_operation`, `last_event_time`-like sequence
    `seq` and `is_deleted`.
    """
    flagged = changes.withColumns({
        "last_operation": F.col("operation"),
        "is_deleted": F.coalesce(F.col("operation").isin(*delete_ops), F.lit(False))})
    return upsert_with_deletes(target, flagged, keys, seq, "is_deleted",
                               null_flag_deletes=False, ties=ties, keep=["last_operation"])


def consumer_lag(source: DataFrame, sink: DataFrame) -> DataFrame:
    """Newest position and time in the log against what readers see, per topic partition."""
    scope = ["source_topic", "source_partition"]
    top = lambda df, p: df.groupBy(*scope).agg(
        F.max("source_offset").alias(f"{p}_offset"), F.max("event_time").alias(f"{p}_time"))
    both = top(source, "source").join(top(sink, "sink"), scope, "left")
    seconds = (F.unix_micros(F.col("source_time").cast("timestamp"))
               - F.unix_micros(F.col("sink_time").cast("timestamp"))) / F.lit(1_000_000.0)
    behind = F.col("source_offset") - F.coalesce(F.col("sink_offset"), F.lit(-1))
    return both.select(*scope, "source_offset", "sink_offset", behind.alias("offset_lag"),
                       seconds.alias("lag_seconds"))
