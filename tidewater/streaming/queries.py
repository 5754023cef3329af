"""Starting streams: keyed counts, windows, the bronze change table."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewater.functions.names import col
from tidewater.operators.conform import latest_by_key
from tidewater.operators.lineage import stream_lineage
from tidewater.functions.time import instant
from tidewater.session import exists
from tidewater.sources import zones
from tidewater.streaming.cdc import (
    POSITION, CdcRules, accepted_records, cdc_check, cdc_current_state, cdc_decode, record_results, rejected_records,
)


def stream_table(spark: SparkSession, folder: str, table: str,
                 files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet table as a stream; a broker topic gives the same columns to what follows.

    A micro-batch takes at most `files_per_trigger` files, so catching up with a long
    backlog is a row of bounded batches. The path is written as a pattern so that a
    table may be a directory or one file.
    """
    folder = folder.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{table}.parquet").schema)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(
        f"{folder}/{table}.parque[t]")


def stream_key_counts(df: DataFrame, ts: str, lateness: str, key: str,
                      window: str | None = None) -> DataFrame:
    """Events per key, and per event-time window where one is given.

    With a window the watermark bounds the state: rows later than `lateness` are dropped and
    counted (`StreamMetrics`). Without one nothing is dropped and the state holds every key.
    """
    timed = df.withColumn("_ts", col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    if window is None:
        return timed.groupBy(col(key)).agg(
            F.count("*").alias("event_count"), F.max("_ts").alias("last_ts"))
    span = F.window("_ts", window)
    return (timed.groupBy(span, col(key)).agg(F.count("*").alias("event_count"))
            .select(col(key), F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"), "event_count"))


def _trigger(trigger: str | None) -> dict:
    """`None` takes what is there and stops; otherwise micro-batches at that interval."""
    return {"availableNow": True} if trigger is None else {"processingTime": trigger}


def start_counts(counts: DataFrame, path: str, checkpoint: str,
                 trigger: str | None = None) -> StreamingQuery:
    """Write changed groups of each micro-batch to a directory named by the batch.

    Update mode sends only groups that changed, not the whole state; a batch run again
    after a failure overwrites its own directory.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    return (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**_trigger(trigger)).foreachBatch(write).start())


def _count_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest fold, if there is one, and the micro-batches after it."""
    stored = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])
    batches = spark.read.schema(stored).parquet(path)
    try:
        folds = spark.read.schema(stored).parquet(f"{path}-folded")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return batches
    upto = folds.agg(F.max("_batch")).first()[0]
    return batches.filter(F.col("_batch") > upto).unionByName(folds.filter(F.col("_batch") == upto))


def read_counts(spark: SparkSession, path: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """The current value of every group: its newest micro-batch."""
    return latest_by_key(_count_rows(spark, path, schema), keys, "_batch", []).drop("_batch")


def fold_counts(spark: SparkSession, path: str, keys: list[str], schema: T.StructType) -> None:
    """Write the current values as one fold, so that later reads leave out the micro-batches behind it."""
    rows = _count_rows(spark, path, schema)
    newest = rows.agg(F.max("_batch")).first()[0]
    if newest is not None:
        latest_by_key(rows, keys, "_batch", []).drop("_batch").write.mode("overwrite").parquet(
            f"{path}-folded/_batch={newest}")


class StreamMetrics(StreamingQueryListener):
    """Rows processed and rows dropped as late, per query, over its whole run.

    `recentProgress` keeps the last hundred reports; a listener sees every one.
    """

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.totals.setdefault(str(event.id), {"batches": 0, "processed": 0, "late": 0, "last_batch": -1})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        total = self.totals.setdefault(str(progress.id), {"batches": 0, "processed": 0, "late": 0, "last_batch": -1})
        total["batches"] += progress.batchId > total["last_batch"]
        total["processed"] += progress.numInputRows
        total["late"] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        total["last_batch"] = max(total["last_batch"], progress.batchId)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def of(self, query: StreamingQuery, wait_seconds: float = 10) -> dict[str, int]:
        """The query's totals, once its newest report has come in."""
        newest = (query.lastProgress or {}).get("batchId", -1)
        until = time.monotonic() + wait_seconds
        while self.totals.get(str(query.id), {}).get("last_batch", -1) < newest and time.monotonic() < until:
            time.sleep(0.05)
        return dict(self.totals.get(str(query.id), {}))


@dataclass(frozen=True)
class BronzeStream:
    """A change stream: its name, where it goes, how its records are judged, and what lineage says of it."""

    name: str
    table: str
    results_table: str
    rejects_table: str
    lineage_table: str
    dataset: str
    envelope: T.StructType
    rules: CdcRules
    version: str = "1"
    source_system: str = ""
    connector: str = ""
    catalog: str = ""
    offset_span: int = 1 << 20

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9_-]+", self.name):
            raise ValueError(f"a stream's name has letters, digits, - and _ only: {self.name!r}")


#: A micro-batch lies in a directory of its own, named by the stream, its checkpoint and the batch, in
#: each of the four tables. Run again, it writes the same directory again; a stream with a new checkpoint,
#: or another stream that shares a table, writes others.
STREAM, CHECKPOINT, BATCH = "stream", "checkpoint", "batch"
_PLACE = [T.StructField(STREAM, T.StringType()), T.StructField(CHECKPOINT, T.StringType()),
          T.StructField(BATCH, T.LongType())]


def own_path(table: str, name: str, checkpoint: str, batch_id: int) -> str:
    return f"{table}/{STREAM}={name}/{CHECKPOINT}={checkpoint}/{BATCH}={batch_id}"


def read_stream_table(spark: SparkSession, table: str, schema: T.StructType | None = None) -> DataFrame:
    """All micro-batches of all streams that write to a table, with where each row came from."""
    reader = spark.read.option("recursiveFileLookup", False)
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, *_PLACE]))
    return reader.parquet(table)


def bronze_schema(spark: SparkSession, spec: BronzeStream) -> T.StructType:
    """Columns of the accepted rows."""
    topic = spark.createDataFrame([], "topic string, partition int, offset bigint, key string, value string, "
                                      "timestamp timestamp")
    accepted = accepted_records(cdc_check(cdc_decode(topic, spec.envelope), spec.rules), "1970-01-01 00:00:00", "")
    return accepted.withColumn("event_day", F.to_date("event_time")).schema



def _pointers(spec: BronzeStream, place: int | None = None) -> str:
    """Where it stands which micro-batches may hold an offset; a place is a span of offsets of a topic partition."""
    return f"{spec.table}-positions" + ("" if place is None else f"/place={place}")


def _offset_spans(spec: BronzeStream, decoded: DataFrame) -> list[Row]:
    """Per topic partition and span of `offset_span` offsets, the batch's lowest and highest, and its days."""
    day, span = F.to_date("event_time"), F.floor(F.col("source_offset") / spec.offset_span)
    return decoded.groupBy("source_topic", "source_partition", F.xxhash64("source_topic", "source_partition", span).alias("place")).agg(
        F.min("source_offset").alias("low"), F.max("source_offset").alias("high"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day")).collect()


def _stretches(spec: BronzeStream, spans: list[Row]) -> list[tuple]:
    """Spans of a topic partition as few stretches of offsets: every held row is compared with each of them.

    A stretch takes in the next span where it begins at most `offset_span` offsets on; what it holds besides joins nothing.
    """
    found: list[tuple] = []
    known = [r for r in spans if None not in (r["source_topic"], r["source_partition"], r["low"])]
    for r in sorted(known, key=lambda r: (r["source_topic"], r["source_partition"], r["low"])):
        place = (r["source_topic"], r["source_partition"])
        if found and found[-1][:2] == place and r["low"] - found[-1][3] <= spec.offset_span:
            found[-1] = (*place, found[-1][2], max(found[-1][3], r["high"]))
        else:
            found.append((*place, r["low"], r["high"]))
    return found


def _announce(spark: SparkSession, spec: BronzeStream, spans: list[Row], who: str, batch_id: int, now: datetime | str) -> None:
    """Record where positions are about to be stored, ahead of the rows, so that no stored row is without a pointer.

    Rows without an event time will have the processing time's day. A batch run again records the same once more.
    """
    rows = [(r["place"], spec.name, who, batch_id, r["first_day"], r["last_day"]) for r in spans]
    frame = spark.createDataFrame(
        rows, f"place bigint, {STREAM} string, {CHECKPOINT} string, {BATCH} bigint, first_day date, last_day date")
    frame.withColumn("today", F.to_date(instant(now))).coalesce(1).write.mode("append").partitionBy("place").parquet(_pointers(spec))


def _held_positions(spark: SparkSession, spec: BronzeStream, spans: list[Row], own: Column | None = None) -> DataFrame | None:
    """Positions that other micro-batches hold, within the given offsets of each topic partition.

    Only the pointers of these spans are read, and of the table only the micro-batches and, where those are folded, the
    days that they name. So the cost follows the batches of a span and not the table's history. As conditions on columns of
    the files the bounds skip row groups of other offsets.
    """
    places = [place for r in spans if exists(spark, place := _pointers(spec, r["place"]))]
    if not places:
        return None
    found = spark.read.parquet(*places).groupBy(STREAM, CHECKPOINT, BATCH).agg(
        F.min("first_day").alias("first"), F.max("last_day").alias("last"), F.collect_set("today").alias("today"))
    schema = bronze_schema(spark, spec)
    live, days = [], set()
    for r in (found if own is None else found.filter(~own)).collect():  # as many as micro-batches share these spans
        path = own_path(spec.table, r[STREAM], r[CHECKPOINT], r[BATCH])
        if exists(spark, path):
            live.append(path)
            continue
        folded = f"{spec.table}-rotated/{STREAM}={r[STREAM]}/{CHECKPOINT}={r[CHECKPOINT]}"
        span = [r["first"] + timedelta(days=n) for n in range((r["last"] - r["first"]).days + 1)] if r["first"] else []
        days.update(f"{folded}/event_day={day}" for day in {*span, *r["today"]})
    read = lambda root, paths: spark.read.schema(T.StructType([schema[c] for c in POSITION])).option(
        "basePath", root).parquet(*paths).select(*POSITION)
    rotated = sorted(day for day in days if exists(spark, day))
    held = [read(root, paths) for root, paths in ((spec.table, live), (f"{spec.table}-rotated", rotated)) if paths]
    if not held:
        return None
    bounds = [(F.col("source_topic") == topic) & (F.col("source_partition") == partition)
              & F.col("source_offset").between(low, high) for topic, partition, low, high in _stretches(spec, spans)]
    if not bounds:
        return None
    return reduce(DataFrame.unionByName, held).filter(reduce(or_, bounds))


def bronze_batch_writer(spec: BronzeStream, clock: Callable[[int], datetime | str],
                        checkpoint: str | None = None) -> Callable[[DataFrame, int], None]:
    """What one micro-batch does: accepted rows, dead letters, evidence, then lineage.

    Each goes to the batch's own directory, so a batch that runs again changes nothing, also after the
    table was compacted by others. `checkpoint` names the stream's checkpoint; inside a running query it
    is the query's id, which is stored there. `clock` gives the processing time of a batch.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        spark, now = rows.sparkSession, clock(batch_id)
        who = checkpoint or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not who:
            raise ValueError("outside of a streaming query the checkpoint must be named")
        run_id = f"{spec.name}/{who}/{batch_id}"
        own = (F.col(STREAM) == spec.name) & (F.col(CHECKPOINT) == who) & (F.col(BATCH) == batch_id)

        def store(df: DataFrame, table: str, *partition_by: str) -> None:
            df.write.mode("overwrite").partitionBy(*partition_by).parquet(own_path(table, spec.name, who, batch_id))

        # The source is read once; the checked rows feed four writes.
        decoded = cdc_decode(rows, spec.envelope).persist()
        spans = _offset_spans(spec, decoded)
        checked = cdc_check(decoded, spec.rules, _held_positions(spark, spec, spans, own)).persist()
        try:
            if spans:
                _announce(spark, spec, spans, who, batch_id, now)
            accepted = accepted_records(checked, now, run_id)
            rejected = rejected_records(checked)
            store(accepted.withColumn("event_day", F.to_date("event_time")).hint("rebalance", "event_day"), spec.table, "event_day")
            store(rejected, spec.rejects_table)
            store(record_results(checked, spec.rules, spec.dataset, run_id, now, batch_id), spec.results_table)
            store(stream_lineage(accepted, rejected, run_id, batch_id, spec.dataset, now, {
                "job_name": spec.name, "job_version": spec.version, "source_system": spec.source_system,
                "connector": spec.connector, "target_catalog": spec.catalog}), spec.lineage_table)
        finally:
            checked.unpersist()
            decoded.unpersist()

    return write


def record_counts(spark: SparkSession, spec: BronzeStream) -> DataFrame:
    """Records committed and refused, per stream and checkpoint, from what is stored."""
    place = [STREAM, CHECKPOINT]
    count = lambda table, column, name: read_stream_table(spark, table).groupBy(*place).agg(
        F.sum(column).alias(name))
    return (count(spec.lineage_table, "row_count", "committed")
            .join(count(spec.rejects_table, "records", "failed"), place, "full_outer").na.fill(0))


def start_current_state(changes: DataFrame, table: str, checkpoint: str, state: T.StructType, keys: list[str],
                        seq: str, delete_operations: tuple[str, ...], clock: Callable[[int], datetime | str],
                        ties: list[str] | None = None, trigger: str | None = "5 minutes") -> StreamingQuery:
    """Keep a silver table, of the columns in `state`, at the newest state per key of a stream of accepted changes.

    Each micro-batch merges into the key buckets it touches. The merge is guarded by the sequence, so a
    batch that runs again, or arrives late, changes nothing that is newer.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        zones.merge_buckets(
            batch, table, keys, "silver", clock(batch_id),
            lambda held, rows: cdc_current_state(held, rows, keys, seq, delete_operations, ties), empty=state)

    return (changes.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**_trigger(trigger)).foreachBatch(write).start())


def start_bronze(stream: DataFrame, spec: BronzeStream, checkpoint: str,
                 clock: Callable[[int], datetime | str],
                 trigger: str | None = "5 minutes") -> StreamingQuery:
    """Append a change topic to bronze, one directory per micro-batch.

    Source offsets are committed to the checkpoint after the writer returns, so data is
    durable first; a restart resumes behind the last finished batch.
    """
    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(**_trigger(trigger))
            .foreachBatch(bronze_batch_writer(spec, clock)).start())


def deduplicated_stream(stream: DataFrame, lateness: str) -> DataFrame:
    """Drop records whose position was seen within the watermark, state bounded by it."""
    return stream.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(
        ["topic", "partition", "offset"])


def replay_rebuild(log: DataFrame, spec: BronzeStream, now: datetime | str) -> DataFrame:
    """Accepted rows of retained events in one batch run, by the stream's own functions."""
    checked = cdc_check(cdc_decode(log, spec.envelope), spec.rules)
    return accepted_records(checked, now, "replay")
