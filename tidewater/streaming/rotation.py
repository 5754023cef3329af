"""Rotation of a stream's output: closed micro-batches folded into day and hour partitions.

A stream leaves a directory per micro-batch. `rotate` folds those up to a given batch, of one stream and checkpoint,
into `<table>-rotated/stream=/checkpoint=/event_day=/event_hour=`, by dynamic partition overwrite: each touched
partition is written anew with what it held and what is added, so the number of files follows the hours and not the
batches. Each row carries the batch up to which its partition is folded. Readers take a micro-batch's row only where
its partition is not folded as far, so a row is seen once in either form, also while a rotation is half done; a rotation
run again finishes it. Directories of folded batches are deleted at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import discard, exists, scratch_path, written
from tidewater.streaming.queries import BATCH, CHECKPOINT, STREAM, BronzeStream, bronze_schema, own_path, read_stream_table

HOUR, FOLDED = "event_hour", "folded_upto"
PLACE = [STREAM, CHECKPOINT, "event_day", HOUR]


def rotated_path(spec: BronzeStream) -> str:
    return f"{spec.table}-rotated"


def _schema(spark: SparkSession, spec: BronzeStream) -> T.StructType:
    return T.StructType([
        *bronze_schema(spark, spec).fields, T.StructField(BATCH, T.LongType()), T.StructField(FOLDED, T.LongType()),
        T.StructField(STREAM, T.StringType()), T.StructField(CHECKPOINT, T.StringType()), T.StructField(HOUR, T.IntegerType())])


def _rotated(spark: SparkSession, spec: BronzeStream) -> DataFrame:
    schema, path = _schema(spark, spec), rotated_path(spec)
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _unfolded(live: DataFrame, rotated: DataFrame) -> DataFrame:
    """Rows of micro-batches that their partition does not hold yet."""
    live = live.withColumn(HOUR, F.hour("event_time"))
    bounds = rotated.groupBy(*PLACE).agg(F.max(FOLDED).alias(FOLDED))
    joined = live.join(bounds, PLACE, "left")
    return joined.filter(F.col(BATCH) > F.coalesce(FOLDED, F.lit(-1))).drop(FOLDED)


def read_bronze(spark: SparkSession, spec: BronzeStream) -> DataFrame:
    """The accepted rows of all streams of the table, rotated or not, with stream, checkpoint, batch and hour."""
    rotated = _rotated(spark, spec)
    held = rotated.drop(FOLDED)
    if not exists(spark, spec.table):
        return held
    live = read_stream_table(spark, spec.table, bronze_schema(spark, spec))
    return held.unionByName(_unfolded(live, rotated).select(*held.columns))


def rotate(spark: SparkSession, spec: BronzeStream, checkpoint: str, upto: int) -> int:
    """Fold the stream's micro-batches up to `upto`, which must be closed (a later one was committed); gives how many."""
    root = f"{spec.table}/{STREAM}={spec.name}/{CHECKPOINT}={checkpoint}"
    if not exists(spark, root):
        return 0
    schema = bronze_schema(spark, spec)
    live = read_stream_table(spark, spec.table, schema).filter(
        (F.col(STREAM) == spec.name) & (F.col(CHECKPOINT) == checkpoint) & (F.col(BATCH) <= upto))
    closed = [r[BATCH] for r in live.select(BATCH).distinct().collect()]  # at most the batches since the last rotation
    if not closed:
        return 0
    rotated = _rotated(spark, spec)
    place = scratch_path(spark, "rotation")
    added = written(spark, _unfolded(live, rotated), f"{place}/added")
    touched = added.select(*PLACE).distinct()
    held = rotated.drop(FOLDED).join(touched, PLACE, "left_semi")
    # Stored first, as the partitions are read and then overwritten.
    merged = written(spark, held.unionByName(added.select(*held.columns)).withColumn(FOLDED, F.lit(upto).cast("long")),
                     f"{place}/merged")
    merged.hint("rebalance", *PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *PLACE).parquet(rotated_path(spec))
    for batch in closed:
        discard(spark, own_path(spec.table, spec.name, checkpoint, batch))
    discard(spark, place)
    return len(closed)
