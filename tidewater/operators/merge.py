"""Silver state: guarded upsert, deletes, fenced staging, merge on read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewater.functions.names import col, require_columns
from tidewater.operators.conform import latest_by_key
from tidewater.session import exists


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], seq: str,
           ties: list[str] | None = None, null_safe: bool = False,
           small_batch: bool = False) -> DataFrame:
    """State after merging `batch`: a row changes only when a newer one arrives.

    A matched row is replaced when the batch sequence is higher or the held one is
    null; an unmatched row is inserted; older and equal sequences change nothing.
    Silver keeps its columns: extra batch columns are left out, missing ones refused.
    A null key matches nothing, as under SQL equality, so its row is inserted each time;
    with `null_safe`, null keys are compared as equal instead.

    The batch is collapsed first, so both sides hold a key at most once and no key is
    hot. Two plans give the same rows:

    * the default shuffles each side once, for one full outer join (a target bucketed on
      the keys is not shuffled at all);
    * `small_batch` joins without moving the target where the batch is small: Catalyst
      and AQE broadcast it when its measured size allows, and sort-merge it otherwise.
    """
    keys = require_columns(target, keys, "business key")
    (seq,) = require_columns(target, [seq], "sequence column")
    columns = target.columns
    held_names = require_columns(batch, columns, "silver column")
    batch = batch.select(*[col(b).alias(t) for b, t in zip(held_names, columns)])
    newest = latest_by_key(batch, keys, seq, ties)
    merge = _merge_small if small_batch else _merge_full
    return merge(target, newest, keys, seq, null_safe)


def _same_key(keys: list[str], left: str, right: str, null_safe: bool) -> Column:
    return _all([
        col(k, left).eqNullSafe(col(k, right)) if null_safe else col(k, left) == col(k, right)
        for k in keys
    ])


def _newer(seq: str) -> Column:
    return F.coalesce((col(seq, "s") > col(seq, "t")) | col(seq, "t").isNull(), F.lit(False))


def _merge_full(target: DataFrame, newest: DataFrame, keys: list[str], seq: str,
                null_safe: bool) -> DataFrame:
    """Target rows with a null key bypass the join: they cannot match, and would pile up
    in one shuffle partition."""
    null_safe = null_safe or not any(target.schema[k].nullable for k in keys)
    keyed = _all([col(k).isNotNull() for k in keys])
    matchable = target if null_safe else target.filter(keyed)
    held = matchable.withColumn("_held", F.lit(True)).alias("t")
    sent = newest.withColumn("_sent", F.lit(True)).alias("s")
    take = F.col("_sent").isNotNull() & (F.col("_held").isNull() | _newer(seq))
    merged = held.join(sent, _same_key(keys, "t", "s", null_safe), "full_outer").select(*[
        F.when(take, col(c, "s")).otherwise(col(c, "t")).alias(c) for c in target.columns
    ])
    return merged if null_safe else merged.unionByName(target.filter(~keyed))


def _merge_small(target: DataFrame, newest: DataFrame, keys: list[str], seq: str,
                 null_safe: bool) -> DataFrame:
    """Updates by a left join from the target, inserts from the keys it does not hold."""
    sent = newest.withColumn("_sent", F.lit(True)).alias("s")
    take = F.col("_sent").isNotNull() & _newer(seq)
    kept = target.alias("t").join(sent, _same_key(keys, "t", "s", null_safe), "left").select(*[
        F.when(take, col(c, "s")).otherwise(col(c, "t")).alias(c) for c in target.columns
    ])
    touched = target.select(*map(col, keys)).alias("t").join(
        newest.alias("s"), _same_key(keys, "t", "s", null_safe), "left_semi").alias("x")
    inserted = newest.alias("n").join(touched, _same_key(keys, "n", "x", null_safe), "left_anti")
    return kept.unionByName(inserted.select(*map(col, target.columns)))


def null_key_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that can never match in a merge, for a report."""
    return df.filter(~_all([col(k).isNotNull() for k in keys]))


def upsert_with_deletes(target: DataFrame, batch: DataFrame, keys: list[str], seq: str,
                        delete_flag: str, null_flag_deletes: bool,
                        ties: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Guarded upsert in which a newer delete leaves a tombstone.

    The tombstone stays in the state with its sequence, so an older upsert that
    arrives late cannot bring the row back; `live_rows` hides it from readers. It holds
    the keys, the sequence, the `ties` and the columns named in `keep`; the others are
    emptied. What a missing flag means is the caller's statement.
    """
    flag = F.coalesce(col(delete_flag).cast("boolean"), F.lit(null_flag_deletes))
    kept = {c.lower() for c in [*keys, seq, delete_flag, *(ties or []), *(keep or [])]}
    marked = batch.withColumn(delete_flag, flag)
    emptied = marked.select(*[
        col(c) if c.lower() in kept else F.when(~col(delete_flag), col(c)).alias(c)
        for c in marked.columns
    ])
    return upsert(target, emptied, keys, seq, ties)


def live_rows(state: DataFrame, delete_flag: str) -> DataFrame:
    return state.filter(~F.coalesce(col(delete_flag), F.lit(False))).drop(delete_flag)


def buffer_then_merge(curated: DataFrame, staging: DataFrame, keys: list[str], seq: str,
                      ties: list[str] | None = None) -> DataFrame:
    """Merge everything buffered in staging into curated in one collapse and join."""
    return upsert(curated, staging, keys, seq, ties)


def staging_lag(curated: DataFrame, staging: DataFrame, seq: str) -> DataFrame:
    """How far curated is behind what is staged: newest sequences and rows waiting.

    Waiting rows are those past the newest merged sequence, one row on the way.
    """
    (name,) = require_columns(curated, [seq], "sequence column")
    merged = curated.agg(F.max(col(name)).alias("m")).first()["m"]
    waiting = F.count("*") if merged is None else F.count_if(col(name) > F.lit(merged))
    return staging.agg(
        F.max(col(name)).alias("staged_max"),
        F.lit(merged).alias("merged_max"),
        waiting.alias("rows_waiting"),
    )


def merge_on_read(data: DataFrame, deletes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows without a delete of the same key that is newer than the row.

    Deletes are reduced to the newest per key before the join, so the delete side is
    small and single-valued; a hot key on the data side is split by AQE.
    """
    newest = deletes.groupBy(*keys).agg(F.max(col(seq)).alias("_deleted_at"))
    same = _all([col(k, "d") == col(k, "x") for k in keys])
    return data.alias("d").join(
        newest.alias("x"), same & (F.col("x._deleted_at") > col(seq, "d")), "left_anti")


def drop_positions(data: DataFrame, positions: DataFrame, file_col: str, pos_col: str) -> DataFrame:
    """Positional deletes: leave out the named rows of the named files."""
    named = positions.select(file_col, pos_col).distinct()
    return data.join(named, [file_col, pos_col], "left_anti").select(*map(col, data.columns))


def deletion_bitmaps(positions: DataFrame, file_col: str, pos_col: str) -> DataFrame:
    """Positional deletes as one bitmap of 32,768 positions (4 KB) per file and stretch: file, _bucket, _bitmap.

    Built map-side, so a file that many deletes name does not gather in one task. Positions count from 0.
    """
    place = col(pos_col).cast("bigint") + 1
    return positions.filter(col(file_col).isNotNull() & (col(pos_col) >= 0)).groupBy(
        col(file_col), F.bitmap_bucket_number(place).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bitmap"))


def merged_bitmaps(held: DataFrame, added: DataFrame, file_col: str) -> DataFrame:
    """Bitmaps of two generations of deletes as one."""
    both = held.unionByName(added.select(*held.columns))
    return both.groupBy(col(file_col), "_bucket").agg(F.bitmap_or_agg("_bitmap").alias("_bitmap"))


def drop_bitmap_positions(data: DataFrame, bitmaps: DataFrame, file_col: str, pos_col: str) -> DataFrame:
    """Leave out the rows whose bit is set. Rows without a file or position stay.

    A lookup by file and stretch instead of a join on positions: where `bitmaps` is a stored table below the broadcast
    threshold (a bit per row of the files with deletes), no data row moves; beyond it both sides are sort-merged
    by file, and AQE splits a hot one.
    """
    place = col(pos_col, "d").cast("bigint") + 1
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr(F.col("x._bitmap"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0
    joined = data.alias("d").join(bitmaps.alias("x"), (col(file_col, "d") == col(file_col, "x")) & (
        F.bitmap_bucket_number(place) == F.col("x._bucket")), "left")
    return joined.filter(~F.coalesce(set_, F.lit(False))).select(*[col(c, "d") for c in data.columns])


@dataclass(frozen=True)
class Staging:
    """A staging buffer: staged deliveries by sequence, and the fence up to which they are merged.

    `path` holds a directory per delivery and, below `_fences`, one file per merge that names the fence and the day of the
    merge. Both are named by what they hold, so staging or merging again changes nothing.
    """

    path: str
    keys: list[str]
    seq: str
    ties: list[str] | None = None

    def stage(self, batch: DataFrame, delivery: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/_delivery={delivery}")

    def fence(self, spark: SparkSession) -> int:
        """The last delivery that is merged; -1 before the first merge."""
        place = f"{self.path}/_fences"
        if not exists(spark, place):
            return -1
        return spark.read.schema("_fence bigint").parquet(place).agg(F.max("_fence")).first()[0]

    def waiting(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """Staged rows behind the fence, with their delivery; a pruned read."""
        stored = StructType([*schema.fields, StructField("_delivery", LongType())])
        if not exists(spark, f"{self.path}/rows"):
            return spark.createDataFrame([], stored)
        return spark.read.schema(stored).parquet(f"{self.path}/rows").filter(F.col("_delivery") > self.fence(spark))

    def due(self, spark: SparkSession, schema: StructType, now: datetime, max_rows: int, max_age: timedelta, staged_at: str) -> bool:
        """Whether enough rows wait, or one of them (by its column `staged_at`) for too long."""
        count, oldest = self.waiting(spark, schema).agg(F.count("*"), F.min(col(staged_at))).first()
        return count >= max_rows or (count > 0 and oldest is not None and now - oldest >= max_age)

    def merge(self, spark: SparkSession, target: DataFrame, upto: int, store: Callable[[DataFrame], None]) -> bool:
        """Merge the deliveries behind the fence, up to and with `upto`, into the target; false if there is none.

        `store` makes the merged state durable; only then the fence moves. A merge that breaks off in between is done once
        more with the same outcome, as the merge is guarded by the sequence.
        """
        waiting = self.waiting(spark, target.schema).filter(F.col("_delivery") <= upto)
        if waiting.isEmpty():
            return False
        store(upsert(target, waiting.drop("_delivery"), self.keys, self.seq, self.ties))
        spark.range(1).select(F.lit(upto).cast("bigint").alias("_fence")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/_fences/upto={upto}")
        return True
