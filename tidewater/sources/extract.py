"""Reading a source table: whole, by key range, or past a watermark."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.names import col
from tidewater.functions.time import instant
from tidewater.operators.conform import latest_by_key


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One named Parquet table; a missing one is named in the error."""
    path = f"{folder.rstrip('/')}/{table}.parquet"
    try:
        return spark.read.parquet(path)
    except Exception as failure:
        raise LookupError(f"source table {table!r} cannot be read at {path}") from failure


def incremental_extract(df: DataFrame, column: str, hwm: datetime, overlap: timedelta,
                        keys: list[str], ties: list[str] | None = None) -> DataFrame:
    """Rows past `hwm - overlap`, newest per key.

    The overlap re-reads a stretch on purpose, as commits arrive out of order; the
    target's guarded upsert ignores what it already holds. Rows deleted at the
    source are not seen by this kind of extract.
    """
    since = hwm - overlap
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        floor = F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz")
    else:
        floor = instant(since)
    return latest_by_key(df.filter(col(column) >= floor), keys, column, ties)


def high_water_mark(df: DataFrame, column: str) -> DataFrame:
    """The mark the next extract starts from."""
    return df.agg(F.max(col(column)).alias("high_water_mark"))


def snapshot_extract(df: DataFrame, key: str, ranges: int) -> DataFrame:
    """Tag each row with its key range, `ranges` equal spans of [min, max].

    The bounds are one row of two numbers, the same pair a partitioned JDBC read
    takes. Rows without a key fall into range -1, so the extract stays whole.
    """
    low, high = df.agg(F.min(col(key)), F.max(col(key))).first()
    if low is None:
        return df.withColumn("_range", F.lit(-1))
    span = int(high) - int(low) + 1
    offset = (col(key).cast("decimal(38,0)") - F.lit(int(low))) * F.lit(ranges)
    index = F.floor(offset / F.lit(span)).cast("int")
    return df.withColumn("_range", F.coalesce(index, F.lit(-1)))


def balanced_ranges(df: DataFrame, key: str, ranges: int, accuracy: int = 400) -> DataFrame:
    """Tag each row with one of about `ranges` ranges of the key, `_range`, that hold about equally many rows.

    The boundaries are the quantiles of a sketch of `accuracy` that tasks make and merge, one row on the driver. A key that
    fills several ranges by itself is dealt to as many parts by a hash of the whole row, so the largest range is
    about the mean however skewed the key is. Rows without a key are range -1; an integer key is required.
    """
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"key {key!r} must be an integer")
    if ranges < 1:
        raise ValueError("ranges must be at least 1")
    sketch = df.filter(col(key).isNotNull()).agg(F.kll_sketch_agg_bigint(col(key).cast("bigint"), accuracy).alias("s"))
    ranks = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)] or [F.lit(1.0)])
    filled = F.kll_sketch_get_n_bigint("s") > 0  # an empty sketch has no quantiles
    row = sketch.select(F.when(filled, F.kll_sketch_get_quantile_bigint("s", ranks)).alias("cuts")).first()
    if row["cuts"] is None:
        return df.withColumn("_range", F.lit(-1))
    plan, number, last = [], 0, None
    cuts = row["cuts"] if ranges > 1 else []
    for cut in sorted(set(cuts)):
        heavy = cuts.count(cut) - 1
        # Keys up to the cut are one range; a cut met more than once is a key of its own weight.
        if heavy:
            plan += [(cut - 1, number, 1), (cut, number + 1, heavy + 1)]
            number += heavy + 2
        else:
            plan.append((cut, number, 1))
            number += 1
        last = cut
    highest = (1 << 63) - 1
    if last != highest:
        plan.append((highest, number, 1))
    uppers = F.array(*[F.lit(upper).cast("bigint") for upper, _, _ in plan])
    firsts, parts = (F.array(*[F.lit(p[i]) for p in plan]) for i in (1, 2))
    place = F.size(F.filter(uppers, lambda upper: upper < col(key).cast("bigint"))) + 1
    dealt = F.element_at(firsts, place) + F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.element_at(parts, place)).cast("int")
    return df.withColumn("_range", F.when(col(key).isNull(), -1).otherwise(dealt))


def bootstrap_with_tail(snapshot: DataFrame, log: DataFrame, keys: list[str], seq: str,
                        ties: list[str] | None = None) -> DataFrame:
    """State from a snapshot plus the log that overlaps it; highest sequence wins."""
    return latest_by_key(snapshot.unionByName(log), keys, seq, ties)
