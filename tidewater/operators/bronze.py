"""Bronze contents as DataFrames: append, replay of one batch, inventories.

`sources.zones` does the same against stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.names import BATCH_ID, col
from tidewater.operators.schema import merged_schema, to_schema


def append_batch(held: DataFrame, batch: DataFrame) -> DataFrame:
    """Held rows plus the delivery; new columns are added, conflicts refused."""
    schema = merged_schema(held.schema, batch.schema)
    return to_schema(held, schema).unionByName(to_schema(batch, schema))


def replace_batch(held: DataFrame, batch: DataFrame, batch_id: str) -> DataFrame:
    """Swap exactly one batch by predicate; all other batches are left as they are."""
    other = held.filter(~F.col(BATCH_ID).eqNullSafe(F.lit(batch_id)))
    return append_batch(other, batch)


def empty_like(df: DataFrame) -> DataFrame:
    """The same columns and no rows."""
    return df.filter(F.lit(False))


def batch_inventory(df: DataFrame, by: str = BATCH_ID, files: bool = False) -> DataFrame:
    """Rows per batch and, for a table read from files, how many files hold them."""
    counts = [F.count("*").alias("row_count")]
    if files:
        counts.append(F.count_distinct("_metadata.file_path").alias("file_count"))
    return df.groupBy(col(by)).agg(*counts)


def purge_run(results: DataFrame, run_id: str) -> DataFrame:
    """Evidence without one run; rows that carry no run stay."""
    return results.filter((F.col("run_id") != run_id) | F.col("run_id").isNull())


def layout(df: DataFrame, zone_col: str, ts_col: str, sort: list[tuple[str, bool]]) -> DataFrame:
    """Rows arranged as a table partitioned by zone and day stores them.

    Adds `_day`; `sort` lists (column, descending). The range shuffle spreads a day
    that holds much of the data over several tasks, which a hash on (zone, day) would
    not, and still leaves few files per directory.
    """
    order = [col(c).desc() if descending else col(c).asc() for c, descending in sort]
    dated = df.withColumn("_day", F.to_date(col(ts_col)))
    return (dated.repartitionByRange(col(zone_col), F.col("_day"), *order)
            .sortWithinPartitions(col(zone_col), F.col("_day"), *order))


def layout_clustered(df: DataFrame, columns: list[str], files: int, bits: int = 6) -> DataFrame:
    """Rows arranged in about `files` stretches of a space-filling curve over several columns.

    Each column (number, date or timestamp) is cut at 2**bits quantiles, a few hundred values on the driver; a row's ranks
    are interleaved bit by bit, and rows are range-partitioned by that number. So each file spans little of every
    column, and readers skip files by their minimum and maximum whichever column they ask for. Rows of one
    place on the curve are spread by a hash, so a hot place fills several files. Nulls have the lowest rank.
    """
    if bits * len(columns) > 60 or not columns:
        raise ValueError("columns x bits must be 1 to 60")
    number = lambda c: (F.unix_micros(col(c).cast("timestamp")) if df.schema[c].dataType.typeName() in (
        "timestamp", "timestamp_ntz", "date") else col(c)).cast("double")
    steps = [(i + 1) / (1 << bits) for i in range((1 << bits) - 1)]
    cuts = df.agg(*[F.percentile_approx(number(c), steps, 10_000).alias(f"_{n}") for n, c in enumerate(columns)]).first()
    place = F.lit(0).cast("bigint")
    for n, c in enumerate(columns):
        bounds = F.array(*[F.lit(x) for x in sorted(cuts[n] or [])]).cast("array<double>")
        value = number(c)
        rank = F.when(col(c).isNull(), 0).otherwise(F.size(F.filter(bounds, lambda x: x < value)))  # noqa: B023
        for bit in range(bits):
            set_ = F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("bigint")
            place = place + F.shiftleft(set_, bit * len(columns) + n)
    spread = F.xxhash64(*[col(c) for c in df.columns])
    return df.withColumns({"_place": place, "_spread": spread}).repartitionByRange(files, "_place", "_spread").sortWithinPartitions(
        "_place", "_spread").drop("_place", "_spread")


def file_spans(stored: DataFrame, columns: list[str]) -> DataFrame:
    """Per file of a stored table its rows and the lowest and highest value of each column, as its footers hold them."""
    return stored.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), *[
        f(col(c)).alias(f"{name}_{c}") for c in columns for name, f in (("low", F.min), ("high", F.max))])


def partition_counts(df: DataFrame, zone_col: str, ts_col: str) -> DataFrame:
    """Rows per (zone, day) with the time span inside, as a partition listing shows."""
    return df.groupBy(col(zone_col), F.to_date(col(ts_col)).alias("_day")).agg(
        F.count("*").alias("row_count"),
        F.min(col(ts_col)).alias("first_ts"),
        F.max(col(ts_col)).alias("last_ts"))
