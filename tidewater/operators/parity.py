"""Where two tables differ, by digests of key ranges compared level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.names import col, require_columns

#: Ranges of the last level are 2**MAX_BITS at most, which is what is ever sent to all executors.
MAX_BITS = 16


def _range(keys: list[str], bits: int) -> Column:
    """A key's range: the leading bits of a hash, so a range of one level lies within one of the level above."""
    return F.shiftrightunsigned(F.xxhash64(*[col(k) for k in keys]), 64 - bits).cast("int")


def range_digests(df: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Per key range: how many rows there are, and two sums over the rows' hashes that no order changes.

    Built map-side, so 2**bits rows per task are shuffled at most, whatever the table holds. Nulls are told apart from
    absent values by their place.
    """
    row = F.xxhash64(*[c for name in df.columns for c in (col(name), col(name).isNull())])
    return df.select(_range(keys, bits).alias("_range"), row.alias("_row")).groupBy("_range").agg(
        F.count("*").alias("rows"), F.sum(F.col("_row").cast("decimal(20,0)")).alias("total"),
        F.bit_xor(F.xxhash64("_row", F.lit(bits))).alias("mix"))


def differing_ranges(a: DataFrame, b: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """The ranges whose digests are not equal, or that one side lacks, with both sides' rows."""
    left, right = (range_digests(df, keys, bits).select("_range", *[F.col(c).alias(f"{side}_{c}") for c in ("rows", "total", "mix")])
                   for df, side in ((a, "left"), (b, "right")))
    both = left.join(right, "_range", "full_outer")
    equal = (F.col("left_rows") == F.col("right_rows")) & (F.col("left_total") == F.col("right_total")) & (
        F.col("left_mix") == F.col("right_mix"))
    return both.filter(~F.coalesce(equal, F.lit(False))).select("_range", "left_rows", "right_rows")


def _within(df: DataFrame, keys: list[str], bits: int, found: list[int]) -> DataFrame:
    """The rows of the named ranges; a filter where they are few, else a lookup of a table of bounded size."""
    place = _range(keys, bits)
    if len(found) <= 256:
        return df.filter(place.isin(found))
    named = df.sparkSession.createDataFrame([(x,) for x in found], "_range int")
    return df.withColumn("_range", place).join(F.broadcast(named), "_range", "left_semi").drop("_range")  # 2**MAX_BITS ints


def parity_ranges(a: DataFrame, b: DataFrame, keys: list[str], levels: tuple[int, ...] = (8, 16)) -> DataFrame:
    """Rows on one side only, as bags: the columns, `side` (left or right) and `rows`.

    Each level compares digests of 2**bits key ranges within the ranges that differ so far, and only rows of ranges that
    differ on the last level are compared themselves. So two large tables that agree but for a few keys are read once
    per level, and little more than those keys' ranges is shuffled. Columns must have the same names and types. Equal digests
    of different rows would need 64-bit hashes to agree in a sum and in a mixed second one.
    """
    types = [{f.name: f.dataType.simpleString() for f in df.schema.fields} for df in (a, b)]
    if types[0] != types[1]:
        raise ValueError(f"columns differ: {sorted(set(types[0].items()) ^ set(types[1].items()))}")
    if not levels or list(levels) != sorted(set(levels)) or not 0 < levels[0] <= levels[-1] <= MAX_BITS:
        raise ValueError(f"levels must rise from 1 to {MAX_BITS} bits")
    keys = require_columns(a, keys, "parity key")
    b = b.select(*[col(c) for c in a.columns])
    for bits in levels:
        found = sorted(r["_range"] for r in differing_ranges(a, b, keys, bits).collect())  # 2**bits at most
        a, b = (_within(df, keys, bits, found) for df in (a, b))
    columns = [col(c) for c in a.columns]
    signed = a.select(*columns, F.lit(1).alias("_sign")).unionByName(b.select(*columns, F.lit(-1).alias("_sign")))
    surplus = signed.groupBy(*columns).agg(F.sum("_sign").alias("_d")).filter("_d <> 0")
    return surplus.select(*columns, F.when(F.col("_d") > 0, "left").otherwise("right").alias("side"), F.abs("_d").alias("rows"))
