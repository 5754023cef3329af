"""Joins and roll-ups the other operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.names import col


def orphan_counts(df: DataFrame, column: str, ref: DataFrame, ref_col: str) -> DataFrame:
    """Values of `column` the reference lacks, with the rows that carry each.

    Both sides are reduced to one row per value before they meet: map-side partial
    aggregation absorbs a value held by a third of the rows, and the anti-join reuses
    the aggregation's partitioning. Null values are absent references, not broken ones.
    """
    values = (df.filter(col(column).isNotNull())
              .groupBy(col(column).alias("_value")).agg(F.count("*").alias("row_count")))
    known = ref.select(col(ref_col).alias("_value")).distinct()
    return values.join(known, "_value", "left_anti")


def anti_reference(df: DataFrame, column: str, ref: DataFrame, ref_col: str) -> DataFrame:
    """The rows themselves whose value the reference lacks."""
    known = ref.select(col(ref_col).alias("_value")).distinct()
    kept = df.filter(col(column).isNotNull())
    return kept.join(known, col(column) == F.col("_value"), "left_anti")


def conditional_rollup(df: DataFrame, by: list[str], conditions: dict[str, Column],
                       measures: dict[str, Column] | None = None) -> DataFrame:
    """Rows, one conditional count per name and any further aggregates, in a single pass."""
    return df.groupBy(*[col(b) for b in by]).agg(
        F.count("*").alias("row_count"),
        *[F.count_if(c).alias(name) for name, c in conditions.items()],
        *[m.alias(name) for name, m in (measures or {}).items()])


def distinct_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many different combinations there are; nulls count as equal."""
    return df.select(*[col(c) for c in columns]).distinct().agg(F.count("*").alias("distinct_keys"))


def range_sum(df: DataFrame, size: str, group: list[str]) -> DataFrame:
    """Every row stands for the numbers 0 to `size` - 1: their sum and count per group.

    The ranges are generated where the rows are and summed before the shuffle. A null, zero or negative
    size stands for no numbers.
    """
    numbers = F.sequence(F.lit(0).cast("long"), col(size).cast("long") - 1)
    ranged = df.select(*map(col, group), F.explode_outer(F.when(col(size) > 0, numbers)).alias("_n"))
    return ranged.groupBy(*map(col, group)).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.count("_n").alias("row_count"))


def newest(df: DataFrame, ts: str, n: int, ties: list[str]) -> DataFrame:
    """Top-n by time; runs as a bounded heap per task, not as a full sort."""
    return df.orderBy(col(ts).desc_nulls_last(), *[col(t).asc() for t in ties]).limit(n)


def enrich_reference(df: DataFrame, ref: DataFrame, on: dict[str, str],
                     columns: list[str]) -> DataFrame:
    """Left join to reference data on {row column: reference column}; misses are flagged.

    The reference must hold each key once. No hint is given: AQE broadcasts it when
    its measured size allows and otherwise splits a skewed row side.
    """
    side = ref.select(*[col(r).alias(f"_on_{i}") for i, r in enumerate(on.values())],
                      *[col(c) for c in columns], F.lit(True).alias("_known"))
    condition = None
    for i, left in enumerate(on):
        same = col(left, "l") == F.col(f"r._on_{i}")
        condition = same if condition is None else condition & same
    return df.alias("l").join(side.alias("r"), condition, "left").select(
        *[col(c, "l") for c in df.columns], *[col(c, "r") for c in columns],
        F.col("_known").isNull().alias("reference_missing"))
