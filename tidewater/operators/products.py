"""Gold tables, marts, semantic views and product scorecards."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.names import col


def materialise(spark: SparkSession, sql: str, sources: dict[str, DataFrame]) -> DataFrame:
    """A gold query over named sources, written `{name}` in the SQL.

    Sources are bound as DataFrames, so the query reads what it was handed. A name that
    is not given, or given and never read, is refused before planning.
    """
    used = {name for _, name, _, _ in string.Formatter().parse(sql) if name}
    missing, unread = used - set(sources), set(sources) - used
    if missing or unread:
        raise ValueError(f"sources not given: {sorted(missing)}; never read: {sorted(unread)}")
    return spark.sql(sql, **sources)


def mart(spark: SparkSession, sql: str, gold: dict[str, DataFrame]) -> DataFrame:
    """A consumer-facing table built from gold sources only."""
    return materialise(spark, sql, gold)


def semantic_view(mart_df: DataFrame, dims: list[str], metrics: dict[str, str],
                  view: str | None = None) -> DataFrame:
    """Approved metrics (name to SQL aggregate) by dimensional keys, optionally registered."""
    result = mart_df.groupBy(*[col(d) for d in dims]).agg(
        *[F.expr(expression).alias(name) for name, expression in metrics.items()])
    if view:
        result.createOrReplaceTempView(view)
    return result


def metric_states(df: DataFrame, dims: list[str], sums: dict[str, str], distinct: dict[str, str] | None = None,
                  lg_size: int = 12) -> DataFrame:
    """A mart of partial states by dimensional keys: `rows`, a sum per entry of `sums` and a sketch per entry of `distinct`.

    Both name a SQL expression per metric. Any subset of the dimensions can be had from the states alone (`rolled_up`); sums
    of integers and decimals stay exact, distinct counts have the sketch's relative error, 1.04 / sqrt(2 ** lg_size).
    """
    taken = {"rows", *dims} & {*sums, *(distinct or {})}
    if taken:
        raise ValueError(f"metrics named like dimensions or rows: {sorted(taken)}")
    return df.groupBy(*[col(d) for d in dims]).agg(
        F.count("*").alias("rows"), *[F.sum(F.expr(e)).alias(n) for n, e in sums.items()],
        *[F.hll_sketch_agg(F.expr(e), lg_size).alias(n) for n, e in (distinct or {}).items()])


def rolled_up(states: DataFrame, dims: list[str], sums: list[str], distinct: list[str] | None = None) -> DataFrame:
    """The metrics by a subset of the dimensions, from states: additive ones added, sketches united and estimated."""
    merged = states.groupBy(*[col(d) for d in dims]).agg(
        F.sum("rows").alias("rows"), *[F.sum(col(n)).alias(n) for n in sums],
        *[F.hll_union_agg(col(n)).alias(n) for n in distinct or []])
    return merged.select(*[col(d) for d in dims], "rows", *[col(n) for n in sums],
                         *[F.hll_sketch_estimate(col(n)).alias(n) for n in distinct or []])


def metric_parity(view: DataFrame, reference: DataFrame, dims: list[str], tolerance: float) -> DataFrame:
    """Each shared metric of the view against the reference aggregate, per key."""
    metrics = [c for c in view.columns if c not in dims and c in reference.columns]
    left = view.select(*[col(d) for d in dims], *[col(m).alias(f"_v_{m}") for m in metrics])
    right = reference.select(*[col(d) for d in dims], *[col(m).alias(f"_r_{m}") for m in metrics])
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"_v_{m}").cast("double").alias("view_value"),
                 F.col(f"_r_{m}").cast("double").alias("mart_value")) for m in metrics])
    compared = left.join(right, dims, "full_outer").select(*[col(d) for d in dims], F.inline(rows))
    gap = F.abs(F.col("view_value") - F.col("mart_value"))
    return compared.withColumn("agrees", F.coalesce(gap <= F.lit(float(tolerance)), F.lit(False)))


def product_scorecard(products: DataFrame, status: DataFrame, gaps: DataFrame,
                      freshness: DataFrame, lineage_targets: DataFrame,
                      max_age_minutes: float) -> DataFrame:
    """Five points per product: owner, freshness, quality, lineage and contract.

    `products` carries `dataset, owner, contract`; the others are keyed by `dataset`.
    """
    quality = status.select("dataset", "quality_status")
    open_gaps = gaps.groupBy("dataset").agg(F.count("*").alias("gaps"))
    age = freshness.select("dataset", "freshness_minutes")
    traced = lineage_targets.select("dataset").distinct().withColumn("_traced", F.lit(True))
    joined = products
    for part in (quality, open_gaps, age, traced):
        joined = joined.join(part, "dataset", "left")
    point = lambda c: F.coalesce(c, F.lit(False))
    points = {
        "has_owner": F.col("owner").isNotNull(),
        "is_fresh": point(F.col("freshness_minutes") <= F.lit(float(max_age_minutes))),
        "quality_passed": point(F.col("quality_status") == "passed"),
        "has_lineage": point(F.col("_traced")),
        "has_contract": F.col("contract").isNotNull(),
    }
    score = sum((p.cast("int") for p in points.values()), F.lit(0))
    return joined.select(
        "dataset", *[p.alias(n) for n, p in points.items()],
        F.coalesce("gaps", F.lit(0)).alias("gaps"), score.alias("score"))
