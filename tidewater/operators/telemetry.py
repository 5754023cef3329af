"""Timing distributions and job counters over rows of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.names import col

SLICES_PER_DOUBLING = 256


def _slice(value: Column) -> Column:
    """A number that does not decrease with the value and splits every doubling in 256."""
    size = F.floor(F.log2(F.abs(value) + 1) * SLICES_PER_DOUBLING)
    return F.when(value < 0, -size).otherwise(size).cast("bigint")


def _ranked(df: DataFrame, metric: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Rows of (metric, quantile, its exact nearest-rank value, totals of the metric).

    A histogram of value slices (bounded in size, built by partial aggregation) gives
    the slice each rank falls in and every total; only the distinct values of those
    slices are then ordered. A metric that holds most of the rows is spread like any other.
    """
    sliced = df.filter(col(value).isNotNull()).select(
        col(metric).alias("_metric"), col(value).alias("_value"),
        _slice(col(value)).alias("_slice"))
    upto = Window.partitionBy("_metric").orderBy("_slice")
    whole = Window.partitionBy("_metric")
    histogram = sliced.groupBy("_metric", "_slice").agg(
        F.count("*").alias("_n"), F.sum("_value").alias("_sum"),
        F.min("_value").alias("_low"), F.max("_value").alias("_high")
    ).withColumns({
        "_upto": F.sum("_n").over(upto), "samples": F.sum("_n").over(whole),
        "total": F.sum("_sum").over(whole), "lowest": F.min("_low").over(whole),
        "highest": F.max("_high").over(whole)})
    wanted = F.array(*[
        F.struct(F.lit(name).alias("_quantile"),
                 F.greatest(F.ceil(F.lit(float(q)) * F.col("samples")), F.lit(1)).alias("_rank"))
        for name, q in quantiles.items()])
    totals = ["samples", "total", "lowest", "highest"]
    located = (histogram.select("*", F.inline(wanted))
               .filter((F.col("_rank") <= F.col("_upto"))
                       & (F.col("_rank") > F.col("_upto") - F.col("_n")))
               .select("_metric", "_slice", "_quantile", *totals,
                       (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank")))
    # Counted before the join: a value that most rows share is one row there.
    counted = (sliced.groupBy("_metric", "_slice", "_value").agg(F.count("*").alias("_n"))
               .join(located, ["_metric", "_slice"]))
    order = Window.partitionBy("_metric", "_quantile").orderBy("_value")
    reached = counted.withColumn("_upto", F.sum("_n").over(order))
    return (reached.filter(F.col("_upto") >= F.col("_rank"))
            .groupBy("_metric", "_quantile", *totals).agg(F.min("_value").alias("_value")))


def timing_states(df: DataFrame, metric: str, value: str, period: str, accuracy: int = 400) -> DataFrame:
    """Per metric and period a state that can be stored and merged: samples, total, lowest, highest and a quantile sketch.

    The sketch's rank error is about 1 % at an accuracy of 400; all other numbers are exact. Samples of a period are read
    once, whatever is asked later.
    """
    return df.filter(col(value).isNotNull()).groupBy(col(metric), col(period)).agg(
        F.count("*").alias("samples"), F.sum(col(value)).alias("total"), F.min(col(value)).alias("lowest"),
        F.max(col(value)).alias("highest"), F.kll_sketch_agg_bigint(col(value).cast("bigint"), accuracy).alias("sketch"))


def merged_timings(states: DataFrame, by: list[str]) -> DataFrame:
    """States merged over what `by` leaves out, by a map-side aggregate of small rows."""
    return states.groupBy(*[col(c) for c in by]).agg(
        F.sum("samples").alias("samples"), F.sum("total").alias("total"), F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def timing_quantiles(states: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The states with approximate quantiles in place of their sketches; the lowest and highest stay exact."""
    return states.select(*[col(c) for c in states.columns if c != "sketch"], *[
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias(name) for name, q in quantiles.items()])


def _quantile_columns(quantiles: dict[str, float]) -> list[Column]:
    return [F.max(F.when(F.col("_quantile") == name, F.col("_value"))).alias(name)
            for name in quantiles]


def nearest_rank(df: DataFrame, metric: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank quantiles per metric, without gathering a metric in one task."""
    ranked = _ranked(df, metric, value, quantiles)
    return ranked.groupBy(F.col("_metric").alias(metric)).agg(*_quantile_columns(quantiles))


def timing_summary(df: DataFrame, metric: str, value: str) -> DataFrame:
    """Samples, total, mean, min, p50, p95 and max per metric; nanoseconds in, whole ms out."""
    quantiles = {"_p50": 0.50, "_p95": 0.95}
    rows = _ranked(df, metric, value, quantiles).groupBy(
        F.col("_metric").alias(metric), "samples", "total", "lowest", "highest"
    ).agg(*_quantile_columns(quantiles))
    millis = lambda expr, name: F.expr(f"{expr} div 1000000").alias(name)
    return rows.select(
        col(metric), "samples", millis("total", "total_ms"),
        millis("(total div samples)", "mean_ms"), millis("lowest", "min_ms"),
        millis("_p50", "p50_ms"), millis("_p95", "p95_ms"), millis("highest", "max_ms"))


# The counters a task reports, in the order they are summed.
TASK_COUNTERS = (
    "executor_run_ms", "executor_cpu_ns", "deserialize_ms", "result_serialization_ms",
    "jvm_gc_ms", "result_bytes", "input_bytes", "input_records", "output_bytes",
    "output_records", "shuffle_read_bytes", "shuffle_read_records", "shuffle_write_bytes",
    "shuffle_write_records", "memory_spill_bytes", "disk_spill_bytes",
)


def operation_rollup(tasks: DataFrame, stages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counters per operation: tasks belong to stages, stages to jobs, jobs to operations.

    `tasks` carries `stage_id` and TASK_COUNTERS, `stages` (stage_id, job_id), `jobs`
    (job_id, operation_id, scheduler_ms). Tasks are summed per stage before any join,
    so a stage with very many tasks is reduced on the map side.
    """
    counters = [c for c in TASK_COUNTERS if c in tasks.columns]
    per_stage = tasks.groupBy("stage_id").agg(
        F.count("*").alias("tasks"), *[F.sum(c).alias(c) for c in counters])
    per_job = stages.join(per_stage, "stage_id", "left").groupBy("job_id").agg(
        F.count("*").alias("stages"), *[F.sum(c).alias(c) for c in ["tasks", *counters]])
    rolled = jobs.filter(F.col("operation_id").isNotNull()).join(per_job, "job_id", "left").groupBy(
        "operation_id").agg(
        F.count("*").alias("jobs"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["stages", "tasks", *counters]],
        F.sum(F.greatest("scheduler_ms", F.lit(0))).alias("scheduler_ms"))
    if "executor_cpu_ns" in counters:
        rolled = rolled.withColumn(
            "executor_cpu_ms", F.expr("executor_cpu_ns div 1000000")).drop("executor_cpu_ns")
    return rolled
