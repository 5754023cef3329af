"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetition.

DataFrame functions only. Sizes are written once as a narrow table, so texts are read one time. The
water level comes from rounds over the table of sources: each round spreads what is left over the
sources not yet clamped and clamps those that would exceed their cap, until none does. Within a source
documents are dealt to BUCKETS hash buckets; sums per bucket say which bucket the cut falls into, and
only that one bucket per source is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import quoted
from tidewater.session import scratch_path, written

BUCKET_DIGITS = 3  # hexadecimal digits of the hash: 4,096 buckets per source


def word_count(text: Column) -> Column:
    """The number of runs of anything but blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """One row per source: its size and its rank from 0 by code point, null last.

    Ranks come from ranges of sources and the ranges' counts, so no task holds all sources.
    """
    spark = sizes.sparkSession
    ranged = written(spark, sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
                     .repartitionByRange(F.col("source").asc_nulls_last())
                     .withColumn("part", F.spark_partition_id()), scratch_path(spark, "sources"))
    order = W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select(  # a row per range, not per source
        "part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"))
    return (ranged.withColumn("place", F.row_number().over(order) - 1).join(starts, "part")
            .select("source", "source_size", (F.col("start") + F.col("place")).alias("rank")))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Add `target`: shares by `weight` of the sum of all sizes, none above `max_epochs` times its size.

    One scalar per round goes to the driver. A source once clamped stays so: taking its cap out raises
    the level for the others.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        clamped = F.col("weight") * F.lit(level) > cap
        given, weight = sources.agg(
            F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        raised = (total - (given or 0)) / weight if weight else level
        if raised <= level:
            break
        level = raised
    share = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *,
        weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """How many words of each document a mix takes: doc_id, source, size, source_size, target, taken, epochs.

    Sources in code point order, null last, weigh `weights` in turn. A source's words are repeated
    whole as often as its target holds them; of the rest, documents in the order of a seeded hash are
    taken until the target is met, the one on the cut with its first words only. So the words taken of
    a source add up to its target rounded to a whole number, and no document exceeds `max_epochs` times
    its size. `epochs` is taken / size, null for documents without words, which take 0.

    Null text has size 0; a null source is a source of its own. Rows that repeat an id are documents of
    their own; which of two of equal id and size on the cut is taken makes no difference. Null ids are
    hashed as empty. An empty table, or one without words, gives targets of 0. Other columns are not
    looked at. The same rows and seed give the same mix.
    """
    spark: SparkSession = docs.sparkSession
    weight = F.lit(0)
    for place, value in enumerate(weights):
        weight = F.when(F.col("rank") % len(weights) == place, value).otherwise(weight)
    identity = quoted(doc_id).cast("string")
    sizes = written(spark, docs.select(
        quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), word_count(quoted(text)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity, F.lit("")))).alias("hash")),
        scratch_path(spark, "sizes"))
    bucket = F.substring("hash", 1, BUCKET_DIGITS)

    targets = water_fill(ranked_sources(sizes).withColumn("weight", weight), max_epochs)
    goal = F.floor(F.col("target") + 0.5).cast("long")
    plan = (targets.withColumn("goal", goal)
            .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(0))
            .withColumn("rest", F.col("goal") - F.col("whole") * F.col("source_size")))
    sums = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    before = (F.coalesce(F.sum("bucket_size").over(
        W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cut = (sums.withColumn("before", before).join(
        plan.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of")))
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bucket_size")))
        .select("of", F.col("bucket").alias("cut_bucket"), F.col("before").alias("cut_before")))
    decided = written(spark, plan.join(
        cut, plan.source.eqNullSafe(cut.of), "left").select(
            plan.source.alias("of"), "source_size", "target", "whole", "rest", "cut_bucket", "cut_before"),
        scratch_path(spark, "mix-plan"))

    rows = sizes.join(decided, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", bucket)
    here = F.col("bucket") == F.col("cut_bucket")
    outside = rows.filter(~F.coalesce(here, F.lit(False))).withColumn(
        "extra", F.when(F.col("bucket") < F.col("cut_bucket"), F.col("size")).otherwise(0))
    ordered = W.partitionBy("source").orderBy("hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("cut_before") + F.coalesce(F.sum("size").over(ordered), F.lit(0))
    inside = rows.filter(here).withColumn("ahead", ahead).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))).drop("ahead")
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    return outside.unionByName(inside).select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
        F.when(F.col("size") > 0, taken / F.col("size")).alias("epochs"))
