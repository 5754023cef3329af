"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import in_few_files
from tidewater.session import discard, scratch_path, written


def _hash_sum(df: DataFrame) -> tuple:
    """Order-free fingerprint of a table of pairs."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _store(df: DataFrame, rows: int | None) -> tuple[DataFrame, str]:
    place = scratch_path(df.sparkSession, "stars")
    return written(df.sparkSession, df if rows is None else in_few_files(df, rows), place), place


def _hooked(edges: DataFrame, small: bool) -> DataFrame:
    """One star step. Each node sends its larger (or smaller) neighbours to the smallest it knows.

    The smallest neighbour is a partial aggregate and the join's other side has one row per node, so a
    node with very many links is split by AQE like any skewed key.
    """
    both = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a > b in small steps: b are the smaller neighbours of a.
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    joined = both.join(least, "a")
    if small:
        sent = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b")))
    else:
        sent = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return sent.filter("a <> b").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Each linked node with the smallest node of its component: node, root.

    `edges` has two columns, a and b, of one orderable type; direction, repetition and self-links don't
    matter; null ends are ignored. `rows` is about how many there are, if that is known. Every round is stored in the shared folder; the number of rounds
    grows with the logarithm of the longest chain.
    """
    current, place = _store(edges.toDF("x", "y").filter("x <> y").select(
        F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), rows)
    mark = _hash_sum(current)
    while True:
        large, large_place = _store(_hooked(current, small=False), mark[0])
        after, after_place = _store(_hooked(large, small=True), mark[0])
        discard(after.sparkSession, large_place)
        discard(after.sparkSession, place)
        current, place = after, after_place
        changed, mark = mark, _hash_sum(current)
        if changed == mark:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
