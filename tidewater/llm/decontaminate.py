"""Benchmark items inside documents: size-partitioned MinHash containment search, then an exact check.

DataFrame functions only. Items are partitioned by the power of two of their number of shingles. An
item's sketch is the b smallest hashes of its shingles; with `a` the largest number of shingles that a
document may lack, b = a + 3, so a document that holds the item shares at least three sketched
shingles, or all that the item has if it has fewer: the sketch loses nothing. A size partition's
threshold is the largest hash in its items' sketches; a document keeps only hashes up to the largest
threshold among partitions small enough to fit into it. The kept hashes meet the sketches in an equi-join.
Pairs that share enough of a sketch are checked on the shingles themselves.

An item of fewer words than a shingle is looked for as a run of just its words. Only numbers of words that such
items have are looked at, so this costs nothing where there are none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import quoted
from tidewater.session import scratch_path, written

WIDTH = 5
THRESHOLD = 0.8
EXTRA = 3


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    Catalyst writes a projected expression out wherever it is used, also inside a lambda that runs for
    each element, when it moves filters down; it doesn't move them below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _windows(column: str, width: int, one, short: Column) -> Column:
    """An array over all runs of `width` neighbours; `short` where there are fewer."""
    size = F.size(column)
    return F.when(size >= width, F.transform(F.sequence(F.lit(0), size - width), one)).when(
        size > 0, F.array(short)).otherwise(F.expr("array()"))


def with_hashes(df: DataFrame, width: int) -> DataFrame:
    """Add `shingles`, the distinct 64-bit hashes of runs of `width` words, from the column `words`."""
    hashed = computed(df, "hashed", F.transform("words", lambda w: F.xxhash64(w)))
    return computed(hashed, "shingles", F.array_distinct(_windows(
        "hashed", width, lambda i: F.xxhash64(*[F.get(F.col("hashed"), i + k) for k in range(width)]),
        F.xxhash64("hashed")))).drop("hashed")


def with_texts(df: DataFrame, width: int) -> DataFrame:
    """Add `spelled`, the distinct runs of `width` words themselves."""
    return computed(df, "spelled", F.array_distinct(_windows(
        "words", width, lambda i: F.array_join(F.slice("words", i + 1, F.lit(width)), " "),
        F.array_join("words", " "))))


def _short(worded: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """Pairs of a document and an item of as few words as `sizes` that stands in it, compared word for word."""
    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, F.lit(n)), " "))
        return F.when(F.size("words") >= n, found).otherwise(F.array().cast("array<string>"))

    held = computed(worded, "runs", F.array_distinct(F.concat(*map(runs, sizes)))).select("doc_id", F.explode("runs").alias("run"))
    wanted = items.select("item_id", F.element_at("spelled", 1).alias("run"))
    return held.join(wanted, "run").select("doc_id", "item_id", F.lit(1).alias("shared"), F.lit(1).alias("n"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", *, width: int = WIDTH,
                 threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item of which it holds at least `threshold` of the shingles.

    Gives doc_id, item_id, item_shingles, shared, containment. Words are lower-cased runs of letters
    and digits; a shingle is `width` of them. An item of fewer words is one shingle of them all, which a
    document holds that has them one after the other anywhere. Null, empty and wordless texts hold
    nothing and are held by nothing. Rows without a doc_id or item_id are not reported. Of rows that
    repeat an id, the one that holds (or is held) most counts. Empty tables give no pairs. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    item = computed(items.filter(quoted(item_id).isNotNull()).select(
        quoted(item_id).alias("item_id"), quoted(item_text).alias("text")), "words", words(F.col("text")))
    item = item.select("item_id", "words").distinct()
    lacking = F.floor(F.col("n") * (1 - threshold) + 1e-9)
    item = with_texts(with_hashes(item.filter(F.size("words") > 0), width), width)
    item = (item.withColumn("n", F.size("shingles")).withColumn("needed", F.col("n") - lacking)
            .withColumn("partition", F.floor(F.log2("n")).cast("int"))
            .withColumn("sketch", F.slice(F.array_sort("shingles"), F.lit(1), (lacking + EXTRA).cast("int")))
            .withColumn("matches", F.least(F.lit(EXTRA), F.col("needed")))
            .withColumn("short", F.when(F.size("words") < width, F.size("words")))
            .withColumn("item", F.monotonically_increasing_id()))
    item = written(spark, item.select("item", "item_id", "n", "needed", "partition", "sketch", "matches", "spelled", "short"),
                   scratch_path(spark, "items"))
    # A row per power of two, 31 at most, and one per number of words below the width.
    partitions = item.groupBy("partition", "short").agg(
        F.min("needed").alias("needed"), F.max(F.element_at("sketch", -1)).alias("highest")).collect()
    limit = F.lit(None).cast("long")
    highest = None
    for row in sorted((r for r in partitions if r["short"] is None), key=lambda r: r["needed"]):
        highest = row["highest"] if highest is None else max(highest, row["highest"])
        limit = F.when(F.col("size") >= row["needed"], highest).otherwise(limit)

    named = docs.filter(quoted(doc_id).isNotNull()).select(
        quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    worded = computed(named, "words", words(F.col("text"))).select("doc_id", "words")
    sized = computed(with_hashes(worded, width), "size", F.size("shingles"))
    kept = computed(sized, "limit", limit).select("doc_id", "size", F.explode(
        F.filter("shingles", lambda h: h <= F.col("limit"))).alias("hash"))
    sketches = item.filter("short IS NULL").select("item", "needed", "matches", F.explode("sketch").alias("hash"))
    pairs = written(spark, kept.join(sketches, "hash").filter("size >= needed")
                    .groupBy("doc_id", "item").agg(F.count("*").alias("found"), F.first("matches").alias("matches"))
                    .filter("found >= matches").select("doc_id", "item"), scratch_path(spark, "pairs"))
    paired = computed(named.join(pairs.select("doc_id").distinct(), "doc_id"), "words", words(F.col("text")))
    spelled = with_texts(paired.select("doc_id", "words"), width).select("doc_id", F.col("spelled").alias("held"))
    shared = F.size(F.array_intersect("held", "spelled"))
    checked = (pairs.join(item, "item").join(spelled, "doc_id").withColumn("shared", shared)
               .filter(F.col("shared") >= F.col("needed")).select("doc_id", "item_id", "shared", "n"))
    sizes = sorted(r["short"] for r in partitions if r["short"] is not None)
    if sizes:
        checked = checked.unionByName(_short(worded, item.filter("short IS NOT NULL"), sizes))
    checked = checked.groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("shared") / F.col("n")).alias("containment"), "shared", "n")).alias("best"))
    return checked.select(
        "doc_id", "item_id", F.col("best.n").cast("long").alias("item_shingles"),
        F.col("best.shared").cast("long").alias("shared"), F.col("best.containment").alias("containment"))


def needed_shingles(n: int, threshold: float = THRESHOLD) -> int:
    """How many of an item's n shingles a document must hold."""
    return n - math.floor(n * (1 - threshold) + 1e-9)
