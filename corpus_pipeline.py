"""A training corpus from raw documents: the operators of tidewater.llm as stages over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, linededup, mixing, neardup, toxicity
from tidewater.llm.common import free_name, held_out, quoted
from tidewater.session import scratch_path, written


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not in the one column of `ids`; rows without an id stay."""
    gone = free_name(docs.columns, "gone")
    return docs.join(ids.toDF(gone), quoted("doc_id") == quoted(gone), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go, if words or labelled neighbours of theirs speak for it.

    Learns from the labels that are not held out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.scorer(docs, toxicity.learn(docs, labels, usable=~held_out(F.col("doc_id"))))
    found = free_name(docs.columns, "toxicity")
    return docs.withColumn(found, score(F.col("text"))).filter(
        ~((quoted(found)["score"] >= 0.5) & quoted(found)["shown"])).select(*map(quoted, docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more stay only in the document of smallest id that holds them."""
    lines, dropped = free_name(docs.columns, "n_lines"), free_name(docs.columns, "n_dropped")
    out = linededup.dedup_lines(docs, n_lines=lines, n_dropped=dropped)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(quoted(dropped) > 0, F.length("text")).otherwise(
            F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*map(quoted, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the smallest id stays."""
    found = neardup.near_duplicates(docs, width=5, percent=80)
    return _without(docs, written(spark, found.filter("NOT kept").select("doc_id").distinct(),
                                  scratch_path(spark, "copies")))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(docs, items)
    return _without(docs, written(spark, found.select("doc_id").distinct(), scratch_path(spark, "leaks")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, epochs."""
    return mixing.mix(docs).drop("source")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
]

#: The toxicity votes and the hashing of the line filters have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is stored in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), scratch_path(spark, name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
