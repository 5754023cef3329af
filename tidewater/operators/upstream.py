"""What lies upstream of a dataset, from labels whose number is linear in the edges.

Storing all reachable pairs (`lineage.lineage_closure`) grows with pairs. Here each dataset that something
leads to keeps one way to an end of the graph, as the list of datasets on it (its hops). Whatever has `x`
among its hops is upstream of `x`. Edges that are on no such way are kept as they are, and a search goes on
from them; it has as many rounds as ways use such edges, not as the graph is deep. Landing objects, which
nothing leads to and most datasets are, keep their edges only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import discard, scratch_path, written


@dataclass(frozen=True)
class UpstreamIndex:
    """`ways`: node, hops (itself first). `others`: edges between nodes that are on no way. `landing`:
    edges out of nodes that nothing leads to."""

    ways: DataFrame
    others: DataFrame
    landing: DataFrame


def _clean(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops on one node and without nulls."""
    return edges.select("source", "target").filter("source <> target").distinct()


def upstream_index(edges: DataFrame) -> UpstreamIndex:
    """Index edges (`source`, `target`); null ends and loops on one node are left out.

    Ways grow backward from the nodes that lead nowhere, nearest first, a written round per step. What is
    left then leads into cycles only. There, each node that sorts ahead of all its targets starts a way; as
    every cycle has such a node, one more search reaches all. A way's list is as long as the graph is deep.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "upstream")
    links = written(spark, _clean(edges), f"{root}/links")
    nodes = links.select(F.col("target").alias("node")).distinct()
    inner = written(spark, links.join(nodes.withColumnRenamed("node", "source"), "source", "left_semi"), f"{root}/inner")
    landing = links.join(nodes.withColumnRenamed("node", "source"), "source", "left_anti")
    paths: list[str] = []

    def put(rows: DataFrame) -> DataFrame:
        paths.append(f"{root}/round-{len(paths)}")
        return written(spark, rows, paths[-1])

    def grow(frontier: DataFrame) -> DataFrame:
        while not frontier.isEmpty():
            known = spark.read.schema(frontier.schema).parquet(*paths).select("node")
            step = (inner.join(frontier.withColumnRenamed("node", "target"), "target")
                    .groupBy(F.col("source").alias("node")).agg(F.min_by("hops", "target").alias("hops"))
                    .join(known, "node", "left_anti")
                    .select("node", F.concat(F.array("node"), "hops").alias("hops")))
            frontier = put(step)
        return spark.read.schema(frontier.schema).parquet(*paths)

    alone = lambda rows: rows.select("node", F.array("node").alias("hops"))
    ends = nodes.join(inner.select(F.col("source").alias("node")), "node", "left_anti")
    ways = grow(put(alone(ends)))
    left = nodes.join(ways, "node", "left_anti")
    if not left.isEmpty():
        left = written(spark, left, f"{root}/left")
        # What leads into cycles only has targets that are left as well.
        first = (inner.join(left.withColumnRenamed("node", "source"), "source", "left_semi")
                 .groupBy(F.col("source").alias("node")).agg(F.min("target").alias("least")).filter("node < least"))
        ways = grow(put(alone(first)))
    onward = ways.filter(F.size("hops") > 1).select(F.col("node").alias("source"), F.col("hops")[1].alias("target"))
    others = written(spark, inner.join(onward, ["source", "target"], "left_anti"), f"{root}/others")
    kept = UpstreamIndex(written(spark, ways, f"{root}/ways"), others, written(spark, landing, f"{root}/landing"))
    for path in [*paths, f"{root}/links", f"{root}/inner"]:
        discard(spark, path)
    return kept


def extend_index(index: UpstreamIndex, edges: DataFrame) -> UpstreamIndex:
    """The index with further edges. Only rows for the new edges are written; labels stay as they are.

    A node that something leads to for the first time gets a way of itself alone, and its landing edges
    count as others too. Edges that were known already change no answer.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "upstream-more")
    links = written(spark, _clean(edges), f"{root}/links")
    added = written(spark, links.select(F.col("target").alias("node")).distinct().join(index.ways, "node", "left_anti"),
                    f"{root}/added")
    ways = index.ways.unionByName(added.select("node", F.array("node").alias("hops")))
    inner = ways.select(F.col("node").alias("source"))
    raised = index.landing.join(added.withColumnRenamed("node", "source"), "source", "left_semi")
    others = written(spark, links.join(inner, "source", "left_semi").unionByName(raised), f"{root}/others")
    landing = written(spark, links.join(inner, "source", "left_anti"), f"{root}/landing")
    return UpstreamIndex(ways, index.others.unionByName(others), index.landing.unionByName(landing))


def upstream(index: UpstreamIndex, asked: DataFrame) -> DataFrame:
    """`asked`, `upstream`: every dataset that leads to one of `asked.node`, but itself.

    Nodes that the index does not know have nothing upstream. Each round opens the ways through the nodes
    reached last and takes the other edges that end in what they add.
    """
    spark = asked.sparkSession
    root = scratch_path(spark, "upstream-of")
    hops = index.ways.select("node", F.explode("hops").alias("hop"))
    seeds = asked.select(F.col("node").alias("asked"), F.col("node").alias("hop")).filter("asked IS NOT NULL").distinct()
    paths: list[str] = []
    while True:
        step = seeds.join(hops, "hop").select("asked", "node").distinct()
        if paths:
            step = step.join(spark.read.schema(step.schema).parquet(*paths), ["asked", "node"], "left_anti")
        paths.append(f"{root}/round-{len(paths)}")
        fresh = written(spark, step, paths[-1])
        if fresh.isEmpty():
            break
        seeds = (fresh.withColumnRenamed("node", "target").join(index.others, "target")
                 .select("asked", F.col("source").alias("hop")).distinct())
    found = spark.read.schema(fresh.schema).parquet(*paths)
    ahead = found.withColumnRenamed("node", "target").join(index.landing, "target").select(
        "asked", F.col("source").alias("node"))
    return (found.unionByName(ahead).filter("asked <> node").distinct()
            .withColumnRenamed("node", "upstream"))
