"""Nearest vectors by inner product with collision-counting hashing.

Vectors are dealt to shards of about SHARD rows and queries to blocks of about QUERY_BLOCK; each pair of
a shard and a block is one group, so a task holds a bounded number of either. A shard's index is one
sorted array per random projection. From a query's own place a window opens in every array, and only
rows that a window meets are counted. Widening goes on from where the windows end (virtual rehashing:
nothing is hashed again, no place is read twice). A row met in a THRESHOLD share of the arrays is verified
by its true inner product. A vector at distance d is met in an array with the probability that a normal
value of deviation d lies within the window, so the k-th best verified distance says how wide the windows
must be for a vector as far as that to be met often enough with probability RECALL; there a query stops.
Nearer vectors are met more often, so the share found is larger than RECALL. Every row is indexed.

Inner product becomes distance by one more component that gives all of a shard's vectors the same norm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import prepare_python, quoted
from tidewater.session import scratch_path, written

SHARD = 8192
QUERY_BLOCK = 4096
PROJECTIONS = 128
THRESHOLD = 0.7
RATIO = 1.05
RECALL = 0.8
SEED = 11
PILOTS = 5
MAX_TASKS = 20_000


def reach(projections: int, threshold: int, recall: float) -> float:
    """Half the width of a window, in distances, at which a vector is met in `threshold` of the arrays or
    more with probability `recall`."""
    def often(p: float) -> float:
        return sum(math.exp(math.lgamma(projections + 1) - math.lgamma(i + 1) - math.lgamma(projections - i + 1)
                            + i * math.log(p) + (projections - i) * math.log1p(-p))
                   for i in range(threshold, projections + 1))

    low, high = 1e-9, 1 - 1e-9
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if often(middle) < recall else (low, middle)
    return NormalDist().inv_cdf((1 + high) / 2)


def random_axes(dims: int, least: int, seed: int) -> np.ndarray:
    """At least `least` axes as columns, in whole orthogonal bases, whose lengths are those of normal vectors:
    each axis is like a random normal vector, and those of a basis repeat nothing of one another."""
    rng = np.random.default_rng(seed)
    bases = []
    for _ in range(math.ceil(least / dims)):
        basis, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        bases.append(basis * np.linalg.norm(rng.standard_normal((dims, dims)), axis=0))
    return np.concatenate(bases, axis=1)


class CollisionIndex:
    """Sorted projections of one shard's vectors (rows of `vectors`), with the rows in that order."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, threshold: float = THRESHOLD,
                 recall: float = RECALL, seed: int = SEED):
        self.vectors = vectors
        count = len(vectors)
        # The longest gets norm 1, in two steps, so that squares of very large components do not overflow.
        self.scale = float(np.abs(vectors).max())
        scaled = vectors / self.scale
        self.norm = math.sqrt(np.einsum("ij,ij->i", scaled, scaled).max())
        scaled /= self.norm
        lift = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", scaled, scaled), 0.0))
        self.axes = random_axes(vectors.shape[1] + 1, projections, seed)
        projections = self.axes.shape[1]
        projected = (scaled @ self.axes[:-1] + lift[:, None] * self.axes[-1]).T
        order = np.argsort(projected, axis=1, kind="stable")
        # All arrays lie one behind another, so that one search finds the places in each.
        span = 2 * float(np.abs(self.axes).sum(axis=0).max()) + 1
        self.starts = np.arange(projections) * count
        self.offsets = np.arange(projections) * 2 * span
        self.places = (np.take_along_axis(projected, order, axis=1) + self.offsets[:, None]).ravel()
        self.order = order.ravel()
        self.enough = math.ceil(threshold * projections)
        self.reach = reach(projections, self.enough, recall)
        self.first_width = 0.05 * float(projected.std()) or 1e-9
        self.met = self.verified = 0  # places read and rows verified so far, for reports

    def walk(self, query: np.ndarray, own: np.ndarray, k: int, level: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows verified for a query, without those marked as its own, their inner products, and the last level."""
        count, scale = len(self.vectors), float(np.abs(query).max())
        length = math.sqrt((query / scale) @ (query / scale))
        centres = (query / scale / length) @ self.axes[:-1] + self.offsets
        low = high = np.clip(np.searchsorted(self.places, centres), self.starts, self.starts + count)
        times, waiting = np.zeros(count, np.int64), ~own
        rows, scores = [], np.empty(0)
        while True:
            width = self.first_width * RATIO ** level
            wide = np.searchsorted(self.places, np.concatenate([centres - width, centres + width]))
            lower = np.minimum(np.maximum(wide[:len(centres)], self.starts), low)
            higher = np.maximum(np.minimum(wide[len(centres):], self.starts + count), high)
            edges = zip(lower.tolist(), low.tolist(), high.tolist(), higher.tolist())
            met = np.concatenate([self.order[a:b] for l0, l1, h0, h1 in edges for a, b in ((l0, l1), (h0, h1)) if a < b]
                                 or [self.order[:0]])
            times += np.bincount(met, minlength=count)
            low, high = lower, higher
            fresh = np.flatnonzero(waiting & (times >= self.enough))
            waiting[fresh] = False
            rows.append(fresh)
            scores = np.concatenate([scores, np.einsum("ij,j->i", self.vectors[fresh], query)])
            self.met += len(met)
            if len(scores) >= k:
                worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                cosine = worst / scale / self.scale / (length * self.norm)
                if np.isfinite(worst) and width >= self.reach * math.sqrt(max(2 - 2 * cosine, 0.0)):
                    break
            if not waiting.any():
                break
            level += 1
        self.verified += len(scores)
        return np.concatenate(rows), scores, level

    def nearest(self, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[
            tuple[int, np.ndarray, np.ndarray]]:
        """For each query the k best ids other than its own, with their inner products, ties to smaller ids.

        The first queries start with narrow windows; the others a step ahead of where most of these ended.
        """
        levels = []
        for query, (vector, name) in enumerate(zip(queries, own)):
            start = max(sorted(levels)[PILOTS // 2] - 1, 0) if len(levels) >= PILOTS else 0
            rows, scores, level = self.walk(vector, ids == name, k, start)
            if len(levels) < PILOTS:
                levels.append(level)
            best = np.lexsort((ids[rows], -scores))[:k]
            yield query, ids[rows[best]], scores[best]


def _search(k: int, recall: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group["asks"].to_numpy(zero_copy_only=False).astype(bool)
        ids = group["id"].to_numpy()
        vectors = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        asks, ids, vectors = asks[order], ids[order], vectors[order]
        found = [[], [], []]
        if (~asks).any():
            index, own = CollisionIndex(vectors[~asks], recall=recall), ids[asks]
            for query, near, scores in index.nearest(ids[~asks], vectors[asks], own, k):
                found[0].append(np.full(len(near), own[query]))
                found[1].append(near)
                found[2].append(scores)
        columns = [np.concatenate(x) if x else np.empty(0) for x in found]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()),
                         "score": pa.array(columns[2], pa.float64())})
    return run


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, vector in double precision: without null ids, null, empty or zero vectors, or vectors with a
    null or non-finite component; of rows that repeat an id, the vector that sorts first."""
    wide = vectors.select(quoted(vec_id).cast("long").alias("id"),
                          quoted(embedding).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return (wide.filter(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
            .groupBy("id").agg(F.min("vector").alias("vector")))


def nearest(vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", *, k: int = 20,
            shard: int = SHARD, query_block: int = QUERY_BLOCK, recall: float = RECALL) -> DataFrame:
    """The k nearest rows of every query: query_id, rank from 1, vec_id, score.

    Queries are the rows of `vectors` whose id, as a column, fulfils `is_query`; candidates are all rows
    of the same number of components but the query's own id. Nearness is the inner product in double
    precision, ties to smaller ids; all candidates come back where there are fewer than k. Null, zero and
    non-finite vectors and rows without an id take no part; rows that repeat an id count once. An empty
    table gives an empty one; other columns are not looked at.
    """
    spark = vectors.sparkSession
    prepare_python(spark)
    rows = written(spark, usable(vectors, vec_id, embedding).withColumn("dims", F.size("vector")),
                   scratch_path(spark, "vectors"))
    asked = F.coalesce(is_query(F.col("id")), F.lit(False))
    sizes = rows.groupBy("dims").agg(  # a row per number of components
        F.greatest(F.ceil(F.count("*") / shard), F.lit(1)).cast("int").alias("shards"),
        F.greatest(F.ceil(F.sum(asked.cast("long")) / query_block), F.lit(1)).cast("int").alias("blocks"))
    groups = sizes.agg(F.sum(F.col("shards").cast("long") * F.col("blocks"))).first()[0] or 1
    sized = rows.join(sizes, "dims")
    hashed = F.xxhash64(F.lit(SEED), "id")
    indexed = sized.select(
        "dims", F.pmod(hashed, "shards").cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), "id", "vector")
    asking = sized.filter(asked).select(
        "dims", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(hashed, "blocks").cast("int").alias("block"), F.lit(True).alias("asks"), "id", "vector")
    # Groups are few and cost much more time than bytes, so they are dealt out by number and not by size.
    found = indexed.union(asking).repartition(min(groups, MAX_TASKS), "dims", "shard", "block").groupBy(
        "dims", "shard", "block").applyInArrow(
        _search(k, recall), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
