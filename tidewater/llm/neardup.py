"""Near-duplicates by a chosen-path set similarity join.

Each text becomes its set of word shingles and a signature of SIGNATURE minwise tokens. Texts of equal
sets are one node from then on. In each of several independent trees a node goes down a path: at every
branch the tree and the path so far choose one signature position, and the token there names the child
branch. Two sets of similarity s stay together with probability s per level; all paths start FIRST_LEVEL
levels deep, where unlike texts hardly meet. Branches of up to `LEAF` nodes are compared exhaustively,
larger ones branch again down to LAST_LEVEL. There are as many trees as it takes for two sets just at the
threshold to stay together down to LAST_LEVEL in one of them with probability `recall`; most pairs need
not go that far, and links within a group are found by way of its other members too.

A group of near copies stays together on any path, so comparing all its pairs, or branching until it is
small, would cost the square of its size. Links are therefore found in two passes:

1. `STAR_TREES` trees, every branch on the way down: each node is paired with the branch's pivot, one
   pair per node. Links confirmed on the full sets give components.
2. All trees: a branch whose nodes are all in one component by now is done. In the others the nodes
   outside the largest component are compared with all. A branch still large at LAST_LEVEL is compared
   block against block, each in a task of its own, which leaves out nothing. First signatures only are
   compared, and nodes that have a likely partner in another component are kept; then these meet again
   with their full sets. Pairs of one component are passed over, and only confirmed links leave a task.

Pairs whose signatures agree too little to reach the threshold (by more than four standard deviations)
are not compared further; all links are confirmed on the full sets, which are made again from the texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import in_few_files, mixed, prepare_python, quoted, shingle_set, texts
from tidewater.llm.components import components
from tidewater.session import discard, scratch_path, written

SIGNATURE = 128
RECALL = 0.9998
STAR_TREES = 3
FIRST_LEVEL, LAST_LEVEL = 2, 4
LEAF = 64
BLOCK = 256
BROADCAST_ROWS = 500_000  # of an id and a 16-byte key

_RANDOM = np.random.default_rng(20240607)
_FACTORS = (_RANDOM.integers(0, 1 << 31, SIGNATURE, np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, SIGNATURE, np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of SIGNATURE hash functions, its upper 16 bits."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for start in range(0, len(low), 2048):
            part = low[start:start + 2048]
            values = part[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]
            values ^= values >> np.uint32(15)
            values *= np.uint32(0x2C1B3C6D)
            least = np.minimum(least, values.min(axis=1))
    # Small values differ in their low bits, so they are mixed before they are cut to 16 bits.
    with np.errstate(over="ignore"):
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, signatures = [], [], []
            for text in texts(batch.column(1)):
                hashes = shingle_set(text, width)
                sizes.append(len(hashes))
                keys.append(set_key(hashes) if len(hashes) else None)
                signatures.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                                   pa.array(signatures, pa.binary())], names=["doc", "size", "node", "signature"])
    return run


def _branch(trees: np.ndarray, paths: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """The child branch of each row: its path, the position that the path chooses, and the token there."""
    chosen = (mixed(paths ^ (trees.astype(np.uint64) << np.uint64(48))) % np.uint64(SIGNATURE)).astype(np.int64)
    token = signatures[np.arange(len(paths)), chosen].astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(paths * np.uint64(0x9E3779B97F4A7C15) + (token << np.uint64(8))
                     + chosen.astype(np.uint64) + np.uint64(1))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SIGNATURE)


def _roots(trees: range):
    """Rows (tree, path, node) at FIRST_LEVEL of each tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signatures, count = _matrix(batch.column(1)), batch.num_rows
            tree = np.repeat(np.array(list(trees), np.int32), count)
            path = (tree.astype(np.uint64) + np.uint64(1)) * np.uint64(0x1000193)
            for _ in range(FIRST_LEVEL):
                path = _branch(tree, path, np.tile(signatures, (len(trees), 1)))
            yield pa.record_batch([pa.array(tree), pa.array(path.view(np.int64)),
                                   batch.column(0).take(pa.array(np.tile(np.arange(count), len(trees))))],
                                  names=["tree", "path", "node"])
    return run


def _next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            tree = batch.column(0).to_numpy()
            path = _branch(tree, batch.column(1).to_numpy().view(np.uint64), _matrix(batch.column(3)))
            yield pa.record_batch([batch.column(0), pa.array(path.view(np.int64)), batch.column(2)],
                                  names=["tree", "path", "node"])


def trees_for(percent: int, recall: float) -> int:
    """How many trees keep a pair at the threshold together in one of them with probability `recall`."""
    together = (percent / 100) ** LAST_LEVEL
    return max(STAR_TREES, math.ceil(math.log(1 - recall) / math.log(1 - together))) if together < 1 else STAR_TREES


def _close_enough(threshold: float):
    """How many signature positions must agree, and the least ratio of sizes."""
    spread = math.sqrt(threshold * (1 - threshold) / SIGNATURE)
    return math.floor((threshold - 4 * spread) * SIGNATURE)


def _similar_stars(least: int, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            agree = (_matrix(batch.column(2)) == _matrix(batch.column(5))).sum(axis=1)
            one, two = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            keep = (agree >= least) & (np.minimum(one, two) >= ratio * np.maximum(one, two) - 1e-9)
            chosen = pa.array(np.flatnonzero(keep))
            yield pa.record_batch([batch.column(0).take(chosen), batch.column(3).take(chosen)], names=["a", "b"])
    return run


class _Group:
    """One branch's rows, or two blocks of them: (block, node, root, size, signature, set)."""

    def __init__(self, rows: list[tuple], crossing: bool, least: int, ratio: float):
        self.rows, self.crossing, self.least, self.ratio = rows, crossing, least, ratio
        self.blocks, self.sizes = (np.array([row[i] for row in rows], np.int64) for i in (0, 3))
        names = {root: number for number, root in enumerate({row[2] for row in rows})}
        self.roots = np.array([names[row[2]] for row in rows])
        self.signatures = np.frombuffer(b"".join(row[4] for row in rows), np.uint16).reshape(-1, SIGNATURE)

    def likely(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Every row outside the largest component that has likely partners in others, these, and in how
        many positions they agree. Pairs within one block belong to another group of the branch."""
        common = Counter(self.roots.tolist()).most_common(1)[0][0]
        others = np.flatnonzero(self.roots != common)
        for start in range(0, len(others), 64):
            left = others[start:start + 64]
            agree = np.zeros((len(left), len(self.rows)), np.int16)
            for position in range(0, SIGNATURE, 16):
                part = slice(position, position + 16)
                agree += (self.signatures[left][:, None, part] == self.signatures[None, :, part]).sum(axis=2, dtype=np.int16)
            sizes = self.sizes[left][:, None]
            fits = (agree >= self.least) & (self.roots[left][:, None] != self.roots) & (
                np.minimum(sizes, self.sizes) >= self.ratio * np.maximum(sizes, self.sizes) - 1e-9)
            if self.crossing:
                fits &= self.blocks[left][:, None] != self.blocks
            for place, row in enumerate(left):
                found = np.flatnonzero(fits[place])
                if len(found):
                    yield int(row), found, agree[place, found]

    def promising(self) -> list[int]:
        rows: set[int] = set()
        for row, found, _ in self.likely():
            rows.update(found.tolist(), (row,))
        return sorted(rows)

    def links(self, percent: int) -> tuple[list, list]:
        """Confirmed links, no more than it takes to join the components that they join."""
        above = list(range(self.roots.max() + 1))

        def top(root: int) -> int:
            while above[root] != root:
                above[root] = root = above[above[root]]
            return root

        one, two = [], []
        for row, found, agree in self.likely():
            for other in found[np.argsort(-agree, kind="stable")]:
                a, b = top(self.roots[row]), top(self.roots[other])
                if a != b and _linked(self.rows[row][5], self.rows[other][5], percent):
                    above[a] = b
                    one.append(self.rows[row][1])
                    two.append(self.rows[other][1])
        return one, two


def _linked(one: bytes, two: bytes, percent: int) -> bool:
    one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    both = len(one) + len(two) - len(np.union1d(one, two))
    return 100 * both >= percent * (len(one) + len(two) - both)


_KEY = ("tree", "path", "low", "high")


def _by_group(compare):
    """Apply `compare` to each group of more than one row; rows come sorted by their four key columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            for *key, row in zip(*(c.to_pylist() for c in batch.columns[:4]),
                                 zip(*(c.to_pylist() for c in batch.columns[4:]))):
                if key != last:
                    if len(held) > 1:
                        yield compare(last, held)
                    held, last = [], key
                held.append(row)
        if len(held) > 1:
            yield compare(last, held)
    return run


def _promising(least: int, ratio: float):
    def compare(key: list, rows: list[tuple]) -> pa.RecordBatch:
        chosen = [rows[i] for i in _Group(rows, key[2] != key[3], least, ratio).promising()]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
        return pa.record_batch(
            [pa.array([part] * len(chosen), kind) for part, kind in zip(key, (pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
            + [pa.array([row[i] for row in chosen], kind) for i, kind in enumerate(kinds)],
            names=[*_KEY, "block", "node", "root", "size", "signature"])
    return _by_group(compare)


def _links(least: int, ratio: float, percent: int):
    def compare(key: list, rows: list[tuple]) -> pa.RecordBatch:
        a, b = _Group(rows, key[2] != key[3], least, ratio).links(percent)
        return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
    return _by_group(compare)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                hashes = shingle_set(text, width)
                if len(hashes) and set_key(hashes) == node:
                    nodes.append(node)
                    sets.append(hashes.tobytes())
            yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "set"])
    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(a, b) for a, b, one, two in zip(*(c.to_pylist() for c in batch.columns)) if _linked(one, two, percent)]
            yield pa.record_batch([pa.array([a for a, _ in held], pa.binary()), pa.array([b for _, b in held], pa.binary())],
                                  names=["a", "b"])
    return run


class _Join:
    """The steps of one run, which share its tables and parameters."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int, trees: int, repeated: bool):
        self.trees, self.count = trees, nodes.count()
        self.spark, self.docs, self.nodes, self.repeated = docs.sparkSession, docs, nodes, repeated
        self.width, self.percent = width, percent
        self.least, self.ratio = _close_enough(percent / 100), percent / 100

    def store(self, df: DataFrame, label: str) -> DataFrame:
        return written(self.spark, in_few_files(df, self.trees * self.count), scratch_path(self.spark, label))

    def first_level(self, trees: range) -> DataFrame:
        return self.nodes.select("node", "signature").mapInArrow(
            _roots(trees), "tree int, path long, node binary")

    def deeper(self, rows: DataFrame) -> DataFrame:
        return rows.select("tree", "path", "node", "signature").mapInArrow(
            _next_level, "tree int, path long, node binary")

    def crowded(self, rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        """The rows of branches with two nodes or more (of different components), signed, with the branch's
        number of nodes and its pivot. One row per branch comes from a partial aggregate, and only rows
        whose branch stays meet the signatures."""
        if labels is not None:
            rows = rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        first = F.min(F.struct(F.xxhash64("tree", "path", "node").alias("order"), "node")).alias("pivot")
        if labels is None:
            counts = rows.groupBy("tree", "path").agg(F.count("*").alias("members"), first).filter("members > 1").select(
                "tree", "path", "members", F.col("pivot.node").alias("pivot"))
        else:
            counts = rows.groupBy("tree", "path", "root").agg(F.count("*").alias("n"), first).groupBy("tree", "path").agg(
                F.sum("n").alias("members"), F.min("pivot").alias("pivot"), F.count("*").alias("roots"),
                F.max(F.struct("n", "root")).alias("most")).filter("roots > 1").select(
                "tree", "path", "members", F.col("pivot.node").alias("pivot"), F.col("most.root").alias("largest"),
                (F.col("members") - F.col("most.n")).alias("outsiders"))
        # Stored ahead of the join: an aggregate that feeds a join keeps Spark from splitting a hot branch there.
        counts = self.store(counts, "branch-counts")
        kept = rows.join(counts, ["tree", "path"])
        return kept.join(self.nodes.select("node", "size", "signature"), "node")

    def star_pairs(self, rows: DataFrame) -> DataFrame:
        pivots = self.nodes.select(F.col("node").alias("pivot"), F.col("size").alias("pivot_size"),
                                   F.col("signature").alias("pivot_signature"))
        return (rows.filter("node <> pivot").select("node", "size", "signature", "pivot").join(pivots, "pivot")
                .select("node", "size", "signature", "pivot", "pivot_size", "pivot_signature")
                .mapInArrow(_similar_stars(self.least, self.ratio), "a binary, b binary"))

    def promising(self, rows: DataFrame) -> DataFrame:
        """The nodes with a likely partner in another component, by group. A branch of over BLOCK nodes is
        cut into blocks by hash, those outside of its largest component first, and each pair of blocks with an outer
        one is a group. So no task holds a whole branch, and the largest component meets the outsiders only."""
        whole, outer = F.col("members") <= BLOCK, F.col("root") != F.col("largest")
        outers = F.ceil(F.col("outsiders") / BLOCK).cast("int")
        inners = F.ceil((F.col("members") - F.col("outsiders")) / BLOCK).cast("int")
        among = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
        dealt = rows.withColumn("block", F.when(whole, 0).when(outer, among(outers)).otherwise(outers + among(inners))).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.when(whole, 0).when(outer, outers + inners - 1).otherwise(outers - 1))))
        return (dealt.select("tree", "path", F.least("block", "other").alias("low"),
                             F.greatest("block", "other").alias("high"), "block", "node", "root", "size", "signature")
                .repartition(*_KEY).sortWithinPartitions(*_KEY)
                .mapInArrow(_promising(self.least, self.ratio),
                            "tree int, path long, low int, high int, block int, node binary, root binary, "
                            "size long, signature binary"))

    def sets(self, wanted: DataFrame) -> tuple[DataFrame, str]:
        """The full sets of the nodes in `wanted`, made from the text that each stands for."""
        named = self.store(wanted.distinct().join(self.nodes.select("node", "doc"), "node").select("node", "doc"), "wanted")
        place = scratch_path(self.spark, "sets")
        # While the wanted rows are few enough to send everywhere, texts are not shuffled for them.
        small = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
        made = self.docs.join(small, "doc").select("node", "text").mapInArrow(
            _sets(self.width), "node binary, set binary")
        made = made.dropDuplicates(["node"]) if self.repeated else made
        return written(self.spark, in_few_files(made, self.count, 20_000), place), place

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets reach the threshold."""
        pairs = self.store(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                           "pairs")
        sets, place = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        one, two = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
        links = self.store(pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(
            _confirmed(self.percent), "a binary, b binary"), "links")
        discard(self.spark, place)
        return links

    def stars(self) -> DataFrame:
        """First pass: links with the pivots of every branch, level by level."""
        found: DataFrame | None = None
        rows = self.first_level(range(STAR_TREES))
        for _ in range(FIRST_LEVEL, LAST_LEVEL + 1):
            crowded = self.store(self.crowded(rows, None), "branches")
            pairs = self.star_pairs(crowded)
            found = pairs if found is None else found.union(pairs)
            rows = self.deeper(crowded.filter(F.col("members") > LEAF))
        return self.confirm(found)

    def leaves(self, labels: DataFrame) -> DataFrame:
        """Second pass: links across components, in branches small enough to compare all."""
        found: DataFrame | None = None
        rows = self.first_level(range(self.trees))
        for level in range(FIRST_LEVEL, LAST_LEVEL + 1):
            crowded = self.store(self.crowded(rows, labels), "branches")
            large = crowded.filter(F.col("members") > LEAF)
            last = level == LAST_LEVEL or large.isEmpty()
            likely = self.promising(crowded if last else crowded.filter(F.col("members") <= LEAF))
            found = likely if found is None else found.union(likely)
            if last:
                break
            rows = self.deeper(large)
        found = self.store(found, "likely")
        sets, place = self.sets(found.select("node"))
        links = self.store(
            found.join(sets, "node").select(*_KEY, "block", "node", "root", "size", "signature", "set")
            .repartition(*_KEY).sortWithinPartitions(*_KEY)
            .mapInArrow(_links(self.least, self.ratio, self.percent), "a binary, b binary").distinct(), "links")
        discard(self.spark, place)
        return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = 5,
                    percent: int = 80, recall: float = RECALL) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but blanks with A-Z lower-cased; a document's set is that of its distinct
    shingles of `width` words, the whole sequence where it has fewer. Documents link where 100 times the
    intersection's size is at least `percent` times the union's. `component_id` is the smallest doc_id
    reachable over links, itself included, and `kept` says whether it is the row's own.

    Null, empty and wordless texts have an empty set and link with nothing. Rows without an id take no
    part: they have no component and are kept. Rows that repeat an id take part one by one. Empty tables
    give empty ones; other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(quoted(doc_id).alias("doc"), quoted(text).alias("text"))
    signed = written(spark, named.mapInArrow(
        _signed(width), f"doc {kind}, size long, node binary, signature binary"), scratch_path(spark, "signed"))
    present = signed.filter("node IS NOT NULL AND doc IS NOT NULL")
    members = present.groupBy("node").agg(F.min("doc").alias("doc"))
    nodes = written(spark, in_few_files(present.join(members, ["node", "doc"]).dropDuplicates(["node"]).select(
        "node", "doc", "size", "signature"), signed.count()), scratch_path(spark, "nodes"))

    repeated = not present.groupBy("doc", "node").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    join = _Join(named, nodes, width, percent, trees_for(percent, recall), repeated)
    links = join.stars()
    labels = join.store(components(links, join.count), "labels")
    links = links.union(join.leaves(labels))
    rooted = components(links, join.count)
    least = rooted.join(nodes.select("node", "doc"), "node").groupBy("root").agg(F.min("doc").alias("component"))
    component = join.store(rooted.join(least, "root").select("node", "component"), "components")
    own = nodes.select("node", F.col("doc").alias("own")).join(component, "node", "left").select(
        "node", F.coalesce("component", "own").alias("component"))
    found = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return signed.select("doc", "size", "node").join(own, "node", "left").select(
        F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), found.alias("component_id"),
        F.coalesce(F.col("doc") == found, F.lit(True)).alias("kept"))
