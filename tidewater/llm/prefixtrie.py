"""A trie of conversations that share heads, by composable fingerprints.

Conversation c takes its first h turns from the head of conversation c - c % `group` and goes on with its own turns
after its first h. No rebuilt text is made. A turn is known by its reference, the SHA-256 of its role and text, under
which it is the same turn wherever it is stored. A sequence of turns is an affine map v -> v * B**n + s modulo the
prime 2**127 - 1, and sequences compose as these maps do. Each conversation's own prefixes are products of its own
turns, which a pass over the turns in order makes once. A prefix of a rebuilt one is the base's head composed with
own suffix, whose product is the own prefix with the own head divided out: three stored values, whatever the length.

Turns are ordered over all tasks by ranges of (conversation, turn), so one conversation may fill many tasks: tasks start
from the neutral element, and what they take over from the tasks before is composed to it afterwards (a row or
two per task reach the driver). Members of a node, one per conversation and depth, are counted map-side by depth and
fingerprint. Equality is verified on the stored references: all members of a node must end in the same turn,
and a node's fingerprint gives its parent's, so by induction from the root all turns agree. Should a collision ever
break this, all is made anew with another B.

Sums over subtrees concern only nodes of two members or more: below a node of one member there is one leaf and
nothing is saved. They are made by doubling: in round k every node adds its sum to its ancestor 2**k above, so
there are as many rounds as the depth of the deepest shared node has bits. The ids of the conversations that end
in a node are joined to texts of CHUNK ids by ranges before one task per node takes the SHA-256 of these texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import prepare_python, quoted
from tidewater.session import discard, scratch_path, written

P = (1 << 127) - 1
GROUP, HEADS = 20, 4
CHUNK = 8192
WORDS = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = bytes(16)


def base_of(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(b"turns %d" % seed).digest()[:16], "big") % P


def turn_value(reference: bytes) -> int:
    return int.from_bytes(reference[:16], "big") % P


def _read(value: bytes) -> int:
    return int.from_bytes(value, "big")


def _bytes(value: int) -> bytes:
    return value.to_bytes(16, "big")


class Powers(dict):
    """Powers of B, remembered up to a bound."""

    def __init__(self, base: int):
        self.base = base

    def __missing__(self, exponent: int) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        self[exponent] = value = pow(self.base, exponent, P)
        return value


def compose(first: int, second: int, length: int, powers: Powers) -> int:
    """The product of two sequences, the second of `length` turns."""
    return (first * powers[length] + second) % P


def divided(whole: int, head: int, length: int, powers: Powers) -> int:
    """The product of the last `length` turns of a sequence whose turns before them have the product `head`."""
    return (whole - head * powers[length]) % P


def parent_value(whole: int, reference: bytes, inverse: int) -> int:
    """The product of a sequence without its last turn."""
    return (whole - turn_value(reference)) * inverse % P


def _own_prefixes(base: int):
    """Each turn's place and product within its task, and what the first and last conversation come to (words -1)."""
    names = ["task", "conv", "pos", "value", "turn", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, pos, value, first = TaskContext.get().partitionId(), None, 0, 0, None
        for batch in batches:
            places, values = [], []
            for conv, reference in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if conv != now:
                    if now is not None and first is None:
                        first = now, pos, value
                    now, pos, value = conv, 0, 0
                pos, value = pos + 1, (value * base + turn_value(reference)) % P
                places.append(pos)
                values.append(_bytes(value))
            yield pa.record_batch([pa.array([task] * len(places), pa.int32()), batch.column(0), pa.array(places, pa.int64()),
                                   pa.array(values, pa.binary()), batch.column(1), batch.column(2)], names=names)
        for conv, n, product in ([first] if first else []) + ([(now, pos, value)] if now is not None else []):
            yield pa.record_batch([pa.array([task], pa.int32()), pa.array([conv], pa.int64()), pa.array([n], pa.int64()),
                                   pa.array([_bytes(product)], pa.binary()), pa.array([None], pa.binary()),
                                   pa.array([-1], pa.int32())], names=names)
    return run


def _carried(ends: list, powers: Powers) -> dict[int, tuple[int, int, int]]:
    """What each task's first conversation takes over: {task: (conversation, turns, product)}."""
    tasks: dict[int, list] = {}
    for r in sorted(ends, key=lambda r: (r["task"], r["conv"])):
        tasks.setdefault(r["task"], []).append((r["conv"], r["pos"], _read(bytes(r["value"]))))
    out, held = {}, None
    for task, found in tasks.items():
        conv, n, product = found[-1]
        if held and held[0] == found[0][0]:
            out[task] = held
            if conv == held[0]:
                n, product = held[1] + n, compose(held[2], product, n, powers)
        held = conv, n, product
    return out


def own_prefixes(turns: DataFrame, base: int, path: str) -> DataFrame:
    """conv, pos (from 1), value (product of the conversation's own first pos turns), turn, words; stored at `path`."""
    spark = turns.sparkSession
    ordered = turns.repartitionByRange(F.col("conv"), F.col("place").asc_nulls_first(), F.col("turn")).sortWithinPartitions(
        "conv", F.col("place").asc_nulls_first(), "turn")
    stored = written(spark, ordered.select("conv", "turn", "words").mapInArrow(
        _own_prefixes(base), "task int, conv long, pos long, value binary, turn binary, words int"), path)
    carried = _carried(stored.filter("words < 0").select("task", "conv", "pos", "value").collect(), Powers(base))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(base)
        for batch in batches:
            places, values = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, (task, conv) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                before = carried.get(task)
                if before and before[0] == conv:
                    values[i] = _bytes(compose(before[2], _read(values[i]), places[i], powers))
                    places[i] += before[1]
            yield pa.record_batch([batch.column(1), pa.array(places, pa.int64()), pa.array(values, pa.binary()),
                                   batch.column(4), batch.column(5)], names=["conv", "pos", "value", "turn", "words"])

    return stored.filter("words >= 0").mapInArrow(whole, "conv long, pos long, value binary, turn binary, words int")


def head_length(conv: Column) -> Column:
    """How many turns a conversation takes from its base: crc32 of its decimal id, unsigned, modulo HEADS."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def _rebuilt_tails(base: int):
    """The own turns behind the head, with depth and product in the rebuilt conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(base)
        for batch in batches:
            conv, length, value, own_head, base_head, *rest = batch.columns
            values = [_bytes(compose(_read(head), divided(_read(v), _read(own), n, powers), n, powers))
                      for n, v, own, head in zip(*(c.to_pylist() for c in (length, value, own_head, base_head)))]
            yield pa.record_batch([rest[0], pa.array(values, pa.binary()), rest[1], rest[2], conv, rest[3]],
                                  names=["depth", "value", "turn", "words", "conv", "ends"])
    return run


def members(own: DataFrame, base: int, steps: list[str]) -> DataFrame:
    """A row per node and member: depth, value, turn (its last one's reference), words, conv, ends (whether it ends there)."""
    spark = own.sparkSession
    head = head_length(F.col("conv"))
    is_base = F.col("conv") % GROUP == 0
    per_conv = own.groupBy("conv").agg(
        F.max("pos").alias("n"), F.max(F.when(F.col("pos") == head, F.col("value"))).alias("own_head"),
        F.array(*[F.max(F.when(is_base & (F.col("pos") == i), F.struct("value", "turn", "words"))) for i in range(1, HEADS)]
                ).alias("first"))
    steps.append(scratch_path(spark, "conversations"))
    convs = written(spark, per_conv, steps[-1])
    heads = convs.filter(is_base).select(F.col("conv").alias("of"), F.filter("first", lambda t: t.isNotNull()).alias("first"))
    none = F.lit(ROOT)
    info = convs.select("conv", "n", "own_head", head.alias("h")).join(
        heads, F.col("conv") - F.col("conv") % GROUP == F.col("of"), "left").select(
        "conv", "n", "h", F.coalesce("own_head", none).alias("own_head"),
        F.coalesce(F.slice("first", 1, F.col("h")), F.array().cast(heads.schema["first"].dataType)).alias("head"))
    info = info.withColumn("total", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int"))
    steps.append(scratch_path(spark, "heads"))
    info = written(spark, info, steps[-1])
    roots = info.select(F.lit(0).alias("depth"), none.alias("value"), F.lit(None).cast("binary").alias("turn"),
                        F.lit(0).alias("words"), "conv", (F.col("total") == 0).alias("ends"))
    shared = info.select("conv", "total", F.posexplode("head").alias("i", "t")).select(
        (F.col("i") + 1).alias("depth"), "t.value", "t.turn", "t.words", "conv", (F.col("total") == F.col("i") + 1).alias("ends"))
    tails = own.join(info.select(F.col("conv").alias("of"), "h", "total", "own_head", F.size("head").alias("taken"), F.when(
        F.size("head") > 0, F.element_at("head", -1)["value"]).otherwise(none).alias("base_head")),
        (F.col("conv") == F.col("of")) & (F.col("pos") > F.col("h")))
    depth = (F.col("taken") + F.col("pos") - F.col("h")).cast("int")
    tails = tails.select("conv", F.col("pos") - F.col("h"), "value", "own_head", "base_head", depth, "turn", "words",
                         depth == F.col("total")).mapInArrow(
        _rebuilt_tails(base), "depth int, value binary, turn binary, words int, conv long, ends boolean")
    return roots.unionByName(shared).unionByName(tails)


def _with_parents(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse = pow(base, -1, P)
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            parents = [None if turn is None else _bytes(parent_value(_read(value), turn, inverse))
                       for value, turn in zip(columns["value"].to_pylist(), columns["turn"].to_pylist())]
            yield batch.append_column("parent", pa.array(parents, pa.binary()))
    return run


def _doubled(spark: SparkSession, sums: DataFrame) -> DataFrame:
    """depth, value, n_leaves and saved_tokens of the nodes' subtrees; `sums` has their own parts and their parents."""
    deepest = sums.agg(F.max("depth")).first()[0] or 0
    step, before = 1, None
    while step <= deepest:
        above = sums.filter(F.col("depth") >= step)
        added = above.groupBy((F.col("depth") - step).alias("d"), F.col("up").alias("v")).agg(
            F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        nexts = sums.filter(F.col("depth") >= step).select(F.col("depth").alias("ud"), F.col("value").alias("uv"), F.col("up").alias("uu"))
        # A node whose ancestor is less than 2 * step deep has none further up to add to.
        moved = sums.join(nexts, (F.col("depth") - step == F.col("ud")) & (F.col("up") == F.col("uv")), "left")
        moved = moved.join(added, (F.col("depth") == F.col("d")) & (F.col("value") == F.col("v")), "left")
        place = scratch_path(spark, "subtrees")
        sums = written(spark, moved.select(
            "depth", "value", F.col("uu").alias("up"), (F.col("n_leaves") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("saved", F.lit(0))).alias("saved_tokens")), place)
        if before:
            discard(spark, before)
        before, step = place, step * 2
    return sums.select("depth", "value", "n_leaves", "saved_tokens")


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids, in order, as comma-joined texts of at most CHUNK ids."""
    node, ids = None, []

    def chunk() -> pa.RecordBatch:
        return pa.record_batch([pa.array([node[0]], pa.int32()), pa.array([node[1]], pa.binary()), pa.array([ids[0]], pa.int64()),
                                pa.array([",".join(map(str, ids))])], names=["depth", "value", "least", "ids"])

    for batch in batches:
        for depth, value, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (node != (depth, value) or len(ids) == CHUNK):
                yield chunk()
                ids = []
            node = depth, value
            ids.append(conv)
    if ids:
        yield chunk()


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([node[0]], pa.int32()), pa.array([node[1]], pa.binary()), pa.array([digest.hexdigest()])],
                               names=["depth", "value", "sha"])

    for batch in batches:
        for depth, value, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node != (depth, value):
                if node:
                    yield done()
                node, digest = (depth, value), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node:
        yield done()


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", *, seed: int = 0) -> DataFrame:
    """The nodes of the rebuilt conversations' trie, from the root (depth 0).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    turn, the reference of the node's last turn (hex; null for the root).

    Rows without a conversation id are left out; null roles and texts are empty ones. Turns are in order of `turn`,
    nulls first, ties by reference, so rows that repeat a turn are turns of their own. A conversation whose base is absent
    has its own turns after its first h only, and may have none; it is a member of the root then. Very long
    conversations and texts and very common turns need no special care. An empty table has no root. Other columns
    are no input.
    """
    spark = conversations.sparkSession
    prepare_python(spark)
    said, by = F.coalesce(quoted(text), F.lit("")), F.coalesce(quoted(role), F.lit(""))
    turns = conversations.filter(quoted(conv_id).isNotNull()).select(
        quoted(conv_id).cast("long").alias("conv"), quoted(turn).alias("place"),
        F.unhex(F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said).cast("binary"), 256)).alias("turn"),
        F.regexp_count(said, F.lit(WORDS)).cast("int").alias("words"))
    while True:
        base = base_of(seed)
        steps = [scratch_path(spark, "own-turns")]
        found = members(own_prefixes(turns, base, steps[0]), base, steps)
        steps.append(scratch_path(spark, "members"))
        found = written(spark, found, steps[-1])
        nodes = found.groupBy("depth", "value").agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.min("turn").alias("turn"),
            (F.min("turn") != F.max("turn")).alias("unequal"), F.max("words").alias("words"),
            F.count(F.when(F.col("ends"), True)).alias("n_ends"), F.min(F.when(F.col("ends"), F.col("conv"))).alias("end"))
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
        steps.append(scratch_path(spark, "nodes"))
        nodes = written(spark, nodes.mapInArrow(_with_parents(base), f"{fields}, parent binary"), steps[-1])
        if nodes.filter("unequal").isEmpty():
            break
        seed += 1
        for step in steps:
            discard(spark, step)
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("d"), F.col("parent").alias("v")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count(F.when(F.col("n_convs") == 1, True)).alias("chains"))
    kids = nodes.join(kids, (F.col("depth") == F.col("d")) & (F.col("value") == F.col("v")), "left").drop("d", "v")
    steps.append(scratch_path(spark, "children"))
    kids = written(spark, kids.fillna(0, ["n_children", "chains"]), steps[-1])
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    sums = _doubled(spark, kids.filter("n_convs > 1").select(
        "depth", "value", F.col("parent").alias("up"), (F.col("chains") + leaf).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")))
    many = nodes.filter("n_ends > 1").select(F.col("depth").alias("d"), F.col("value").alias("v"))
    ended = found.filter("ends").join(many, (F.col("depth") == F.col("d")) & (F.col("value") == F.col("v")), "left_semi")
    texts = ended.select("depth", "value", "conv").repartitionByRange("depth", "value", "conv").sortWithinPartitions(
        "depth", "value", "conv").mapInArrow(_id_texts, "depth int, value binary, least long, ids string")
    steps.append(scratch_path(spark, "end-ids"))
    digests = written(spark, texts, steps[-1]).repartition("depth", "value").sortWithinPartitions("depth", "value", "least").select(
        "depth", "value", "ids").mapInArrow(_id_digests, "depth int, value binary, sha string")

    def at(df: DataFrame, *columns: str) -> DataFrame:
        return df.select(F.col("depth").alias("d"), F.col("value").alias("v"), *columns)

    out = kids
    for more in (at(sums, "n_leaves", "saved_tokens"), at(digests, "sha")):
        out = out.join(more, (F.col("depth") == F.col("d")) & (F.col("value") == F.col("v")), "left").drop("d", "v")
    parents = nodes.select(F.col("depth").alias("d"), F.col("value").alias("v"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parents, (F.col("depth") - 1 == F.col("d")) & (F.col("parent") == F.col("v")), "left")
    ends = (F.when(F.col("n_ends") == 0, F.lit(EMPTY)).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string").cast("binary"), 256))
            .otherwise(F.col("sha")))
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), ends.alias("ends_sha256"),
        F.lower(F.hex("turn")).alias("turn"))
