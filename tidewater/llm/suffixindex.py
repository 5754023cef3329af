"""Long passages that stand anywhere else, by a logarithmic family of suffix arrays.

Every string of `length` bytes is represented by one of its suffixes' places: of its runs of `head` bytes the one of
smallest hash, the leftmost of equal ones. Equal strings choose the same place, so a suffix array of the chosen places
alone (one in 170 bytes at 400) finds all of them. Consecutive strings of a text mostly choose the same place; an entry
is such a place with the bytes its strings span (`length` and at most length - head more): the first SHOWN bytes and a
hash of the first `head` bytes of the suffix, by which arrays are in order, a digest of all the bytes, and a
reference to a text that holds them. Texts are known by a hash of their bytes.

`Family` holds arrays of geometric sizes. A new batch of texts gets its array, which is merge-scanned against the
arrays of all levels: what starts alike in the batch and anywhere else, or twice in the batch, is passed on. Then the
array joins the family. Ahead of the next batch arrays of the same number of batches are merged into one of the next
level, so a text's entries are rewritten as often as the number of batches has bits. Families can be added to at
any time.

What the scans pass on is decided exactly. Entries of equal bytes are one class; a class of two or more entries is
covered whole. A class of one is compared, byte by byte to the left and right of the place, with the other classes
whose suffixes start alike, in groups of at most LIMIT. Larger groups, however hot, are never in one task: the
strings of each entry are halved by where they start, and what all strings of a half have in common names a smaller
group, and so on down to groups of one whole string. Halves of equal bytes cover each other and go on as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import free_name, in_few_files, mixed, prepare_python, quoted, texts
from tidewater.session import discard, scratch_path, written

LENGTH = 400
HEAD = 64
SHOWN = 16
BATCHES = 4
LIMIT = 512
STEP = 1 << 19  # strings looked at in one go
PLACES = (1 << 20) - 1
B = 0x9E3779B97F4A7C15 | 1
ENTRY = "batch int, text binary, start int, before int, size int, suffix binary, digest binary, n long"


def head_size(length: int) -> int:
    return max(1, min(HEAD, length // 4))


@lru_cache(2)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of B and of its inverse modulo 2**64, and a value per byte."""
    up, down = np.full(count, B, np.uint64), np.full(count, pow(B, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), mixed(np.arange(1, 257, dtype=np.uint64))


def chosen_places(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(place, first, last): the strings of `length` bytes that start from first to last choose this place."""
    head = head_size(length)
    width = length - head + 1
    up, down, values = _powers(STEP + length)
    for offset in range(0, len(text) - length + 1, STEP):
        x = np.frombuffer(text, np.uint8, min(STEP + length - 1, len(text) - offset), offset)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[x] * up[:len(x)])])
            hashes = mixed((sums[head:] - sums[:-head]) * down[:len(x) - head + 1])
        ranked = (hashes & ~np.uint64(PLACES)) | np.arange(len(hashes), dtype=np.uint64)
        rows = np.pad(ranked, (0, -len(ranked) % width), constant_values=np.uint64(2 ** 64 - 1)).reshape(-1, width)
        from_left = np.minimum.accumulate(rows, axis=1).ravel()
        from_right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(x) - length + 1
        least = np.minimum(from_right[:count], from_left[width - 1:width - 1 + count]) & np.uint64(PLACES)
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
        lasts = np.concatenate([firsts[1:] - 1, [count - 1]])
        for place, first, last in zip(least[firsts].tolist(), firsts.tolist(), lasts.tolist()):
            yield offset + place, offset + first, offset + last


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union, as maximal runs in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _entries(length: int, batches_: int):
    """A text's entries. What it repeats in itself is covered at once (rows without a digest) and counts in the first."""
    head = head_size(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies: dict[bytes, list] = {}
            for name, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                copies.setdefault(name, [0, text])[0] += 1
            rows: list[tuple] = []
            for name, (n, text) in copies.items():
                found: dict[bytes, list] = {}
                again = []
                for place, first, last in chosen_places(text, length):
                    whole = text[first:last + length]
                    key = hashlib.blake2b((place - first).to_bytes(4, "big") + whole, digest_size=16).digest()
                    if key in found:
                        found[key][-1] += n
                        again.append((first, last + length))
                        continue
                    start = text[place:place + head]
                    found[key] = [first, place - first, len(whole),
                                  start[:SHOWN] + xxhash.xxh3_64_digest(start), key, n]
                number = name[0] % batches_
                rows += [(number, name, *row) for row in found.values()]
                rows += [(number, name, start, 0, end - start, None, None, 0) for start, end in merged_spans(again)]
            columns = list(zip(*rows)) or [()] * 8
            kinds = (pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
            names = [field.split()[0] for field in ENTRY.split(", ")]
            for start in range(0, max(len(rows), 1), 50_000):
                yield pa.record_batch([pa.array(c[start:start + 50_000], k) for c, k in zip(columns, kinds)], names=names)
    return run


def text_name(text: Column) -> Column:
    """What a text is known by: half of the SHA-256 of its bytes."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def entries(docs: DataFrame, text: str = "text", length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """The entries of all texts of at least `length` bytes; the batch follows from the text."""
    prepare_python(docs.sparkSession)
    column = quoted(text)
    return docs.filter(F.octet_length(column) >= length).select(text_name(column), column).mapInArrow(
        _entries(length, batches), ENTRY)


class Family:
    """Suffix arrays of geometric sizes, stored; `levels` lists (number of batches, path), the largest first."""

    def __init__(self, spark: SparkSession, levels: list[tuple[int, str]] | None = None, rows: int = 1 << 62):
        """`rows` is a bound on the entries, where one is known; few are kept in few files."""
        self.spark, self.levels, self.rows = spark, list(levels or []), rows

    def _array(self, found: DataFrame) -> tuple[DataFrame, str]:
        """One row per class, each file in the order of the suffixes."""
        place = scratch_path(self.spark, "suffix-array")
        rows = found.groupBy("suffix", "digest").agg(F.sum("n").alias("n"), F.min("of").alias("of"))
        return written(self.spark, in_few_files(rows, self.rows).sortWithinPartitions("suffix", "digest"), place), place

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def add(self, found: DataFrame) -> DataFrame:
        """Add a batch's entries; gives the classes, old and new, that start like one of the batch does (stored)."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, other) = self.levels.pop(), self.levels.pop()
            _, place = self._array(self._read(one).unionByName(self._read(other)))
            self.levels.append((2 * size, place))
            discard(self.spark, one)
            discard(self.spark, other)
        batch, place = self._array(found.filter(F.col("digest").isNotNull()).select(
            "suffix", "digest", "n", F.struct("text", "start", "before", "size").alias("of")))
        scanned = batch.withColumn("new", F.lit(True))
        for _, path in self.levels:
            scanned = scanned.unionByName(self._read(path).withColumn("new", F.lit(False)))
        alike = scanned.groupBy("suffix").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("most"), F.max("new").alias("new"))
        alike = alike.filter("new AND (rows > 1 OR most > 1)").select("suffix")
        met = written(self.spark, in_few_files(scanned.drop("new").join(alike, "suffix", "left_semi"), self.rows),
                      scratch_path(self.spark, "met"))
        self.levels.append((1, place))
        return met


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted entries of each text."""
    for batch in batches:
        rows = [(w["suffix"], w["digest"], w["alone"], w["before"], text[w["start"]:w["start"] + w["size"]])
                for text, wanted in zip(texts(batch.column(0)), batch.column(1).to_pylist()) for w in wanted]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.int32(), pa.binary())
        for start in range(0, max(len(rows), 1), 5000):
            yield pa.record_batch([pa.array(c[start:start + 5000], k) for c, k in zip(columns, kinds)],
                                  names=["core", "digest", "alone", "before", "bytes"])


HALF = "core binary, lo int, hi int, part binary, digest binary, alone boolean, before int, from int, to int, bytes binary"


def _halved(length: int):
    """Each entry's strings in two halves by where they start, each with what its strings have in common.

    `part` is a digest of all bytes of the half's strings, which go from `from` to `to` in the entry's.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, lo, hi, digest, alone, before, offset, whole in zip(*(c.to_pylist() for c in batch.columns)):
                nearest, middle = before + length - len(whole), (lo + hi) // 2
                for low, high in ((lo, middle), (middle + 1, hi)):
                    first, last = max(low, nearest), min(high, before)
                    if low <= high and first <= last:
                        common = whole[before - low:before + length - high]
                        held = whole[before - last:before + length - first]
                        part = hashlib.blake2b(last.to_bytes(4, "big") + held, digest_size=16).digest()
                        rows.append((hashlib.blake2b(common, digest_size=16).digest(), low, high, part, digest, alone, last,
                                     offset + before - last, offset + before + length - first, held))
            columns = list(zip(*rows)) or [()] * 10
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.int32(), pa.int32(),
                     pa.int32(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                                  names=[field.split()[0] for field in HALF.split(", ")])
    return run


def covered(entries_: list[tuple[bool, int, bytes]], lo: int, hi: int, length: int) -> list[tuple[int, int, int]]:
    """(entry, start, end) of what other entries cover in those that are alone, by strings that start lo to hi before.

    An entry is whether it is alone, how many of its bytes are before the place, and its bytes.
    """
    def matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in parts])
        out = np.zeros((len(parts), sizes.max(initial=0) + 1), np.uint8)
        for row, part in zip(out, parts):
            row[:len(part)] = np.frombuffer(part, np.uint8)
        return out, sizes

    left, left_sizes = matrix([whole[:before][::-1] for _, before, whole in entries_])
    right, right_sizes = matrix([whole[before:] for _, before, whole in entries_])

    def alike(rows: np.ndarray, sizes: np.ndarray, i: int) -> np.ndarray:
        differ = rows != rows[i]
        return np.minimum(np.where(differ.any(1), differ.argmax(1), rows.shape[1]), np.minimum(sizes, sizes[i]))

    out = []
    for i, (alone, before, _) in enumerate(entries_):
        if not alone:
            continue
        most = np.minimum(alike(left, left_sizes, i), hi)
        least = np.maximum(length - alike(right, right_sizes, i), lo)
        good = most >= least
        good[i] = False
        spans = {(before - a, before + length - b) for a, b in zip(most[good].tolist(), least[good].tolist())}
        out += [(i, *span) for span in merged_spans(list(spans))]
    return out


def _compared(length: int):
    """Groups that follow one another in order, each of at most LIMIT entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def done() -> pa.RecordBatch:
            found = covered([(alone, before, whole) for _, alone, before, _, whole in rows], group[1], group[2], length)
            return pa.record_batch([pa.array([rows[i][0] for i, _, _ in found], pa.binary()),
                                    pa.array([rows[i][3] + a for i, a, _ in found], pa.int32()),
                                    pa.array([rows[i][3] + b for i, _, b in found], pa.int32())], names=["digest", "from", "to"])

        for batch in batches:
            for core, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and group != (core, lo, hi):
                    yield done()
                    rows = []
                group = core, lo, hi
                rows.append(row)
        if rows:
            yield done()
    return run


def _decided(docs: DataFrame, text: str, classes: DataFrame, length: int, limit: int) -> DataFrame:
    """digest, from, to: what is covered in classes of one entry, as offsets in its bytes."""
    spark, count = docs.sparkSession, classes.count()

    def store(df: DataFrame, label: str, rows: int, per_file: int = 200_000) -> DataFrame:
        return written(spark, in_few_files(df, rows, per_file), scratch_path(spark, label))

    open_ = classes.groupBy("suffix").agg(F.count(F.lit(1)).alias("classes"), F.max("alone").alias("open")).filter(
        "open AND classes > 1").select("suffix")
    wanted = store(classes.join(open_, "suffix", "left_semi").groupBy(F.col("of.text").alias("held_by")).agg(
        F.collect_list(F.struct("suffix", "digest", "alone", "of.start", "of.before", "of.size")).alias("wanted")), "wanted", count)
    column = quoted(text)
    holders = docs.filter(F.octet_length(column) >= length).select(column.alias("text"), text_name(column).alias("name"))
    sliced = holders.join(wanted, F.col("name") == F.col("held_by")).select("text", "wanted").mapInArrow(
        _slices, "core binary, digest binary, alone boolean, before int, bytes binary")
    # `from` says where an entry's bytes here start in its own; halves have fewer.
    pending = sliced.groupBy("core", "digest").agg(*[F.first(c).alias(c) for c in ("alone", "before", "bytes")]).select(
        "core", F.lit(0).alias("lo"), F.lit(length - head_size(length)).alias("hi"), "digest", "alone", "before",
        F.lit(0).alias("from"), "bytes")
    key, columns, found = ["core", "lo", "hi"], pending.columns, []
    while True:
        pending = store(pending, "alike", count, 20_000)
        rows = pending.count()
        groups = store(pending.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.max("alone").alias("open")).filter(
            "open AND members > 1").drop("open"), "groups", rows)
        small = pending.join(groups.filter(F.col("members") <= limit), key, "left_semi")
        found.append(store(small.repartition(*key).sortWithinPartitions(*key, "digest").mapInArrow(
            _compared(length), "digest binary, from int, to int"), "covered", rows, 20_000))
        large = groups.filter(F.col("members") > limit)
        if large.isEmpty():
            break
        # Halves of equal bytes cover each other, and one of them stands for all in what follows; at the end of the
        # halving that is all there is to know.
        halves = store(pending.join(large, key, "left_semi").filter("lo < hi").select(*columns).mapInArrow(
            _halved(length), HALF), "halves", 2 * rows, 20_000)
        parts = halves.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("some"), *[
            F.first(c).alias(c) for c in ("digest", "before", "from", "bytes")])
        again = halves.drop("bytes").groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key, "part")
        found.append(store(halves.filter("alone").join(again, [*key, "part"], "left_semi").select("digest", "from", "to"),
                           "covered", 2 * rows))
        pending, count = parts.select(
            *key, "digest", (F.col("some") & (F.col("n") == 1)).alias("alone"), "before", "from", "bytes"), 2 * rows
    return reduce(DataFrame.unionByName, found)


def repeated_spans(docs: DataFrame, text: str = "text", *, length: int = LENGTH, batches: int = BATCHES,
                   limit: int = LIMIT) -> DataFrame:
    """name (a text's), spans (array of (start, end) in bytes, not merged): what strings of `length` bytes that
    also start anywhere else cover. Texts without any are left out."""
    spark = docs.sparkSession
    place = scratch_path(spark, "entries")
    held = written(spark, entries(docs, text, length, batches), place)
    count = held.count()
    family, met = Family(spark, rows=count), None
    for number in range(batches):
        more = family.add(held.filter(F.col("batch") == number))
        met = more if met is None else met.unionByName(more)
    # A class that several scans pass on is the same entry each time unless it has two.
    classes = met.groupBy("suffix", "digest").agg(
        F.min("of").alias("of"), ((F.max("n") == 1) & (F.min("of") == F.max("of"))).alias("alone"))
    classes = written(spark, in_few_files(classes, count), scratch_path(spark, "classes"))
    in_part = _decided(docs, text, classes, length, limit)
    ones = classes.filter("alone").select("digest", "of")
    in_part = in_part.join(ones, "digest").select(
        F.col("of.text").alias("name"), (F.col("of.start") + F.col("from")).alias("start"), (F.col("of.start") + F.col("to")).alias("end"))
    whole = held.join(classes.filter("NOT alone").select("digest"), "digest", "left_semi")
    whole = whole.unionByName(held.filter(F.col("digest").isNull())).select(
        F.col("text").alias("name"), "start", (F.col("start") + F.col("size")).alias("end"))
    return written(spark, in_few_files(whole.unionByName(in_part).groupBy("name").agg(
        F.collect_set(F.struct("start", "end")).alias("spans")), count), scratch_path(spark, "spans"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, runs = [], []
        for text, spans in zip(texts(batch.column(batch.num_columns - 2)), batch.column(batch.num_columns - 1).to_pylist()):
            gone = merged_spans([(s["start"], s["end"]) for s in spans or ()])
            runs.append([{"start": a, "end": b} for a, b in gone])
            edges = [0, *(x for span in gone for x in span), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if gone else text)
        yield pa.record_batch([*batch.columns[:-2], pa.array(kept, pa.binary()),
                               pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                              names=[*batch.schema.names[:-2], "kept", "spans"])


def dedup_passages(docs: DataFrame, text: str = "text", *, length: int = LENGTH, batches: int = BATCHES,
                   limit: int = LIMIT) -> DataFrame:
    """The documents with kept (their bytes without what repeats), spans (of removed bytes: maximal runs), n_bytes,
    n_removed and n_spans.

    Removed is each byte that a string of `length` bytes covers which also starts anywhere else, in this text or another,
    as texts are given. Strings never cross documents. A null text is an empty one and keeps nothing; its own column
    stays null. All columns stay but those named like the added ones, which are replaced. Ids are no input, so rows
    that repeat or lack an id are texts like others, and rows of equal texts of `length` bytes or more lose all.
    An empty table gives an empty one. Very long texts are looked at in parts.
    """
    spark = docs.sparkSession
    found = repeated_spans(docs, text, length=length, batches=batches, limit=limit)
    added = ("kept", "spans", "n_bytes", "n_removed", "n_spans")
    carried = [c for c in docs.columns if c not in added]
    name = free_name([*docs.columns, *added], "name")
    other = free_name([*docs.columns, *added, name], "spans")
    joined = docs.withColumn(name, text_name(quoted(text))).join(
        found.select(F.col("name").alias(f"{name}_of"), F.col("spans").alias(other)), F.col(name) == F.col(f"{name}_of"), "left")
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in carried),
                        "n_bytes bigint", "kept binary", "spans array<struct<start: int, end: int>>"])
    size = F.coalesce(F.octet_length(quoted(text)), F.lit(0)).cast("long")
    return joined.select(*map(quoted, carried), size.alias("n_bytes"), quoted(text).alias(f"{name}_text"), F.col(other)).mapInArrow(
        _without, schema).select(
        *map(quoted, carried), "kept", "spans", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"))
