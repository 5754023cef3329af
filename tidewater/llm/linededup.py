"""Lines that repeat across documents: two Bloom filters pick suspects, a shuffle of those decides.

Each task reads its texts and keeps two Bloom filters, one of line keys seen at least once and one of
keys seen in at least two documents. Merging two tasks' filters makes a key that both have seen once
a twice-seen one, so no key of two documents can be missing from the merged twice-seen filter. Only
keys found there are shuffled, as (SHA-256 of the key, doc_id), to find the smallest doc_id that holds
each; then only documents that hold a suspect are joined with what they lose.

A filter is cut into segments of SEGMENT_BITS. Tasks send a segment as bit positions while that is
shorter, so the filters cost some bytes per line and not a full filter per task. The filter grows
with the number of lines up to `max_bits` (64 MB by default, which is what the driver broadcasts at
most); beyond, more keys become suspects and are decided by the shuffle, with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import BLANKS, free_name, in_few_files, prepare_python, quoted, texts
from tidewater.session import discard, scratch_path, written

SEGMENT_BITS = 1 << 18
PROBES = 3
BITS_PER_KEY = 16
MAX_BITS = 1 << 29
MIN_CHARS = 10


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line without blanks at its ends and with A-Z lower-cased; None if it is too short to judge."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars
                                and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def distinct_keys(text: bytes, min_chars: int) -> set[bytes]:
    keys = {line_key(line, min_chars) for line in text.split(b"\n")}
    keys.discard(None)
    return keys


def _positions(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's segment, and its PROBES bit positions there."""
    step = (hashes >> np.uint64(20)) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        bits = (hashes + probes * step) & np.uint64(SEGMENT_BITS - 1)
    return ((hashes >> np.uint64(40)) & np.uint64(segments - 1)).astype(np.int64), bits.astype(np.int64)


def _bits(filter_: np.ndarray, where: np.ndarray) -> np.ndarray:
    return (filter_[where >> 3] >> (where & 7).astype(np.uint8)) & 1 == 1


def _set(filter_: np.ndarray, where: np.ndarray) -> None:
    np.bitwise_or.at(filter_, where >> 3, np.left_shift(1, where & 7).astype(np.uint8))


def _pack(segment: np.ndarray) -> bytes:
    """Bit positions while they are shorter than the segment itself."""
    found = np.flatnonzero(np.unpackbits(segment, bitorder="little"))
    return b"p" + found.astype(np.uint32).tobytes() if 4 * len(found) < len(segment) else b"b" + segment.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    if packed[:1] == b"b":
        return np.frombuffer(packed, np.uint8, offset=1).copy()
    segment = np.zeros(SEGMENT_BITS // 8, np.uint8)
    _set(segment, np.frombuffer(packed, np.uint32, offset=1).astype(np.int64))
    return segment


def _partial_filters(segments: int, min_chars: int):
    """One task's two filters, as rows of segments that have any bit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = SEGMENT_BITS // 8
        once, twice = np.zeros(segments * size, np.uint8), np.zeros(segments * size, np.uint8)
        for batch in batches:
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(key) for text in texts(batch.column(0))
                                  for key in distinct_keys(text, min_chars)), np.uint64)
            hashes, counts = np.unique(hashes, return_counts=True)
            segment, bits = _positions(hashes, segments)
            where = bits + segment * SEGMENT_BITS
            repeated = _bits(once, where).all(axis=0) | (counts > 1)
            _set(twice, where[:, repeated].ravel())
            _set(once, where.ravel())
        for number in range(segments):
            part = slice(number * size, (number + 1) * size)
            if once[part].any():
                yield pa.record_batch([[number], [_pack(once[part])], [_pack(twice[part])]],
                                      names=["segment", "once", "twice"])
    return run


def _merge_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the tasks' filters of each segment dealt to this task; two segments of memory each."""
    state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for number, once, twice in zip(*(column.to_pylist() for column in batch.columns)):
            once, twice = _unpack(once), _unpack(twice)
            if number in state:
                seen, repeated = state[number]
                repeated |= twice | (seen & once)
                seen |= once
            else:
                state[number] = once, twice
    for number, (_, repeated) in state.items():
        yield pa.record_batch([[number], [_pack(repeated)]], names=["segment", "twice"])


def twice_seen_filter(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS,
                      max_bits: int = MAX_BITS) -> tuple[Broadcast, int, int]:
    """The filter of keys seen in two documents or more, broadcast, its number of segments, and of lines."""
    spark = docs.sparkSession
    column = quoted(text)
    lines = docs.agg(F.sum(F.length(column) - F.length(F.replace(column, F.lit("\n"))) + 1)).first()[0] or 0
    segments = 1
    while segments * SEGMENT_BITS < min(max_bits, lines * BITS_PER_KEY):
        segments *= 2
    partial = docs.select(column).mapInArrow(
        _partial_filters(segments, min_chars), "segment long, once binary, twice binary")
    merged = partial.repartition("segment").mapInArrow(_merge_filters, "segment long, twice binary")
    size = SEGMENT_BITS // 8
    filter_ = np.zeros(segments * size, np.uint8)
    for row in merged.toLocalIterator():  # at most max_bits in all
        filter_[row["segment"] * size:(row["segment"] + 1) * size] = _unpack(bytes(row["twice"]))
    return spark.sparkContext.broadcast(filter_.tobytes()), segments, lines


def _suspects(text: bytes, filter_: np.ndarray, segments: int, min_chars: int) -> list[bytes]:
    keys = list(distinct_keys(text, min_chars))
    if not keys:
        return keys
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    segment, bits = _positions(hashes, segments)
    found = _bits(filter_, bits + segment * SEGMENT_BITS).all(axis=0)
    return [keys[i] for i in np.flatnonzero(found)]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
                n_lines: str = "n_lines", n_dropped: str = "n_dropped",
                min_chars: int = MIN_CHARS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with every line dropped whose key a document of smaller id holds too.

    A line ends at \\n; its key is the line without blanks at both ends and with A-Z lower-cased. Keys
    under `min_chars` code points stay. All columns stay; `n_lines` (before dropping) and `n_dropped`
    are added, in place of columns of the same name. A null text stays null and has one line; so does
    an empty one. Rows without an id lose nothing and count for nothing. Rows that repeat an id are one
    document that holds the lines of all of them: each row keeps its first-held lines. An empty table
    gives an empty one. Lines within one document may repeat.
    """
    spark: SparkSession = docs.sparkSession
    prepare_python(spark)
    filter_, segments, lines_held = twice_seen_filter(docs, text, min_chars, max_bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_.value, np.uint8)
        for batch in batches:
            rows, keys = [], []
            for row, value in enumerate(texts(batch.column(1))):
                found = _suspects(value, bits, segments, min_chars)
                rows += [row] * len(found)
                keys += [hashlib.sha256(key).digest() for key in found]
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary())],
                                  names=["doc", "key"])

    kind = docs.schema[doc_id].dataType.simpleString()
    place = scratch_path(spark, "suspect-lines")
    suspects = written(spark, in_few_files(docs.filter(quoted(doc_id).isNotNull()).select(
        quoted(doc_id), quoted(text)).mapInArrow(emit, f"doc {kind}, key binary"), lines_held, 100_000), place)
    # Stored ahead of the join: an aggregate that feeds a join keeps Spark from splitting a hot key there.
    held = scratch_path(spark, "repeated-lines")
    holders = written(spark, in_few_files(
        suspects.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        .filter("first < last").select("key", "first"), lines_held), held)
    lost = written(spark, in_few_files(
        suspects.join(holders, "key").filter("doc > first").groupBy("doc").agg(F.collect_set("key").alias("lost")),
        lines_held), scratch_path(spark, "lost-lines"))
    discard(spark, place)
    discard(spark, held)

    @F.pandas_udf("boolean")
    def suspect(values):
        import pandas as pd

        bits = np.frombuffer(filter_.value, np.uint8)
        return pd.Series([bool(value) and bool(_suspects(value.encode("utf-8", "replace"), bits, segments, min_chars))
                          for value in values], dtype=bool)

    @F.pandas_udf("struct<kept string, dropped bigint>")
    def without(values, gone):
        import pandas as pd

        kept, dropped = [], []
        for value, keys in zip(values, gone):
            if value is None or keys is None:
                kept.append(value)
                dropped.append(0)
                continue
            keys = {bytes(key) for key in keys}
            lines = value.encode("utf-8", "replace").split(b"\n")
            stay = [line for line in lines if (key := line_key(line, min_chars)) is None
                    or hashlib.sha256(key).digest() not in keys]
            kept.append(b"\n".join(stay).decode("utf-8", "replace"))
            dropped.append(len(lines) - len(stay))
        return pd.DataFrame({"kept": kept, "dropped": dropped})

    carried = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    names = [*carried, n_lines, n_dropped]
    column, mark = quoted(text), free_name(names, "suspected")
    lines = F.coalesce(F.length(column) - F.length(F.replace(column, F.lit("\n"))) + 1, F.lit(1)).cast("long")
    marked = docs.select(*[quoted(c) for c in carried], lines.alias(n_lines), suspect(column).alias(mark))
    clean = marked.filter(~quoted(mark)).withColumn(n_dropped, F.lit(0).cast("long")).select(*map(quoted, names))
    key, gone, result = (free_name([*names, mark], x) for x in ("lost_by", "lost", "outcome"))
    joined = marked.filter(quoted(mark)).join(
        lost.select(F.col("doc").alias(key), F.col("lost").alias(gone)), quoted(doc_id) == quoted(key), "left")
    outcome = joined.withColumn(result, without(column, quoted(gone)))
    changed = outcome.select(*[
        quoted(result)["kept"].alias(c) if c == text else quoted(result)["dropped"].alias(c) if c == n_dropped
        else quoted(c) for c in names])
    return clean.unionByName(changed)
