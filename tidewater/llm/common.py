"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words and ends lines' margins: space, tab, line feed, vertical tab, form feed,
#: carriage return. These are also what `bytes.split()` splits at.
BLANKS = b" \t\n\x0b\x0c\r"


BATCH_BYTES, BATCH_ROWS = "4m", "2000"


def free_name(columns: Iterable[str], stem: str) -> str:
    """`stem`, with underscores added until no column has that name in any spelling."""
    taken = {name.lower() for name in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def prepare_python(spark: SparkSession) -> None:
    """Give Python workers this package, and bound what a task hands them at once.

    A batch exists several times over, in the JVM, in Arrow and as Python values; at the default of 64 MB
    two tasks can outgrow an executor's memory beside its heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # the driver's own copy, which Spark hands out
        with zipfile.ZipFile(archive, "w") as out:
            for source in package.rglob("*.py"):
                out.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(application)


_SHIPPED: set[str] = set()


def in_few_files(df: DataFrame, rows: int, rows_per_file: int = 200_000) -> DataFrame:
    """The same rows in no more tasks than a step of at most `rows` rows needs, or than there are cores.

    A small step written by every shuffle partition is mostly files that hold nothing.
    """
    return df.coalesce(min(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_file)), (1 << 31) - 1))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def texts(column: pa.Array) -> list[bytes]:
    """The column's values as UTF-8, null as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a finaliser of two multiply and shift rounds)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        values = (values ^ (values >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


_HASHES = WordHashes()


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles of `width` words as sorted 64-bit hashes.

    Words are runs of anything but BLANKS, with A-Z lower-cased. Fewer words than `width` make one
    shingle of the whole sequence, no words make none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64)
    count = len(words) - width + 1
    total = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(width):
            total = total * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[start:start + count]
    return np.unique(mixed(total))


LETTERS = re.compile(r"[^\W\d_]+")
