"""Product codes of vectors on an integer grid, with memoised grid cells.

A component x becomes the integer floor(scale * x). Vectors are cut into `parts` equal consecutive parts, and
each part position has a codebook of `entries` entries, refined by Lloyd rounds. Integers make sums, floors and
ties the same in any order of the rows, so reruns and lost tasks change nothing.

Finding a part's nearest entry starts from its coarse grid cell, 2 ** CELL_BITS wide. For a cell not met before,
each entry's smallest and largest squared distance from the cell's box is taken; an entry whose smallest distance
is above the least of the largest ones is dominated across the box, as some entry is nearer to every point of it.
The others (about 4 % on unit vectors of 64 components) are remembered by the cell's hash, and only those are
compared with the part itself. Ties are never dominated, so the result is that of a full search. The memory of cells
is bounded and belongs to a task, and starts anew with each round's codebooks.

Rows are read once into the grid and stored; each round is one pass over the stored rows in which a task sends a
count and a sum per used entry, so shuffles and the driver see tasks x parts x entries rows, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import prepare_python, quoted
from tidewater.session import discard, scratch_path, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CELL_BITS = 5
KNOWN_CELLS = 1 << 17
#: Integer components beyond this saturate, so that squared distances and sums fit 64 bits.
LIMIT = 1 << 26


def _fixed(column: pa.Array, scale: int) -> list[bytes | None]:
    """Each vector on the grid as little-endian 32-bit integers; None where it is not to be kept."""
    out: list[bytes | None] = [None] * len(column)
    for row, vector in enumerate(column):
        values = vector.values
        if values is None or not len(values) or values.null_count:
            continue
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            out[row] = np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype("<i4").tobytes()
    return out


class Cells:
    """Nearest entries of one codebook, by remembered cells."""

    def __init__(self, codebook: np.ndarray, bits: int = CELL_BITS, known: int = KNOWN_CELLS):
        self.codebook, self.bits, self.bound = codebook.astype(np.int64), bits, known
        self.known: dict[bytes, np.ndarray] = {}
        self.exact = self.asked = 0

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries, ascending, that no other entry is nearer than to all of its box.

        The sphere around the box rules out most entries by their distance from its middle, for all cells in one
        product; with a margin for its rounding.
        """
        entries, low = self.codebook, cells << self.bits
        side = (1 << self.bits) - 1
        middle, points = low + side / 2, entries.astype(float)
        squares = (middle * middle).sum(1)[:, None], (points * points).sum(1)[None]
        apart = np.sqrt(np.maximum(squares[0] - 2 * (middle @ points.T) + squares[1], 0))
        margin = 1e-6 * np.sqrt(squares[0] + squares[1].max()) + 1e-3
        which, of = np.nonzero(apart <= apart.min(1)[:, None] + side * np.sqrt(cells.shape[1]) + margin)
        below, above = low[which] - entries[of], entries[of] - (low[which] + side)
        near, far = np.maximum(np.maximum(below, above), 0), np.maximum(abs(below), abs(above))
        starts = np.searchsorted(which, np.arange(len(cells)))
        most = np.minimum.reduceat(np.einsum("ij,ij->i", far, far), starts)
        kept = np.einsum("ij,ij->i", near, near) <= most[which]
        return np.split(of[kept], np.cumsum(np.add.reduceat(kept.astype(np.int64), starts))[:-1])

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every row's nearest entry, ties to the lower index, and its squared distance."""
        values = values.astype(np.int64)
        cells = values >> self.bits
        first: dict[bytes, int] = {}
        keys = [cell.tobytes() for cell in cells.astype(np.int32)]
        row_cell = np.fromiter((first.setdefault(key, len(first)) for key in keys), np.int64, len(keys))
        if len(self.known) + len(first) > self.bound:
            self.known.clear()
        new = [key for key in first if key not in self.known]
        if new:
            made = np.frombuffer(b"".join(new), np.int32).reshape(len(new), -1).astype(np.int64)
            for start in range(0, len(new), 1024):
                self.known.update(zip(new[start:start + 1024], self._undominated(made[start:start + 1024])))
        lists = [self.known[key] for key in first]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        row_sizes = sizes[row_cell]
        ends = np.cumsum(row_sizes)
        places = np.arange(ends[-1]) + np.repeat(starts[row_cell] - ends + row_sizes, row_sizes)
        entries = np.concatenate(lists)[places]
        rows = np.repeat(np.arange(len(values)), row_sizes)
        apart = values[rows] - self.codebook[entries]
        distance = np.einsum("ij,ij->i", apart, apart)
        best = np.minimum.reduceat(distance, ends - row_sizes)
        hits = np.flatnonzero(distance == best[rows])
        _, lowest = np.unique(rows[hits], return_index=True)
        self.exact += len(entries)
        self.asked += len(values)
        return entries[hits[lowest]], best


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """The batch's vectors, padded with zeros to a whole number of components per part: rows x parts x width."""
    rows = np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1)
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % parts))).reshape(len(rows), parts, -1)


def on_grid(vectors: DataFrame, vec_id: str, embedding: str, label: str | None, path: str,
            scale: int = SCALE) -> DataFrame:
    """vec_id, label and vector (little-endian 32-bit integers) of the rows that are kept, stored at `path`."""
    spark = vectors.sparkSession
    prepare_python(spark)
    columns = [quoted(vec_id).alias("vec_id"), (quoted(label) if label else F.lit(None).cast("int")).alias("label")]
    read = vectors.filter(quoted(embedding).isNotNull()).select(*columns, quoted(embedding).alias("vector"))
    kinds = [read.schema[name].dataType.simpleString() for name in ("vec_id", "label")]

    def fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _fixed(batch.column(2), scale)
            keep = pa.array([i for i, x in enumerate(found) if x is not None], pa.int64())
            yield pa.record_batch([batch.column(0).take(keep), batch.column(1).take(keep),
                                   pa.array([x for x in found if x is not None], pa.binary())],
                                  names=["vec_id", "label", "vector"])

    return written(spark, read.mapInArrow(fixed, f"vec_id {kinds[0]}, label {kinds[1]}, vector binary"), path)


def learn(grid: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
          cell_bits: int = CELL_BITS) -> list[np.ndarray]:
    """The codebooks (one array of entries x width per part); empty without rows.

    They start as the parts of the first rows by id, nulls last, then by vector.
    """
    spark = grid.sparkSession
    start = grid.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not start:
        return []
    books = _matrix(pa.array([bytes(r["vector"]) for r in start], pa.binary()), parts).transpose(1, 0, 2).astype(np.int64)
    width = books.shape[2]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)  # parts x entries x width integers

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = [Cells(book, cell_bits) for book in shared.value]
            sums, counts = np.zeros_like(shared.value), np.zeros(shared.value.shape[:2], np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                values = _matrix(batch.column(0), parts)
                for part in range(parts):
                    found, _ = cells[part].nearest(values[:, part])
                    np.add.at(sums[part], found, values[:, part])
                    counts[part] += np.bincount(found, minlength=len(counts[part]))
            part, entry = np.nonzero(counts)
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
                                   pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
                                  names=["part", "entry", "n", "sums"])

        added = grid.select("vector").mapInArrow(totals, "part int, entry int, n long, sums array<long>")
        for row in added.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(
                *[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect():  # parts x entries at most
            books[row["part"], row["entry"]] = np.array(row["sums"], np.int64) // row["n"]
        shared.unpersist()
    return list(books)


def encode(grid: DataFrame, books: list[np.ndarray], cell_bits: int = CELL_BITS) -> DataFrame:
    """vec_id, label, code (two hex digits per part) and error (squared distances summed over parts)."""
    kinds = [grid.schema[name].dataType.simpleString() for name in ("vec_id", "label")]
    shared = grid.sparkSession.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book, cell_bits) for book in shared.value]
        for batch in batches:
            if not len(batch):
                continue
            values = _matrix(batch.column(2), len(cells))
            found = [cell.nearest(values[:, part]) for part, cell in enumerate(cells)]
            codes = np.stack([entry for entry, _ in found], 1).astype(np.uint8)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([code.tobytes().hex() for code in codes]),
                                   pa.array(sum(distance for _, distance in found), pa.int64())],
                                  names=["vec_id", "label", "code", "error"])

    return grid.mapInArrow(coded, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of the entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label", *,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             cell_bits: int = CELL_BITS) -> tuple[DataFrame, list[np.ndarray]]:
    """The rows' codes and the codebooks: vec_id, code, error, label_error (errors summed over equal labels).

    Rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are vectors of
    another length than that of the smallest id's (null ids last, then by vector). A length that `parts` does not
    divide is padded with zeros. Integer components beyond 2**26 saturate. Null ids are coded like others; rows that
    repeat an id are rows of their own and stand in the order of their vectors where the codebooks start. Null
    labels are one label. Fewer rows than `entries` make as many entries. An empty table gives an empty one and no
    codebooks; other columns are no input. `entries` is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = vectors.sparkSession
    place = scratch_path(spark, "grid")
    grid = on_grid(vectors, vec_id, embedding, label, place, scale)
    first = grid.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if first:
        grid = grid.filter(F.octet_length("vector") == len(first[0]["vector"]))
    books = learn(grid, parts, entries, rounds, cell_bits)
    # Stored, as the codes are read twice and an aggregate ahead of a join keeps Spark from splitting a hot label.
    coded = written(spark, encode(grid, books, cell_bits), scratch_path(spark, "codes"))
    discard(spark, place)
    totals = written(spark, coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")),
                     scratch_path(spark, "label-errors"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error"), books
