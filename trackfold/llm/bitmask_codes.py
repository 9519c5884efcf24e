"""Compression of vectors to one byte per part, with nearest entries found by slice-and-intersect bitmasks.

A component ``x`` becomes the integer ``floor(1024 * x)``; vectors are cut into equal consecutive
parts. Each part position has a codebook of at most 256 entries, which starts as that part of the
smallest ids and is moved ``rounds`` times to the floored mean of the parts that are nearest to
each entry. A vector's code is the number of its nearest entry for each part.

Nearest entries. The coordinates of a codebook are sorted in every dimension, and each place in that
order carries the mask of the entries before it, as uint64 words. A part within ``r`` of an entry
is within ``r`` of it in every dimension: two places in each order give the range, the XOR of
their masks its entries, and the AND over all dimensions the candidates, none of them missed.
Only candidates are compared. The initial ``r`` is about the distance expected from the round
before (from entry to entry in the first). Where the best candidate is farther than ``r``, its
distance is the next and last ``r``; where there is no candidate, ``r`` is doubled. Ties go to the
lower number, whatever ``r`` was, so results do not hang on it.

Work on Spark: vectors are made integers once and written to the shared folder; every round maps
that table to sums per part and entry, one row per task and entry, which are added by a shuffle.
Through the driver go the codebooks only, ``256 * dimensions`` numbers.

Nulls: vectors that are null, or hold a null or a component that is not finite, are dropped, as are
empty ones and those whose length is no multiple of the number of parts; so are vectors of another
length than that of the smallest id kept. A null id comes after all others in the start; of equal ids the
smaller vector comes first. Fewer vectors than entries give smaller codebooks, none an empty result. Integers
beyond ``LARGEST`` (components beyond 65,536) are set to it, so that sums of squares fit in a long.
Columns beyond id, vector and label are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold.llm.base import bounded
from trackfold.session import cut

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LARGEST = 1 << 26
# squares of differences below this are exact in doubles, as are sums over 128 dimensions
EXACT = 1 << 22
BLOCK = 4096
WORD = 64


@dataclass(frozen=True)
class Codebooks:
    """``books[part]`` is an integer array of ``(entries, width)``; ``radius[part]`` where to begin a search."""

    books: list[np.ndarray]
    radius: list[int]

    def sha256(self) -> str:
        """Of all numbers in decimal by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


class Slices:
    """A codebook with its coordinates sorted in each dimension and the masks of all beginnings."""

    def __init__(self, book: np.ndarray):
        self.book = book
        n, width = book.shape
        order = np.argsort(book, axis=0, kind="stable")
        self.sorted = np.take_along_axis(book, order, 0).T.copy()
        self.masks = np.zeros((width, n + 1, -(-n // WORD)), np.uint64)
        for d in range(width):
            for place, entry in enumerate(order[:, d].tolist()):
                self.masks[d, place + 1] = self.masks[d, place]
                self.masks[d, place + 1, entry // WORD] |= np.uint64(1 << entry % WORD)
        self.norms = (book.astype(np.float64) ** 2).sum(1)

    def candidates(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which entries are within ``radius`` of each part in every dimension, as booleans."""
        mask = np.full((len(parts), self.masks.shape[2]), np.uint64(2**64 - 1))
        for d, (coordinates, masks) in enumerate(zip(self.sorted, self.masks)):
            low = np.searchsorted(coordinates, parts[:, d] - radius, "left")
            high = np.searchsorted(coordinates, parts[:, d] + radius, "right")
            mask &= masks[high] ^ masks[low]
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        return bits[:, : len(self.book)].view(bool)

    def compare(self, parts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of the chosen entries of each part (-1 without any) and its squared distance."""
        best = np.full(len(parts), -1, np.int64)
        far = np.zeros(len(parts), np.int64)
        many = np.count_nonzero(chosen, axis=1)
        small = max(np.abs(parts).max(initial=0), np.abs(self.book).max(initial=0)) < EXACT
        if small and many.sum() * 8 > chosen.size:
            # most entries are candidates: all products at once, in whole numbers that doubles hold
            x = parts.astype(np.float64)
            square = (x * x).sum(1)[:, None] - 2 * (x @ self.book.T.astype(np.float64)) + self.norms
            square[~chosen] = np.inf
            best = np.where(many > 0, square.argmin(1), -1)
            found = np.flatnonzero(many)
            far[found] = square[found, best[found]].astype(np.int64)
            return best, far
        row, entry = np.nonzero(chosen)
        if len(row):
            square = ((parts[row] - self.book[entry]) ** 2).sum(1)
            found = np.flatnonzero(many)
            starts = np.cumsum(many[found]) - many[found]
            least = np.minimum.reduceat(square, starts)
            far[found] = least
            ties = np.flatnonzero(square == np.repeat(least, many[found]))
            rows, first = np.unique(row[ties], return_index=True)
            best[rows] = entry[ties[first]]
        return best, far

    def nearest(self, parts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry of every part, the lower one of ties, and its squared distance."""
        best = np.empty(len(parts), np.int64)
        far = np.empty(len(parts), np.int64)
        for begin in range(0, len(parts), BLOCK):
            open_ = np.arange(begin, min(begin + BLOCK, len(parts)))
            reach = np.full(len(open_), max(radius, 1), np.int64)
            while len(open_):
                block = parts[open_]
                entry, square = self.compare(block, self.candidates(block, reach))
                sure = (entry >= 0) & (square <= reach * reach)
                best[open_[sure]], far[open_[sure]] = entry[sure], square[sure]
                reach = np.where(entry >= 0, np.ceil(np.sqrt(square)).astype(np.int64) + 1, reach * 2)[~sure]
                open_ = open_[~sure]
        return best, far


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """The vectors that are kept: ``vec_id, label`` and ``x array<int>``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(2)
            size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            # flatten leaves null lists out, so sizes and values fit together
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            owner = np.repeat(np.arange(len(size)), size)
            bad = np.bincount(owner, weights=~np.isfinite(values), minlength=len(size)) > 0
            keep = ~bad & (size > 0) & (size % parts == 0)
            with np.errstate(over="ignore"):
                scaled = np.floor(values[keep[owner]] * SCALE)
            whole = np.clip(scaled, -LARGEST, LARGEST).astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(size[keep]))).astype(np.int32)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.ListArray.from_arrays(pa.array(ends), pa.array(whole))],
                names=["vec_id", "label", "x"])

    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fields = [rows.schema["vec_id"], rows.schema["label"], T.StructField("x", T.ArrayType(T.IntegerType()))]
    table = cut(rows.mapInArrow(run, T.StructType(fields)))
    least, most = table.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least == most:
        return table
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x")).first()[0]
    return table.filter(F.size("x") == first)


def _parts(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """``(rows, parts, width)`` of the column ``x``."""
    x = batch.column(batch.schema.get_field_index("x"))
    return x.flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, parts, -1)


def _start(table: DataFrame, parts: int, entries: int) -> Codebooks | None:
    rows = table.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not rows:
        return None
    x = np.array([r["x"] for r in rows], np.int64).reshape(len(rows), parts, -1)
    books = [np.ascontiguousarray(x[:, p]) for p in range(parts)]
    radius = []
    for book in books:
        square = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2).astype(np.float64)
        np.fill_diagonal(square, np.inf)
        nearest = square.min(1)
        radius.append(int(np.sqrt(nearest[np.isfinite(nearest)].mean())) + 1 if len(book) > 1 else 1)
    return Codebooks(books, radius)


def _moved(table: DataFrame, codebooks: Codebooks) -> Codebooks:
    """The codebooks after one round over all vectors."""
    parts = len(codebooks.books)
    width = codebooks.books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in codebooks.books]
        shape = parts, len(codebooks.books[0])
        count, error, total = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros((*shape, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch, parts)
            for p in range(parts):
                part = np.ascontiguousarray(x[:, p])
                entry, square = slices[p].nearest(part, codebooks.radius[p])
                count[p] += np.bincount(entry, minlength=shape[1])
                np.add.at(error[p], entry, square)
                np.add.at(total[p], entry, part)
        p, entry = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[p, entry]),
                 pa.array(error[p, entry]), pa.array(list(total[p, entry]), pa.list_(pa.int64()))],
                names=["part", "entry", "n", "error", "total"])

    rows = table.select("x").mapInArrow(sums, "part int, entry int, n bigint, error bigint, total array<bigint>")
    added = rows.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.sum("error").cast("double").alias("error"),
        F.array(*[F.sum(F.col("total")[d]) for d in range(width)]).alias("total"))
    books = [b.copy() for b in codebooks.books]
    seen, error = np.zeros(parts), np.zeros(parts)
    for r in added.collect():
        books[r["part"]][r["entry"]] = [t // r["n"] for t in r["total"]]
        seen[r["part"]] += r["n"]
        error[r["part"]] += r["error"]
    return Codebooks(books, [int(np.sqrt(e / max(n, 1))) + 1 for e, n in zip(error, seen)])


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of a table of ``integers``; None without vectors."""
    codebooks = _start(table, parts, entries)
    for _ in range(rounds if codebooks else 0):
        codebooks = _moved(table, codebooks)
    return codebooks


def encode(table: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Per vector ``vec_id, label, code`` (a byte per part, two where a codebook has over 256 entries) and ``error``."""
    parts = len(codebooks.books)
    number = np.uint8 if len(codebooks.books[0]) <= 256 else np.dtype(">u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in codebooks.books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch, parts)
            found = [slices[p].nearest(np.ascontiguousarray(x[:, p]), codebooks.radius[p]) for p in range(parts)]
            codes = np.stack([entry for entry, _ in found], axis=1).astype(number)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(sum(square for _, square in found))], names=["vec_id", "label", "code", "error"])

    rows = table.select("vec_id", "label", "x")
    fields = [rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.BinaryType()),
              T.StructField("error", T.LongType())]
    return rows.mapInArrow(run, T.StructType(fields))


def decode(codes: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``vec_id`` and the ``vector`` that each code stands for."""
    books = [b / SCALE for b in codebooks.books]
    number = np.uint8 if len(books[0]) <= 256 else np.dtype(">u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                numbers = np.frombuffer(b"".join(batch.column(1).to_pylist()), number).reshape(batch.num_rows, -1)
                vectors = np.concatenate([b[numbers[:, p]] for p, b in enumerate(books)], axis=1)
                ends = np.arange(batch.num_rows + 1, dtype=np.int32) * vectors.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))],
                    names=["vec_id", "vector"])

    rows = codes.select("vec_id", "code")
    return rows.mapInArrow(run, T.StructType([rows.schema["vec_id"], T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """Per vector kept: ``vec_id, code`` (hex), ``error, label_error, codebooks_sha256``."""
    table = integers(vectors, id_col, vector_col, label_col, parts)
    codebooks = train(table, parts, entries, rounds)
    if codebooks is None:
        return table.select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
            F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = cut(encode(table, codebooks))
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(bounded(cut(by_label)), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(codebooks.sha256()).alias("codebooks_sha256"))
