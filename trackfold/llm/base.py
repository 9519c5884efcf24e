"""Text helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
# of a few numbers or a digest each: some tens of MB
BROADCAST_ROWS = 300_000
SLICE_BYTES = 1 << 20
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lowered(text: Column) -> Column:
    """Text with A-Z, and no other letters, in lower case; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def words(text: Column) -> Column:
    """Words between blanks, tabs, line feeds, vertical tabs, form feeds and returns."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text of an Arrow column; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator], Iterator]:
    """An Arrow map that handles every batch alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
    return run


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of a text column, or numbers of a list column.

    Handled one after the other, they bound what a worker holds, however large Spark's batches are.
    """
    for batch in batches:
        values = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        lengths = np.array(length(values).fill_null(0), np.int64)
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            if end > begin:
                yield batch.slice(begin, end - begin)


def bounded(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it has few rows; as it is, to be shuffled, beyond that."""
    return F.broadcast(side) if side.count() <= rows else side


def without(docs: DataFrame, gone: DataFrame, id_col: str, mark: Callable[[], Column]) -> DataFrame:
    """The rows of ``docs`` that are not in ``gone`` (``id, mark``), with all their columns.

    ``mark()`` is an expression on ``docs`` that tells rows of one id apart.
    """
    marked = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), mark().alias("_mark"))
    gone = gone.select(F.col("id").alias("_gone_id"), F.col("mark").alias("_gone_mark")).distinct()
    same = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_mark") == F.col("_gone_mark"))
    return marked.join(bounded(gone), same, "left_anti").select("_doc.*")
