"""Fill-in-the-middle training texts by rotating blocks in place, and back again.

A text is cut into lines at two places that follow from its id alone. The bytes go into one
bytearray with a sentinel in front of each of the three parts::

    psm   <P>prefix <M>middle <S>suffix  ->  <P>prefix <S>suffix <M>middle
    spm   <P>prefix <M>middle <S>suffix  ->  <S>suffix <P>prefix <M>middle

Both orders are one rotation of neighbouring blocks: reversing each block and then both together
exchanges them where they stand. ``restored`` finds the sentinels in the output, rotates by the
other amount and takes them out, which gives the text byte for byte. A text that has a sentinel in
it already, or is empty, is left as it is, so a sentinel in an output is always one of ours: each
begins with ``<`` and has no other, so none can come about where two parts meet.

Only this text is held while a task works on it, plus its bytearray. Batches are handed on in
slices of about a megabyte, so what a worker holds does not hang on the size of an Arrow batch.

Nulls: a null text is an empty one. A null id is cut by the hash of the word ``null``, so all rows
without an id are cut at the same shares. Repeated rows are cut alike. An empty table gives an
empty result. Other columns of the table are not looked at; ``fill_in_middle`` keeps them,
except those with the names it adds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold.llm.base import slices

SWAP_BYTES = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ADDED = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
])


@dataclass(frozen=True)
class Rules:
    """Seed of the cuts, percent of texts that are rearranged, percent of these that take spm."""

    seed: int = 7
    rate: int = 100
    spm: int = 50

    def draws(self, doc_id: int | None) -> list[int]:
        """Four numbers below 2**32 for an id."""
        name = f"{self.seed}:{'null' if doc_id is None else doc_id}"
        return np.frombuffer(hashlib.sha256(name.encode()).digest()[:16], ">u4").tolist()


def reverse(block: np.ndarray) -> None:
    """Reverse in place, swapping a bounded number of bytes at a time from both ends."""
    low, high = 0, len(block)
    while high - low > 1:
        step = min(SWAP_BYTES, (high - low) // 2)
        front = block[low : low + step].copy()
        block[low : low + step] = block[high - step : high][::-1]
        block[high - step : high] = front[::-1]
        low, high = low + step, high - step


def rotate(buffer: bytearray, begin: int, middle: int, end: int) -> None:
    """Exchange ``[begin, middle)`` and ``[middle, end)`` by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view[begin:middle])
    reverse(view[middle:end])
    reverse(view[begin:end])


def line_ends(text: bytes) -> np.ndarray:
    """Where each line ends, its line feed included; a rest without one is a line too."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A) + 1
    if text and not text.endswith(b"\n"):
        ends = np.append(ends, len(text))
    return ends


def code_points(text: bytes, begin: int, end: int) -> int:
    part = np.frombuffer(text, np.uint8)[begin:end]
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def arranged(text: bytes, doc_id: int | None, rules: Rules) -> tuple[int, str, int | None, int | None, bytes]:
    """``(lines, form, code points of prefix and of middle, output)``."""
    ends = line_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = rules.draws(doc_id)
    if not n or h3 % 100 >= rules.rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
    buffer = bytearray(text)
    for at, sentinel in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    form = "spm" if h4 % 100 < rules.spm else "psm"
    rotate(buffer, 0 if form == "spm" else middle, suffix, len(buffer))
    return n, form, code_points(text, 0, a), code_points(text, a, b), bytes(buffer)


def restored(output: bytes, form: str | None) -> bytes:
    """The text from its output and form alone."""
    if form not in ("psm", "spm"):
        return output
    buffer = bytearray(output)
    # where the exchanged blocks meet, and where the one that comes first in the text is
    begin = 0 if form == "spm" else output.index(SUFFIX)
    meet = output.index(PREFIX if form == "spm" else MIDDLE)
    rotate(buffer, begin, meet, len(buffer))
    middle, suffix = buffer.index(MIDDLE), buffer.index(SUFFIX)
    for at in (suffix, middle, 0):
        del buffer[at : at + len(PREFIX)]
    return bytes(buffer)


def _strings(texts: list[bytes]) -> pa.Array:
    """Bytes that are UTF-8 as they came from Spark; not checked a second time."""
    return pa.array(texts, pa.binary()).view(pa.string())


def fill_in_middle(
    docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", check: bool = False,
) -> DataFrame:
    """All columns of every document with ``n, form, prefix_chars, middle_chars, output`` added.

    With ``check`` also ``restored``: the text as it comes back from output and form.
    """
    added = T.StructType([*ADDED.fields, *([T.StructField("restored", T.StringType())] if check else [])])
    keep = [c for c in docs.columns if c not in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, keep.index(text_col)):
            ids = batch.column(keep.index(id_col)).to_pylist()
            texts = batch.column(keep.index(text_col)).cast(pa.binary()).to_pylist()
            n, form, before, between, output = zip(*(arranged(t or b"", i, rules) for i, t in zip(ids, texts)))
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()),
                       pa.array(between, pa.int64()), _strings(output)]
            if check:
                columns.append(_strings([restored(o, f) for o, f in zip(output, form)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*keep, *added.names])

    rows = docs.select(*keep)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


def restore(arranged_docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of rows with ``output`` and ``form``, with their text as ``text_col`` (replaced if there)."""
    keep = [c for c in arranged_docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, keep.index("output")):
            outputs = batch.column(keep.index("output")).cast(pa.binary()).to_pylist()
            texts = [restored(o or b"", f) for o, f in zip(outputs, batch.column(keep.index("form")).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, _strings(texts)], names=[*keep, text_col])

    rows = arranged_docs.select(*keep)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def digests(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return fill_in_middle(rows, rules, check=True).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
