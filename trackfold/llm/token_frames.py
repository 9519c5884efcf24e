"""Token ids in files of independent zstandard frames with a trailing seek table.

File layout (the public "seekable format" of zstandard, all numbers little-endian)::

    frame*                    token ids, 2 bytes each (4 if the vocabulary is larger)
    skippable frame           magic 0x184D2A5E, u32 size
      entry per frame         u32 compressed size, u32 plain size, u32 checksum
      footer                  u32 number of frames, u8 0x80, u32 0x8F92EAB1

The checksum is the lower half of XXH64 of the frame's plain bytes and is compared on every
read. Any zstandard reader can decompress a file as a whole. A frame ends with a document once
it holds ``FRAME_IDS`` ids; a document longer than ``4 * FRAME_IDS`` is cut into several frames,
so a frame stays small.

``write_tokens`` range-partitions documents by id (repeated ids are spread further by row
number), so a partition is a stretch of ids in ascending order. Its task encodes and writes one
file and hands Spark one index row per document: ``file, offset, n_tokens`` in ids. The index is
a Parquet table committed by Spark: a lost or repeated attempt leaves a file that no index row
names. ``read_tokens`` reads index rows wherever Spark puts them and decompresses only frames
that hold wanted documents.

The tokenizer is the ``tokenizers`` library. No token crosses white space, so a task encodes
each word once and keeps a bounded table of words; ``tests/llm`` compare this with encoding whole
texts.

A null or blank text has no ids but the end id. Null ids come first. Rows with the same id are
written one after the other, in no set order. Empty table: no files, an empty index.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackfold.llm.base import bounded, text_bytes

TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
FRAME_IDS = 1 << 16
LEVEL = 3
WORDS_KEPT = 600_000
CHUNK_BYTES = 1 << 20
TOGETHER = 256
INDEX = pa.schema([
    ("doc_id", pa.int64()), ("part", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
INDEX_DDL = "doc_id bigint, part int, file string, offset bigint, n_tokens bigint"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordCoder(dict):
    """Ids of texts, by way of a table of words that are encoded once.

    Words are numbered as they turn up; ``flat[start[n] : start[n] + length[n]]`` are the ids of
    word ``n``. The table starts anew once it holds ``WORDS_KEPT`` words.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = _tokenizer(path)
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new: list[bytes] = []
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def _encode_new(self) -> None:
        """Encode the new words, many in one text with blanks between: a call costs as much as ten words."""
        if not self.new:
            return
        words = [w.decode("utf-8", "replace") for w in self.new]
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        flat, counts = [], []
        cuts = range(0, len(words), TOGETHER)
        found = self.tokenizer.encode_batch([" ".join(words[c : c + TOGETHER]) for c in cuts], add_special_tokens=False)
        for c, e in zip(cuts, found):
            begin = np.cumsum(size[c : c + TOGETHER]) - size[c : c + TOGETHER]
            at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            flat.append(np.array(e.ids, np.uint32))
            counts.append(np.bincount(np.searchsorted(begin, at, "right") - 1, minlength=len(begin)))
        counts = np.concatenate(counts)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.length = np.concatenate([self.length, counts])
        self.flat = np.concatenate([self.flat, *flat])
        self.new = []

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. The library lower-cases; that a capital's word is looked up once."""
        if len(self) > WORDS_KEPT or len(self.flat) > 8 * WORDS_KEPT:
            self.clear()
        lookup = self.__getitem__
        numbers = []
        for text in texts:
            # names of special tokens are told by case
            words = (text if b"<|" in text else text.lower()).split()
            numbers.append(np.fromiter(map(lookup, words), np.int64, len(words)))
        self._encode_new()
        out = []
        for n in numbers:
            length = self.length[n]
            ends = np.cumsum(length)
            shift = np.repeat(self.start[n] - (ends - length), length)
            out.append(self.flat[shift + np.arange(len(shift))])
        return out


@lru_cache(maxsize=1)
def _coder(path: str) -> WordCoder:
    """A worker's table of words, kept from task to task."""
    return WordCoder(path)


class FrameWriter:
    """Write arrays of ids one after the other; ``close`` adds the seek table."""

    def __init__(self, sink, dtype: str, level: int = LEVEL):
        self.sink, self.dtype = sink, np.dtype(dtype)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0
        self.table = bytearray()

    def add(self, ids: np.ndarray) -> int:
        """Add a document; returns its offset in ids."""
        offset = self.n
        self.n += len(ids)
        for at in range(0, len(ids), 4 * FRAME_IDS):
            part = ids[at : at + 4 * FRAME_IDS]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held >= FRAME_IDS:
                self._flush()
        return offset

    def _flush(self) -> None:
        if not self.n_held:
            return
        plain = np.concatenate(self.held).astype(self.dtype).tobytes()
        packed = self.zstd.compress(plain)
        self.sink.write(packed)
        self.table += struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        footer = struct.pack("<IBI", len(self.table) // 12, 0x80, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(self.table) + len(footer)) + self.table + footer)


class FrameReader:
    """Read stretches of ids; keeps the last frame, so reading in order decompresses each once."""

    def __init__(self, source, size: int, dtype: str):
        self.source, self.dtype = source, np.dtype(dtype)
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("the file has no seek table with checksums")
        source.seek(size - 9 - 12 * frames)
        table = np.frombuffer(source.read(12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.table = table
        self.at = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.first = np.concatenate(([0], np.cumsum(table[:, 1]))) // self.dtype.itemsize
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, self.dtype))
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> np.ndarray:
        if self.last[0] != number:
            packed, plain, checksum = self.table[number]
            self.source.seek(int(self.at[number]))
            data = self.zstd.decompress(self.source.read(int(packed)), max_output_size=int(plain))
            if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {number} does not match its checksum")
            self.last = number, np.frombuffer(data, self.dtype)
        return self.last[1]

    def read(self, offset: int, n: int) -> np.ndarray:
        parts = [np.zeros(0, self.dtype)]
        number = int(np.searchsorted(self.first, offset, "right")) - 1
        while n > 0:
            begin = offset - int(self.first[number])
            part = self.frame(number)[begin : begin + n]
            parts.append(part)
            offset, n, number = offset + len(part), n - len(part), number + 1
        return np.concatenate(parts)


def width(tokenizer_path: str) -> str:
    return "<u2" if _tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode and write all documents under ``path`` in ascending id order; returns the index."""
    spark = docs.sparkSession
    dtype = width(tokenizer_path)
    name = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        file = f"{path}/part-{part:06d}-{name[:8]}-{task.taskAttemptId()}.zst"
        coder = writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, at = pa.fs.FileSystem.from_uri(file)
                fs.create_dir(os.path.dirname(at), recursive=True)
                sink = fs.open_output_stream(at, compression=None)
                coder, writer = _coder(tokenizer_path), FrameWriter(sink, dtype)
            offsets, lengths = [], []
            for texts in _chunks(text_bytes(batch.column(1))):
                for ids in coder.encode(texts):
                    ids = np.append(ids, np.uint32(end_id))
                    offsets.append(writer.add(ids))
                    lengths.append(len(ids))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * n, pa.int32()), pa.array([file] * n), pa.array(offsets, pa.int64()),
                 pa.array(lengths, pa.int64())], schema=INDEX)
        if writer is not None:
            writer.close()
            sink.close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = rows.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").drop("_row")
    index = f"{path}/index"
    placed.mapInArrow(write, INDEX_DDL).write.parquet(index)
    return spark.read.schema(INDEX_DDL).parquet(index)


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for text in texts:
        chunk.append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def read_tokens(index: DataFrame, tokenizer_path: str, digest: bool = False) -> DataFrame:
    """Ids of the documents of the index rows given: these rows with ``ids array<int>`` added.

    With ``digest`` the ids are not handed on, but their CRC-32 as little-endian 32-bit numbers.
    """
    dtype = width(tokenizer_path)
    added, kind, arrow = ("ids_crc32", "bigint", pa.int64()) if digest else ("ids", "array<int>", pa.list_(pa.int32()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = reader = source = None
        for batch in batches:
            out = []
            for file, offset, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "n_tokens"))):
                if file != name:
                    if source is not None:
                        source.close()
                    fs, at = pa.fs.FileSystem.from_uri(file)
                    source = fs.open_input_file(at)
                    name, reader = file, FrameReader(source, source.size(), dtype)
                ids = reader.read(offset, n)
                out.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32))
            yield batch.append_column(added, pa.array(out, arrow))

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields)
    return index.mapInArrow(read, f"{ddl}, {added} {kind}")


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before. Sums per file, then the offset in the file."""
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("part").alias("_part"), F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    return index.join(bounded(files), F.col("part") == F.col("_part")).withColumn(
        "start", F.col("_before") + F.col("offset")).drop("_part", "_before")


def token_digests(index: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document, read back from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    return read_tokens(with_starts(index), tokenizer_path, digest=True).select(
        "doc_id", "start", "n_tokens", "ids_crc32")
