"""SentencePiece encoding and decoding by suffix-array matching.

For a batch of texts: blanks become ``▁`` and one is put in front, as the model's normaliser
does. No piece holds a ``▁`` behind another character, so a text falls into chunks (``▁`` runs
with what follows) that are encoded alone, each distinct one once. Then

1. the new chunks are concatenated and their suffixes sorted by the first ``longest piece``
   characters;
2. every piece is binary-searched, all at once, for its range of suffixes: its occurrences;
3. the occurrences are edges (position, piece), sorted by position and length;
4. edges are relaxed. The model is a BPE model, whose segmentation is not the path of the best
   sum of scores: neighbouring symbols are merged along the edge of the best score first, the
   leftmost among equals, until no edge joins two neighbours. All chunks advance together, one
   merge each per round; a chunk of over ``LONG`` characters is merged with a heap instead, so
   its work stays n log n.

Characters without a piece become their UTF-8 bytes. Results are those of the ``sentencepiece``
library, which tests compare. Decoding puts the pieces' bytes together and takes the first blank
off; bytes that are no UTF-8 become U+FFFD.

A null or empty text has no ids and decodes to an empty text. A literal ``▁`` decodes to a
blank, as in the library. Repeated rows are encoded each, repeated ids do not matter, an empty
table gives an empty result; other columns are kept by
``encode_documents`` and ``decode_documents`` and not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold.llm.base import slices

SPACE = "▁"
LONG = 200
CHUNKS_KEPT = 250_000
CHUNKS_AT_ONCE = 40_000
BATCH_CHARS = 1 << 20
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


class Model:
    """Pieces of a model as arrays: characters, scores, bytes for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_id = np.full(256, sp.unk_id(), np.int32)
        self.unknown = sp.unk_id()
        plain, shown = [], []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                shown.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                shown.append(b"")
            elif sp.is_unknown(i):
                shown.append(" ⁇ ".encode())
            else:
                shown.append(piece.replace(SPACE, " ").encode())
                plain.append((i, piece, sp.get_score(i)))
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in plain):
            raise ValueError("pieces cross blanks: chunks cannot be encoded alone")
        self.ids = np.array([i for i, _, _ in plain], np.int32)
        self.scores = np.full(sp.get_piece_size(), -np.inf)
        self.scores[self.ids] = [s for _, _, s in plain]
        self.lengths = np.array([len(p) for _, p, _ in plain], np.int64)
        self.longest = int(self.lengths.max())
        self.chars = np.zeros((len(plain), self.longest), np.uint32)
        codes = np.frombuffer("".join(p for _, p, _ in plain).encode("utf-32-le"), np.uint32)
        inside = np.arange(self.longest) < self.lengths[:, None]
        self.chars[inside] = codes
        self.shown_start = np.concatenate(([0], np.cumsum([len(b) for b in shown])))
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.first_blank = np.array([b.startswith(b" ") and not sp.is_unknown(i) for i, b in enumerate(shown)])


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``flat[start : start + length]`` of every entry, one after the other."""
    ends = np.cumsum(length)
    shift = np.repeat(start - (ends - length), length)
    return flat[shift + np.arange(len(shift))]


def _packed(ranks: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of small numbers as big numbers of 64 bits, first column most significant."""
    per = 64 // bits
    rows, width = ranks.shape
    out = []
    for at in range(0, width, per):
        word = np.zeros(rows, np.uint64)
        for k in range(per):
            word <<= np.uint64(bits)
            if at + k < width:
                word |= ranks[:, at + k].astype(np.uint64)
        out.append(word)
    return out


def _first_not(keys: list[np.ndarray], wanted: list[np.ndarray], or_equal: bool) -> np.ndarray:
    """Binary search for each wanted row: how many sorted rows are smaller (or equal)."""
    low = np.zeros(len(wanted[0]), np.int64)
    high = np.full(len(low), len(keys[0]), np.int64)
    while (low < high).any():
        middle = np.minimum((low + high) >> 1, len(keys[0]) - 1)
        smaller, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for key, want in zip(keys, wanted):
            here = key[middle]
            smaller |= equal & (here < want)
            equal &= here == want
        go = (smaller | equal if or_equal else smaller) & (low < high)
        low, high = np.where(go, middle + 1, low), np.where(go, high, np.minimum(high, middle))
    return low


class Lattice:
    """All occurrences of all pieces in a concatenated text (0 between chunks), sorted by position."""

    def __init__(self, model: Model, codes: np.ndarray):
        n, width = len(codes), model.longest
        alphabet = np.unique(codes[codes > 0])
        known = np.isin(model.chars, alphabet) | (model.chars == 0)
        usable = known.all(axis=1)
        # only characters of pieces need a rank of their own; 1 is any other, 0 ends a chunk
        used = np.unique(model.chars[usable])
        used = used[used > 0]
        bits = 8 if len(used) < 250 else 16
        rank = lambda c: np.where(c == 0, 0, np.where(
            np.isin(c, used), np.searchsorted(used, c) + 2, 1)).astype(np.uint16)
        text = np.concatenate([rank(codes), np.zeros(width, np.uint16)])
        windows = np.lib.stride_tricks.sliding_window_view(text, width)[:n]
        keys = _packed(windows, bits)
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        pieces = rank(model.chars[usable])
        length = model.lengths[usable]
        top = np.where(np.arange(width) < length[:, None], pieces, (1 << bits) - 1)
        begin = _first_not(keys, _packed(pieces, bits), False)
        end = _first_not(keys, _packed(top, bits), True)
        many = end - begin
        position = gather(order, begin, many)
        length, piece = np.repeat(length, many), np.repeat(model.ids[usable], many)
        by_position = np.argsort(position * (width + 1) + length, kind="stable")
        position, length, self.piece = position[by_position], length[by_position], piece[by_position]
        self.first = np.searchsorted(position, np.arange(n + 1))
        self.lengths_at = np.zeros(n + 1, np.uint64)
        np.bitwise_or.at(self.lengths_at, position, np.uint64(1) << length.astype(np.uint64))

    def edge(self, position: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The piece at each position with that length, -1 where there is none."""
        length = np.minimum(length, 63).astype(np.uint64)
        here = self.lengths_at[position]
        there = (here >> length) & np.uint64(1) == 1
        before = np.bitwise_count(here & ((np.uint64(1) << length) - np.uint64(1)))
        at = np.minimum(self.first[position] + before, max(len(self.piece) - 1, 0))
        return np.where(there, self.piece[at] if len(self.piece) else -1, -1)


def _relax(model: Model, lattice: Lattice, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the characters of chunks; position and length of the symbols left, in text order."""
    position = gather(np.arange(start[-1] + length[-1]), start, length)
    size = np.ones(len(position), np.int64)
    chunk = np.repeat(np.arange(len(start)), length)
    done_position, done_size = [], []
    while len(position):
        piece = lattice.edge(position[:-1], size[:-1] + size[1:])
        score = np.full(len(position), -np.inf)
        score[:-1] = np.where((piece >= 0) & (chunk[:-1] == chunk[1:]), model.scores[piece], -np.inf)
        begins = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        best = np.maximum.reduceat(score, begins)
        symbols = np.diff(np.append(begins, len(chunk)))
        at_best = (score == np.repeat(best, symbols)) & (score > -np.inf)
        merged = np.flatnonzero(at_best)
        merged = merged[np.concatenate(([True], chunk[merged][1:] != chunk[merged][:-1]))] if len(merged) else merged
        size[merged] += size[merged + 1]
        stay = np.ones(len(position), bool)
        stay[merged + 1] = False
        open_chunk = np.repeat(best > -np.inf, symbols)
        done = stay & ~open_chunk
        done_position.append(position[done])
        done_size.append(size[done])
        stay &= open_chunk
        position, size, chunk = position[stay], size[stay], chunk[stay]
    position, size = np.concatenate(done_position), np.concatenate(done_size)
    order = np.argsort(position)
    return position[order], size[order]


def _relax_long(model: Model, lattice: Lattice, start: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long chunk, with a heap of the edges that join two neighbours."""
    size = [1] * length + [0]
    before, after = list(range(-1, length)), list(range(1, length + 2))
    heap: list[tuple[float, int, int]] = []

    def offer(a: int, piece: int) -> None:
        if piece >= 0:
            heapq.heappush(heap, (-model.scores[piece], a, size[a] + size[after[a]]))

    def look(a: int) -> None:
        if a >= 0 and after[a] < length:
            offer(a, int(lattice.edge(np.array([start + a]), np.array([size[a] + size[after[a]]]))[0]))

    at = np.arange(start, start + length - 1)
    for a, piece in enumerate(lattice.edge(at, np.full(length - 1, 2)).tolist()):
        offer(a, piece)
    while heap:
        _, a, total = heapq.heappop(heap)
        b = after[a]
        if not size[a] or b >= length or size[a] + size[b] != total:
            continue
        size[a], size[b] = total, 0
        after[a] = after[b]
        if after[b] < length:
            before[after[b]] = a
        look(before[a])
        look(a)
    sizes = np.array(size[:length])
    left = np.flatnonzero(sizes)
    return left + start, sizes[left]


class PieceCoder(dict):
    """Encode and decode texts, by way of a bounded table of chunks that are encoded once."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new: list[str] = []
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number

    def _encode_new(self) -> None:
        model = self.model
        while self.new:
            part, self.new = self.new[:CHUNKS_AT_ONCE], self.new[CHUNKS_AT_ONCE:]
            codes = np.frombuffer("\0".join(["", *part, ""]).encode("utf-32-le"), np.uint32)
            length = np.fromiter(map(len, part), np.int64, len(part)) + 1
            start = np.cumsum(length) - length
            # a chunk's leading ▁ takes the place of the separator; a zero ends the last one
            codes = codes.copy()[:-1]
            text = np.zeros(len(codes) + len(part), np.uint32)
            start = start + np.arange(len(part))
            inside = np.ones(len(text), bool)
            inside[start + length] = False
            codes[start - np.arange(len(part))] = ord(SPACE)
            text[inside] = codes
            text_nul = inside & (text == 0)
            text[text_nul] = 0x110000  # the character U+0000 itself is no separator
            lattice = Lattice(model, text)
            short = length <= LONG
            found = [_relax(model, lattice, start[short], length[short])] if short.any() else []
            found += [_relax_long(model, lattice, int(s), int(n)) for s, n in zip(start[~short], length[~short])]
            position = np.concatenate([p for p, _ in found])
            size = np.concatenate([s for _, s in found])
            order = np.argsort(position)
            position, size = position[order], size[order]
            ids = lattice.edge(position, size).astype(np.int32)
            owner = np.searchsorted(start, position, "right") - 1
            many = np.ones(len(ids), np.int64)
            unknown = np.flatnonzero(ids < 0)
            if len(unknown):
                spelt = [
                    model.byte_id[np.frombuffer(chr(c if c < 0x110000 else 0).encode("utf-8", "replace"), np.uint8)]
                    for c in text[position[unknown]].tolist()]
                many[unknown] = [len(b) for b in spelt]
                out = np.repeat(ids, many)
                out[out < 0] = np.concatenate(spelt)
                ids, owner = out, np.repeat(owner, many)
            counts = np.bincount(owner, minlength=len(part))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
            self.length = np.concatenate([self.length, counts])
            self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > CHUNKS_KEPT or len(self.flat) > 8 * CHUNKS_KEPT:
            self.clear()
        lookup = self.__getitem__
        numbers = []
        for text in texts:
            if not text:
                chunks = []
            elif "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
                chunks = [c[1:] for c in CHUNK.findall(SPACE + text.replace(" ", SPACE))]
            else:
                chunks = text.split(" ")
            numbers.append(np.fromiter(map(lookup, chunks), np.int64, len(chunks)))
        self._encode_new()
        return [gather(self.flat, self.start[n], self.length[n]) for n in numbers]

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        start = self.model.shown_start[ids]
        raw = gather(self.model.shown, start, self.model.shown_start[ids + 1] - start).tobytes()
        return raw[bool(self.model.first_blank[ids[0]]):].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _coder(path: str) -> PieceCoder:
    return PieceCoder(Model(path))


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _encoded(column: pa.Array, path: str) -> list[np.ndarray]:
    coder, out, at, texts = _coder(path), [], 0, _texts(column)
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < BATCH_CHARS:
            size += len(texts[end])
            end += 1
        out += coder.encode(texts[at:end])
        at = end
    return out


def _ids_column(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _decoded(column: pa.Array, path: str) -> pa.Array:
    """Texts of a list column, straight from its numbers."""
    decode = _coder(path).decode
    values, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([decode(values[a:b]) if ok else "" for a, b, ok in zip(starts, starts[1:], valid)], pa.string())


def encode_documents(
    docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decode: bool = False,
) -> DataFrame:
    """All columns of every document with ``ids_col array<int>`` added (one of that name is replaced).

    With ``decode`` the text is replaced by what the ids decode to, in the same pass: one worker a
    task, a slice of documents at a time.
    """
    keep = [c for c in docs.columns if c != ids_col]
    place = keep.index(text_col)

    def encode(batches):
        for batch in slices(batches, place):
            ids = _ids_column(_encoded(batch.column(place), model_path))
            columns = list(batch.columns)
            if decode:
                columns[place] = _decoded(ids, model_path)
            yield pa.RecordBatch.from_arrays([*columns, ids], names=[*keep, ids_col])

    rows = docs.select(*keep)
    return rows.mapInArrow(encode, T.StructType([*rows.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode_documents(encoded: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of every row with the text of its ids as ``text_col`` (one of that name is replaced)."""
    keep = [c for c in encoded.columns if c != text_col]

    def decode(batches):
        for batch in slices(batches, keep.index(ids_col)):
            texts = _decoded(batch.column(keep.index(ids_col)), model_path)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*keep, text_col])

    rows = encoded.select(*keep)
    return rows.mapInArrow(decode, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_crc32`` and whether the ids decode to the text.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers; ``round_trip`` is
    false only where the text has a literal ``▁``.
    """
    def digest(batches):
        for batch in slices(batches, 1):
            texts = _texts(batch.column(1))
            ids = _encoded(batch.column(1), model_path)
            decode = _coder(model_path).decode
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                pa.array([decode(i) == t for i, t in zip(ids, texts)], pa.bool_()),
            ], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(digest, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, round_trip boolean")
