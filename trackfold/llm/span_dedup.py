"""Substring dedup by sliding runs of pieces.

A text is cut into pieces between words. It is cut behind a word that ends in ``. ! ? , ; :``,
and, so that a long stretch without such words is several pieces too, at content-defined places:
of any ``WINDOW`` gaps between words in a row one is cut, a gap behind punctuation or else the
one with the least hash of the two words beside it (all of them if equal). These cuts depend on
nothing but the words near by in lower case (A-Z), so texts that share a passage share its cuts
from at most ``WINDOW`` words inside its edges on. It is also cut at line ends and where a
lower-case word is followed by a capitalised one, so that a passage pasted into the middle of a
sentence still begins a piece of its own.

From every piece a run goes on, and up to every piece a run comes from before, to the nearest
cut of the first kind (or the edge of the text) that gives it ``run`` pieces and ``min_words``
words; its 128-bit hash is over its words in lower case, whatever the white space. Thus every
piece of a repeated passage that lies between two cuts ``min_words`` apart is in a repeated run,
and of any repeated passage of ``min_words + 2 * WINDOW`` words only less than a window at each
edge can stay, where the passage begins or ends inside a piece.

Runs are joined globally. Counting takes one half of the hash and combines on the map side; only
runs whose half occurs twice go on, with the whole hash. The first run of a hash, by smallest id
text hash and then position, stays; pieces covered by any other run of it are removed.

A null or empty text has no pieces and comes back as empty text. A text shorter than one run is
one run as a whole, so it goes only where an earlier text is the same. A document is its id and
a hash of its text: rows that share both are one document and keep or lose the same pieces; of
rows that share the id alone the one with the smaller hash comes first. A null id comes before
all others. A document that repeats an earlier one whole comes back empty. Empty table: empty
result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackfold.session import cut

RUN = 2
MIN_WORDS = 24
WINDOW = 13
STOPS = np.isin(np.arange(256), list(b".!?,;:"))
WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
POWERS = np.random.Generator(np.random.PCG64(4)).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
RUNS_DDL = "high bigint, low bigint, doc_id bigint, mark bigint, at int, many int"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _over_window(pick: np.ufunc, values: np.ndarray) -> np.ndarray:
    """``pick`` of every ``WINDOW`` values in a row."""
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        values = pick(values[:-step], values[step:])
        width += step
    return values


def _chosen(ranks: np.ndarray) -> np.ndarray:
    """Which ranks are the least of any ``WINDOW`` in a row."""
    if len(ranks) < WINDOW:
        return np.zeros(len(ranks), bool)
    padded = np.zeros(len(ranks) + WINDOW - 1, np.uint64)
    padded[WINDOW - 1:len(ranks)] = _over_window(np.minimum, ranks)
    return _over_window(np.maximum, padded) == ranks


def _cuts(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words in lower case with a blank behind each, where each begins there and in ``data``, and
    per gap between words whether it is cut by its words, and whether it is cut at all."""
    spoken = b" ".join([*data.lower().split(), b""])
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(WHITE[raw], prepend=True, append=True))
    begins, ends = edges[0::2], edges[1::2]
    sizes = ends - begins + 1
    at = np.cumsum(sizes) - sizes
    if len(begins) < 2:
        none = np.zeros(0, bool)
        return spoken, at, begins, none, none
    place = np.arange(len(spoken)) - np.repeat(at, sizes)
    letters = np.frombuffer(spoken, np.uint8).astype(np.uint64)
    hashes = _mixed(np.add.reduceat(letters * POWERS[place & 255], at))
    ranks = _mixed(hashes[:-1] * np.uint64(3) + hashes[1:]) | np.uint64(1)
    last, first = raw[ends[:-1] - 1], raw[begins[1:]]
    stops = STOPS[last]
    ranks[stops] = 0
    fixed = stops | _chosen(ranks)
    breaks = np.concatenate([[0], np.cumsum((raw >= 10) & (raw <= 13))])
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    within = lambda sums: sums[begins[1:]] > sums[ends[:-1]]
    # a-z and the letters from sharp s on; A-Z and those up to capital thorn
    lead = (ends[:-1] - begins[:-1] > 1) & (raw[ends[:-1] - 2] == 0xC3)
    lower = ((last >= 97) & (last <= 122)) | (lead & (last >= 0x9F) & (last <= 0xBF))
    second = raw[np.minimum(begins[1:] + 1, len(raw) - 1)]
    upper = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    return spoken, at, begins, fixed, fixed | within(lines) | (lower & upper & ~within(breaks))


def sentences(text: str) -> tuple[list[str], list[str]]:
    """Pieces, and the white space behind each (none behind the last)."""
    data = text.encode("utf-8", "replace")
    _, _, begins, _, cuts = _cuts(data)
    edges = [0, *begins[1:][cuts].tolist(), len(data)]
    parts, gaps = [], []
    for low, high in zip(edges, edges[1:]):
        part = data[low:high]
        bare = part if high == len(data) else part.rstrip(b" \t\n\v\f\r")
        parts.append(bare.decode())
        gaps.append(part[len(bare):].decode())
    return parts, gaps


def runs(text: str, run: int, min_words: int) -> list[tuple[bytes, int, int]]:
    """Hash, first piece and number of pieces of every run."""
    spoken, at, _, fixed, cuts = _cuts(text.encode("utf-8", "replace"))
    n = len(at)
    if not n:
        return []
    inner = np.flatnonzero(cuts) + 1
    begins, ends = np.concatenate([[0], inner]), np.concatenate([inner, [n]])
    inner = np.flatnonzero(fixed) + 1
    sources, goals = np.concatenate([[0], inner]), np.concatenate([inner, [n]])
    on = np.maximum(np.searchsorted(goals, begins + min_words), np.searchsorted(goals, begins, "right") + run - 1)
    back = np.minimum(np.searchsorted(sources, ends - min_words, "right") - 1, np.searchsorted(sources, ends) - run)
    on_ok, back_ok = on < len(goals), back >= 0
    low = np.concatenate([begins[on_ok], sources[back[back_ok]]])
    high = np.concatenate([goals[on[on_ok]], ends[back_ok]])
    pairs = np.unique(low * (n + 1) + high) if len(low) else np.array([n])
    low, high = np.divmod(pairs, n + 1)
    first = np.searchsorted(begins, low)
    many = np.searchsorted(ends, high) + 1 - first
    at = np.append(at, len(spoken))
    digest = xxhash.xxh3_128_digest
    return [(digest(spoken[a:b]), f, m) for a, b, f, m in zip(
        at[low].tolist(), at[high].tolist(), first.tolist(), many.tolist())]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"),
                       F.col(text_col).cast("string").alias("text"))


def sentence_runs(docs: DataFrame, run: int, min_words: int, id_col: str, text_col: str) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, marks, at, many = [], [], [], [], []
            owners = zip(*(batch.column(c).to_pylist() for c in range(3)))

            def block() -> pa.RecordBatch:
                halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays(
                    [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64()),
                     pa.array(marks, pa.int64()), pa.array(at, pa.int32()), pa.array(many, pa.int32())],
                    names=["high", "low", "doc_id", "mark", "at", "many"])

            for owner, mark, text in owners:
                for key, first, length in runs(text or "", run, min_words):
                    keys.append(key)
                    ids.append(owner)
                    marks.append(mark)
                    at.append(first)
                    many.append(length)
                if len(keys) > 50_000:
                    yield block()
                    keys, ids, marks, at, many = [], [], [], [], []
            if keys:
                yield block()

    return _documents(docs, id_col, text_col).mapInArrow(spread, RUNS_DDL)


def repeated_runs(found: DataFrame) -> DataFrame:
    """Runs that are not the first of their hash: ``doc_id, mark, at, many, first_doc``."""
    twice = found.groupBy("high").count().filter("count > 1").select("high")
    # tables on both sides, so that a run that very many documents have can be split in the joins
    again = cut(found.join(cut(twice), "high", "left_semi"))
    firsts = again.groupBy("high", "low").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "mark", "at")).alias("first")).filter("n > 1").select(
        F.col("high").alias("_high"), F.col("low").alias("_low"), "first")
    firsts = cut(firsts)
    own = F.struct("doc_id", "mark", "at").eqNullSafe(F.col("first"))
    return (
        again.join(firsts, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")))
        .filter(~own).select("doc_id", "mark", "at", "many", F.col("first.doc_id").alias("first_doc")))


def without_repeats(
    docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document ``doc_id, text`` as left, ``n_sentences, n_removed, first_docs``.

    ``first_docs`` are the documents that keep what is removed here, in ascending order.
    """
    found = cut(sentence_runs(docs, run, min_words, id_col, text_col))
    spans = repeated_runs(found).groupBy(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.collect_set(F.struct("at", "many")).alias("spans"), F.array_sort(F.collect_set("first_doc")).alias("first_docs"))
    rows = _documents(docs, id_col, text_col)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    joined = rows.join(spans, same, "left").select(
        "doc_id", "text", F.col("spans.at").alias("at"), F.col("spans.many").alias("many"), "first_docs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, counts, removed = [], [], []
            for text, at, many in zip(*(batch.column(c).to_pylist() for c in range(1, 4))):
                if not at:
                    _, spoken, _, _, cuts = _cuts((text or "").encode("utf-8", "replace"))
                    counts.append(int(cuts.sum()) + (len(spoken) > 0))
                    texts.append(text or "")
                    removed.append(0)
                    continue
                parts, gaps = sentences(text)
                counts.append(len(parts))
                edges = np.zeros(len(parts) + 1, np.int64)
                np.add.at(edges, at, 1)
                np.add.at(edges, np.add(at, many), -1)
                gone = np.cumsum(edges)[:-1] > 0
                texts.append("".join(p + g for p, g, x in zip(parts, gaps, gone) if not x))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 batch.column(4)], names=["doc_id", "text", "n_sentences", "n_removed", "first_docs"])

    return joined.mapInArrow(
        remove, "doc_id bigint, text string, n_sentences bigint, n_removed bigint, first_docs array<bigint>")
