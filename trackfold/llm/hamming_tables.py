"""Near copies by SimHash, found with multi-index hashing.

A text's fingerprint: words in lower case (A-Z), 3-word shingles with repeats, each hashed to 64
bits; a bit is 1 if it is set in over half of the hashes. Fingerprints link at ``RADIUS`` = 2 or
fewer differing bits.

1. Equal fingerprints become one row, with the smallest id of their texts; counting combines on the
   map side, so a text that a third of the rows have costs one row per task.
2. Two tables, one for each 32-bit half. Two linked fingerprints differ by at most one bit in the
   high half or not at all in the low half. So each fingerprint is looked up in the table of high
   halves with the ball of radius 1 around its own, and in that of low halves with its own. Of a
   ball only the points that set a bit are fetched: of two halves that differ in one bit, exactly
   one sets it.
3. Pairs that met in a table are verified over all 64 bits.
4. A half that over ``CROWD`` distinct fingerprints have would make all pairs of them. These, and
   those one bit away that would meet them, are compared by their whole fingerprints instead:
   two of them are linked exactly if some 64-bit number is within one bit of both. Each lists the
   65 numbers within one bit of it; who shares a number is linked to the least that has it. No
   number can be shared by more than 65, so this is linear, exact, and has no hot key.
5. Components of the links by alternating stars; a component is named by its smallest id.

Nulls and empty texts: no words give fingerprint zero, linked like any other. A row without id
belongs to its component but does not name it; a component without any id is null. Rows that
share an id are each fingerprinted; ties are harmless since only equality and minima count. An empty
table gives an empty result; columns beyond id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfold.llm.base import bounded, text_bytes
from trackfold.llm.prefix_join import components
from trackfold.session import cut

WIDTH = 3
SEED = 42
RADIUS = 2
HALF = 32
CROWD = 64
COUNT_AT_ONCE = 1 << 14
FREQUENT = 1_000_000
MOST_FREQUENT = 100_000


def shingle_hashes(text: bytes, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; of all words where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    span = min(width, len(words))
    starts = np.concatenate(([0], ends[: len(words) - span])).tolist()
    stops = (ends[span - 1 :] - 1).tolist()
    return np.array([hashed(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNT_AT_ONCE):
        part = np.ascontiguousarray(hashes[at : at + COUNT_AT_ONCE].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id`` and ``print``, the fingerprint as a signed number of the same bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(t)) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "print"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, print bigint")


def _bits(n: int) -> Column:
    return F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint") for k in range(n)])


def _ball(key: Column, bits: int) -> Column:
    """``key`` and all numbers that differ from it in one of the low ``bits`` bits."""
    return F.concat(F.array(key), F.transform(_bits(bits), lambda b: key.bitwiseXOR(b)))


def _upward(key: Column, bits: int) -> Column:
    """``key`` and the numbers that have one bit more."""
    more = F.filter(_bits(bits), lambda b: key.bitwiseAND(b) == 0)
    return F.concat(F.array(key), F.transform(more, lambda b: key.bitwiseOR(b)))


HALVES = {
    "high": lambda: F.shiftrightunsigned("print", HALF),
    "low": lambda: F.col("print").bitwiseAND(F.lit((1 << HALF) - 1)),
}


def _crowded(prints: DataFrame, half: str, crowd: int) -> DataFrame:
    """Values of a half that over ``crowd`` distinct fingerprints have."""
    return cut(prints.groupBy(HALVES[half]().alias("key")).count().filter(F.col("count") > crowd).select("key"))


def _table_links(prints: DataFrame, half: str, crowded: DataFrame) -> DataFrame:
    """Links met in the table of a half, except those of crowded values."""
    table = prints.select("print", HALVES[half]().alias("key")).join(bounded(crowded), "key", "left_anti")
    points = _upward(F.col("key"), HALF) if half == "high" else F.array("key")
    fetched = table.select(F.col("print").alias("a"), F.col("key").alias("own"), F.explode(points).alias("key"))
    met = fetched.join(table.withColumnRenamed("print", "b"), "key").filter("own <> key OR a < b")
    return met.filter(f"bit_count(a ^ b) <= {RADIUS}").select("a", "b")


def _ball_links(prints: DataFrame) -> DataFrame:
    """Links to the least of those that share a number within one bit of their whole fingerprint."""
    points = prints.select("print", F.explode(_ball(F.col("print"), 64)).alias("point"))
    least = F.min("print").over(Window.partitionBy("point"))
    return points.select(F.col("print").alias("a"), least.alias("b")).filter("a <> b").distinct()


def linked_prints(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints whose components are those of all links."""
    found, dense = [], []
    for half in HALVES:
        crowded = _crowded(prints, half, crowd)
        found.append(_table_links(prints, half, crowded))
        if not crowded.isEmpty():
            around = crowded if half == "low" else crowded.select(
                F.explode(_ball(F.col("key"), HALF)).alias("key")).distinct()
            dense.append(prints.withColumn("key", HALVES[half]()).join(bounded(around), "key", "left_semi").select("print"))
    if dense:
        members = dense[0] if len(dense) == 1 else dense[0].unionByName(dense[1]).distinct()
        found.append(_ball_links(cut(members)))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with the name of their fingerprint; fingerprints of very many rows are not shuffled."""
    total, prints = names.agg(F.sum("copies"), F.count(F.lit(1))).first()
    if prints <= MOST_FREQUENT:
        return rows.join(F.broadcast(names), "print")
    # at most MOST_FREQUENT fingerprints can have more rows than this
    often = F.col("copies") > max(FREQUENT, total // MOST_FREQUENT)
    frequent = F.broadcast(names.filter(often))
    usual = rows.join(frequent, "print", "left_anti").join(names.filter(~often), "print")
    return usual.unionByName(rows.join(frequent, "print"))


def similar_prints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD,
) -> DataFrame:
    """Per row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``."""
    rows = cut(fingerprints(docs, id_col, text_col))
    prints = cut(rows.groupBy("print").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    labels = components(linked_prints(prints, crowd)).withColumnRenamed("id", "print")
    grouped = prints.join(labels, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    names = cut(grouped.join(least, "component").select("print", "copies", "component_id"))
    return _named(rows, names).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
