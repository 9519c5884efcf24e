"""Shards by extendible hashing: a bucket that is too large, and no other, splits on one more bit.

A bucket is a prefix of a 64-bit hash of the id. All rows start in the bucket of the empty
prefix. A bucket above ``max_bytes`` splits into the two buckets of the next bit until every one
fits. The directory (one row per bucket: prefix, depth, bytes, rows) is all that the levels work
on: rows are summed once per ``STEP`` bits, map-side first, and only rows of buckets that are
still too large are summed again on further bits.

A hash may be shared by many rows (an id that repeats). Past its 64 bits a bucket splits on the
bits of a row hash, taken from the row's number in the table, so any number of repeats spreads
out. One row above the limit is a bucket of its own. Null ids hash like one id. A null text has
no bytes. Empty table: no rows, no buckets. Columns beyond id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackfold.llm.base import bounded
from trackfold.session import cut

MAX_BYTES = 1 << 20
STEP = 12
ID_BITS = 64
ALL_BITS = 128


def _bits(md5: Column) -> Column:
    """The first 64 bits of an MD5 in hex, as text of zeros and ones."""
    half = lambda at: F.lpad(F.conv(F.substring(md5, at, 8), 16, 2), 32, "0")
    return F.concat(half(1), half(9))


def with_hash(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """``doc_id, bytes, row, hash`` (64 bits as zeros and ones), and the row itself as ``record``."""
    return docs.select(
        *([F.struct("*").alias("record")] if whole else []),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("hash", _bits(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))


def _fitting(open_rows: DataFrame, depth: int, last: int, max_bytes: int) -> DataFrame:
    """Buckets on bits ``depth..last`` below the open ones: ``cell, prefix, depth, bytes, rows, fits``.

    ``cell`` is the prefix of ``last`` bits; each cell is given the shortest prefix that fits.
    """
    cells = (
        open_rows.groupBy(F.substring("hash", 1, last).alias("cell"))
        .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    )
    nested = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(last))))
    nested = nested.withColumn("prefix", F.expr("substring(cell, 1, depth)"))
    sums = (
        nested.groupBy("prefix").agg(F.sum("bytes").alias("all_bytes"), F.sum("rows").alias("all_rows"))
        .withColumn("fits", (F.col("all_bytes") <= max_bytes) | (F.col("all_rows") == 1))
    )
    each = nested.select("cell", "prefix", "depth").join(sums, "prefix")
    return each.groupBy("cell").agg(
        F.min_by(F.struct("prefix", "depth", F.col("all_bytes").alias("bytes"), F.col("all_rows").alias("rows"), "fits"),
                 F.struct(~F.col("fits"), F.col("depth"))).alias("bucket"))


def extendible_shards(
    docs: DataFrame, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", step: int = STEP,
    whole: bool = False,
) -> DataFrame:
    """Per document its shard: ``doc_id, bytes, shard, depth, shard_bytes, shard_docs``.

    ``shard`` is the bucket's prefix as zeros and ones, empty while all rows fit one shard. With
    ``whole`` the document's row is added as ``record``.
    """
    rows = with_hash(docs, id_col, text_col, whole)
    kept = ["record"] if whole else []
    done, depth = [], 0
    while True:
        last = min(depth + step, ALL_BITS)
        if depth == ID_BITS:
            # the table is written down, so that a row keeps its number from here on
            rows = cut(rows.withColumn("hash", F.concat("hash", _bits(F.md5(F.col("row").cast("string"))))))
        elif depth < ID_BITS:
            last = min(last, ID_BITS)
        buckets = cut(_fitting(rows, depth, last, max_bytes))
        cell = F.substring("hash", 1, last)
        placed = rows.withColumn("cell", cell).join(bounded(buckets), "cell")
        done.append(placed.filter("bucket.fits").select(
            *kept, "doc_id", "bytes", F.col("bucket.prefix").alias("shard"), F.col("bucket.depth").alias("depth"),
            F.col("bucket.bytes").alias("shard_bytes"), F.col("bucket.rows").alias("shard_docs")))
        if buckets.filter("not bucket.fits").isEmpty():
            break
        if last == ALL_BITS:
            raise ValueError("rows with equal hashes of id and row number do not fit one shard")
        rows = placed.filter("not bucket.fits").select(*kept, "doc_id", "bytes", "row", "hash")
        depth = last
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def write_shards(docs: DataFrame, path: str, max_bytes: int = MAX_BYTES, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write the documents as Parquet, one folder per shard."""
    placed = extendible_shards(docs, max_bytes, id_col, text_col, whole=True)
    folder = F.concat(F.lit("b"), "shard").alias("_shard")
    placed.select("record.*", folder).repartition("_shard").write.partitionBy("_shard").parquet(path)
