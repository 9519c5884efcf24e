"""Tumbling windows per vehicle, for batch rows and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = """vehicle string, window_ms bigint, n_rows bigint,
    fix struct<at: struct<t_ms: bigint, seq: bigint>, gps_x: double, gps_y: double>"""
MERGE = 8


def window_parts(rows: DataFrame, width_ms: int = 200) -> DataFrame:
    """Rows per vehicle and window, and the last GPS fix in it with its place in time.

    The aggregates combine before the shuffle, so a crowded window costs one row per task.
    """
    start = F.floor(F.col("t_ms") / width_ms).cast("bigint") * width_ms
    fix = F.when(F.col("kind") == "gps", F.struct(F.struct("t_ms", "seq").alias("at"), "gps_x", "gps_y"))
    return rows.groupBy("vehicle", start.alias("window_ms")).agg(
        F.count("*").alias("n_rows"), F.max_by(fix, F.when(fix.isNotNull(), F.struct("t_ms", "seq"))).alias("fix"))


def merged_parts(parts: DataFrame) -> DataFrame:
    """One part per window from any number of parts of each; in which order they were made does not matter."""
    return parts.groupBy("vehicle", "window_ms").agg(
        F.sum("n_rows").alias("n_rows"), F.max_by("fix", F.when(F.col("fix").isNotNull(), F.col("fix.at"))).alias("fix"))


def merged_windows(parts: DataFrame) -> DataFrame:
    return merged_parts(parts).select("vehicle", "window_ms", "n_rows", "fix.gps_x", "fix.gps_y")


def fix_windows(rows: DataFrame, width_ms: int = 200) -> DataFrame:
    """Rows per vehicle and window, and the last GPS fix in it (null without a fix)."""
    parts = window_parts(rows, width_ms)
    return parts.select("vehicle", "window_ms", "n_rows", "fix.gps_x", "fix.gps_y")


def drain_windows(stream: DataFrame, table: str, checkpoint: str, width_ms: int = 200, merge: int = MERGE) -> None:
    """Add all that has arrived to a table of window parts.

    Every micro-batch writes its parts to a folder of its own. No row is late: one that belongs to an
    old window becomes another part of it. ``merge`` folders of micro-batches become one of the next
    level, ``merge`` of those one of the level after, and so on: a row is written again once a level,
    and a reader needs fewer than ``merge`` folders of each. What a folder holds follows from its
    number alone, so a batch that is retried writes the same again.
    """
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, table, width_ms, merge))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def add_batch(batch: DataFrame, number: int, table: str, width_ms: int = 200, merge: int = MERGE) -> None:
    """Write the parts of micro-batch ``number``, and the merged folders it is the last one of."""
    spark = batch.sparkSession
    window_parts(batch, width_ms).write.mode("overwrite").parquet(_folder(table, 0, number))
    level, width = 1, merge
    while (number + 1) % width == 0:
        first, there = number + 1 - width, whole_folders(spark, table)
        below = [_folder(table, level - 1, n) for n in range(first, number + 1, width // merge) if (level - 1, n) in there]
        merged_parts(spark.read.schema(PARTS).parquet(*below)).write.mode("overwrite").parquet(_folder(table, level, first))
        level, width = level + 1, width * merge


def _folder(table: str, level: int, first: int) -> str:
    return f"{table}/level={level}/first={first}"


def whole_folders(spark: SparkSession, table: str) -> set[tuple[int, int]]:
    """Level and first batch of the folders whose write has been committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/level=*/first=*/_SUCCESS")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    folders = (str(f.getPath().getParent()).rsplit("/", 2)[1:] for f in found)
    return {(int(level.split("=")[1]), int(first.split("=")[1])) for level, first in folders}


def newest_folders(folders: set[tuple[int, int]], merge: int = MERGE) -> list[tuple[int, int]]:
    """The folders that no other one covers: each batch is in just one of them."""
    levels = range(1, max((level for level, _ in folders), default=0) + 1)
    return sorted(
        (level, first) for level, first in folders
        if not any((up, first - first % merge**up) in folders for up in levels if up > level))


def read_windows(spark: SparkSession, table: str, merge: int = MERGE) -> DataFrame:
    """The windows as of now; ``merge`` as it was when the parts were written."""
    paths = [_folder(table, *f) for f in newest_folders(whole_folders(spark, table), merge)]
    parts = spark.read.schema(PARTS).parquet(*paths) if paths else spark.createDataFrame([], PARTS)
    return merged_windows(parts)
