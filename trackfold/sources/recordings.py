"""Readers of recordings, batch and streaming. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold.functions import geometry, text
from trackfold.schema import GPS, GPS_SECONDS, ODOMETRY, RAW_ODOMETRY, TRACK_LANDMARKS, TRACK_STEPS

LINE = T.StructType([T.StructField("value", T.StringType())])


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines with ``file`` and ``seq``; ``seq`` (file, offset, line number) keeps the line order.

    Large files are read in parallel splits: the order lives in ``seq``, not in the reader. The
    line number only has to rise inside one block of one file.
    """
    return _numbered(spark.read.schema(LINE).text(list(paths))).select("value", "seq.file", "seq")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    ).alias("seq"))


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The lines of the files arriving in a folder, with ``file`` and ``seq`` as ``read_lines`` gives them."""
    reader = spark.readStream.schema(LINE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    fields = T.StructType([*rows.schema.fields, T.StructField("line", T.LongType())])
    counted = rows.mapInArrow(_with_line_numbers, fields)
    return counted.select("value", "file", F.struct("file", "block", "line").alias("seq"))


def _with_line_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spark's own row numbers are not there for streams; a task reads the lines of a block in order."""
    seen = 0
    for batch in batches:
        lines = pa.array(range(seen, seen + batch.num_rows), pa.int64())
        seen += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, lines], names=[*batch.schema.names, "line"])


def _split(lines: DataFrame) -> DataFrame:
    """Add ``_parts``. The explode keeps later filters above it, so a line is split once."""
    return lines.select("*", F.explode(F.array(text.fields(F.col("value")))).alias("_parts"))


def tagged(lines: DataFrame, vehicle: str | Column | None = None) -> DataFrame:
    """All lines of a tagged recording as sensor rows plus ``reason`` (null for good rows).

    With ``vehicle`` None the fifth field names the vehicle, and scans, which carry none, are
    rejected; else every row belongs to ``vehicle``.
    """
    parts = F.col("_parts")
    kind = F.col("kind")
    odo, gps, laser = kind == "odo", kind == "gps", kind == "laser"
    if vehicle is None:
        name = F.when(odo | gps, F.concat(F.lit("vehicle"), F.trim(text.text_field(parts, 4))))
    else:
        name = F.lit(vehicle) if isinstance(vehicle, str) else vehicle
    split = _split(lines).withColumn("kind", F.trim(text.text_field(parts, 0)))
    keep = [c for c in ("file", "seq") if c in lines.columns]
    rows = split.select(
        *keep,
        name.alias("vehicle"),
        text.long_field(parts, 1).alias("t_ms"),
        "kind",
        F.when(odo, text.double_field(parts, 3)).alias("speed"),
        F.when(odo, text.double_field(parts, 2)).alias("steering"),
        F.when(gps, text.double_field(parts, 3)).alias("gps_x"),
        F.when(gps, text.double_field(parts, 2)).alias("gps_y"),
        F.when(laser, text.scan_field(parts, 2)).alias("ranges"),
        F.col("value").alias("line"),
    )
    bad_number = (
        F.when(odo, F.col("speed").isNull() | F.col("steering").isNull())
        .when(gps, F.col("gps_x").isNull() | F.col("gps_y").isNull())
        .otherwise(F.exists("ranges", lambda r: r.isNull()))
    )
    reason = (
        F.when(~kind.isin(*text.KINDS) | kind.isNull(), "kind")
        .when(F.col("t_ms").isNull(), "time")
        .when(F.col("vehicle").isNull(), "vehicle")
        .when(bad_number, "number")
    )
    return rows.withColumn("reason", reason)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason", "line")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("line", "reason")


def parsed_increments(lines: DataFrame, vehicle: str = "full") -> DataFrame:
    """Lines ``t,x_inc,y_inc,phi_inc,"[r0,...]"`` (metres) with ``reason`` (null for good rows).

    The time is rounded half up.
    """
    parts = F.col("_parts")
    split = _split(lines)
    keep = [c for c in ("file", "seq") if c in lines.columns]
    rows = split.select(
        *keep,
        F.lit(vehicle).alias("vehicle"),
        geometry.half_up(text.double_field(parts, 0)).alias("t_ms"),
        text.double_field(parts, 1).alias("x_inc"),
        text.double_field(parts, 2).alias("y_inc"),
        text.double_field(parts, 3).alias("phi_inc"),
        text.scan_field(parts, 4).alias("ranges"),
        F.col("value").alias("line"),
    )
    bad = F.col("x_inc").isNull() | F.col("y_inc").isNull() | F.col("phi_inc").isNull()
    bad = bad | F.exists("ranges", lambda r: r.isNull())
    return rows.withColumn("reason", F.when(F.col("t_ms").isNull(), "time").when(bad, "number"))


def increments(lines: DataFrame, vehicle: str = "full") -> DataFrame:
    """The good rows of ``parsed_increments``; see there."""
    return accepted(parsed_increments(lines, vehicle))


def read_tagged(spark: SparkSession, *paths: str, vehicle: str | None = None) -> DataFrame:
    return accepted(tagged(read_lines(spark, *paths), vehicle))


def read_vehicle_files(
    spark: SparkSession, *paths: str, vehicle_pattern: str = r"([^/]+?)(?:\.[^./]*)?$"
) -> DataFrame:
    """One recording per vehicle; the first group of the pattern names it from the file path.

    By default the base name of the file is the vehicle.
    """
    lines = read_lines(spark, *paths)
    lines = lines.withColumn("_vehicle", F.regexp_extract(F.col("file"), vehicle_pattern, 1))
    return accepted(tagged(lines, F.col("_vehicle")))


def read_csv(spark: SparkSession, schema: T.StructType, *paths: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", False).csv(list(paths))


def parsed_csv(
    spark: SparkSession, schema: T.StructType, *paths: str, sep: str = ",", vehicle: str = "full", kind: str | None = None,
) -> DataFrame:
    """Rows of a headerless file with ``vehicle``, ``seq``, ``kind`` and ``reason`` (null for good rows).

    A row is rejected as ``number`` if one of its numbers is missing, no number or not finite.
    ``line`` is the row as read, field by field.
    """
    written = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = _numbered(read_csv(spark, written, *paths, sep=sep))
    numbers = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    typed = {
        f.name: F.trim(F.col(f.name)).try_cast("bigint") if isinstance(f.dataType, T.LongType) else text.number(F.col(f.name))
        for f in numbers
    }
    line = F.concat_ws(sep, *[F.coalesce(f.name, F.lit("")) for f in schema.fields])
    rows = rows.withColumn("line", line).withColumns(typed)
    if "vehicle" not in schema.names:
        rows = rows.withColumn("vehicle", F.lit(vehicle))
    if kind is not None and "kind" not in schema.names:
        rows = rows.withColumn("kind", F.lit(kind))
    bad = F.lit(False)
    for f in numbers:
        bad = bad | F.col(f.name).isNull()
    return rows.withColumn("reason", F.when(bad, "number"))


def read_odometry(spark: SparkSession, *paths: str, vehicle: str = "full") -> DataFrame:
    """Odometry rows as the trackers take them."""
    return accepted(parsed_csv(spark, ODOMETRY, *paths, vehicle=vehicle, kind="odo"))


def read_raw_odometry(spark: SparkSession, *paths: str, vehicle: str = "full") -> DataFrame:
    return accepted(parsed_csv(spark, RAW_ODOMETRY, *paths, vehicle=vehicle))


def read_gps(spark: SparkSession, *paths: str, vehicle: str = "full") -> DataFrame:
    return accepted(parsed_csv(spark, GPS, *paths, vehicle=vehicle, kind="gps"))


def read_gps_seconds(spark: SparkSession, *paths: str, offset_ms: int = 0, vehicle: str = "full") -> DataFrame:
    """Fixes timed in seconds, as sensor rows."""
    raw = accepted(parsed_csv(spark, GPS_SECONDS, *paths, vehicle=vehicle, kind="gps"))
    return raw.select(
        "vehicle", geometry.align_clock(F.col("seconds"), offset_ms).alias("t_ms"), "seq", "kind",
        F.col("x").alias("gps_x"), F.col("y").alias("gps_y"),
    )


def read_track_steps(spark: SparkSession, *paths: str) -> DataFrame:
    """The good rows of ``parsed_csv`` of a track file."""
    return accepted(parsed_csv(spark, TRACK_STEPS, *paths)).select(TRACK_STEPS.names)


def parsed_track_landmarks(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of a landmark file with ``reason``: ``number``, or ``landmarks`` where the list is not one of pairs.

    ``landmarks`` is an array of (lx, ly).
    """
    rows = parsed_csv(spark, TRACK_LANDMARKS, *paths, sep=";")
    listed = text.are_points(F.col("landmarks"))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(~listed, "landmarks")))
    return rows.withColumn("landmarks", text.points(F.col("landmarks")))


def read_track_landmarks(spark: SparkSession, *paths: str) -> DataFrame:
    """Track rows with their landmark list as an array of (lx, ly)."""
    return accepted(parsed_track_landmarks(spark, *paths)).select(TRACK_LANDMARKS.names)
