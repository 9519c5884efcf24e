"""Writers of tracks and time-series points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackfold.functions import text


def write_csv(df: DataFrame, path: str, sep: str = ",", single_file: bool = False) -> None:
    """Overwrite ``path`` with headerless text. One file only when asked for: one task writes it."""
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").option("sep", sep).option("header", False).csv(path)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def step_xy(track: DataFrame) -> DataFrame:
    return track.select("step", "x", "y")


def vehicle_time_xy(track: DataFrame) -> DataFrame:
    """Rows of the track file: the label is the vehicle and the step, parted by a comma."""
    return track.select(F.concat_ws(",", "vehicle", "step").alias("key"), "t_ms", "x", "y")


def track_steps(track: DataFrame) -> DataFrame:
    """The same rows with vehicle and step as two fields, which is how they read back."""
    return track.select("vehicle", "step", "t_ms", "x", "y")


def time_xy(track: DataFrame) -> DataFrame:
    return track.select("t_ms", "x", "y")


def time_xy_landmarks(track: DataFrame) -> DataFrame:
    """Landmarks as nested rows; for CSV use ``time_xy_landmark_text``."""
    return track.select("t_ms", "x", "y", "landmarks")


def time_xy_landmark_text(track: DataFrame) -> DataFrame:
    return track.select("t_ms", "x", "y", text.points_text(F.col("landmarks")).alias("landmarks"))


def _escape(name: Column) -> Column:
    return F.regexp_replace(name, r"([,= ])", r"\\$1")


def point_lines(
    rows: DataFrame, measurement: str, fields: dict[str, str], key: str | None = "vehicle",
    time: str = "t_ms", decimals: int | None = None,
) -> DataFrame:
    """Rows as line-protocol text: measurement, tag ``key``, fields, time in milliseconds.

    ``fields`` maps field names to columns; null fields are left out, rows without any field too.
    """
    def number(column: str) -> Column:
        value = F.col(column)
        return value.cast("string") if decimals is None else F.format_string(f"%.{decimals}f", value)

    pairs = F.concat_ws(",", *[
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), number(c))) for name, c in fields.items()
    ])
    head = _escape(F.lit(measurement))
    if key is not None:
        head = F.concat(head, F.lit(",key="), _escape(F.col(key)))
    line = F.concat(head, F.lit(" "), pairs, F.lit(" "), F.col(time).cast("string"))
    return rows.filter(F.greatest(*[F.col(c).isNotNull() for c in fields.values()]) if len(fields) > 1
                       else F.col(next(iter(fields.values()))).isNotNull()).select(line.alias("value"))


def value_points(rows: DataFrame, measurement: str, value: str, **options) -> DataFrame:
    return point_lines(rows, measurement, {"value": value}, **options)


def gps_points(rows: DataFrame, measurement: str, latitude: str, longitude: str, **options) -> DataFrame:
    return point_lines(rows, measurement, {"latitude": latitude, "longitude": longitude}, **options)


def sensor_points(
    rows: DataFrame, measurement: str, latitude: str, longitude: str, steering: str, **options
) -> DataFrame:
    return point_lines(
        rows, measurement, {"latitude": latitude, "longitude": longitude, "steering": steering}, **options
    )


def write_points(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.write.mode(mode).text(path)


def points_batch_writer(path: str, measurement: str, fields: dict[str, str], **options):
    """For ``foreachBatch``: each micro-batch becomes one folder, rewritten if it is retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_points(point_lines(batch, measurement, fields, **options), f"{path}/batch={batch_id}")

    return write
