"""Range scans: cleaning, cutting into objects, landmark points.

The scan is an array column and a row stays a row, so nothing here is shuffled but for the
pose of the car.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackfold.functions import geometry
from trackfold.functions.beams import cloud_points, segment_stats
from trackfold.operators.ordered import HOT_ROWS
from trackfold.operators.track import accumulate_pose
from trackfold.schema import CLOUD_MAX_RANGE, METRE_SCAN, RAW_SCAN, ScanConfig, Start, Vehicle


def metres_with_blind_zone(ranges: Column, scan: ScanConfig = RAW_SCAN) -> Column:
    """Centimetres to metres; the first beams see the car itself and get a far value."""
    return F.transform(
        ranges,
        lambda r, i: F.when(i < scan.blind_beams, F.lit(scan.blind_value)).otherwise(r / F.lit(scan.unit)),
    )


def clamp_far(ranges: Column, max_range: float) -> Column:
    """Ranges beyond ``max_range`` become 0, which means no echo."""
    return F.transform(ranges, lambda r: F.when(r <= F.lit(max_range), r).otherwise(F.lit(0.0)))


def clean_raw(ranges: Column, scan: ScanConfig = RAW_SCAN) -> Column:
    return clamp_far(metres_with_blind_zone(ranges, scan), scan.max_range)


def place(segments: Column, phi: Column, vehicle: Vehicle = Vehicle()) -> Column:
    """Segments as objects (first, last, x, y, diameter, range, bearing), car-relative metres."""
    placed = F.transform(segments, lambda s: F.struct(
        s["first"].alias("first"), s["last"].alias("last"), s["diameter"].alias("diameter"),
        geometry.beam_x(s["degrees"], s["reach"], phi, vehicle).alias("x"),
        geometry.beam_y(s["degrees"], s["reach"], phi, vehicle).alias("y"),
    ))
    return F.transform(placed, lambda o: F.struct(
        o["first"].alias("first"), o["last"].alias("last"), o["x"].alias("x"), o["y"].alias("y"),
        o["diameter"].alias("diameter"),
        geometry.sight_range(o["x"], o["y"]).alias("range"),
        geometry.sight_bearing(o["x"], o["y"], phi).alias("bearing"),
    ))


def object_rows(
    rows: DataFrame, segments: Column, phi: Column, *keep: str, vehicle: Vehicle = Vehicle()
) -> DataFrame:
    """One row per object: ``keep`` columns and what ``place`` gives, outside any array."""
    flat = rows.select(*keep, phi.alias("_phi"), F.inline(segments))
    flat = flat.withColumns({
        "x": geometry.beam_x(F.col("degrees"), F.col("reach"), F.col("_phi"), vehicle),
        "y": geometry.beam_y(F.col("degrees"), F.col("reach"), F.col("_phi"), vehicle),
    })
    return flat.select(
        *keep, "first", "last", "x", "y", "diameter",
        geometry.sight_range(F.col("x"), F.col("y")).alias("range"),
        geometry.sight_bearing(F.col("x"), F.col("y"), F.col("_phi")).alias("bearing"),
    )


def raw_objects(rows: DataFrame, phi: Column, *keep: str, scan: ScanConfig = RAW_SCAN) -> DataFrame:
    """One row per object of scans in centimetres (column ``ranges``)."""
    return object_rows(rows, segment_stats(F.col("ranges"), scan, raw=True), phi, *keep, vehicle=scan.vehicle)


def metre_objects(rows: DataFrame, phi: Column, *keep: str, scan: ScanConfig = METRE_SCAN) -> DataFrame:
    """One row per object of scans in metres, taken as they are."""
    return object_rows(rows, segment_stats(F.col("ranges"), scan), phi, *keep, vehicle=scan.vehicle)


def track_with_cloud(
    rows: DataFrame, start: Start = Start(), max_range: float = CLOUD_MAX_RANGE, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Track from pose increments, each row with the landmark points its scan sees."""
    posed = accumulate_pose(rows, start, hot_rows)
    points = cloud_points(F.col("ranges"), F.col("x"), F.col("y"), F.col("phi"), max_range)
    return posed.select("vehicle", "t_ms", "seq", "x", "y", "phi", points.alias("landmarks"))


def track_with_objects(
    rows: DataFrame, start: Start = Start(), scan: ScanConfig = METRE_SCAN, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Track from pose increments, each row with the objects of its scan.

    Objects are turned by phi but keep the car as origin. Scans are cut into segments before
    the rows are moved, which needs no pose and leaves fewer numbers to move.
    """
    measured = rows.withColumn("_segments", segment_stats(F.col("ranges"), scan)).drop("ranges")
    posed = accumulate_pose(measured, start, hot_rows)
    return posed.select("vehicle", "t_ms", "seq", "x", "y", "phi",
                        place(F.col("_segments"), F.col("phi"), scan.vehicle).alias("objects"))
