"""Preparing recordings and judging tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfold.functions import geometry
from trackfold.operators.ordered import HOT_ROWS, Ordered, in_order
from trackfold.schema import CLOCK_OFFSET_MS


def route(rows: DataFrame, *kinds: str) -> DataFrame:
    """Rows of the sensor kinds a job handles; the filter reaches the scan."""
    return rows.filter(F.col("kind").isin(*kinds))


def select_steps(track: DataFrame, *steps: str) -> DataFrame:
    """Only predictions, only updates, or both."""
    return track.filter(F.col("step").isin(*steps))


def with_key(rows: DataFrame, key: str | Column) -> DataFrame:
    return rows.withColumn("vehicle", F.lit(key) if isinstance(key, str) else key)


def union_vehicles(*parts: DataFrame) -> DataFrame:
    """One stream of rows from the streams of several vehicles."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def odometry_rows(raw: DataFrame, offset_ms: int = CLOCK_OFFSET_MS) -> DataFrame:
    """Raw odometry with seconds of its own clock -> sensor rows on the shared clock."""
    moved = raw.filter(F.col("kind") == "odo")
    return moved.withColumn("t_ms", geometry.align_clock(F.col("seconds"), offset_ms)).drop("seconds")


def gps_rows(fixes: DataFrame) -> DataFrame:
    """(t_ms, lat, lon) -> sensor rows."""
    renamed = fixes.withColumnsRenamed({"lat": "gps_x", "lon": "gps_y"})
    return renamed.withColumn("kind", F.lit("gps"))


def merge_sensors(odometry: DataFrame, fixes: DataFrame, offset_ms: int = CLOCK_OFFSET_MS) -> DataFrame:
    """Both recordings as one, with missing columns null. Not sorted: see ``by_time``."""
    return union_vehicles(odometry_rows(odometry, offset_ms), gps_rows(fixes))


def by_time(rows: DataFrame) -> DataFrame:
    """Whole recording in numeric time order (range partitioned, no single task)."""
    return rows.orderBy("t_ms", "seq")


def by_vehicle_and_time(rows: DataFrame) -> DataFrame:
    """Rows of a vehicle next to each other and in time order.

    Range partitioning on all three columns, so a hot vehicle is spread over partitions.
    """
    return rows.repartitionByRange("vehicle", "t_ms", "seq").sortWithinPartitions("vehicle", "t_ms", "seq")


def step_shift(
    track: DataFrame, hot_rows: int | None = HOT_ROWS, sized_by: DataFrame | None = None
) -> DataFrame:
    """Distance of each output row from the vehicle's output row before it.

    For a track that is still to be computed pass the filter's input as ``sized_by``, so the
    filter is not run to count its rows.
    """

    def body(o: Ordered) -> DataFrame:
        o = o.previous(_x=F.col("x"), _y=F.col("y"))
        shifted = o.df.filter(F.col("_x").isNotNull())
        moved = geometry.distance(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"))
        return shifted.select("vehicle", "step", "t_ms", "seq", moved.alias("distance"))

    return in_order(track.select("vehicle", "step", "t_ms", "seq", "x", "y"), body, hot_rows, sized_by)


def prediction_error(
    track: DataFrame, hot_rows: int | None = HOT_ROWS, sized_by: DataFrame | None = None
) -> DataFrame:
    """Each update with the last prediction before it and the distance between the two.

    ``sized_by`` as in ``step_shift``.
    """

    def body(o: Ordered) -> DataFrame:
        here = F.struct(F.col("t_ms").alias("t_ms"), F.col("x").alias("x"), F.col("y").alias("y"))
        o = o.last_seen("_seen", F.when(F.col("step") == "prediction", here))
        updates = o.df.filter(F.col("step") == "update")
        return updates.select(
            "vehicle", "t_ms", "seq",
            F.col("_seen.t_ms").alias("pred_t_ms"),
            F.col("_seen.x").alias("pred_x"),
            F.col("_seen.y").alias("pred_y"),
            F.col("x").alias("upd_x"),
            F.col("y").alias("upd_y"),
            geometry.distance(F.col("_seen.x"), F.col("_seen.y"), F.col("x"), F.col("y")).alias("error"),
        )

    return in_order(track.select("vehicle", "step", "t_ms", "seq", "x", "y"), body, hot_rows, sized_by)


def shifts(judged: DataFrame) -> DataFrame:
    """``step_shift`` of a track that carries the pose before each row: nothing is moved."""
    moved = geometry.distance(F.col("x"), F.col("y"), F.col("prev_x"), F.col("prev_y"))
    return judged.filter(F.col("prev_x").isNotNull()).select("vehicle", "step", "t_ms", "seq", moved.alias("distance"))


def errors(judged: DataFrame) -> DataFrame:
    """``prediction_error`` of a track that carries the last prediction before each row: nothing is moved."""
    return judged.filter(F.col("step") == "update").select(
        "vehicle", "t_ms", "seq", "pred_t_ms", "pred_x", "pred_y",
        F.col("x").alias("upd_x"), F.col("y").alias("upd_y"),
        geometry.distance(F.col("pred_x"), F.col("pred_y"), F.col("x"), F.col("y")).alias("error"),
    )


def mark_gps_outliers(
    fixes: DataFrame, max_jump: float, min_group: int, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Number the groups of fixes between jumps and mark the small groups.

    A fix farther than ``max_jump`` from the fix before it opens a new group; a group of fewer
    than ``min_group`` fixes is an outlier.
    """

    def body(o: Ordered) -> DataFrame:
        o = o.previous(_x=F.col("gps_x"), _y=F.col("gps_y"))
        far = geometry.distance(F.col("gps_x"), F.col("gps_y"), F.col("_x"), F.col("_y")) > F.lit(max_jump)
        o = o.running_sum(group=F.coalesce(far.cast("int"), F.lit(0)))
        df = o.df.drop("_x", "_y")
        whole = Window.partitionBy("vehicle", "group")
        if not o.sliced:
            df = df.withColumn("group_size", F.count(F.lit(1)).over(whole))
        else:
            # a group may run over many slices: count inside slices, then add the counts
            sizes = df.groupBy("vehicle", "slice", "group").count()
            sizes = sizes.withColumn("group_size", F.sum("count").over(whole)).drop("count")
            df = df.join(sizes, ["vehicle", "slice", "group"])
        return df.withColumn("outlier", F.col("group_size") < F.lit(min_group))

    return in_order(fixes, body, hot_rows)


def drop_gps_outliers(
    fixes: DataFrame, max_jump: float, min_group: int, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    marked = mark_gps_outliers(fixes, max_jump, min_group, hot_rows)
    return marked.filter(~F.col("outlier")).select(fixes.columns)


def evaluation_row(pairs: DataFrame) -> DataFrame:
    """Projection (key, predicted xy, updated xy, distance) of ``prediction_error`` rows."""
    return pairs.select("vehicle", "pred_x", "pred_y", "upd_x", "upd_y", F.col("error").alias("distance"))


def count_kinds(rows: DataFrame) -> DataFrame:
    """Processed rows per vehicle and sensor kind."""
    return rows.groupBy("vehicle", "kind").agg(F.count("*").alias("n_rows"))
