"""Tracks that are sums of known increments: windows only, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfold.functions import motion
from trackfold.operators.ordered import HOT_ROWS, ORDER, Ordered, in_order
from trackfold.schema import EKF_START, Start, Vehicle


def time_step(rows: DataFrame, start_ms: int = 0, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add ``dt``: seconds since the vehicle's row before, or since ``start_ms``."""
    return in_order(rows, lambda o: _with_dt(o, start_ms).df, hot_rows)


def _with_dt(rows: Ordered, start_ms: int) -> Ordered:
    rows = rows.previous(_t=F.col("t_ms"))
    dt = (F.col("t_ms") - F.coalesce("_t", F.lit(start_ms).cast("bigint"))) / F.lit(1000.0)
    return Ordered(rows.with_columns(dt=dt).df.drop("_t"))


def _integrate(rows: Ordered, start: Start, half_turn: bool) -> Ordered:
    """Poses from columns ``forward``, ``left``, ``turn``."""
    if rows.sliced:
        return Ordered(_integrate_slices(rows, start, half_turn))
    rows = rows.running_sum(_turned=F.col("turn"))
    rows = rows.with_columns(phi=F.lit(start.phi) + F.col("_turned"))
    heading = F.col("phi") - F.col("turn") * F.lit(0.5 if half_turn else 1.0)
    rows = rows.running_sum(
        _dx=motion.plane_x(heading, F.col("forward"), F.col("left")),
        _dy=motion.plane_y(heading, F.col("forward"), F.col("left")),
    )
    rows = rows.with_columns(x=F.lit(start.x) + F.col("_dx"), y=F.lit(start.y) + F.col("_dy"))
    return Ordered(rows.df.drop("_turned", "_dx", "_dy", "forward", "left", "turn"))


def _integrate_slices(
    rows: Ordered, start: Start, half_turn: bool, moved: Callable[[Column], tuple[Column, Column, Column]] | None = None,
    raw: tuple[str, ...] = (),
) -> DataFrame:
    """The same over slices, whose table is read twice.

    Each slice is first driven by itself, heading 0 from the origin; that is a turn and a shift, and
    such motions compose: on the table of slices they give the pose each slice begins with. ``moved``
    gives forward, left and turn of a row from the time of the row before it and the columns ``raw``;
    as a slice's first row needs the time of the slice before, it is kept apart until then.
    """
    window = rows.window
    share = F.lit(0.5 if half_turn else 1.0)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def drive(df: DataFrame, turned: Column | None) -> DataFrame:
        """Sums of turn and shift inside each slice, from the heading it begins with (null: 0)."""
        df = df.withColumn("_turned", F.sum("turn").over(upto))
        heading = F.col("_turned") - F.col("turn") * share + (F.lit(0.0) if turned is None else turned)
        df = df.withColumns({"_px": motion.plane_x(heading, F.col("forward"), F.col("left")),
                             "_py": motion.plane_y(heading, F.col("forward"), F.col("left"))})
        return df if turned is None else df.withColumns({"_dx": F.sum("_px").over(upto), "_dy": F.sum("_py").over(upto)})

    def with_motion(df: DataFrame, before: Column) -> DataFrame:
        if moved is None:
            return df
        return df.withColumns(dict(zip(("forward", "left", "turn"), moved(before))))

    lag = F.lag("t_ms").over(window)
    kept = rows.df.select(*rows.keys, *ORDER, *(raw or ("forward", "left", "turn")))
    alone = drive(with_motion(kept, lag), None)
    lead = F.struct("t_ms", *raw)
    slices = alone.groupBy(*rows.keys).agg(
        F.sum("turn").alias("_turn"), F.sum("_px").alias("_sx"), F.sum("_py").alias("_sy"),
        F.max("t_ms").alias("_last"), F.min_by(lead, F.struct(*ORDER)).alias("_lead"))
    order = Window.partitionBy("vehicle").orderBy("slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_t", F.lag("_last").over(order))
    if moved is None:
        slices = slices.withColumns({n: F.lit(None).cast("double") for n in ("forward", "left", "turn")})
    else:
        slices = with_motion(slices.select("*", "_lead.*"), F.coalesce("_t", F.lit(start.t_ms).cast("bigint")))
    both = lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    slices = slices.withColumn("_c_turn", F.sum(both(F.col("turn"), F.col("_turn"))).over(before))
    base = F.lit(start.phi) + F.coalesce("_c_turn", F.lit(0.0))
    first, rest = base + F.col("turn") * (F.lit(1.0) - share), base + F.coalesce("turn", F.lit(0.0))
    slices = slices.withColumns({
        "_mx": both(motion.plane_x(first, F.col("forward"), F.col("left")), motion.plane_x(rest, F.col("_sx"), F.col("_sy"))),
        "_my": both(motion.plane_y(first, F.col("forward"), F.col("left")), motion.plane_y(rest, F.col("_sx"), F.col("_sy"))),
    })
    carry = slices.select(
        *rows.keys, F.col("_t").alias("_c_t"), "_c_turn",
        F.sum("_mx").over(before).alias("_c_x"), F.sum("_my").over(before).alias("_c_y"))
    df = rows.df.join(carry, rows.keys, "left")
    df = with_motion(df, F.coalesce(lag, F.col("_c_t"), F.lit(start.t_ms).cast("bigint")))
    df = drive(df, F.lit(start.phi) + F.coalesce("_c_turn", F.lit(0.0)))
    # null only as long as no value was seen, as in an uncut window
    poses = {n: F.lit(from_) + both(F.col(c), F.col(d)) for n, from_, c, d in (
        ("phi", start.phi, "_c_turn", "_turned"), ("x", start.x, "_c_x", "_dx"), ("y", start.y, "_c_y", "_dy"))}
    work = ("_c_t", "_c_turn", "_c_x", "_c_y", "_turned", "_px", "_py", "_dx", "_dy", "forward", "left", "turn")
    return df.withColumns(poses).drop(*work)


def dead_reckoning(
    rows: DataFrame, start: Start = EKF_START, vehicle: Vehicle = Vehicle(), hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Pose after each odometry row from speed and steering alone (phi is not wrapped)."""
    odometry = rows.filter(F.col("kind") == "odo").select("vehicle", "t_ms", "seq", "speed", "steering")

    def moved(before: Column) -> tuple[Column, Column, Column]:
        dt = (F.col("t_ms") - before) / F.lit(1000.0)
        return motion.body_motion(dt, F.col("speed"), F.col("steering"), vehicle)

    def body(o: Ordered) -> DataFrame:
        if o.sliced:
            poses = _integrate_slices(o, start, False, moved, ("speed", "steering"))
            return poses.select("vehicle", "t_ms", "seq", "x", "y", "phi")
        o = o.previous(_t=F.col("t_ms"))
        forward, left, turn = moved(F.coalesce("_t", F.lit(start.t_ms).cast("bigint")))
        o = o.with_columns(forward=forward, left=left, turn=turn)
        return _integrate(o, start, half_turn=False).df.select("vehicle", "t_ms", "seq", "x", "y", "phi")

    return in_order(odometry, body, hot_rows)


def accumulate_pose(rows: DataFrame, start: Start = Start(), hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add x, y, phi from columns ``x_inc``, ``y_inc``, ``phi_inc``; other columns are kept."""

    def body(o: Ordered) -> DataFrame:
        o = o.with_columns(forward=F.col("x_inc"), left=F.col("y_inc"), turn=F.col("phi_inc"))
        return _integrate(o, start, half_turn=True).df

    return in_order(rows, body, hot_rows)


def discrete_kalman(
    rows: DataFrame,
    vehicle: Vehicle = Vehicle(),
    variance: float = 1.0,
    noise: float = 0.1,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Track that moves with the speed of the row before; phi is set, not accumulated.

    ``gain`` and ``variance`` follow the scalar recursion in closed form over the row number.
    """
    odometry = rows.filter(F.col("kind") == "odo").select("vehicle", "t_ms", "seq", "speed", "steering")

    def body(o: Ordered) -> DataFrame:
        o = o.previous(_t=F.col("t_ms"), _v=F.col("speed"))
        o = o.with_columns(
            _dt=F.col("t_ms") - F.coalesce("_t", F.lit(0).cast("bigint")),
            _v=F.coalesce("_v", F.lit(0.0)),
        )
        o = o.with_columns(
            phi=F.col("_v") * F.col("_dt") * F.tan("steering") / F.lit(vehicle.wheelbase * 1000.0)
        )
        o = o.previous(_phi=F.col("phi"))
        o = o.with_columns(_phi=F.coalesce("_phi", F.lit(0.0)))
        reach = F.col("_v") * F.col("_dt") / F.lit(1000.0)
        o = o.running_sum(x=F.cos("_phi") * reach, y=F.sin("_phi") * reach, _n=F.lit(1))
        before = F.lit(1.0) / (F.lit(1.0 / variance) + (F.col("_n") - 1) / F.lit(noise))
        after = F.lit(1.0) / (F.lit(1.0 / variance) + F.col("_n") / F.lit(noise))
        return o.df.select(
            "vehicle", "t_ms", "seq", "x", "y", "phi",
            (before / (before + F.lit(noise))).alias("gain"), after.alias("variance"),
        )

    return in_order(odometry, body, hot_rows)
