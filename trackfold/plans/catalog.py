"""Every registered query: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfold.functions import geometry, motion, text
from trackfold.operators import associate, ekf, prep, scan, slam, track
from trackfold.plans import adapter
from trackfold.schema import METRE_SCAN, TRACK_KEYED, TRACK_STEPS, Vehicle
from trackfold.session import scratch_path
from trackfold.sources import exports, recordings
from trackfold.streaming import jobs, run, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MAX_JUMP, MIN_GROUP = 5.0, 2


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _round(column: str | Column, digits: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: _round(n, digits) for n in names})


# --- reading and parsing ---


@query
def parse_tagged(spark, sf_dir):
    lines = adapter.tagged_lines(adapter.sensors(spark, sf_dir))
    rows = recordings.accepted(recordings.tagged(lines))
    return rows.select("vehicle", "t_ms", "seq", "kind", "speed", "steering", "gps_x", "gps_y")


@query
def parse_rejected(spark, sf_dir):
    lines = adapter.tagged_lines(adapter.sensors(spark, sf_dir))
    return recordings.rejected(recordings.tagged(lines))


@query
def parse_scan(spark, sf_dir):
    line = F.concat_ws(",", "kind", "t_ms", adapter.scan_text("ranges"))
    lines = adapter.scans(spark, sf_dir).select("seq", line.alias("value"))
    rows = recordings.accepted(recordings.tagged(lines, vehicle="data"))
    return rows.select("vehicle", "t_ms", "seq", F.posexplode("ranges").alias("beam", "reading"))


@query
def parse_increments(spark, sf_dir):
    time = (F.col("t_ms") + 0.5).cast("string")
    line = F.concat_ws(",", time, "x_inc", "y_inc", "phi_inc", adapter.scan_text("ranges"))
    lines = adapter.scans(spark, sf_dir).select("seq", line.alias("value"))
    return recordings.increments(lines).select(
        "vehicle", "t_ms", "seq", "x_inc", "y_inc", "phi_inc",
        F.size("ranges").alias("n_beams"), F.array_max("ranges").alias("farthest"),
    )


@query
def parse_landmarks(spark, sf_dir):
    cloud = scan.track_with_cloud(adapter.scans(spark, sf_dir))
    printed = cloud.select("t_ms", "seq", text.points_text(F.col("landmarks")).alias("landmarks"))
    points = printed.select("t_ms", "seq", F.inline(text.points(F.col("landmarks"))))
    return _rounded(points, "lx", "ly")


@query
def text_files(spark, sf_dir):
    path = scratch_path(spark, "lines")
    adapter.tagged_lines(adapter.sensors(spark, sf_dir)).select("value").write.text(path)
    rows = recordings.read_tagged(spark, path)
    return rows.select("vehicle", "t_ms", "kind", "speed", "steering", "gps_x", "gps_y")


@query
def vehicle_files(spark, sf_dir):
    """Recordings told apart by their folder. One folder per sensor: few, however large the fleet."""
    path = scratch_path(spark, "recordings")
    lines = adapter.tagged_lines(adapter.sensors(spark, sf_dir))
    named = lines.select(F.split("value", "[,;]")[0].alias("recorder"), "value")
    named.filter(F.col("recorder").isin("odo", "gps")).write.partitionBy("recorder").text(path)
    back = recordings.read_vehicle_files(spark, path, vehicle_pattern=r"recorder=([^/]+)/")
    return back.select("vehicle", "t_ms", "kind", "speed", "steering", "gps_x", "gps_y")


@query
def text_stream(spark, sf_dir):
    path = scratch_path(spark, "arriving")
    adapter.tagged_lines(adapter.sensors(spark, sf_dir)).select("value").write.text(path)
    rows = recordings.accepted(recordings.tagged(recordings.stream_lines(spark, path, max_files=4)))
    out = rows.select("vehicle", "t_ms", "kind", "speed", "steering", "gps_x", "gps_y")
    return run.drain(out, "text-stream")


@query
def merged_files(spark, sf_dir):
    """Raw odometry and GPS files of different shape, merged on one clock."""
    rows = adapter.sensors(spark, sf_dir)
    odometry, fixes = scratch_path(spark, "odometry"), scratch_path(spark, "fixes")
    seconds = (F.col("t_ms") / 1000.0).alias("seconds")
    exports.write_csv(rows.filter("kind IN ('odo', 'error')").select("kind", seconds, "speed", "steering"), odometry)
    exports.write_csv(rows.filter("kind = 'gps'").select("t_ms", "gps_x", "gps_y"), fixes)
    merged = prep.merge_sensors(
        recordings.read_raw_odometry(spark, odometry), recordings.read_gps(spark, fixes)
    )
    return prep.by_time(merged).select("t_ms", "kind", "speed", "steering", "gps_x", "gps_y")


@query
def discrete_from_files(spark, sf_dir):
    """The discrete filter straight from odometry files, which name no vehicle."""
    path = scratch_path(spark, "odometry")
    # event numbers for times, so that no two rows are at one time
    rows = adapter.sensors(spark, sf_dir, "odo").select(F.col("seq").alias("t_ms"), "steering", "speed")
    exports.write_csv(rows, path)
    out = track.discrete_kalman(recordings.read_odometry(spark, path))
    return _rounded(out.select("vehicle", "t_ms", "x", "y", "phi", "gain", "variance"), "x", "y", "phi", "gain", "variance")


@query
def track_steps_roundtrip(spark, sf_dir):
    """The track file of five comma fields, written and read back."""
    path = scratch_path(spark, "steps")
    exports.write_csv(exports.track_steps(_ekf(spark, sf_dir)), path)
    rows = recordings.read_track_steps(spark, path).select("vehicle", "step", "t_ms", "x", "y")
    return _rounded(rows, "x", "y", digits=4)


@query
def gps_seconds_files(spark, sf_dir):
    path = scratch_path(spark, "seconds")
    rows = adapter.sensors(spark, sf_dir, "gps")
    exports.write_csv(rows.select((F.col("t_ms") / 1000.0).alias("seconds"), "gps_x", "gps_y"), path)
    return recordings.read_gps_seconds(spark, path).select("t_ms", "gps_x", "gps_y")


@query
def odometry_files(spark, sf_dir):
    path = scratch_path(spark, "steering")
    rows = adapter.sensors(spark, sf_dir, "odo")
    exports.write_csv(rows.select("t_ms", "steering", "speed"), path)
    return recordings.read_odometry(spark, path).select("t_ms", "steering", "speed")


# --- preparation ---


@query
def merge_sensors(spark, sf_dir):
    rows = adapter.sensors(spark, sf_dir)
    odometry = rows.filter("kind = 'odo'").select(
        "vehicle", "seq", "kind", (F.col("t_ms") / 1000.0).alias("seconds"), "speed", "steering"
    )
    fixes = rows.filter("kind = 'gps'").select(
        "vehicle", "seq", "t_ms", F.col("gps_x").alias("lat"), F.col("gps_y").alias("lon")
    )
    merged = prep.by_time(prep.merge_sensors(odometry, fixes))
    return merged.select("vehicle", "t_ms", "seq", "kind", "speed", "steering", "gps_x", "gps_y")


@query
def union_vehicles(spark, sf_dir):
    rows = adapter.sensors(spark, sf_dir)
    parts = [prep.route(rows, kind).drop(*drop) for kind, drop in
             (("odo", ("gps_x", "gps_y")), ("gps", ("speed", "steering")))]
    return prep.by_vehicle_and_time(prep.union_vehicles(*parts))


@query
def rekeyed_rows(spark, sf_dir):
    return prep.with_key(prep.route(adapter.sensors(spark, sf_dir, "odo"), "odo"), "data")


@query
def kind_counts(spark, sf_dir):
    return prep.count_kinds(adapter.sensors(spark, sf_dir))


@query
def gps_outliers(spark, sf_dir):
    fixes = prep.route(adapter.sensors(spark, sf_dir, "gps"), "gps").select("vehicle", "t_ms", "seq", "gps_x", "gps_y")
    return prep.mark_gps_outliers(fixes, MAX_JUMP, MIN_GROUP)


@query
def gps_cleaned(spark, sf_dir):
    fixes = prep.route(adapter.sensors(spark, sf_dir, "gps"), "gps").select("vehicle", "t_ms", "seq", "gps_x", "gps_y")
    return prep.drop_gps_outliers(fixes, MAX_JUMP, MIN_GROUP)


@query
def scalar_functions(spark, sf_dir):
    rows = prep.route(adapter.sensors(spark, sf_dir, "odo"), "odo")
    car = Vehicle()
    v, a = F.col("speed"), F.col("steering")
    forward, left, turn = motion.body_motion(F.col("t_ms") / 1000.0, v, a, car)
    return rows.select(
        "seq",
        _round(motion.centre_speed(v, a, car), 9).alias("centre_speed"),
        _round(motion.plane_x(a, forward, left), 8).alias("dx"),
        _round(motion.plane_y(a, forward, left), 8).alias("dy"),
        _round(turn).alias("dphi"),
        _round(geometry.wrap(F.col("seq") * a)).alias("wrapped"),
        geometry.align_clock(F.col("t_ms") / 1000.0, 20967).alias("aligned"),
        geometry.half_up(a * 50.0).alias("half_up"),
        _round(geometry.distance(v, a, F.lit(3.0), F.lit(4.0))).alias("away"),
        _round(F.degrees(a)).alias("degrees"),
        _round(geometry.beam_x(F.degrees(a), v, a)).alias("beam_x"),
        _round(geometry.beam_y(F.degrees(a), v, a)).alias("beam_y"),
        _round(geometry.sight_range(v, a)).alias("sight_range"),
        _round(geometry.sight_bearing(v, a, F.lit(0.25))).alias("sight_bearing"),
    )


# --- tracks ---


@query
def time_steps(spark, sf_dir):
    rows = prep.route(adapter.sensors(spark, sf_dir, "odo", "gps"), "odo", "gps").select("vehicle", "t_ms", "seq", "kind")
    return track.time_step(rows)


@query
def dead_reckoning(spark, sf_dir):
    out = track.dead_reckoning(adapter.sensors(spark, sf_dir, "odo"), adapter.START)
    return out.select("vehicle", "t_ms", "seq", _round("x").alias("x"), _round("y").alias("y"),
                      _round(F.sin("phi")).alias("sin_phi"), _round(F.cos("phi")).alias("cos_phi"))


@query
def pose_accumulate(spark, sf_dir):
    rows = adapter.scans(spark, sf_dir).drop("ranges", "kind")
    out = track.accumulate_pose(rows).select("vehicle", "t_ms", "seq", "x", "y", "phi")
    return _rounded(out, "x", "y", "phi")


@query
def discrete_kalman(spark, sf_dir):
    out = track.discrete_kalman(adapter.sensors(spark, sf_dir, "odo"))
    return _rounded(out, "x", "y", "phi", "gain", "variance", digits=8)


# --- scans ---


@query
def clean_scan(spark, sf_dir):
    rows = adapter.raw_scans(spark, sf_dir)
    rows = rows.select("vehicle", "seq", F.posexplode(scan.clean_raw(F.col("ranges"))).alias("beam", "range"))
    return _rounded(rows, "range")


@query
def segment_scan(spark, sf_dir):
    rows = adapter.scans(spark, sf_dir)
    out = rows.select("vehicle", "seq", F.inline(scan.segment_stats(F.col("ranges"), METRE_SCAN)))
    out = out.drop("degrees", "reach")
    return _rounded(out, "width", "mean", "nearest", "diameter")


def _objects(df: DataFrame) -> DataFrame:
    return _rounded(df, "x", "y", "diameter", "range", "bearing")


@query
def extract_objects(spark, sf_dir):
    out = scan.track_with_objects(adapter.scans(spark, sf_dir))
    rows = out.select("vehicle", "seq", "phi", F.inline("objects")).drop("range", "bearing")
    return _rounded(rows, "x", "y", "diameter", "phi")


@query
def extract_objects_raw(spark, sf_dir):
    return _objects(scan.raw_objects(adapter.raw_scans(spark, sf_dir), F.col("phi_inc"), "vehicle", "seq"))


@query
def landmark_cloud(spark, sf_dir):
    cloud = scan.track_with_cloud(adapter.scans(spark, sf_dir), max_range=45.0)
    rows = cloud.select("vehicle", "t_ms", "seq", "x", "y", F.inline("landmarks"))
    return _rounded(rows, "x", "y", "lx", "ly")


@query
def associate_landmarks(spark, sf_dir):
    number = (F.col("seq") - adapter.SCAN_SEQ) * 1000 + F.col("first")
    seen = scan.raw_objects(adapter.raw_scans(spark, sf_dir), F.lit(0.0), "vehicle", "seq")
    known = scan.metre_objects(adapter.scans(spark, sf_dir), F.lit(0.0), "vehicle", "seq")
    out = associate.associate(
        seen.select("vehicle", number.alias("obs_id"), "x", "y"),
        known.select("vehicle", number.alias("idx"), "x", "y"),
    )
    return _rounded(out, "x", "y", "lx", "ly")


# --- GPS filter ---


def _ekf(spark, sf_dir, **changes) -> DataFrame:
    return ekf.ekf_track(adapter.sensors(spark, sf_dir, "odo", "gps"), adapter.EKF.at(**changes))


def _pose(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.withColumns({
        "x": _round("x", digits), "y": _round("y", digits),
        "sin_phi": _round(F.sin("phi"), digits), "cos_phi": _round(F.cos("phi"), digits),
    }).drop("phi")


@query
def ekf_track(spark, sf_dir):
    out = ekf.ekf_track(adapter.sensors(spark, sf_dir, "odo", "gps"), adapter.EKF, covariance=True)
    return _rounded(_pose(out), *ekf.COVARIANCE, digits=4)


@query
def ekf_final(spark, sf_dir):
    out = ekf.ekf_final(adapter.sensors(spark, sf_dir, "odo", "gps"), adapter.EKF)
    return _rounded(_pose(out), *ekf.COVARIANCE, digits=4)


@query
def ekf_step_xy(spark, sf_dir):
    return _rounded(exports.step_xy(_ekf(spark, sf_dir)), "x", "y", digits=4)


@query
def ekf_time_xy(spark, sf_dir):
    return _rounded(exports.time_xy(_ekf(spark, sf_dir)), "x", "y", digits=4)


@query
def ekf_updates_only(spark, sf_dir):
    return _pose(ekf.ekf_track(adapter.sensors(spark, sf_dir, "odo", "gps"), adapter.EKF, emit=("update",)))


@query
def ekf_predictions_only(spark, sf_dir):
    rows = prep.route(adapter.sensors(spark, sf_dir, "odo"), "odo")
    return _pose(ekf.ekf_track(rows, adapter.EKF))


@query
def ekf_observer(spark, sf_dir):
    return _pose(_ekf(spark, sf_dir, innovation="observer"))


@query
def ekf_difference(spark, sf_dir):
    return _pose(_ekf(spark, sf_dir, innovation="difference"))


@query
def ekf_gps_only(spark, sf_dir):
    return _pose(_ekf(spark, sf_dir, innovation="gps_only"))


@query
def ekf_pose_only(spark, sf_dir):
    return _pose(_ekf(spark, sf_dir, innovation="pose_only"))


@query
def step_shift(spark, sf_dir):
    return _rounded(prep.shifts(_judged(spark, sf_dir)), "distance", digits=4)


def _judged(spark, sf_dir) -> DataFrame:
    return ekf.ekf_judged(adapter.sensors(spark, sf_dir, "odo", "gps"), adapter.EKF)


def _errors(spark, sf_dir) -> DataFrame:
    return prep.prediction_error(_ekf(spark, sf_dir), sized_by=adapter.sensors(spark, sf_dir, "odo", "gps"))


@query
def prediction_error(spark, sf_dir):
    out = prep.errors(_judged(spark, sf_dir))
    return _rounded(out, "pred_x", "pred_y", "upd_x", "upd_y", "error", digits=4)


@query
def evaluation_rows(spark, sf_dir):
    out = prep.evaluation_row(_errors(spark, sf_dir))
    return _rounded(out, "pred_x", "pred_y", "upd_x", "upd_y", "distance", digits=4)


# --- mapping filter ---


@query
def slam_track(spark, sf_dir):
    return _rounded(slam.slam_track(adapter.mapping_rows(spark, sf_dir), adapter.SLAM), "x", "y", "phi", digits=3)


@query
def slam_map(spark, sf_dir):
    return _rounded(slam.slam_map(adapter.mapping_rows(spark, sf_dir), adapter.SLAM), "x", "y", digits=3)


@query
def slam_fast(spark, sf_dir):
    out = slam.slam_track(adapter.mapping_rows(spark, sf_dir), adapter.SLAM.at(predict="fast"))
    return _rounded(out, "x", "y", "phi", digits=3)


@query
def slam_relative(spark, sf_dir):
    out = slam.slam_track(adapter.mapping_rows(spark, sf_dir), adapter.SLAM.at(frame="relative"))
    return _rounded(out, "x", "y", "phi", digits=3)


@query
def slam_predictions_only(spark, sf_dir):
    rows = prep.route(adapter.mapping_rows(spark, sf_dir), "odo")
    return _pose(slam.slam_track(rows, adapter.SLAM), digits=8).drop("landmarks")


# --- sinks ---


@query
def export_points(spark, sf_dir):
    rows = adapter.sensors(spark, sf_dir)
    return exports.value_points(rows, "speed of car", "speed", decimals=6)


@query
def export_gps_points(spark, sf_dir):
    return exports.gps_points(adapter.sensors(spark, sf_dir), "gps", "gps_x", "gps_y", decimals=6)


@query
def export_sensor_points(spark, sf_dir):
    rows = adapter.sensors(spark, sf_dir)
    return exports.sensor_points(rows, "sensor", "gps_x", "gps_y", "steering", decimals=6)


@query
def track_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "track")
    exports.write_csv(exports.vehicle_time_xy(_ekf(spark, sf_dir)), path, sep=";")
    label = F.split("key", ",")
    back = recordings.read_csv(spark, TRACK_KEYED, path, sep=";")
    rows = back.select(label[0].alias("vehicle"), label[1].alias("step"), "t_ms", "x", "y")
    return _rounded(rows, "x", "y", digits=4)


@query
def track_parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "track")
    exports.write_parquet(exports.track_steps(_ekf(spark, sf_dir)), path, "step")
    rows = spark.read.schema(TRACK_STEPS).parquet(path).select("vehicle", "step", "t_ms", "x", "y")
    return _rounded(rows, "x", "y", digits=4)


@query
def track_landmark_files(spark, sf_dir):
    path = scratch_path(spark, "cloud")
    cloud = scan.track_with_cloud(adapter.scans(spark, sf_dir), max_range=45.0)
    exports.write_csv(exports.time_xy_landmark_text(cloud), path, sep=";")
    rows = recordings.read_track_landmarks(spark, path).select("t_ms", "x", "y", F.inline("landmarks"))
    return _rounded(rows, "x", "y", "lx", "ly")


# --- streams ---


@query
def fix_windows(spark, sf_dir):
    return windows.fix_windows(adapter.sensors(spark, sf_dir))


# no row of these tables is further behind the newest of its files than this
TABLE_DELAY = "1 hour"


def _drained(spark, name: str, job: Callable, *sources: tuple[DataFrame, str]) -> DataFrame:
    """What the job makes of the whole recording, in event time, and no row late."""
    end = run.end_mark(spark, name)
    rows = [jobs.timed(run.with_end(source, end, kind), TABLE_DELAY) for source, kind in sources]
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1], allowMissingColumns=True)
    return jobs.on_time(run.drain(job(both), name, end=end))


@query
def move_stream(spark, sf_dir):
    rows = _scan_stream(spark, sf_dir).drop("ranges")
    return _rounded(_drained(spark, "move", jobs.move_stream, (rows, "laser")), "x", "y", "phi")


@query
def objects_stream(spark, sf_dir):
    out = _drained(spark, "objects", jobs.objects_stream, (_scan_stream(spark, sf_dir), "laser"))
    rows = out.select("vehicle", "seq", "phi", F.inline("objects")).drop("range", "bearing")
    return _rounded(rows, "x", "y", "diameter", "phi")


@query
def discrete_stream(spark, sf_dir):
    out = _drained(spark, "discrete", jobs.discrete_stream, (_sensor_stream(spark, sf_dir), "odo"))
    return _rounded(out, "x", "y", "phi", "gain", "variance", digits=8)


@query
def ekf_stream(spark, sf_dir):
    job = lambda rows: jobs.ekf_stream(rows, adapter.EKF)
    return _pose(_drained(spark, "ekf", job, (_sensor_stream(spark, sf_dir), "odo")))


@query
def ekf_text_stream(spark, sf_dir):
    """Text files as recorded, parsed and tracked while they arrive."""
    path = scratch_path(spark, "arriving")
    lines = adapter.tagged_lines(adapter.sensors(spark, sf_dir)).orderBy("seq")
    lines.select("value").write.text(path)
    rows = recordings.accepted(recordings.tagged(recordings.stream_lines(spark, path, max_files=4)))
    job = lambda rows: jobs.ekf_stream(rows, adapter.EKF)
    return _pose(_drained(spark, "ekf-text", job, (rows, "odo")).drop("seq"))


@query
def slam_stream(spark, sf_dir):
    rows = _sensor_stream(spark, sf_dir).filter("kind = 'odo'").select(
        "vehicle", "t_ms", "seq", "kind", "speed", "steering")
    laser = _scan_stream(spark, sf_dir).select(
        "vehicle", "t_ms", "seq", "kind", F.transform("ranges", lambda r: r * 100.0).alias("ranges"))
    job = lambda rows: jobs.slam_stream(rows, adapter.SLAM)
    return _rounded(_drained(spark, "slam", job, (rows, "odo"), (laser, "laser")), "x", "y", "phi", digits=3)


@query
def window_stream(spark, sf_dir):
    """Windows kept up to date by every micro-batch, in whatever order rows arrive."""
    table = scratch_path(spark, "windows")
    windows.drain_windows(_sensor_stream(spark, sf_dir), table, scratch_path(spark, "windows-state"))
    return windows.read_windows(spark, table)


def _sensor_stream(spark, sf_dir) -> DataFrame:
    return adapter.sensor_rows(adapter.event_stream(spark, sf_dir))


def _scan_stream(spark, sf_dir) -> DataFrame:
    return adapter.scan_rows(adapter.scan_source(spark, sf_dir))
