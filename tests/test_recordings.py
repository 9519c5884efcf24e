"""Readers, parsers, preparation and writers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from trackfold.functions import geometry
from trackfold.operators import prep, track
from trackfold.schema import ODOMETRY, TRACK_STEPS
from trackfold.sources import exports, recordings
from trackfold.streaming import windows


def lines_of(spark, *lines):
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "seq bigint, value string")


def test_tagged_lines(spark):
    df = lines_of(
        spark,
        "odo,21000,0.1,2.5,1", "gps;21010;-41.5;-67.5;2", 'laser,21819,"[1.0, 1.5, 9.0]"',
        "sonar,1,2,3,4", "odo,x,0.1,2.5,1", "odo,21000,zero,2.5,1", "odo,21000,0.1", "",
    )
    parsed = recordings.tagged(df)
    good = {r.seq: r for r in recordings.accepted(parsed).collect()}
    assert sorted(good) == [0, 1]
    assert (good[0].vehicle, good[0].t_ms, good[0].speed, good[0].steering) == ("vehicle1", 21000, 2.5, 0.1)
    assert (good[1].vehicle, good[1].gps_x, good[1].gps_y, good[1].speed) == ("vehicle2", -67.5, -41.5, None)
    bad = sorted((r.reason, r.line) for r in recordings.rejected(parsed).collect())
    assert [reason for reason, _ in bad] == ["kind", "kind", "number", "time", "vehicle", "vehicle"]


def test_scan_lines_with_one_vehicle(spark):
    df = lines_of(spark, 'laser,21819,"[1.0, 1.5, 9.0]"', 'laser,5,"[1.0, x]"', "odo,1,0.1,2.5")
    parsed = recordings.tagged(df, vehicle="data")
    good = {r.seq: r for r in recordings.accepted(parsed).collect()}
    assert good[0].ranges == [1.0, 1.5, 9.0] and good[0].vehicle == "data"
    assert good[2].speed == 2.5
    assert recordings.rejected(parsed).collect()[0].reason == "number"


def test_increment_lines(spark):
    row = recordings.increments(lines_of(spark, '12.5,0.1,-0.2,0.3,"[4.0, 5.5]"')).first()
    assert (row.t_ms, row.x_inc, row.y_inc, row.phi_inc, row.ranges) == (13, 0.1, -0.2, 0.3, [4.0, 5.5])


def test_line_order_survives_splits(spark, tmp_path):
    path = str(tmp_path / "long.txt")
    with open(path, "w") as out:
        out.writelines(f"odo,{i // 10},0.1,{i}.0,1\n" for i in range(20000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = recordings.read_tagged(spark, path)
        assert rows.rdd.getNumPartitions() > 4
        assert [r.speed for r in rows.orderBy("t_ms", "seq").collect()] == [float(i) for i in range(20000)]
        track.dead_reckoning(rows).count()  # seq is a struct here and orders all the same
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_file_per_vehicle(spark, tmp_path):
    for name in ("red", "blue"):
        (tmp_path / f"{name}.csv").write_text("odo,1,0.1,2.5\ngps,2,3.5,4.5\n")
    rows = recordings.read_vehicle_files(spark, str(tmp_path / "red.csv"), str(tmp_path / "blue.csv"))
    assert sorted((r.vehicle, r.kind) for r in rows.collect()) == [
        ("blue", "gps"), ("blue", "odo"), ("red", "gps"), ("red", "odo")]


def test_headerless_files(spark, tmp_path):
    (tmp_path / "odo.csv").write_text("100,0.1,2.5\n")
    (tmp_path / "raw.csv").write_text("odo,0.0335,2.5,0.1\nother,1.0,0,0\n")
    (tmp_path / "gps.csv").write_text("150,-41.5,-67.5\n")
    (tmp_path / "seconds.csv").write_text("0.0,0.0,0.0\n1.2015,-0.11,0.03\n")
    (tmp_path / "steps.csv").write_text("vehicle1,prediction,5,1.5,2.5\n")
    (tmp_path / "marks.csv").write_text("7;1.0;2.0;[(1.5, -2.0), (3.0, 4e1)]\n8;1.0;2.0;[]\n")
    at = lambda name: str(tmp_path / name)
    odometry = recordings.read_odometry(spark, at("odo.csv"))
    assert odometry.select("vehicle", "t_ms", "kind", "steering", "speed").first() == ("full", 100, "odo", 0.1, 2.5)
    assert track.discrete_kalman(odometry).count() == 1
    fixes = recordings.read_gps_seconds(spark, at("seconds.csv")).orderBy("t_ms").collect()
    assert [(r.t_ms, r.gps_x, r.gps_y) for r in fixes] == [(0, 0.0, 0.0), (1202, -0.11, 0.03)]
    assert recordings.read_track_steps(spark, at("steps.csv")).first() == ("vehicle1", "prediction", 5, 1.5, 2.5)
    marks = recordings.read_track_landmarks(spark, at("marks.csv")).orderBy("t_ms").collect()
    assert [tuple(p) for p in marks[0].landmarks] == [(1.5, -2.0), (3.0, 40.0)] and marks[1].landmarks == []
    merged = prep.merge_sensors(recordings.read_raw_odometry(spark, at("raw.csv")),
                                recordings.read_gps(spark, at("gps.csv")))
    merged = prep.by_time(merged).collect()
    assert [(r.kind, r.t_ms) for r in merged] == [("gps", 150), ("odo", 21001)]
    assert merged[0].gps_y == -67.5 and merged[0].speed is None


def test_half_up(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (-2.6,), (3.49,)], "v double")
    assert [r[0] for r in df.select(geometry.half_up(F.col("v"))).collect()] == [3, -2, -3, 3]
    assert df.select(geometry.wrap(F.lit(-7.0))).first()[0] == pytest.approx(math.fmod(-7.0, 2 * math.pi))


def steps_frame(spark, rows):
    return spark.createDataFrame(rows, "vehicle string, step string, t_ms bigint, seq bigint, x double, y double")


def test_step_shift(spark):
    rows = [("v", "update", 1, 0, 0.0, 0.0), ("v", "update", 2, 0, 3.0, 4.0), ("v", "update", 2, 1, 3.0, 4.0),
            ("w", "update", 1, 0, 9.0, 9.0)]
    got = prep.step_shift(steps_frame(spark, rows)).orderBy("seq", "t_ms").collect()
    assert [r.distance for r in got] == [5.0, 0.0]


def test_prediction_error(spark):
    rows = [("v", "update", 0, 0, 1.0, 1.0), ("v", "prediction", 1, 0, 0.0, 0.0), ("v", "prediction", 2, 0, 1.0, 1.0),
            ("v", "update", 3, 0, 4.0, 5.0), ("v", "update", 4, 0, 1.0, 1.0), ("w", "update", 5, 0, 1.0, 1.0)]
    got = prep.prediction_error(steps_frame(spark, rows)).orderBy("t_ms").collect()
    assert [r.error for r in got] == [None, 5.0, 0.0, None]


def test_outliers(spark):
    rows = [("v", t, 0, x, 0.0) for t, x in enumerate([0.0, 1.0, 2.0, 90.0, 91.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "vehicle string, t_ms bigint, seq bigint, gps_x double, gps_y double")
    kept = prep.drop_gps_outliers(df, max_jump=10.0, min_group=3)
    assert kept.columns == df.columns
    assert sorted(r.gps_x for r in kept.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_variance_closed_form(spark):
    rows = [("v", t, 0, "odo", 1.0, 0.1) for t in range(3)]
    df = spark.createDataFrame(rows, "vehicle string, t_ms bigint, seq bigint, kind string, speed double, steering double")
    got = track.discrete_kalman(df).orderBy("t_ms").collect()
    assert [r.variance for r in got] == pytest.approx([1 / 11, 1 / 21, 1 / 31])


def test_point_lines(spark, tmp_path):
    df = spark.createDataFrame([("a b", 5, 1.5, None), ("c", 6, None, None), ("d", 7, 2.0, 3.25)],
                               "vehicle string, t_ms bigint, x double, y double")
    lines = exports.gps_points(df, "my fix", "x", "y")
    assert sorted(r.value for r in lines.collect()) == [
        r"my\ fix,key=a\ b latitude=1.5 5", r"my\ fix,key=d latitude=2.0,longitude=3.25 7"]
    path = str(tmp_path / "points")
    exports.points_batch_writer(path, "m", {"value": "x"}, key=None)(df, 3)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["m value=1.5 5", "m value=2.0 7"]


def test_single_file(spark, tmp_path):
    path = tmp_path / "out"
    exports.write_csv(spark.range(100).repartition(5), str(path), sep=";", single_file=True)
    assert len(list(path.glob("part-*"))) == 1


def test_windows(spark):
    rows = [("v", 0, 0, "gps", 1.0, 2.0), ("v", 199, 1, "odo", None, None), ("v", 150, 2, "gps", 3.0, 4.0),
            ("v", 200, 3, "odo", None, None)]
    df = spark.createDataFrame(rows, "vehicle string, t_ms bigint, seq bigint, kind string, gps_x double, gps_y double")
    got = windows.fix_windows(df).orderBy("window_ms").collect()
    assert [tuple(r) for r in got] == [("v", 0, 3, 3.0, 4.0), ("v", 200, 1, None, None)]


def test_order_helpers(spark):
    rows = spark.createDataFrame([("v", 2, 0), ("v", 1, 1), ("u", 3, 0)], "vehicle string, t_ms bigint, seq bigint")
    assert [r.t_ms for r in prep.by_time(rows).collect()] == [1, 2, 3]
    assert [(r.vehicle, r.t_ms) for r in prep.by_vehicle_and_time(rows).collect()] == [("u", 3), ("v", 1), ("v", 2)]


def test_names_and_numbers_of_tagged_lines(spark):
    lines = ["odo,1,0.1,2.5,a b", "odo;2;0.1;2.5;ab", 'odo, 3 , 0.1 ,2.5,"ab"', "odo,4,NaN,2.5,ab", "gps,5,1.0,Infinity,ab",
             "odo,xx,0.1,2.5,ab", "odo,7,0.1,2.5", "radar,8,0.1,2.5,ab"]
    parsed = recordings.tagged(lines_of(spark, *lines))
    assert sorted(r.vehicle for r in recordings.accepted(parsed).collect()) == ['vehicle"ab"', "vehiclea b", "vehicleab"]
    assert sorted(r.reason for r in recordings.rejected(parsed).collect()) == ["kind", "number", "number", "time", "vehicle"]


def test_rejected_rows_of_every_reader(spark, tmp_path):
    (tmp_path / "odo.csv").write_text("100,0.1,2.5\nxx,0.1,2.5\n200,NaN,2.5\n300,0.1\n")
    parsed = recordings.parsed_csv(spark, ODOMETRY, str(tmp_path / "odo.csv"), kind="odo")
    assert [r.t_ms for r in recordings.accepted(parsed).collect()] == [100]
    assert sorted(r.line for r in recordings.rejected(parsed).collect()) == ["200,NaN,2.5", "300,0.1,", "xx,0.1,2.5"]
    lines = lines_of(spark, '1.0,0.1,0.2,0.3,"[1.0]"', '2.0,0.1,,0.3,"[1.0]"', 'z,0.1,0.2,0.3,"[1.0]"', '3.0,0.1,0.2,0.3,"[inf]"')
    parsed = recordings.parsed_increments(lines)
    assert sorted(r.reason for r in recordings.rejected(parsed).collect()) == ["number", "number", "time"]


def test_rejected_rows_of_track_files(spark, tmp_path):
    (tmp_path / "steps.csv").write_text("v,update,5,1.5,2.5\nv,update,5,,2.5\nv,update,x,1.5,2.5\nv,update,5,inf,2.5\n")
    steps = str(tmp_path / "steps.csv")
    assert [tuple(r) for r in recordings.read_track_steps(spark, steps).collect()] == [("v", "update", 5, 1.5, 2.5)]
    assert recordings.rejected(recordings.parsed_csv(spark, TRACK_STEPS, steps)).count() == 3
    good = ["[]", " [ ( 1 , -2e1 ),(3,4) ] "]
    bad = ["", "[(1, 2)", "[(1, 2) (3, 4)]", "[(1, 2), (x, 4)]", "[(1, 2, 3)]", "[(1.2.3, 4)]", "[(1e999, 4)]", "[p]", "(1, 2)", "[(1, NaN)]"]
    (tmp_path / "marks.csv").write_text("".join(f"{n};1.0;2.0;{t}\n" for n, t in enumerate(good + bad)) + "99;y;2.0;[]\n")
    parsed = recordings.parsed_track_landmarks(spark, str(tmp_path / "marks.csv"))
    got = recordings.accepted(parsed).orderBy("t_ms").collect()
    assert [[tuple(p) for p in r.landmarks] for r in got] == [[], [(1.0, -20.0), (3.0, 4.0)]]
    reasons = sorted(r.reason for r in recordings.rejected(parsed).collect())
    assert reasons == ["landmarks"] * len(bad) + ["number"]


@pytest.mark.parametrize("split", ["200", "100000000"])
def test_order_of_equal_times_in_two_files(spark, tmp_path, split):
    for n, name in enumerate(("b.csv", "a.csv")):
        (tmp_path / name).write_text("".join(f"odo,5,0.1,{n}.{i:03d},1\n" for i in range(100)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = recordings.read_tagged(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
        got = [r.speed for r in rows.orderBy("t_ms", "seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [n + i / 1000 for n in (1, 0) for i in range(100)]
