"""A hot vehicle is cut into slices; the result must be that of the uncut vehicle."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackfold.operators import ekf, prep, slam, slices, steps, track
from trackfold.operators.ordered import split_hot
from trackfold.plans import adapter
from trackfold.schema import EkfConfig, Start, Vehicle

HOT = 40


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    """A third of all rows belong to one vehicle."""
    sensors = adapter.sensors(spark, sf_dir)
    skewed = F.when(F.col("seq") % 3 == 0, F.lit("vehicle3")).otherwise(F.col("vehicle"))
    return sensors.withColumn("vehicle", skewed)


def frame(df, *order):
    pdf = df.toPandas()
    return pdf[sorted(pdf.columns)].sort_values(list(order), kind="stable").reset_index(drop=True)


def same(a, b, order=("vehicle", "t_ms", "seq"), exact=False):
    tolerance = {"check_exact": True} if exact else {"rtol": 1e-9, "atol": 1e-9}
    pd.testing.assert_frame_equal(frame(a, *order), frame(b, *order), check_dtype=True, **tolerance)


def test_split_keeps_all_rows_and_bounds_slices(rows):
    split = split_hot(rows, HOT)
    hot = split.hot
    assert split.usual.count() + hot.count() == rows.count() == split.rows
    sizes = hot.groupBy("slice").count().agg(F.max("count")).first()[0]
    assert sizes < 4 * HOT
    # slices follow the row order
    spans = hot.groupBy("vehicle", "slice").agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))
    spans = spans.toPandas().sort_values(["vehicle", "slice"])
    for _, part in spans.groupby("vehicle"):
        assert (part["a"].iloc[1:].values >= part["b"].iloc[:-1].values).all()


def test_nothing_hot_changes_nothing(rows):
    split = split_hot(rows, 10_000)
    assert split.usual is rows and split.hot is None


def test_dead_reckoning(rows):
    same(track.dead_reckoning(rows, hot_rows=None), track.dead_reckoning(rows, hot_rows=HOT))


def test_discrete_kalman(rows):
    same(track.discrete_kalman(rows, hot_rows=None), track.discrete_kalman(rows, hot_rows=HOT))


def test_time_step(rows):
    same(track.time_step(rows, 5, hot_rows=None), track.time_step(rows, 5, hot_rows=HOT))


def test_pose(rows):
    moved = rows.filter("kind = 'odo'").select(
        "vehicle", "t_ms", "seq", F.col("speed").alias("x_inc"), (F.col("speed") / 7).alias("y_inc"),
        F.col("steering").alias("phi_inc"))
    same(track.accumulate_pose(moved, hot_rows=None), track.accumulate_pose(moved, hot_rows=HOT))


def test_slices_are_read_twice(rows):
    """The pose of a hot vehicle: once to drive each slice by itself, once from where it begins."""
    moved = rows.filter("kind = 'odo'").select(
        "vehicle", "t_ms", "seq", F.col("speed").alias("x_inc"), (F.col("speed") / 7).alias("y_inc"),
        F.col("steering").alias("phi_inc"))
    for hot in (track.dead_reckoning(rows, hot_rows=HOT), track.accumulate_pose(moved, hot_rows=HOT)):
        plan = hot._jdf.queryExecution().executedPlan().toString()
        assert sum("slice" in line for line in plan.splitlines() if "FileScan" in line) == 2


@pytest.mark.parametrize("jump", [5.0, 50.0])
def test_outliers(rows, jump):
    fixes = rows.filter("kind = 'gps'").select("vehicle", "t_ms", "seq", "gps_x", "gps_y")
    same(prep.mark_gps_outliers(fixes, jump, 3, hot_rows=None), prep.mark_gps_outliers(fixes, jump, 3, hot_rows=20))


def test_track_judging(rows):
    walked = ekf.ekf_track(rows, adapter.EKF, hot_rows=None)
    same(prep.step_shift(walked, hot_rows=None), prep.step_shift(walked, hot_rows=HOT))
    same(prep.prediction_error(walked, hot_rows=None), prep.prediction_error(walked, hot_rows=HOT))


@pytest.mark.parametrize("long", [1, ekf.LONG_TRACK])
def test_judged_track(rows, monkeypatch, long):
    """Values out of the filter are those of windows over its track: by vehicle, in time order, in slices."""
    monkeypatch.setattr(ekf, "LONG_TRACK", long)
    walked = ekf.ekf_track(rows, adapter.EKF, hot_rows=None)
    shifts, errors = prep.step_shift(walked, hot_rows=None), prep.prediction_error(walked, hot_rows=None)
    for hot in (HOT, 10_000_000):
        judged = ekf.ekf_judged(rows, adapter.EKF, hot_rows=hot)
        same(shifts, prep.shifts(judged), exact=True)
        same(errors, prep.errors(judged), exact=True)


@pytest.mark.parametrize("by_time", [False, True])
def test_judged_track_over_blocks(rows, monkeypatch, by_time):
    """A vehicle's memory goes from block to block."""
    keys = [] if by_time else ["vehicle"]
    table = ekf.ekf_input(rows).orderBy(*keys, "t_ms", "seq").toArrow()
    outs = []
    for block in (7, 10**6):
        monkeypatch.setattr(ekf, "BLOCK_ROWS", block)
        fold = ekf._Fold(adapter.EKF, "judged", False, None, by_time)
        out = pa.Table.from_batches(fold(iter(table.to_batches(max_chunksize=3)))).to_pandas()
        outs.append(out.sort_values(["vehicle", "t_ms", "seq"]).reset_index(drop=True))
    assert outs[0]["pred_x"].notna().sum() > len(table) // 2
    pd.testing.assert_frame_equal(*outs, check_exact=False, rtol=1e-12, atol=1e-12)


def test_judging_moves_nothing(rows):
    for judge in (prep.shifts, prep.errors):
        plan = judge(ekf.ekf_judged(rows, adapter.EKF))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan


@pytest.mark.parametrize("config", [adapter.EKF, EkfConfig()], ids=["adapter", "default"])
def test_ekf(rows, config):
    whole = ekf.ekf_track(rows, config, covariance=True, hot_rows=None)
    same(whole, ekf.ekf_track(rows, config, covariance=True, hot_rows=HOT))


def test_ekf_final(rows):
    same(ekf.ekf_final(rows, adapter.EKF, hot_rows=None), ekf.ekf_final(rows, adapter.EKF, hot_rows=HOT), ("vehicle",))


def test_slam(spark, sf_dir):
    mapping = adapter.mapping_rows(spark, sf_dir).filter(F.col("vehicle").isin("vehicle1", "vehicle2", "vehicle3"))
    same(slam.slam_track(mapping, adapter.SLAM, hot_rows=None), slam.slam_track(mapping, adapter.SLAM, hot_rows=30))
    same(slam.slam_map(mapping, adapter.SLAM, hot_rows=None), slam.slam_map(mapping, adapter.SLAM, hot_rows=30),
         ("vehicle", "idx"))


def drive(spark, rows_per_fix=8, n=20000):
    """A car on a winding road whose fixes fit its odometry."""
    rng = np.random.default_rng(1)
    x = y = phi = 0.0
    rows = []
    for i in range(n):
        t, v, a = (i + 1) * 25, 3 + math.sin(i / 900), 0.25 * math.sin(i / 1500)
        dx, dy, turn = steps.motion(math, phi, 0.025, v, a, Vehicle())
        x, y, phi = x + dx, y + dy, phi + turn
        rows.append(("car", t, 2 * i, "odo", v, a, None, None))
        if i % rows_per_fix == 0:
            rows.append(("car", t, 2 * i + 1, "gps", None, None, x + rng.normal(0, 0.3), y + rng.normal(0, 0.3)))
    return spark.createDataFrame(rows, "vehicle string, t_ms bigint, seq bigint, kind string, speed double, "
                                       "steering double, gps_x double, gps_y double")


def test_a_forgetting_filter_needs_few_passes(spark, monkeypatch):
    rows = drive(spark)
    passes = []
    with_starts = slices.with_starts
    monkeypatch.setattr(slices, "with_starts", lambda *a: passes.append(1) or with_starts(*a))
    config = EkfConfig(start=Start())
    cut = ekf.ekf_track(rows, config, covariance=True, hot_rows=2500)
    same(ekf.ekf_track(rows, config, covariance=True, hot_rows=None), cut, exact=True)
    assert len(passes) <= 5  # about ten slices; the last pass writes the track


def test_reckoning_with_nulls_in_slices(spark):
    """Slices of one row and of several, nulls in the first, the last and all rows of some."""
    rows = [("v", 40 * t + t % 3, t, "odo", None if t % 10 in (3, 4, 9) or t < 2 else 3.0 + t % 5,
             None if t % 13 == 6 else 0.02 * (t % 9 - 4)) for t in range(60)]
    df = spark.createDataFrame(rows, "vehicle string, t_ms bigint, seq bigint, kind string, speed double, steering double")
    whole = track.dead_reckoning(df, hot_rows=None).orderBy("t_ms").collect()
    assert whole[0].x is None and whole[-1].x is not None
    for hot in (1, 3, 9, 20):
        for a, b in zip(whole, track.dead_reckoning(df, hot_rows=hot).orderBy("t_ms").collect()):
            for x, y in zip(a, b):
                assert (x is None) == (y is None) and (x is None or x == pytest.approx(y))


def test_nulls_at_the_edges_of_slices(spark):
    """Running values of a vehicle that is cut are those of the uncut one, nulls at any edge."""
    rows = [("v", t, t, None if t % 10 in (3, 4, 9) or t < 2 else 1.0, 0.0 if t % 7 else None, 0.1) for t in range(60)]
    df = spark.createDataFrame(rows, "vehicle string, t_ms bigint, seq bigint, x_inc double, y_inc double, phi_inc double")
    for hot in (1, 3, 9, 20):
        whole, cut = (track.accumulate_pose(df, hot_rows=h).orderBy("t_ms").collect() for h in (None, hot))
        for a, b in zip(whole, cut):
            for x, y in zip(a[3:], b[3:]):
                assert (x is None) == (y is None) and (x is None or x == pytest.approx(y))
