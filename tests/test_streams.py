"""Streams equal the batch operators, for any cut of time into micro-batches."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackfold.operators import ekf, scan, track
from trackfold.plans import adapter
from trackfold.schema import SENSOR
from trackfold.sources import recordings
from trackfold.streaming import jobs, run, windows

CUTS = (0, 4000, 9000, 15000, 30000)


def files_in_time_order(rows, path):
    """One file per stretch of time, written one after the other."""
    for low, high in zip(CUTS, CUTS[1:]):
        rows.filter((F.col("t_ms") >= low) & (F.col("t_ms") < high)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream_of(spark, rows, path):
    """Files that are not in order of time, one a micro-batch, and the mark of the recording's end."""
    for part in (2, 0, 3, 1):
        rows.filter(F.expr(f"t_ms div 4000 % 4 = {part}")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    end = run.end_mark(spark, "t")
    return run.with_end(stream, end, "laser" if "ranges" in rows.columns else "odo"), end


def close(got, want, *numbers):
    keys = ["vehicle", "t_ms", "seq"]
    assert got.filter("late").count() == 0
    got, want = (df.orderBy(*keys).toPandas() for df in (jobs.on_time(got), want))
    assert len(got) == len(want) and (got[keys] == want[keys]).all(axis=None)
    assert np.allclose(got[list(numbers)], want[list(numbers)], atol=1e-9)


@pytest.fixture(scope="module")
def sensors(spark, sf_dir):
    return adapter.sensors(spark, sf_dir).filter("vehicle like 'vehicle1%'")


def test_ekf(spark, sensors, tmp_path):
    stream, end = stream_of(spark, sensors, str(tmp_path / "in"))
    close(run.drain(jobs.ekf_stream(stream, adapter.EKF), "t", end=end), ekf.ekf_track(sensors, adapter.EKF), "x", "y", "phi")


def test_discrete(spark, sensors, tmp_path):
    stream, end = stream_of(spark, sensors, str(tmp_path / "in"))
    close(run.drain(jobs.discrete_stream(stream), "t", end=end), track.discrete_kalman(sensors), "x", "y", "phi", "variance")


def test_move_with_cloud(spark, sf_dir, tmp_path):
    rows = adapter.scans(spark, sf_dir).filter("vehicle like 'vehicle1%'")
    stream, end = stream_of(spark, rows, str(tmp_path / "in"))
    got = run.drain(jobs.move_stream(stream, cloud_range=45.0), "t", end=end).withColumn("n", F.size("landmarks"))
    want = scan.track_with_cloud(rows, max_range=45.0).withColumn("n", F.size("landmarks"))
    close(got, want, "x", "y", "phi", "n")


def row(vehicle, t, speed=1.0):
    return (vehicle, t, t, "odo", speed, 0.0, None, None, None)


def test_rows_wait_for_the_watermark_and_late_ones_are_given_back(spark, tmp_path):
    path, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    end = run.end_mark(spark, "late")

    def arrive(*rows):
        spark.createDataFrame(list(rows), SENSOR).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SENSOR).option("maxFilesPerTrigger", 1).parquet(path)
        job = jobs.ekf_stream(run.with_end(stream, end), adapter.EKF, delay="2 seconds")
        return run.drain(job, "late", output, checkpoint)

    def times(df):
        return sorted((r["vehicle"], r["t_ms"]) for r in df.select("vehicle", "t_ms").collect())

    # the watermark is 2 s behind the newest row
    got = arrive(row("a", 1000), row("a", 5000), row("b", 4500))
    assert times(jobs.on_time(got)) == [("a", 1000)]
    # 4000 is older than what waits, yet in time; 500 has been passed for a, and b has stepped through nothing
    got = arrive(row("a", 4000), row("a", 500), row("a", 9000))
    assert times(jobs.on_time(got)) == [("a", 1000), ("a", 4000), ("a", 5000), ("b", 4500)]
    assert times(jobs.late_rows(got)) == [("a", 500)]
    stream = spark.readStream.schema(SENSOR).option("maxFilesPerTrigger", 1).parquet(path)
    job = jobs.ekf_stream(run.with_end(stream, end), adapter.EKF, delay="2 seconds")
    got = run.drain(job, "late", output, checkpoint, end)
    assert times(jobs.late_rows(got)) == [("a", 500)]
    kept = [row(v, t) for v, t in (("a", 1000), ("a", 4000), ("a", 5000), ("a", 9000), ("b", 4500))]
    close(got.filter("not late"), ekf.ekf_track(spark.createDataFrame(kept, SENSOR), adapter.EKF), "x", "y", "phi")


def test_the_slower_of_two_sources_sets_the_watermark(spark, tmp_path):
    end = run.end_mark(spark, "two")
    sources = []
    for name, files in (("fast", [[row("a", 20_000)], [row("a", 21_000)], [row("a", 22_000)]]),
                        ("slow", [[row("a", 1000)], [row("a", 2000)], [row("a", 3000), row("a", 500)]])):
        for rows in files:
            spark.createDataFrame(rows, SENSOR).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(SENSOR).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        sources.append(jobs.timed(run.with_end(stream, end), "5 seconds"))
    got = run.drain(jobs.ekf_stream(sources[0].unionByName(sources[1]), adapter.EKF), "two", end=end)
    want = ekf.ekf_track(spark.createDataFrame(
        [row("a", t) for t in (500, 1000, 2000, 3000, 20_000, 21_000, 22_000)], SENSOR), adapter.EKF)
    close(got, want, "x", "y", "phi")


def test_text_lines_are_numbered_as_they_stand(spark, tmp_path):
    path = str(tmp_path / "lines")
    for part in range(3):
        spark.range(part * 500, part * 500 + 500, 1, 1).selectExpr("concat('odo,', id, ',0.1,1.0,7') AS value").write.mode("append").text(path)
    lines = run.drain(recordings.stream_lines(spark, path, max_files=2), "lines")
    for _, rows in lines.toPandas().groupby("file"):
        by_line = rows.assign(line=[s["line"] for s in rows["seq"]]).sort_values("line")
        numbers = [int(v.split(",")[1]) for v in by_line["value"]]
        assert numbers == list(range(numbers[0], numbers[0] + 500))


@pytest.mark.parametrize("in_order", [True, False])
def test_windows_lose_no_row(spark, sensors, tmp_path, in_order):
    path = str(tmp_path / "in")
    if in_order:
        files_in_time_order(sensors, path)
    else:
        sensors.repartition(5).write.parquet(path)
    stream = spark.readStream.schema(sensors.schema).option("maxFilesPerTrigger", 1).parquet(path)
    windows.drain_windows(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got, want = (sorted(map(tuple, df.collect()), key=str) for df in (
        windows.read_windows(spark, str(tmp_path / "out")), windows.fix_windows(sensors)))
    assert got == want


def test_window_parts_are_merged(spark, sensors, tmp_path):
    """Few folders are read after many micro-batches, also while some are retried or half written."""
    table = str(tmp_path / "parts")
    batches = [sensors.filter(F.col("seq") % 11 == n) for n in range(11)]
    for n, batch in enumerate(batches):
        windows.add_batch(batch, n, table, merge=3)
        if n in (2, 8):
            windows.add_batch(batch, n, table, merge=3)
    folders = windows.whole_folders(spark, table)
    assert windows.newest_folders(folders, 3) == [(0, 9), (0, 10), (2, 0)]
    whole = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = whole(windows.fix_windows(sensors))
    assert whole(windows.read_windows(spark, table, 3)) == want
    # a merged folder that is being written again: the ones it was made of stand in
    (tmp_path / "parts" / "level=2" / "first=0" / "_SUCCESS").rename(tmp_path / "moved")
    assert windows.newest_folders(windows.whole_folders(spark, table), 3) == [(0, 9), (0, 10), (1, 0), (1, 3), (1, 6)]
    assert whole(windows.read_windows(spark, table, 3)) == want


def test_windows_of_an_empty_table(spark, tmp_path):
    assert windows.read_windows(spark, str(tmp_path / "none")).collect() == []
