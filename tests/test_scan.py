"""Scans against the worked-out golden scan and against a plain loop."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackfold.functions.beams import measure, segment_stats
from trackfold.operators import associate, scan
from trackfold.schema import METRE_SCAN, RAW_SCAN

# The readings (cm) of the recorded scan, beam by beam; 8191 is "no echo".
READINGS = [
    83, 84, 84, 85, 84, 84, 85, 85, 86, 86, 86, 89, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8187, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8187, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8187, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 2028, 2029, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 2947, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8187, 8191, 870, 853, 853, 855, 8191, 8191, 8183, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8183, 8187, 8191, 8187, 2856, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 1269, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 2372, 2380, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 2429, 2416, 2418,
    2424, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 1257, 1246, 1247, 1251, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 311, 308, 309, 313, 8191, 8191, 8191, 8191,
    8191, 8191, 8187, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
    8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191, 8191,
]
# first, last, x, y, diameter, range, bearing
OBJECTS = [
    (101, 102, 19.678090, -12.374020, 0.354040, 23.245292, -0.561343),
    (117, 117, 29.084183, -14.854955, 0.257174, 32.658222, -0.472216),
    (128, 131, 11.646485, -3.168202, 0.299411, 12.069719, -0.265604),
    (146, 146, 31.247567, -7.766799, 0.249233, 32.198348, -0.243620),
    (155, 155, 16.235173, -2.204283, 0.110741, 16.384129, -0.134947),
    (170, 171, 27.633585, -1.377318, 0.414690, 27.667888, -0.049801),
    (206, 209, 27.632465, 6.447087, 0.845350, 28.374602, 0.229215),
    (217, 220, 15.731007, 4.732073, 0.436420, 16.427327, 0.292201),
    (321, 324, 4.774480, 3.472187, 0.108298, 5.903537, 0.628774),
]


def recorded_scan() -> list[float]:
    return [float(v) for v in READINGS]


@pytest.fixture(scope="module")
def one_scan(spark):
    return spark.createDataFrame([("v", recorded_scan())], "vehicle string, ranges array<double>")


def test_golden_scan_as_rows(one_scan):
    rows = scan.raw_objects(one_scan, F.lit(0.0), "vehicle").orderBy("first").collect()
    assert len(rows) == len(OBJECTS)
    for row, want in zip(rows, OBJECTS):
        got = (row["first"], row["last"], row.x, row.y, row.diameter, row.range, row.bearing)
        assert got == pytest.approx(want, abs=1e-5)


def test_golden_scan_as_array(one_scan):
    segments = segment_stats(F.col("ranges"), RAW_SCAN, raw=True)
    placed = one_scan.select(scan.place(segments, F.lit(0.3)).alias("o")).first().o
    rows = scan.raw_objects(one_scan, F.lit(0.3), "vehicle").orderBy("first").collect()
    for nested, row in zip(placed, rows, strict=True):
        for name in ("first", "last", "x", "y", "diameter", "range", "bearing"):
            assert nested[name] == pytest.approx(row[name], abs=1e-12)


def test_cleaning_is_the_same_in_columns_and_kernels(one_scan):
    cleaned = one_scan.select(scan.clean_raw(F.col("ranges")).alias("ranges"))
    direct = one_scan.select(F.inline(segment_stats(F.col("ranges"), RAW_SCAN, raw=True))).collect()
    assert cleaned.select(F.inline(segment_stats(F.col("ranges"), RAW_SCAN))).collect() == direct


def loop_segments(readings, gap):
    parts, part = [], [0]
    for i in range(1, len(readings)):
        if abs(readings[i] - readings[i - 1]) > gap:
            parts.append(part)
            part = []
        part.append(i)
    parts.append(part)
    return [p for p in parts if sum(readings[i] for i in p) > 0]


@pytest.mark.parametrize("gap", [1.1, 2.0])
def test_segments_equal_a_loop(gap):
    rng = np.random.default_rng(4)
    scans = [np.where(rng.random(n) < 0.3, 0.0, rng.integers(0, 8, n).astype(float)) for n in (1, 2, 40, 361, 7)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in scans])))
    columns, begins = measure(np.concatenate(scans), bounds, METRE_SCAN.__class__(gap=gap), raw=False)
    for k, readings in enumerate(scans):
        want = loop_segments(readings, gap)
        here = slice(begins[k], begins[k + 1])
        assert columns["first"][here].tolist() == [p[0] for p in want]
        assert columns["last"][here].tolist() == [p[-1] for p in want]
        for i, part in zip(range(begins[k], begins[k + 1]), want):
            width = len(part) * math.pi / 360
            mean = sum(readings[part]) / len(part)
            assert columns["width"][i] == pytest.approx(width)
            assert columns["diameter"][i] == pytest.approx(width * mean)
            assert columns["reach"][i] == pytest.approx(min(readings[part]) + width * mean / 2)


def test_odd_scans(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, 1.5, 9.0]), (4, [5.0])]
    df = spark.createDataFrame(rows, "k int, ranges array<double>")
    got = df.select("k", segment_stats(F.col("ranges"), METRE_SCAN).alias("s")).orderBy("k").collect()
    assert got[0].s is None
    assert [[(s["first"], s["last"]) for s in r.s] for r in got[1:]] == [[], [], [(0, 1), (2, 2)], [(0, 0)]]


def test_cloud_keeps_valid_beams(spark):
    df = spark.createDataFrame([("v", 0, 0, 1.0, 0.0, 0.0, [0.0, 5.0, 80.0, 80.5])],
                               "vehicle string, t_ms bigint, seq bigint, x_inc double, y_inc double, "
                               "phi_inc double, ranges array<double>")
    row = scan.track_with_cloud(df).first()
    assert [p.beam for p in row.landmarks] == [1, 2]
    angle = math.radians(0.5) - math.radians(90)
    assert row.landmarks[0].lx == pytest.approx(1 + 5 * math.cos(angle) + 3.78)
    assert row.landmarks[0].ly == pytest.approx(5 * math.sin(angle) + 0.5)


def test_association_worked_out(spark):
    landmarks = spark.createDataFrame([("v", 1, 20.0, -12.0), ("v", 2, 24.0, 10.0), ("v", 3, 10.0, 4.0),
                                       ("w", 1, 0.0, 0.0)], "vehicle string, idx int, x double, y double")
    seen = spark.createDataFrame([("v", 1, 9.8, 4.1), ("v", 2, 11.0, 4.0), ("v", 3, 0.0, 0.0), ("v", 4, 8.0, 4.0)],
                                 "vehicle string, obs_id int, x double, y double")
    got = {r.obs_id: (r.status, r.landmark) for r in associate.associate(seen, landmarks).collect()}
    assert got == {1: ("match", 3), 2: ("ambiguous", None), 3: ("new", None), 4: ("new", None)}


def test_association_equals_a_loop(spark):
    rng = np.random.default_rng(9)
    marks = [("v", i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-8, 8, (60, 2)).round(1))]
    marks += [("v", 100 + i, m[2], m[3]) for i, m in enumerate(marks[:20])]  # copies at the same place
    objects = [("v", i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-9, 9, (300, 2)))]
    objects += [("v", 1000 + i, *objects[0][2:]) for i in range(50)]
    got = associate.associate(
        spark.createDataFrame(objects, "vehicle string, obs_id int, x double, y double"),
        spark.createDataFrame(marks, "vehicle string, idx int, x double, y double"),
    ).collect()
    found = {r.obs_id: (r.status, r.landmark) for r in got}
    assert len(got) == len(objects)
    for _, i, x, y in objects:
        want = ("new", None)
        for _, idx, mx, my in sorted(marks, key=lambda m: m[1]):
            d = math.sqrt((mx - x) ** 2 + (my - y) ** 2)
            if 0.4 < d < 2.0:
                want = ("ambiguous", None)
            elif d < 0.4:
                want = ("match", idx)
                break
        assert found[i] == want


def one_by_one(objects, marks):
    """Status and landmark of each object, every landmark looked at: (status, idx) by numpy."""
    out = []
    for x, y in objects:
        d = np.sqrt((marks[:, 0] - x) ** 2 + (marks[:, 1] - y) ** 2)
        hits = np.flatnonzero(d < 0.4)
        out.append(("match", int(hits[0])) if len(hits) else ("ambiguous" if ((d > 0.4) & (d < 2.0)).any() else "new", None))
    return out


def associated(spark, objects, marks):
    seen = pd.DataFrame({"vehicle": "v", "obs_id": range(len(objects)), "x": objects[:, 0], "y": objects[:, 1]})
    known = pd.DataFrame({"vehicle": "v", "idx": range(len(marks)), "x": marks[:, 0], "y": marks[:, 1]})
    got = associate.associate(spark.createDataFrame(seen), spark.createDataFrame(known)).orderBy("obs_id").collect()
    for r in got:
        at = (None, None) if r.landmark is None else tuple(marks[r.landmark])
        assert (r.lx, r.ly) == at
    return [(r.status, r.landmark) for r in got]


@pytest.mark.parametrize("falling", [False, True])
def test_a_crowded_square(spark, falling):
    """Very many landmarks in one square: those of lowest index in the middle, or at the far side."""
    rng = np.random.default_rng(4)
    marks = rng.uniform(0, 2, (100_000, 2))
    away = np.hypot(*(marks - 1).T)
    marks = marks[np.argsort(-away if falling else away)]
    objects = rng.uniform(-2.3, 4.3, (10_000, 2))
    got = associated(spark, objects, marks)
    some = rng.choice(len(objects), 400, replace=False)
    assert [got[i] for i in some] == one_by_one(objects[some], marks)


def test_places_on_the_limits(spark):
    """Distances that are exactly a limit, boxes of one place and of several, places that are no numbers."""
    rng = np.random.default_rng(5)
    marks = np.concatenate([rng.integers(-12, 12, (150, 2)) * 0.2, rng.integers(-3, 3, (40, 2)) * 0.05, np.full((1, 2), np.nan),
                            rng.uniform(5, 5.1, (30, 2)), np.array([[0.05, np.inf]])])
    marks = marks[rng.permutation(len(marks))]
    objects = np.concatenate([rng.integers(-20, 20, (300, 2)) * 0.2, rng.uniform(3, 7.5, (200, 2)), np.full((1, 2), np.nan)])
    assert associated(spark, objects, marks) == one_by_one(objects, marks)


def test_observations_and_boxes_meet_once(spark):
    """Observations are read once, and a box goes into a few squares, all those with a place near it."""
    rng = np.random.default_rng(6)
    marks, objects = rng.uniform(-50, 50, (3000, 2)), rng.uniform(-50, 50, (2000, 2))
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    seen = pd.DataFrame({"vehicle": "v", "obs_id": range(len(objects)), "x": objects[:, 0], "y": objects[:, 1]})
    known = pd.DataFrame({"vehicle": "v", "idx": range(len(marks)), "x": marks[:, 0], "y": marks[:, 1]})
    frame = spark.createDataFrame(seen)
    got = associate.associate(frame.mapInArrow(counted, frame.schema), spark.createDataFrame(known)).orderBy("obs_id").collect()
    assert [(r.status, r.landmark) for r in got] == one_by_one(objects, marks)
    assert rows.value == len(objects)
    placed = spark.createDataFrame(known).selectExpr("vehicle", "idx", "x AS lx", "y AS ly", "idx AS fx", "idx AS fy")
    spread = associate.spread_boxes(placed, 2.0, 4.0).select("idx", "sx", "sy").collect()
    assert len(spread) < 4.5 * len(marks)
    there = {(r.idx, r.sx, r.sy) for r in spread}
    for x, y in objects[:300]:
        near = np.flatnonzero(np.hypot(*(marks - (x, y)).T) < 2.0)
        assert {(i, math.floor(x / 4), math.floor(y / 4)) for i in near.tolist()} <= there
