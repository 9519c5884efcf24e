"""Range scans as Arrow batches: one numpy pass over the beams of all scans in a batch.

Cutting a scan into segments looks at neighbouring beams; as array lambdas that costs two
hundred times more than here (measured on scans of 384 beams).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold.schema import ScanConfig, Vehicle

SEGMENT = T.StructType([
    T.StructField("first", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("width", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("nearest", T.DoubleType()),
    T.StructField("diameter", T.DoubleType()),
    T.StructField("reach", T.DoubleType()),
    T.StructField("degrees", T.DoubleType()),
])

POINT = T.StructType([
    T.StructField("beam", T.IntegerType()),
    T.StructField("lx", T.DoubleType()),
    T.StructField("ly", T.DoubleType()),
])


def _flat(scans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Readings of all scans in a row, and where each scan begins (one more than scans)."""
    sizes = np.asarray(pc.list_value_length(scans).fill_null(0))
    readings = scans.flatten().to_numpy(zero_copy_only=False)
    return readings, np.concatenate(([0], np.cumsum(sizes)))


def _lists(columns: dict[str, np.ndarray], bounds: np.ndarray, scans: pa.Array) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))
    offsets = pa.array(bounds.astype(np.int32), mask=np.append(np.asarray(scans.is_null()), False))
    return pa.ListArray.from_arrays(offsets, values)


def clean(readings: np.ndarray, beam: np.ndarray, scan: ScanConfig) -> np.ndarray:
    """Blind zone, metres, far limit: see ``metres_with_blind_zone`` and ``clamp_far``."""
    metres = np.where(beam < scan.blind_beams, scan.blind_value, readings / scan.unit)
    return np.where(metres <= scan.max_range, metres, 0.0)


def measure(readings: np.ndarray, bounds: np.ndarray, scan: ScanConfig, raw: bool) -> tuple[dict, np.ndarray]:
    """Segments of all scans as columns, and where each scan's segments begin."""
    size = len(readings)
    beam = np.arange(size) - np.repeat(bounds[:-1], np.diff(bounds))
    if raw:
        readings = clean(readings, beam, scan)
    begins = beam == 0
    begins[1:] |= np.abs(np.diff(readings)) > scan.gap
    start = np.flatnonzero(begins)
    if not len(start):
        empty = np.zeros(0)
        names = SEGMENT.names
        return {n: empty.astype(np.int32) if n in ("first", "last") else empty for n in names}, np.zeros_like(bounds)
    beams = np.diff(np.append(start, size))
    total = np.add.reduceat(readings, start)
    nearest = np.minimum.reduceat(readings, start)
    keep = total > 0
    start, beams, total, nearest = start[keep], beams[keep], total[keep], nearest[keep]
    width = beams * np.pi / (180.0 / scan.degrees_per_beam)
    mean = total / beams
    diameter = width * mean
    first = beam[start]
    return {
        "first": first.astype(np.int32),
        "last": (first + beams - 1).astype(np.int32),
        "width": width,
        "mean": mean,
        "nearest": nearest,
        "diameter": diameter,
        "reach": nearest + diameter / 2,
        "degrees": first * scan.degrees_per_beam + np.degrees(width / 2),
    }, np.searchsorted(start, bounds)


def segment_stats(ranges: Column, scan: ScanConfig, raw: bool = False) -> Column:
    """Array of segments with an echo. With ``raw`` the readings are cleaned first."""

    @F.arrow_udf(T.ArrayType(SEGMENT))
    def stats(scans: pa.Array) -> pa.Array:
        readings, bounds = _flat(scans)
        return _lists(*measure(readings, bounds, scan, raw), scans)

    return stats(ranges)


def cloud_points(
    ranges: Column, x: Column, y: Column, phi: Column, max_range: float,
    vehicle: Vehicle = Vehicle(), degrees_per_beam: float = 0.5,
) -> Column:
    """World points of the valid beams, as an array of (beam, lx, ly) in beam order."""

    @F.arrow_udf(T.ArrayType(POINT))
    def points(scans: pa.Array, xs: pa.Array, ys: pa.Array, phis: pa.Array) -> pa.Array:
        r, bounds = _flat(scans)
        row = np.repeat(np.arange(len(scans)), np.diff(bounds))
        beam = np.arange(len(r)) - bounds[row]
        keep = np.flatnonzero((r != 0.0) & (r <= max_range))
        r, row, beam = r[keep], row[keep], beam[keep]
        angle = np.radians(beam * degrees_per_beam) - np.radians(90.0) + phis.to_numpy(zero_copy_only=False)[row]
        columns = {
            "beam": beam.astype(np.int32),
            "lx": xs.to_numpy(zero_copy_only=False)[row] + (r * np.cos(angle) + vehicle.sensor_ahead),
            "ly": ys.to_numpy(zero_copy_only=False)[row] + (r * np.sin(angle) + vehicle.sensor_left),
        }
        return _lists(columns, np.searchsorted(keep, bounds), scans)

    return points(ranges, x, y, phi)
