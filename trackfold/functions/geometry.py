"""Angles, distances and the position of a beam, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackfold.schema import Vehicle

TWO_PI = 6.283185307179586


def half_up(value: Column) -> Column:
    """Nearest integer, a half going up also below zero."""
    return F.floor(value + F.lit(0.5))


def align_clock(seconds: Column, offset_ms: int) -> Column:
    """Seconds of one recorder as milliseconds on the clock of another."""
    return half_up(seconds * F.lit(1000.0)) + F.lit(offset_ms).cast("bigint")


def wrap(angle: Column) -> Column:
    """Remainder of a full turn with the sign of the angle."""
    return angle % F.lit(TWO_PI)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def beam_x(degrees: Column, reach: Column, phi: Column, vehicle: Vehicle = Vehicle()) -> Column:
    return reach * F.cos(F.radians(degrees) - F.radians(F.lit(90.0)) + phi) + F.lit(vehicle.sensor_ahead)


def beam_y(degrees: Column, reach: Column, phi: Column, vehicle: Vehicle = Vehicle()) -> Column:
    return reach * F.sin(F.radians(degrees) - F.radians(F.lit(90.0)) + phi) + F.lit(vehicle.sensor_left)


def sight_range(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def sight_bearing(x: Column, y: Column, phi: Column) -> Column:
    return F.atan2(y, x) - phi
