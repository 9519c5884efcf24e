"""The car's motion model as column expressions.

A row moves the car by ``forward`` and ``left`` metres in its own frame and turns it by
``turn``. In the plane that is ``cos(phi) * forward - sin(phi) * left`` along x and
``sin(phi) * forward + cos(phi) * left`` along y.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackfold.schema import Vehicle


def centre_speed(speed: Column, steering: Column, vehicle: Vehicle) -> Column:
    """Speed of the axle centre from the speed of the rear left wheel."""
    return speed / (F.lit(1.0) - F.tan(steering) * F.lit(vehicle.wheel_offset) / F.lit(vehicle.wheelbase))


def turn_rate(speed: Column, steering: Column, vehicle: Vehicle) -> Column:
    return speed / F.lit(vehicle.wheelbase) * F.tan(steering)


def body_motion(dt: Column, speed: Column, steering: Column, vehicle: Vehicle) -> tuple[Column, Column, Column]:
    """(forward, left, turn) of one odometry row."""
    v = centre_speed(speed, steering, vehicle)
    rate = turn_rate(v, steering, vehicle)
    return (dt * (v - rate * F.lit(vehicle.sensor_left)), dt * rate * F.lit(vehicle.sensor_ahead), dt * rate)


def plane_x(phi: Column, forward: Column, left: Column) -> Column:
    return F.cos(phi) * forward - F.sin(phi) * left


def plane_y(phi: Column, forward: Column, left: Column) -> Column:
    return F.sin(phi) * forward + F.cos(phi) * left
