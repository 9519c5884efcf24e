"""Row layouts and parameters shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

SENSOR = T.StructType([
    T.StructField("vehicle", T.StringType()),
    T.StructField("t_ms", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("speed", T.DoubleType()),
    T.StructField("steering", T.DoubleType()),
    T.StructField("gps_x", T.DoubleType()),
    T.StructField("gps_y", T.DoubleType()),
    T.StructField("ranges", T.ArrayType(T.DoubleType())),
])

ODOMETRY = T.StructType([
    T.StructField("t_ms", T.LongType()),
    T.StructField("steering", T.DoubleType()),
    T.StructField("speed", T.DoubleType()),
])

RAW_ODOMETRY = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("speed", T.DoubleType()),
    T.StructField("steering", T.DoubleType()),
])

GPS = T.StructType([
    T.StructField("t_ms", T.LongType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

GPS_SECONDS = T.StructType([
    T.StructField("seconds", T.DoubleType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
])

TRACK_STEPS = T.StructType([
    T.StructField("vehicle", T.StringType()),
    T.StructField("step", T.StringType()),
    T.StructField("t_ms", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
])

# the track file as one label field: read with ";" between the fields
TRACK_KEYED = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("t_ms", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
])

TRACK_LANDMARKS = T.StructType([
    T.StructField("t_ms", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("landmarks", T.StringType()),
])


@dataclass(frozen=True)
class Vehicle:
    """Vehicle geometry in metres. Fixed values of the recorded car."""

    wheelbase: float = 2.83
    wheel_offset: float = 0.76
    sensor_ahead: float = 3.78
    sensor_left: float = 0.5


@dataclass(frozen=True)
class Start:
    """State of a filter before its first row."""

    x: float = 0.0
    y: float = 0.0
    phi: float = 0.0
    t_ms: int = 0


# Fixed values of the recorded data set.
EKF_START = Start(-67.64927093982358, -41.71421779374552, 0.0, 20967)
SLAM_START = Start(t_ms=21819)
CLOCK_OFFSET_MS = 20967


@dataclass(frozen=True)
class EkfConfig:
    """Noise, start state and choice of innovation of the GPS filter."""

    vehicle: Vehicle = field(default_factory=Vehicle)
    start: Start = EKF_START
    motion_noise: float = 0.5
    gps_noise_x: float = 0.5
    gps_noise_y: float = 5.0
    innovation: str = "position"  # position | observer | difference | gps_only | pose_only

    def at(self, **changes) -> "EkfConfig":
        return replace(self, **changes)


@dataclass(frozen=True)
class SlamConfig:
    """Noise, start state and association limits of the mapping filter."""

    vehicle: Vehicle = field(default_factory=Vehicle)
    start: Start = SLAM_START
    motion_noise: float = 0.5
    sight_noise: float = 0.01
    new_landmark_variance: float = 1e6
    match_below: float = 0.4
    ambiguous_below: float = 2.0
    frame: str = "world"  # world | relative
    predict: str = "full"  # full | fast

    def at(self, **changes) -> "SlamConfig":
        return replace(self, **changes)


@dataclass(frozen=True)
class ScanConfig:
    """How a range scan is cleaned and cut into objects."""

    vehicle: Vehicle = field(default_factory=Vehicle)
    gap: float = 2.0
    blind_beams: int = 15
    blind_value: float = 81.0
    unit: float = 100.0
    max_range: float = 40.0
    degrees_per_beam: float = 0.5


RAW_SCAN = ScanConfig()
METRE_SCAN = ScanConfig(gap=1.1)
CLOUD_MAX_RANGE = 80.0
