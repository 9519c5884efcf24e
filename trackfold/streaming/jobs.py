"""The trackers as Structured Streaming jobs, one keyed state per vehicle, in event-time order.

A vehicle's rows wait in its state until the watermark has passed their ``t_ms``; a timer then steps
the filter through them in the order of ``(t_ms, seq)``, with the same functions as the batch
operators. So results do not hang on how rows arrive, over whichever files, sources and
micro-batches, as long as none comes more than ``delay`` behind the newest of its source. A row that does is
late: it is not stepped through but given back with ``late`` true and no result, to be kept and
counted apart (``on_time``, ``late_rows``).

With several sources set the watermark on each (``timed``): Spark takes the least, so one that is
behind holds the others back. At the end of a recording ``run.drain`` moves the watermark past
everything, so no row is left waiting.

Waiting rows are a list of Arrow blocks in the state, one for what a micro-batch brought, so a block is
written once and read when its time comes. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from trackfold.functions.beams import cloud_points, segment_stats
from trackfold.operators import ekf, slam, steps
from trackfold.operators import scan as scans
from trackfold.schema import METRE_SCAN, RAW_SCAN, EkfConfig, ScanConfig, SlamConfig, Start, Vehicle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = "10 minutes"
END_MS = 7_258_118_400_000  # the year 2200; a row of this time or later only ends a recording
# no leading underscores: pandas renames such columns on the way
AT = "at_time"
HELD = T.StructType([T.StructField("oldest", T.LongType()), T.StructField("rows", T.BinaryType())])
STATE = T.StructType([T.StructField("stepped_ms", T.LongType()), T.StructField("vector", T.BinaryType())])


def timed(rows: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rows of one source with its watermark; rows that have one stay as they are."""
    if AT in rows.columns:
        return rows
    return rows.withColumn(AT, F.timestamp_millis("t_ms")).withWatermark(AT, delay)


def on_time(track: DataFrame) -> DataFrame:
    """What the filter was stepped through."""
    return track.filter("not late").drop("late")


def late_rows(track: DataFrame) -> DataFrame:
    """Which rows came too late for it: ``vehicle, t_ms, seq``."""
    return track.filter("late").select("vehicle", "t_ms", "seq")


def _packed(frame: pd.DataFrame) -> bytes:
    block = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema) as writer:
        writer.write_batch(block)
    return sink.getvalue().to_pybytes()


class _Tracker(StatefulProcessor):
    """``fold(state vector, frame in order) -> (state vector, columns)`` as rows' time comes."""

    def __init__(self, names: list[str], order: list[str], first, fold: Callable):
        self.names, self.order, self.first, self.fold = names, order, np.array(first, dtype=float), fold

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upto, _ = self._state()
        for frame in rows:
            frame = frame[frame["t_ms"] < END_MS]
            late = frame["t_ms"] <= upto
            if late.any():
                yield self._output(key, frame[late], {}, True)
                frame = frame[~late]
            if len(frame):
                oldest = int(frame["t_ms"].min())
                self.held.appendValue((oldest, _packed(frame)))
                self.handle.registerTimer(oldest)
        yield from self._step(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, timerValues.getCurrentWatermarkInMs())

    def _state(self) -> tuple[int, np.ndarray]:
        if not self.state.exists():
            return -(2**63), self.first
        upto, vector = self.state.get()
        return upto, np.frombuffer(vector)

    def _step(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """Through all rows that wait and whose time has come."""
        upto, vector = self._state()
        if watermark <= upto or not self.held.exists():
            return
        ready, waiting = [], []
        for oldest, block in self.held.get():
            if oldest > watermark:
                waiting.append((oldest, bytes(block)))
                continue
            frame = pa.ipc.open_stream(bytes(block)).read_pandas()
            ripe = frame["t_ms"] <= watermark
            ready.append(frame[ripe])
            if not ripe.all():
                rest = frame[~ripe]
                waiting.append((int(rest["t_ms"].min()), _packed(rest)))
        if not ready:
            return
        frame = pd.concat(ready, ignore_index=True)
        frame = frame.sort_values(["t_ms", *self.order], kind="stable").reset_index(drop=True)
        vector, columns = self.fold(vector, frame)
        self.state.update((watermark, np.asarray(vector, dtype=float).tobytes()))
        if waiting:
            self.held.put(waiting)
            self.handle.registerTimer(min(oldest for oldest, _ in waiting))
        else:
            self.held.clear()
        yield self._output(key, frame, columns, False)

    def _output(self, key, frame: pd.DataFrame, columns: dict, late: bool) -> pd.DataFrame:
        known = {"vehicle": key[0], "late": late, **{n: frame[n] for n in ("t_ms", *self.order)}, **columns}
        return pd.DataFrame({n: known.get(n) for n in self.names}, index=frame.index)


def _order(rows: DataFrame) -> tuple[list[str], list[Column], Column]:
    """Names and columns of the parts of ``seq``, and ``seq`` from its parts."""
    kind = rows.schema["seq"].dataType
    if not isinstance(kind, T.StructType):
        return ["seq_0"], [F.col("seq").alias("seq_0")], F.col("seq_0")
    names = [f"seq_{i}" for i in range(len(kind))]
    parts = [F.col(f"seq.{f.name}").alias(n) for f, n in zip(kind, names)]
    return names, parts, F.struct(*[F.col(n).alias(f.name) for f, n in zip(kind, names)])


def _stateful(rows: DataFrame, fields: list[tuple[str, T.DataType]], first, fold: Callable) -> DataFrame:
    """``vehicle, t_ms, seq, late`` and ``fields`` of every row, as its time comes."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    names, parts, seq = _order(rows)
    # without the column of the watermark, which keeps its timers, Spark leaves rows behind it to the tracker
    narrow = rows.select("*", *parts).drop("seq", AT)
    output = T.StructType([
        rows.schema["vehicle"], rows.schema["t_ms"], *[narrow.schema[n] for n in names],
        T.StructField("late", T.BooleanType()), *[T.StructField(n, t) for n, t in fields]])
    out = narrow.groupBy("vehicle").transformWithStateInPandas(
        _Tracker(output.names, names, first, fold), output, "Append", "EventTime")
    return out.select("vehicle", "t_ms", seq.alias("seq"), "late", *[n for n, _ in fields])


_DOUBLE = T.DoubleType()
_POSE = (("x", _DOUBLE), ("y", _DOUBLE), ("phi", _DOUBLE))


def _pose_columns(poses) -> dict:
    table = np.array(poses).reshape(-1, 3)
    return {"x": table[:, 0], "y": table[:, 1], "phi": table[:, 2]}


def _moved(vector, frame):
    state, poses = tuple(vector), []
    for inc in zip(frame["x_inc"], frame["y_inc"], frame["phi_inc"]):
        state = steps.move(state, *inc)
        poses.append(state)
    return state, _pose_columns(poses)


def move_stream(
    rows: DataFrame, start: Start = Start(), cloud_range: float | None = None, delay: str = DELAY
) -> DataFrame:
    """Pose accumulation; with ``cloud_range`` also the landmark points of each row's scan."""
    rows = timed(rows, delay)
    if cloud_range is None:
        narrow = rows.select("vehicle", "t_ms", "seq", AT, "x_inc", "y_inc", "phi_inc")
        return _stateful(narrow, [*_POSE], (start.x, start.y, start.phi), _moved)
    ranges = T.ArrayType(_DOUBLE)
    narrow = rows.select("vehicle", "t_ms", "seq", AT, "x_inc", "y_inc", "phi_inc", "ranges")

    def fold(vector, frame):
        state, columns = _moved(vector, frame)
        return state, {**columns, "ranges": frame["ranges"]}

    posed = _stateful(narrow, [*_POSE, ("ranges", ranges)], (start.x, start.y, start.phi), fold)
    # the filter lets no row fall; it turns the state operator's rows into the form a UDF reads
    posed = posed.filter(F.col("vehicle").isNotNull())
    points = cloud_points(F.col("ranges"), F.col("x"), F.col("y"), F.col("phi"), cloud_range)
    return posed.select("vehicle", "t_ms", "seq", "late", "x", "y", "phi", points.alias("landmarks"))


def objects_stream(
    rows: DataFrame, start: Start = Start(), scan: ScanConfig = METRE_SCAN, delay: str = DELAY
) -> DataFrame:
    """Pose accumulation with the objects of each scan; the scan is measured before the state."""
    stats = segment_stats(F.col("ranges"), scan)
    narrow = timed(rows, delay).withColumn("_stats", stats).select(
        "vehicle", "t_ms", "seq", AT, "x_inc", "y_inc", "phi_inc",
        *[F.col(f"_stats.{n}").alias(n) for n in ("first", "last", "diameter", "reach", "degrees")],
    )
    carried = ("first", "last", "diameter", "reach", "degrees")

    def fold(vector, frame):
        state, columns = _moved(vector, frame)
        return state, {**columns, **{n: frame[n] for n in carried}}

    extra = [(n, narrow.schema[n].dataType) for n in carried]
    posed = _stateful(narrow, [*_POSE, *extra], (start.x, start.y, start.phi), fold)
    stats = F.arrays_zip(*carried)
    return posed.select("vehicle", "t_ms", "seq", "late", "x", "y", "phi",
                        scans.place(stats, F.col("phi"), scan.vehicle).alias("objects"))


def discrete_stream(
    rows: DataFrame, vehicle: Vehicle = Vehicle(), variance: float = 1.0, noise: float = 0.1, delay: str = DELAY
) -> DataFrame:
    narrow = timed(rows, delay).filter(F.col("kind") == "odo").select("vehicle", "t_ms", "seq", AT, "speed", "steering")

    def fold(vector, frame):
        state, out = tuple(vector), []
        for t, v, a in zip(frame["t_ms"], frame["speed"], frame["steering"]):
            state, gain = steps.discrete_kalman(state, t, v, a, vehicle.wheelbase, noise)
            out.append((*state[:3], gain, state[3]))
        table = np.array(out).reshape(-1, 5)
        return state, dict(zip(("x", "y", "phi", "gain", "variance"), table.T))

    fields = [*_POSE, ("gain", _DOUBLE), ("variance", _DOUBLE)]
    return _stateful(narrow, fields, (0.0, 0.0, 0.0, variance, 0.0, 0.0), fold)


def ekf_stream(
    rows: DataFrame, config: EkfConfig = EkfConfig(), emit: tuple[str, ...] = ("prediction", "update"),
    delay: str = DELAY,
) -> DataFrame:
    narrow = ekf.ekf_input(timed(rows, delay), AT)

    def fold(vector, frame):
        state, poses = tuple(vector.tolist()), []
        code = frame["code"].to_numpy()
        with np.errstate(all="ignore"):
            for c, t, a, b in zip(code.tolist(), frame["t_ms"].tolist(), frame["m0"].tolist(), frame["m1"].tolist()):
                step = steps.ekf_predict if c == ekf.ODO else steps.ekf_update
                state = step(steps.NUMBERS, state, float(t), a, b, config)
                poses.append(state[:3])
        return state, {"step": ekf.STEP_NAMES[code], **_pose_columns(poses)}

    out = _stateful(narrow, [("step", T.StringType()), *_POSE], steps.ekf_start(config), fold)
    return out if len(emit) == 2 else out.filter(F.col("late") | F.col("step").isin(*emit))


def slam_stream(
    rows: DataFrame, config: SlamConfig = SlamConfig(), scan: ScanConfig = RAW_SCAN, cleaned: bool = False,
    delay: str = DELAY,
) -> DataFrame:
    narrow = slam.slam_input(timed(rows, delay), scan, cleaned, AT)

    def fold(vector, frame):
        state, poses = steps.SlamState.unpack(vector), []
        code = frame["code"].to_numpy()
        times, m0, m1 = (frame[n].to_numpy(dtype=float) for n in ("t_ms", "m0", "m1"))
        reach, degrees = frame["reach"].to_numpy(), frame["degrees"].to_numpy()
        for i, c in enumerate(code):
            if c == slam.ODO:
                steps.slam_predict(state, times[i], m0[i], m1[i], config)
            else:
                steps.slam_update(state, times[i], np.asarray(reach[i]), np.asarray(degrees[i]), config)
            poses.append((*state.mean[:3], (state.size - 3) // 2))
        table = np.array(poses).reshape(-1, 4)
        step = np.where(code == slam.ODO, "prediction", "update").astype(object)
        return state.pack(), {"step": step, **_pose_columns(table[:, :3]), "landmarks": table[:, 3].astype(np.int32)}

    fields = [("step", T.StringType()), *_POSE, ("landmarks", T.IntegerType())]
    return _stateful(narrow, fields, steps.SlamState.first(config).pack(), fold)
