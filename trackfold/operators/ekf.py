"""GPS filter of a fleet: odometry predicts, fixes correct.

Rows are moved once, by vehicle, and sorted; tasks read them as a stream of Arrow batches and
keep one state per vehicle in work, never a whole vehicle. A batch with many vehicles is
stepped for all of them together, row by row of each. Where vehicles have many rows, a partition is
sorted by time across its vehicles, so that its batches hold a stretch of time of all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold.operators import slices, steps
from trackfold.operators.ordered import HOT_ROWS, split_hot
from trackfold.schema import EkfConfig

ODO, GPS = 0, 1
COVARIANCE = steps.EKF_FIELDS[3:9]
STATE = len(steps.EKF_FIELDS)
# what a judged track keeps beside the state: whether a row was seen, and the last prediction (NaN without one)
MEMORY = (0.0, math.nan, math.nan, math.nan)
JUDGED = ("prev_x", "prev_y", "pred_t_ms", "pred_x", "pred_y")
STEP_NAMES = np.array(["prediction", "update"], dtype=object)
# rows stepped together: more vehicles at once, still a few megabytes
BLOCK_ROWS = 131_072
# one numpy step over many vehicles costs about as much as this many single steps
LOCKSTEP_ROWS = 16
# rows per vehicle from which a partition goes by time: a task then has few vehicles, all in work
LONG_TRACK = 512


def ekf_input(rows: DataFrame, *also: str) -> DataFrame:
    """The few numbers per row the filter needs, and columns ``also``; other sensors' rows are left behind."""
    odo = F.col("kind") == "odo"
    return rows.filter(F.col("kind").isin("odo", "gps")).select(
        "vehicle", "t_ms", "seq", *also,
        F.when(odo, ODO).otherwise(GPS).cast("tinyint").alias("code"),
        F.when(odo, F.col("speed")).otherwise(F.col("gps_x")).alias("m0"),
        F.when(odo, F.col("steering")).otherwise(F.col("gps_y")).alias("m1"),
    )


def ekf_track(
    rows: DataFrame,
    config: EkfConfig = EkfConfig(),
    emit: tuple[str, ...] = ("prediction", "update"),
    covariance: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Pose after every odometry row (``prediction``) and fix (``update``)."""
    return _run(ekf_input(rows), config, "track", covariance, hot_rows, emit)


def ekf_judged(
    rows: DataFrame, config: EkfConfig = EkfConfig(), covariance: bool = False, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """The track, each row with the pose before it and the last prediction before it.

    ``prev_x, prev_y`` are null on a vehicle's first row; ``pred_t_ms, pred_x, pred_y`` before its first
    prediction. The filter has them at hand, so ``prep.shifts`` and ``prep.errors`` need no second sort.
    """
    return _run(ekf_input(rows), config, "judged", covariance, hot_rows, None)


def ekf_final(
    rows: DataFrame, config: EkfConfig = EkfConfig(), covariance: bool = True, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """State of each vehicle after its last row."""
    return _run(ekf_input(rows), config, "final", covariance, hot_rows, None)


def _run(narrow: DataFrame, config, what: str, covariance: bool, hot_rows, emit) -> DataFrame:
    split = split_hot(narrow, hot_rows)
    hot = split.hot
    long = split.vehicles is not None and split.rows is not None and split.rows >= LONG_TRACK * split.vehicles > 0
    out = _fold(split.usual, config, what, covariance, emit, split.rows, by_time=long)
    if hot is None:
        return out
    memory = MEMORY if what == "judged" else ()
    starts = slices.settle(
        hot,
        lambda df: _fold(df, config, "judged end" if memory else "end", covariance, None, split.hot_rows),
        F.array(*[F.lit(float(v)) for v in (*steps.ekf_start(config), *memory)]),
        lambda df: _guess(df, config, memory),
    )
    if what == "final":
        last = Window.partitionBy("vehicle").orderBy(F.desc("slice"))
        starts = starts.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
        hot = hot.join(starts.select(*slices.KEYS), slices.KEYS, "left_semi")
    return out.unionByName(_fold(slices.with_starts(hot, starts), config, what, covariance, emit, split.hot_rows))


def _guess(hot: DataFrame, config: EkfConfig, memory: tuple = ()) -> DataFrame:
    """A start for each slice: at its first fix, at the time the slice before it ends."""
    order = F.struct("t_ms", "seq")
    gps = F.col("code") == GPS
    per_slice = hot.groupBy(*slices.KEYS).agg(
        F.min_by("m0", F.when(gps, order)).alias("x"),
        F.min_by("m1", F.when(gps, order)).alias("y"),
        F.max("t_ms").alias("_last"),
    )
    before = F.lag("_last").over(Window.partitionBy("vehicle").orderBy("slice"))
    r = config.motion_noise
    state = F.array(
        F.coalesce("x", F.lit(config.start.x)), F.coalesce("y", F.lit(config.start.y)), F.lit(config.start.phi),
        *[F.lit(v) for v in (r, 0.0, 0.0, r, 0.0, r)],
        F.coalesce(before, F.lit(config.start.t_ms).cast("bigint")).cast("double"),
        *[F.lit(v) for v in memory],
    )
    return per_slice.select(*slices.KEYS, state.alias("start"))


def _fold(
    rows: DataFrame, config: EkfConfig, what: str, covariance: bool, emit, total: int | None = None, by_time: bool = False,
) -> DataFrame:
    fields = [T.StructField("vehicle", T.StringType())]
    if what in ("track", "judged"):
        fields += [rows.schema["t_ms"], rows.schema["seq"], T.StructField("step", T.StringType())]
    elif what == "final":
        fields += [T.StructField("t_ms", T.LongType())]
    else:
        fields += [rows.schema["slice"], T.StructField("end", T.ArrayType(T.DoubleType()))]
    if what not in ("end", "judged end"):
        names = ("x", "y", "phi") + (COVARIANCE if covariance else ())
        fields += [T.StructField(n, T.DoubleType()) for n in names]
    if what == "judged":
        fields += [T.StructField(n, T.LongType() if n == "pred_t_ms" else T.DoubleType()) for n in JUDGED]
    fold = _Fold(config, what, covariance, emit, by_time)
    return slices.gather(rows, total, by_time).mapInArrow(fold, T.StructType(fields))


class _Fold:
    """Folds a sorted stream of batches; holds the state of the run in work only, or of all in order of time."""

    def __init__(self, config: EkfConfig, what: str, covariance: bool, emit, by_time: bool = False):
        self.config, self.what, self.by_time = config, what, by_time
        self.width = 9 if covariance else 3
        self.judged, self.tracks = what.startswith("judged"), what in ("track", "judged")
        self.first = np.array(steps.ekf_start(config) + (MEMORY if self.judged else ()))[:, None]
        self.emit = None if emit is None or len(emit) == 2 else [("prediction", "update").index(e) for e in emit]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return self._through_time(batches) if self.by_time else self._through_vehicles(batches)

    def _through_time(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = {}, np.empty((len(self.first), 0))
        for batch in _blocks(batches):
            # a vehicle's rows next to each other, in the order they have
            codes = batch.column("vehicle").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.argsort(codes, kind="stable")))
            starts, keys = _runs(batch)
            at = np.array([number.setdefault(k, len(number)) for k in keys])
            held = np.concatenate([held, np.repeat(self.first, len(number) - held.shape[1], axis=1)], axis=1)
            states = held[:, at]
            track, judged = self._step(batch, starts, states)
            held[:, at] = states
            if self.tracks:
                yield self._track(batch, track, judged)
        if number and not self.tracks:
            yield self._ends([(k, held[:, i]) for k, i in number.items()])

    def _through_vehicles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in _blocks(batches):
            starts, keys = _runs(batch)
            states = np.tile(self.first, len(starts))
            finished = []
            if key == keys[0]:
                states[:, 0] = state
            elif key is not None:
                finished.append((key, state))
            track, judged = self._step(batch, starts, states)
            finished += [(k, states[:, i]) for i, k in enumerate(keys[:-1])]
            key, state = keys[-1], states[:, -1].copy()
            if self.tracks:
                yield self._track(batch, track, judged)
            elif finished:
                yield self._ends(finished)
        if key is not None and not self.tracks:
            yield self._ends([(key, state)])

    def _step(self, batch: pa.RecordBatch, starts: np.ndarray, states: np.ndarray) -> tuple:
        """The track of a batch and what it is judged by; ``states`` ends up with each run's last."""
        before = states.copy() if self.judged else None
        track = _step_batch(batch, starts, states[:STATE], self.config)
        return track, _judge(batch, starts, before, states, track) if self.judged else None

    def _track(self, batch: pa.RecordBatch, track: np.ndarray, judged: list | None = None) -> pa.RecordBatch:
        code = batch.column("code").to_numpy(zero_copy_only=False)
        keep = code != slices.START_CODE
        if self.emit is not None:
            keep &= np.isin(code, self.emit)
        index = pa.array(np.flatnonzero(keep))
        names = ["vehicle", "t_ms", "seq", "step", *steps.EKF_FIELDS[: self.width]]
        columns = [batch.column(n).take(index) for n in names[:3]]
        columns.append(pa.DictionaryArray.from_arrays(
            pa.array(code[keep].astype(np.int32)), pa.array(STEP_NAMES)).dictionary_decode())
        columns += [pa.array(track[i][keep]) for i in range(self.width)]
        if judged is not None:
            names += JUDGED
            columns += [column.take(index) for column in judged]
        return pa.RecordBatch.from_arrays(columns, names)

    def _ends(self, finished: list) -> pa.RecordBatch:
        vehicles = pa.array([k[0] for k, _ in finished], pa.string())
        table = np.array([s for _, s in finished])
        if self.what.endswith("end"):
            part = pa.array([k[1] for k, _ in finished], pa.int32())
            end = pa.array(list(table), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([vehicles, part, end], ["vehicle", "slice", "end"])
        names = ["vehicle", "t_ms", *steps.EKF_FIELDS[: self.width]]
        columns = [vehicles, pa.array(table[:, 9].astype(np.int64))]
        columns += [pa.array(np.ascontiguousarray(table[:, i])) for i in range(self.width)]
        return pa.RecordBatch.from_arrays(columns, names)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, list]:
    """Positions where a vehicle (and slice) begins, and the key of each run."""
    vehicle = batch.column("vehicle")
    codes = vehicle.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    change = codes[1:] != codes[:-1]
    part = None
    if "slice" in batch.schema.names:
        part = batch.column("slice").to_numpy(zero_copy_only=False)
        change = change | (part[1:] != part[:-1])
    starts = np.concatenate(([0], np.flatnonzero(change) + 1))
    names = vehicle.take(pa.array(starts)).to_pylist()
    return starts, [(n, int(part[s]) if part is not None else None) for n, s in zip(names, starts)]


def _step_batch(batch: pa.RecordBatch, starts: np.ndarray, states: np.ndarray, config: EkfConfig) -> np.ndarray:
    """Run all rows of a batch; ``states`` ends up with each run's last state."""
    code = batch.column("code").to_numpy(zero_copy_only=False)
    t_ms = batch.column("t_ms").to_numpy(zero_copy_only=False)
    m0 = batch.column("m0").to_numpy(zero_copy_only=False)
    m1 = batch.column("m1").to_numpy(zero_copy_only=False)
    given = {i: np.array(batch.column("state")[i].as_py())[:STATE] for i in np.flatnonzero(code == slices.START_CODE)}
    track = np.empty((9, len(code)))
    lengths = np.diff(np.append(starts, len(code)))
    # a bad value makes its vehicle's numbers NaN from there on, and no other's
    with np.errstate(all="ignore"):
        if lengths.max() * LOCKSTEP_ROWS < len(code):
            _lockstep(code, t_ms.astype(float), m0, m1, given, starts, lengths, states, track, config)
        else:
            for run, (begin, n) in enumerate(zip(starts, lengths)):
                _one_run(code, t_ms, m0, m1, given, range(begin, begin + n), run, states, track, config)
    return track


def _one_run(code, t_ms, m0, m1, given, positions, run, states, track, config) -> None:
    state = tuple(states[:, run].tolist())
    part = slice(positions.start, positions.stop)
    rows = zip(positions, code[part].tolist(), t_ms[part].tolist(), m0[part].tolist(), m1[part].tolist())
    poses = []
    for i, c, t, a, b in rows:
        if c == ODO:
            state = steps.ekf_predict(steps.NUMBERS, state, float(t), a, b, config)
        elif c == GPS:
            state = steps.ekf_update(steps.NUMBERS, state, float(t), a, b, config)
        else:
            state = tuple(given[i].tolist())
        poses.append(state[:9])
    track[:, part] = np.array(poses).T
    states[:, run] = state


def _lockstep(code, t_ms, m0, m1, given, starts, lengths, states, track, config) -> None:
    """Row j of every run at once, longest runs first so the active ones stay in front."""
    order = np.argsort(-lengths, kind="stable")
    begins, sizes = starts[order], lengths[order]
    work = states[:, order]
    for j in range(int(sizes[0])):
        active = int(np.searchsorted(-sizes, -j, side="left"))
        at = begins[:active] + j
        kinds = code[at]
        for kind, step in ((ODO, steps.ekf_predict), (GPS, steps.ekf_update)):
            pick = np.flatnonzero(kinds == kind)
            if len(pick):
                here = at[pick]
                after = step(steps.NUMBERS, tuple(work[:, pick]), t_ms[here], m0[here], m1[here], config)
                work[:, pick] = np.array(after)
        for k in np.flatnonzero(kinds == slices.START_CODE):
            work[:, k] = given[int(at[k])]
        track[:, at] = work[:9, :active]
    states[:, order] = work


def _judge(batch: pa.RecordBatch, starts: np.ndarray, before: np.ndarray, states: np.ndarray, track: np.ndarray) -> list:
    """Columns ``JUDGED`` of a batch; ``before`` and ``states`` are the runs' states at its two ends."""
    code = batch.column("code").to_numpy(zero_copy_only=False)
    t_ms = batch.column("t_ms").to_numpy(zero_copy_only=False)
    place = np.arange(len(code))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
    for i in np.flatnonzero(code == slices.START_CODE):
        before[:, run[i]] = batch.column("state")[int(i)].as_py()
    # the row before, and the last prediction before; what is not in the batch is in the run's memory
    inner = (place > starts[run]) & (code[place - 1] != slices.START_CODE)
    last = np.maximum.accumulate(np.where(code == ODO, place, -1))
    prior = np.concatenate(([-1], last[:-1]))
    seen = prior >= starts[run]
    x, y = (np.where(inner, track[k][place - 1], before[k][run]) for k in (0, 1))
    t = np.where(seen, t_ms[prior], np.nan_to_num(before[STATE + 1])[run].astype(np.int64))
    px, py = (np.where(seen, track[k][prior], before[STATE + 2 + k][run]) for k in (0, 1))
    no_row, no_prediction = ~inner & (before[STATE][run] == 0), ~seen & np.isnan(before[STATE + 1])[run]
    # what the next batch has to know
    ends = np.append(starts[1:], len(code)) - 1
    some = last[ends] >= starts
    states[STATE] = np.where(code[ends] == slices.START_CODE, before[STATE], 1.0)
    for k, values in enumerate((t_ms, track[0], track[1]), STATE + 1):
        states[k] = np.where(some, values[last[ends]], before[k])
    masks = (no_row, no_row, no_prediction, no_prediction, no_prediction)
    return [pa.array(values, mask=mask) for values, mask in zip((x, y, t, px, py), masks)]
