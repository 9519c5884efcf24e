"""Mapping filter of a fleet: odometry predicts, scan objects correct and extend the map."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold.functions.beams import segment_stats
from trackfold.operators import slices, steps
from trackfold.operators.ekf import _runs
from trackfold.operators.ordered import HOT_ROWS, split_hot
from trackfold.schema import RAW_SCAN, ScanConfig, SlamConfig

ODO, LASER = 0, 1


def slam_input(rows: DataFrame, scan: ScanConfig = RAW_SCAN, cleaned: bool = False, *also: str) -> DataFrame:
    """Odometry numbers, and of each scan only distance and angle of its objects; also the columns ``also``.

    Cutting the scan into objects does not need the pose, so it runs before the rows move. Only
    scans pass through it: the two kinds are read apart, each with the columns it needs.
    """
    keys = ("vehicle", "t_ms", "seq", *also)
    none = F.lit(None).cast("array<double>")
    odometry = rows.filter(F.col("kind") == "odo").select(
        *keys, F.lit(ODO).cast("tinyint").alias("code"),
        F.col("speed").alias("m0"), F.col("steering").alias("m1"), none.alias("reach"), none.alias("degrees"),
    )
    if "ranges" not in rows.columns:
        return odometry
    segments = segment_stats(F.col("ranges"), scan, raw=not cleaned)
    laser = rows.filter(F.col("kind") == "laser").select(*keys, segments.alias("_segments")).select(
        *keys, F.lit(LASER).cast("tinyint").alias("code"),
        F.lit(None).cast("double").alias("m0"), F.lit(None).cast("double").alias("m1"),
        F.col("_segments.reach").alias("reach"), F.col("_segments.degrees").alias("degrees"),
    )
    return odometry.unionByName(laser)


def slam_track(
    rows: DataFrame, config: SlamConfig = SlamConfig(), scan: ScanConfig = RAW_SCAN, cleaned: bool = False,
    emit: tuple[str, ...] = ("prediction", "update"), hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Pose after every row, with the number of landmarks known by then."""
    track = _run(slam_input(rows, scan, cleaned), config, "track", hot_rows)
    return track if len(emit) == 2 else track.filter(F.col("step").isin(*emit))


def slam_map(
    rows: DataFrame, config: SlamConfig = SlamConfig(), scan: ScanConfig = RAW_SCAN, cleaned: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Landmarks of each vehicle after its last row: vehicle, idx (from 1), x, y."""
    return _run(slam_input(rows, scan, cleaned), config, "map", hot_rows)


def _run(narrow: DataFrame, config: SlamConfig, what: str, hot_rows) -> DataFrame:
    split = split_hot(narrow, hot_rows)
    hot = split.hot
    out = _fold(split.usual, config, what, split.rows)
    if hot is None:
        return out
    # a map forgets nothing, so slices are run one after the other, each from a stored state
    first = F.array(*[F.lit(float(v)) for v in steps.SlamState.first(config).pack()])
    starts = slices.settle(hot, lambda df: _fold(df, config, "end", split.hot_rows), first)
    if what == "map":
        last = Window.partitionBy("vehicle").orderBy(F.desc("slice"))
        starts = starts.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
        hot = hot.join(starts.select(*slices.KEYS), slices.KEYS, "left_semi")
    return out.unionByName(_fold(slices.with_starts(hot, starts), config, what, split.hot_rows))


def _fold(rows: DataFrame, config: SlamConfig, what: str, total: int | None = None) -> DataFrame:
    double = T.DoubleType()
    fields = {
        "track": [rows.schema["vehicle"], rows.schema["t_ms"], rows.schema["seq"],
                  T.StructField("step", T.StringType()), T.StructField("x", double), T.StructField("y", double),
                  T.StructField("phi", double), T.StructField("landmarks", T.IntegerType())],
        "map": [rows.schema["vehicle"], T.StructField("idx", T.IntegerType()),
                T.StructField("x", double), T.StructField("y", double)],
    }
    if what == "end":
        schema = [rows.schema["vehicle"], rows.schema["slice"], T.StructField("end", T.ArrayType(double))]
    else:
        schema = fields[what]
    return slices.gather(rows, total).mapInArrow(_Fold(config, what), T.StructType(schema))


class _Fold:
    """Folds a sorted stream of batches; holds the state of the vehicle in work only."""

    def __init__(self, config: SlamConfig, what: str):
        self.config, self.what = config, what

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, keys = _runs(batch)
            code = batch.column("code").to_numpy(zero_copy_only=False)
            t_ms = batch.column("t_ms").to_numpy(zero_copy_only=False)
            m0 = batch.column("m0").to_numpy(zero_copy_only=False)
            m1 = batch.column("m1").to_numpy(zero_copy_only=False)
            reach, degrees = batch.column("reach"), batch.column("degrees")
            poses = np.empty((len(code), 4))
            ends = np.append(starts[1:], len(code))
            for run, (begin, end) in enumerate(zip(starts, ends)):
                if keys[run] != key:
                    if key is not None and self.what != "track":
                        yield self._end(key, state)
                    key, state = keys[run], steps.SlamState.first(self.config)
                for i in range(begin, end):
                    if code[i] == ODO:
                        steps.slam_predict(state, float(t_ms[i]), m0[i], m1[i], self.config)
                    elif code[i] == LASER:
                        steps.slam_update(
                            state, float(t_ms[i]),
                            reach[i].values.to_numpy(zero_copy_only=False),
                            degrees[i].values.to_numpy(zero_copy_only=False), self.config,
                        )
                    else:
                        state = steps.SlamState.unpack(
                            batch.column("state")[i].values.to_numpy(zero_copy_only=False))
                    poses[i, :3], poses[i, 3] = state.mean[:3], (state.size - 3) // 2
            if self.what == "track":
                yield self._track(batch, code, poses)
        if key is not None and self.what != "track":
            yield self._end(key, state)

    def _track(self, batch: pa.RecordBatch, code: np.ndarray, poses: np.ndarray) -> pa.RecordBatch:
        keep = code != slices.START_CODE
        index = pa.array(np.flatnonzero(keep))
        poses = poses[keep]
        step = pa.array(np.where(code[keep] == ODO, "prediction", "update").astype(object), pa.string())
        columns = [batch.column(n).take(index) for n in ("vehicle", "t_ms", "seq")] + [step]
        columns += [pa.array(np.ascontiguousarray(poses[:, i])) for i in range(3)]
        columns.append(pa.array(poses[:, 3].astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            columns, ["vehicle", "t_ms", "seq", "step", "x", "y", "phi", "landmarks"])

    def _end(self, key, state: steps.SlamState) -> pa.RecordBatch:
        if self.what == "end":
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int32()),
                 pa.array([state.pack()], pa.list_(pa.float64()))],
                ["vehicle", "slice", "end"])
        marks = state.mean[3:]
        count = len(marks) // 2
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * count, pa.string()), pa.array(np.arange(1, count + 1, dtype=np.int32)),
             pa.array(np.ascontiguousarray(marks[0::2])), pa.array(np.ascontiguousarray(marks[1::2]))],
            ["vehicle", "idx", "x", "y"])
