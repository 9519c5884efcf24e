"""Filter steps against hand-worked values and against plain matrix algebra."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import Row

from trackfold.functions.beams import measure
from trackfold.operators import ekf, slam, steps
from trackfold.plans import adapter
from trackfold.schema import EKF_START, RAW_SCAN, EkfConfig, SlamConfig, Start

CONFIG = EkfConfig()


def covariance(state):
    pxx, pxy, pxh, pyy, pyh, phh = state[3:9]
    return np.array([[pxx, pxy, pxh], [pxy, pyy, pyh], [pxh, pyh, phh]])


def matrix_predict(mean, cov, dt, speed, steering, noise):
    """Full-matrix prediction; mean may hold landmarks behind the pose."""
    wheelbase, offset, ahead, left = 2.83, 0.76, 3.78, 0.5
    v = speed / (1 - math.tan(steering) * offset / wheelbase)
    w = v / wheelbase * math.tan(steering)
    phi = math.fmod(mean[2], 2 * math.pi)
    dx = dt * (v * math.cos(phi) - w * (ahead * math.sin(phi) + left * math.cos(phi)))
    dy = dt * (v * math.sin(phi) + w * (ahead * math.cos(phi) - left * math.sin(phi)))
    n = len(mean)
    g, r = np.eye(n), np.zeros((n, n))
    g[0, 2], g[1, 2] = -dy, dx
    r[:3, :3] = noise * np.eye(3)
    out = mean.copy()
    out[:3] += (dx, dy, dt * w)
    return out, g @ cov @ g.T + r


def test_first_rows_worked_out():
    state = steps.ekf_predict(math, steps.ekf_start(CONFIG), 21967.0, 2.0, 0.0, CONFIG)
    assert state[:3] == pytest.approx((-65.649271, -41.714218, 0.0), abs=1e-6)
    assert [state[i] for i in (3, 6, 8)] == [0.5, 0.5, 0.5] and state[4] == state[5] == state[7] == 0.0
    state = steps.ekf_update(math, state, 22167.0, -65.0, -41.0, CONFIG)
    assert state[:3] == pytest.approx((-65.324635, -41.649289, 0.0), abs=1e-6)
    assert [state[i] for i in (3, 6, 8)] == pytest.approx([0.25, 0.454545, 0.5], abs=1e-6)


def test_ekf_equals_matrix_form():
    rng = np.random.default_rng(7)
    state = steps.ekf_start(CONFIG)
    mean, cov, before = np.array(state[:3]), np.zeros((3, 3)), state[9]
    h, noise = np.array([[1.0, 0, 0], [0, 1, 0]]), np.diag([0.5, 5.0])
    for i in range(300):
        t = before + int(rng.integers(0, 400))
        if rng.random() < 0.7:
            speed, steering = rng.uniform(0, 4), rng.uniform(-0.4, 0.4)
            state = steps.ekf_predict(math, state, t, speed, steering, CONFIG)
            mean[2] = math.fmod(mean[2], 2 * math.pi)
            mean, cov = matrix_predict(mean, cov, (t - before) / 1000, speed, steering, 0.5)
        else:
            fix = mean[:2] + rng.normal(0, 2, 2)
            state = steps.ekf_update(math, state, t, *fix, CONFIG)
            s = h @ cov @ h.T + noise
            k = cov @ h.T @ np.linalg.inv(s)
            mean, cov = mean + k @ (fix - mean[:2]), cov - k @ s @ k.T
        before = t
        assert state[:3] == pytest.approx(mean, abs=1e-8)
        assert covariance(state) == pytest.approx(cov, abs=1e-8)
        assert np.linalg.eigvalsh(covariance(state)).min() > -1e-9


@pytest.mark.parametrize("kind", ["position", "observer", "difference", "gps_only", "pose_only"])
def test_many_vehicles_at_once_equal_one_by_one(kind):
    config = EkfConfig(innovation=kind)
    rng = np.random.default_rng(3)
    many = np.tile(np.array(steps.ekf_start(config))[:, None], 5)
    many[:9] += rng.normal(0, 0.1, (9, 5))
    many[[3, 6, 8]] += 2
    args = rng.uniform(-1, 1, (2, 5))
    times = np.full(5, EKF_START.t_ms + 500.0)
    for step in (steps.ekf_predict, steps.ekf_update):
        together = np.array(step(np, tuple(many), times, args[0], args[1], config))
        for i in range(5):
            alone = step(math, tuple(many[:, i]), times[i], args[0, i], args[1, i], config)
            assert together[:, i] == pytest.approx(alone, rel=1e-12, abs=1e-12)


def test_unknown_innovation():
    with pytest.raises(ValueError):
        steps.ekf_innovation(math, 0, 0, 1, 1, "other")


def brute_slam(events, config: SlamConfig):
    """Full matrices, one row after the other, as the definition reads."""
    mean, cov, before = np.zeros(3), np.zeros((3, 3)), float(config.start.t_ms)
    for t, kind, a, b in events:
        if kind == "odo":
            full = matrix_predict(mean, cov, (t - before) / 1000, a, b, config.motion_noise)
            if config.predict == "fast":
                block = matrix_predict(mean[:3], cov[:3, :3], (t - before) / 1000, a, b, config.motion_noise)[1]
                cov = cov.copy()
                cov[:3, :3] = block
                mean = full[0]
            else:
                mean, cov = full
        else:
            seen_at = mean.copy()
            phi = mean[2]
            for reach, degrees in zip(a, b):
                angle = math.radians(degrees) - math.pi / 2 + phi
                x, y = reach * math.cos(angle) + 3.78, reach * math.sin(angle) + 0.5
                dist, bearing = math.hypot(x, y), math.atan2(y, x) - phi
                world = config.frame == "world"
                ox, oy = (x + seen_at[0], y + seen_at[1]) if world else (x, y)
                found, close = None, False
                for j in range(3, len(seen_at), 2):
                    d = math.hypot(seen_at[j] - ox, seen_at[j + 1] - oy)
                    if 0.4 < d < 2.0:
                        close = True
                    elif d < 0.4:
                        found = j
                        break
                if found is None and close:
                    continue
                if found is None:
                    found = len(mean)
                    mark = (x + mean[0], y + mean[1]) if world else (x, y)
                    mean = np.append(mean, mark)
                    grown = np.zeros((found + 2, found + 2))
                    grown[:found, :found] = cov
                    grown[found, found] = grown[found + 1, found + 1] = 1e6
                    cov = grown
                    dx, dy = x, y
                elif world:
                    dx, dy = mean[found] - mean[0], mean[found + 1] - mean[1]
                else:
                    dx, dy = seen_at[found], seen_at[found + 1]
                q = dx * dx + dy * dy
                r = math.sqrt(q)
                low = np.array([[-dx / r, -dy / r, 0, dx / r, dy / r], [dy / q, -dx / q, -1, -dy / q, dx / q]])
                h = np.zeros((2, len(mean)))
                h[:, :3] = low[:, :3]
                h[:, found: found + 2] = low[:, 3:]
                k = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + 0.01 * np.eye(2))
                turn = bearing - (math.atan2(dy, dx) - mean[2])
                if world:
                    turn = math.remainder(turn, 2 * math.pi)
                mean = mean + k @ np.array([dist - r, turn])
                cov = (np.eye(len(mean)) - k @ h) @ cov
        before = t
    return mean, cov


def slam_events(seed: int):
    """A slow drive past fixed landmarks, so that some are seen again."""
    rng = np.random.default_rng(seed)
    events, t = [], 0
    for i in range(60):
        t += int(rng.integers(20, 80))
        if i % 4:
            events.append((t, "odo", float(rng.uniform(0, 0.6)), float(rng.uniform(-0.05, 0.05))))
        else:
            reach = np.array([6.0, 11.0, 17.0, 25.0]) + rng.normal(0, 0.05, 4)
            events.append((t, "laser", reach, np.array([40.0, 75.0, 100.0, 140.0])))
    return events


@pytest.mark.parametrize("frame", ["world", "relative"])
@pytest.mark.parametrize("predict", ["full", "fast"])
def test_slam_equals_full_matrices(frame, predict):
    config = SlamConfig(start=Start(), frame=frame, predict=predict)
    events = slam_events(11)
    state = steps.SlamState.first(config)
    for t, kind, a, b in events:
        if kind == "odo":
            steps.slam_predict(state, t, a, b, config)
        else:
            steps.slam_update(state, t, a, b, config)
    mean, cov = brute_slam(events, config)
    assert len(mean) > 3 and state.size == len(mean)
    assert state.mean == pytest.approx(mean, abs=1e-6)
    assert state.cov == pytest.approx(cov, rel=1e-5, abs=1e-5)
    if predict == "full":
        assert state.cov == pytest.approx(state.cov.T, abs=1e-9)
    assert (np.diag(state.cov) >= 0).all()


def test_slam_state_packs_and_grows():
    state = steps.SlamState(np.ones(3), np.ones((3, 3)), 5.0)
    assert state.grow(7.0, 8.0, 1e6) == 3
    assert state.mean.tolist() == [1, 1, 1, 7, 8]
    assert state.cov[:3, 3:].tolist() == [[0, 0]] * 3 and state.cov[3, 3] == state.cov[4, 4] == 1e6
    back = steps.SlamState.unpack(state.pack())
    assert back.t_ms == 5.0 and (back.mean == state.mean).all() and (back.cov == state.cov).all()


def test_match_takes_the_first_not_the_nearest():
    marks = np.array([[20, -12], [24, 10], [10, 4], [9.8, 4.1]])
    seen = np.array([[9.8, 4.1], [11, 4], [0, 0], [8, 4]])
    hits = steps.match_landmarks(seen[:, 0], seen[:, 1], marks[:, 0], marks[:, 1], 0.4, 2.0)
    assert hits.tolist() == [2, -10, -2, -10]
    alone = steps.match_landmarks(seen[:, 0], seen[:, 1], marks[:3, 0], marks[:3, 1], 0.4, 2.0)
    assert alone.tolist() == [2, -10, -2, -2]  # (8, 4) lies at exactly 2.0: outside


def test_batch_slam_equals_steps(spark):
    config = SlamConfig(start=Start())
    rng = np.random.default_rng(5)
    rows, events = [], []
    for i in range(40):
        if i % 5:
            v, a = float(rng.uniform(0, 0.5)), float(rng.uniform(-0.05, 0.05))
            rows.append(Row(vehicle="v", t_ms=i * 50, seq=i, kind="odo", speed=v, steering=a, ranges=None))
            events.append((i * 50, "odo", v, a))
        else:
            ranges = np.where(rng.random(60) < 0.2, rng.uniform(500, 3000, 60), 8191.0)
            rows.append(Row(vehicle="v", t_ms=i * 50, seq=i, kind="laser", speed=None, steering=None,
                            ranges=ranges.tolist()))
            found, _ = measure(ranges, np.array([0, 60]), RAW_SCAN, raw=True)
            events.append((i * 50, "laser", found["reach"], found["degrees"]))
    df = spark.createDataFrame(rows, "vehicle string, t_ms bigint, seq bigint, kind string, speed double, "
                                     "steering double, ranges array<double>").repartition(3)
    mean, _ = brute_slam(events, config)
    track = slam.slam_track(df, config).orderBy("t_ms").collect()
    assert [track[-1][n] for n in ("x", "y", "phi")] == pytest.approx(mean[:3], abs=1e-6)
    assert track[-1].landmarks == (len(mean) - 3) // 2
    found = slam.slam_map(df, config).orderBy("idx").collect()
    assert [v for r in found for v in (r.x, r.y)] == pytest.approx(mean[3:], abs=1e-5)


def test_batches_do_not_matter(spark, sf_dir, monkeypatch):
    """Runs cut by batch borders carry their state on."""
    mapping = adapter.mapping_rows(spark, sf_dir).filter("vehicle IN ('vehicle1', 'vehicle2')")
    marks = slam.slam_map(mapping, adapter.SLAM).orderBy("vehicle", "idx").toPandas()
    rows = adapter.sensors(spark, sf_dir)
    whole = ekf.ekf_track(rows, adapter.EKF).orderBy("vehicle", "t_ms", "seq").toPandas()
    monkeypatch.setattr(ekf, "BLOCK_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert slam.slam_map(mapping, adapter.SLAM).orderBy("vehicle", "idx").toPandas().equals(marks)
        small = ekf.ekf_track(rows.repartition(5), adapter.EKF).orderBy("vehicle", "t_ms", "seq").toPandas()
        final = ekf.ekf_final(rows, adapter.EKF).toPandas().set_index("vehicle")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (whole[["vehicle", "t_ms", "seq", "step"]] == small[["vehicle", "t_ms", "seq", "step"]]).all(axis=None)
    assert np.allclose(whole[["x", "y", "phi"]], small[["x", "y", "phi"]], atol=1e-9)
    last = whole.groupby("vehicle").last()
    assert np.allclose(last[["x", "y", "phi"]], final.loc[last.index, ["x", "y", "phi"]], atol=1e-9)


def test_a_vehicle_alone_and_in_company(spark):
    """Bad values and the last bit: the company a vehicle is computed in changes nothing."""
    def rows(vehicles):
        return spark.createDataFrame(
            [(v, t, t, "odo" if t % 3 else "gps", 3.1 + t if t != bad else float("inf"), 0.37 * (t % 5), 1.0 * t, 2.0)
             for v, bad in vehicles for t in range(40)],
            "vehicle string, t_ms bigint, seq bigint, kind string, speed double, steering double, gps_x double, gps_y double")

    many = [(f"v{n}", -1) for n in range(40)]
    company = {(r.vehicle, r.seq): tuple(r) for r in ekf.ekf_track(rows([("a", 20), ("b", -1), *many]).coalesce(1)).collect()}
    for v, bad in (("a", 20), ("b", -1)):
        alone = ekf.ekf_track(rows([(v, bad)])).collect()
        assert len(alone) == 40
        assert [repr(tuple(r)) for r in alone] == [repr(company[v, r.seq]) for r in alone]


def test_partitions_in_order_of_time_change_nothing(spark, sf_dir, monkeypatch):
    """Vehicles stepped side by side through stretches of time, to the last bit as one after the other."""
    rows = adapter.sensors(spark, sf_dir)
    unnamed = rows.filter("vehicle = 'vehicle1'").selectExpr("CAST(NULL AS string) AS vehicle", *rows.columns[1:])
    rows = rows.unionByName(unnamed)
    plan = ekf.ekf_track(rows, adapter.EKF)
    want = sorted(map(repr, plan.collect())), sorted(map(repr, ekf.ekf_final(rows, adapter.EKF).collect()))
    monkeypatch.setattr(ekf, "LONG_TRACK", 1)
    for block in (ekf.BLOCK_ROWS, 50):
        monkeypatch.setattr(ekf, "BLOCK_ROWS", block)
        got = sorted(map(repr, ekf.ekf_track(rows, adapter.EKF).collect())), sorted(
            map(repr, ekf.ekf_final(rows, adapter.EKF).collect()))
        assert got == want
