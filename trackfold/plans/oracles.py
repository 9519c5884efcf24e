"""The same queries in DuckDB SQL, from the same tables."""

from __future__ import annotations

from trackfold.plans.adapter import EPOCH_MS, SCAN_SEQ, SCANS_PER_VEHICLE, START, TICK_MS
from trackfold.plans.catalog import MAX_JUMP, MIN_GROUP

PI = "3.141592653589793::DOUBLE"
TWO_PI = "6.283185307179586::DOUBLE"
L, H, A, B = "2.83::DOUBLE", "0.76::DOUBLE", "3.78::DOUBLE", "0.5::DOUBLE"

SENSOR = f"""
_s AS (
  SELECT 'vehicle' || user_id AS vehicle,
         CAST((epoch_ms(ts) - {EPOCH_MS}) // {TICK_MS} AS BIGINT) AS t_ms,
         event_id AS seq,
         CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'odo'
              WHEN event_type = 'purchase' THEN 'gps' ELSE event_type END AS kind,
         value / 100::DOUBLE AS speed,
         (event_id % 21 - 10) / 100::DOUBLE AS steering,
         -67.65::DOUBLE + (event_id % 101 - 50) / 10::DOUBLE AS gps_x,
         -41.71::DOUBLE + (event_id % 89 - 44) / 10::DOUBLE AS gps_y
  FROM events),
sensor AS (
  SELECT vehicle, t_ms, seq, kind,
         CASE WHEN kind = 'odo' THEN speed END AS speed,
         CASE WHEN kind = 'odo' THEN steering END AS steering,
         CASE WHEN kind = 'gps' THEN gps_x END AS gps_x,
         CASE WHEN kind = 'gps' THEN gps_y END AS gps_y
  FROM _s)"""

SCANS = f"""
scans AS (
  SELECT 'vehicle' || (vec_id // {SCANS_PER_VEHICLE}) AS vehicle,
         (vec_id % {SCANS_PER_VEHICLE} + 1) * 5000 AS t_ms,
         vec_id + {SCAN_SEQ} AS seq,
         0.5::DOUBLE + (vec_id % 7) / 10::DOUBLE AS x_inc,
         (vec_id % 5 - 2) / 20::DOUBLE AS y_inc,
         (vec_id % 9 - 4) / 20::DOUBLE AS phi_inc,
         embedding
  FROM embeddings),
beams AS (
  SELECT vehicle, seq, phi_inc, unnest(range(len(embedding))) AS beam,
         abs(unnest(embedding)::DOUBLE) * 100 AS r
  FROM scans),
raw_beams AS (
  SELECT vehicle, seq, phi_inc, beam,
         CASE WHEN v <= 40 THEN v ELSE 0 END AS r
  FROM (SELECT *, CASE WHEN beam < 15 THEN 81::DOUBLE ELSE r * 100 / 100 END AS v FROM beams)),
posed AS (
  SELECT *, sum(cos(phi - phi_inc / 2) * x_inc - sin(phi - phi_inc / 2) * y_inc) OVER w AS x,
            sum(sin(phi - phi_inc / 2) * x_inc + cos(phi - phi_inc / 2) * y_inc) OVER w AS y
  FROM (SELECT *, sum(phi_inc) OVER (PARTITION BY vehicle ORDER BY t_ms, seq) AS phi FROM scans)
  WINDOW w AS (PARTITION BY vehicle ORDER BY t_ms, seq))"""


def _r(name: str, digits: int = 6, expr: str | None = None) -> str:
    return f"round({expr or name}, {digits}) + 0.0 AS {name}"


def _segments(beams: str, gap: float, name: str) -> str:
    """Common table ``name`` with the measured segments of ``beams``."""
    return f"""
{name} AS (
  SELECT vehicle, seq, any_value(phi_inc) AS phi_inc, min(beam) AS first, max(beam) AS last,
         (max(beam) - min(beam) + 1) * {PI} / 360 AS width,
         sum(r) / (max(beam) - min(beam) + 1) AS mean, min(r) AS nearest,
         (max(beam) - min(beam) + 1) * {PI} / 360 * (sum(r) / (max(beam) - min(beam) + 1)) AS diameter
  FROM (SELECT *, sum(jump) OVER (PARTITION BY vehicle, seq ORDER BY beam) AS segment
        FROM (SELECT *, CASE WHEN abs(r - lag(r) OVER (PARTITION BY vehicle, seq ORDER BY beam)) > {gap}
                        THEN 1 ELSE 0 END AS jump
              FROM {beams}))
  GROUP BY vehicle, seq, segment HAVING sum(r) > 0)"""


def _beam(degrees: str, reach: str, phi: str) -> tuple[str, str]:
    angle = f"radians({degrees}) - radians(90::DOUBLE) + {phi}"
    return f"{reach} * cos({angle}) + {A}", f"{reach} * sin({angle}) + {B}"


def _objects(segments: str, phi: str, name: str) -> str:
    x, y = _beam("(first * 0.5::DOUBLE + degrees(width / 2))", "(nearest + diameter / 2)", phi)
    return f"""
{name} AS (
  SELECT *, sqrt(x * x + y * y) AS range, atan2(y, x) - {phi} AS bearing
  FROM (SELECT *, {x} AS x, {y} AS y FROM {segments}))"""


INNOVATION = {
    "position": ("m0 - x", "m1 - y"),
    "observer": ("sqrt(m0 * m0 + m1 * m1) - sqrt(x * x + y * y)", "atan2(m1, m0) - atan2(y, x)"),
    "difference": ("sqrt((m0 - x) * (m0 - x) + (m1 - y) * (m1 - y))", "atan2(m1 - y, m0 - x)"),
    "gps_only": ("sqrt(m0 * m0 + m1 * m1)", "atan2(m1, m0)"),
    "pose_only": ("sqrt(x * x + y * y)", "atan2(y, x)"),
}


def _ekf(innovation: str = "position", kinds: str = "'odo', 'gps'", start: tuple[float, float] = (START.x, START.y)) -> str:
    u, v = INNOVATION[innovation]
    x0, y0 = start
    return f"""
WITH RECURSIVE {SENSOR},
_in AS (
  SELECT vehicle, t_ms, seq, kind, coalesce(speed, gps_x) AS m0, coalesce(steering, gps_y) AS m1,
         row_number() OVER (PARTITION BY vehicle ORDER BY t_ms, seq) AS n
  FROM sensor WHERE kind IN ({kinds})),
_ekf AS (
  SELECT DISTINCT vehicle, 0::BIGINT AS t_ms, 0::BIGINT AS seq, '' AS kind, 0::BIGINT AS n,
         {x0}::DOUBLE AS x, {y0}::DOUBLE AS y, 0::DOUBLE AS phi,
         0::DOUBLE AS pxx, 0::DOUBLE AS pxy, 0::DOUBLE AS pxh, 0::DOUBLE AS pyy, 0::DOUBLE AS pyh, 0::DOUBLE AS phh
  FROM _in
  UNION ALL
  SELECT vehicle, t_ms, seq, kind, n,
    CASE WHEN kind = 'odo' THEN x + dx ELSE x + kx0 * u + kx1 * v END,
    CASE WHEN kind = 'odo' THEN y + dy ELSE y + ky0 * u + ky1 * v END,
    CASE WHEN kind = 'odo' THEN wrapped + dphi ELSE phi + kh0 * u + kh1 * v END,
    CASE WHEN kind = 'odo' THEN pxx - 2 * dy * pxh + dy * dy * phh + 0.5 ELSE pxx - (pxx * kx0 + pxy * kx1) END,
    CASE WHEN kind = 'odo' THEN pxy + dx * pxh - dy * pyh - dx * dy * phh ELSE pxy - (pxx * ky0 + pxy * ky1) END,
    CASE WHEN kind = 'odo' THEN pxh - dy * phh ELSE pxh - (pxx * kh0 + pxy * kh1) END,
    CASE WHEN kind = 'odo' THEN pyy + 2 * dx * pyh + dx * dx * phh + 0.5 ELSE pyy - (pxy * ky0 + pyy * ky1) END,
    CASE WHEN kind = 'odo' THEN pyh + dx * phh ELSE pyh - (pxy * kh0 + pyy * kh1) END,
    CASE WHEN kind = 'odo' THEN phh + 0.5 ELSE phh - (pxh * kh0 + pyh * kh1) END
  FROM (
    SELECT *, dt * (speed - rate * {B}) * cos(wrapped) - dt * rate * {A} * sin(wrapped) AS dx,
              dt * (speed - rate * {B}) * sin(wrapped) + dt * rate * {A} * cos(wrapped) AS dy,
              dt * rate AS dphi, {u} AS u, {v} AS v,
              (pxx * syy - pxy * pxy) / det AS kx0, (pxy * sxx - pxx * pxy) / det AS kx1,
              (pxy * syy - pyy * pxy) / det AS ky0, (pyy * sxx - pxy * pxy) / det AS ky1,
              (pxh * syy - pyh * pxy) / det AS kh0, (pyh * sxx - pxh * pxy) / det AS kh1
    FROM (
      SELECT *, speed / {L} * tan(m1) AS rate, sxx * syy - pxy * pxy AS det
      FROM (
        SELECT r.vehicle, r.t_ms, r.seq, r.kind, r.n, r.m0, r.m1, s.x, s.y, s.phi, s.phi % {TWO_PI} AS wrapped,
               s.pxx, s.pxy, s.pxh, s.pyy, s.pyh, s.phh, (r.t_ms - s.t_ms) / 1000::DOUBLE AS dt,
               r.m0 / (1 - tan(r.m1) * {H} / {L}) AS speed, s.pxx + 0.5 AS sxx, s.pyy + 5 AS syy
        FROM _ekf s JOIN _in r ON r.vehicle = s.vehicle AND r.n = s.n + 1)))),
track AS (
  SELECT *, CASE WHEN kind = 'odo' THEN 'prediction' ELSE 'update' END AS step FROM _ekf WHERE n > 0)"""


def _pose(digits: int = 4) -> str:
    return ", ".join(_r(n, digits, e) for n, e in
                     (("x", "x"), ("y", "y"), ("sin_phi", "sin(phi)"), ("cos_phi", "cos(phi)")))


_POSE = _pose()
_COV = ", ".join(
    _r(name, 4, column)
    for name, column in (("p_xx", "pxx"), ("p_xy", "pxy"), ("p_xphi", "pxh"), ("p_yy", "pyy"),
                         ("p_yphi", "pyh"), ("p_phiphi", "phh"))
)


def _ekf_track(innovation: str = "position", kinds: str = "'odo', 'gps'", where: str = "true") -> str:
    return f"{_ekf(innovation, kinds)} SELECT vehicle, t_ms, seq, step, {_POSE} FROM track WHERE {where}"


def _slam(frame: str = "world", predict: str = "full") -> str:
    """The mapping filter: one recursion step a row of odometry or an object of a scan.

    The covariance is a list of rows. Objects of a scan are told apart by the map as it
    was before the scan (``base``).
    """
    world = frame == "world"
    shift_x, shift_y = ("base[1]", "base[2]") if world else ("0", "0")
    new_x, new_y = ("ox + mean[1]", "oy + mean[2]") if world else ("ox", "oy")
    seen_x, seen_y = ("mean[place + 1] - mean[1]", "mean[place + 2] - mean[2]") if world else ("base[place + 1]", "base[place + 2]")
    turn = f"turn - {TWO_PI} * round_even(turn / {TWO_PI}, 0)" if world else "turn"
    tail_x, tail_y, rest = "c1[4:]", "c2[4:]", "cov[4:]"
    if predict == "full":
        tail_x = "list_transform(range(4, n + 1), lambda j: c1[j] - dy * c3[j])"
        tail_y = "list_transform(range(4, n + 1), lambda j: c2[j] + dx * c3[j])"
        rest = "list_transform(cov[4:], lambda v: [v[1] - dy * v[3], v[2] + dx * v[3]] || v[3:])"
    away = f"sqrt(pow(base[2 * i + 4] - (ox + {shift_x}), 2) + pow(base[2 * i + 5] - (oy + {shift_y}), 2))"
    marks = "range((len(base) - 3) // 2)"
    pxy = "c1[2] + dx * c1[3] - dy * c2[3] - dx * dy * c3[3]"
    ox, oy = _beam("m1", "m0", "base[3]")
    return f"""
WITH RECURSIVE {SENSOR}, {SCANS}, {_segments('raw_beams', '2.0', 'parts')},
_rows AS (
  SELECT vehicle, t_ms, seq, 'prediction' AS step, speed AS m0, steering AS m1, -1 AS k FROM sensor WHERE kind = 'odo'
  UNION ALL
  SELECT s.vehicle, s.t_ms, s.seq, 'update', nearest + diameter / 2, first * 0.5::DOUBLE + degrees(width / 2), first
  FROM scans s LEFT JOIN parts p ON p.seq = s.seq),
_in AS MATERIALIZED (
  SELECT *, row_number() OVER w AS nth, coalesce(lag(seq) OVER w <> seq, true) AS opens,
         coalesce(lead(seq) OVER w <> seq, true) AS closes
  FROM _rows WINDOW w AS (PARTITION BY vehicle ORDER BY t_ms, seq, k)),
_slam(vehicle, nth, t_ms, mean, cov, base, track) USING KEY (vehicle) AS (
  SELECT DISTINCT vehicle, 0::BIGINT, 0::BIGINT, [0, 0, 0]::DOUBLE[], [[0, 0, 0], [0, 0, 0], [0, 0, 0]]::DOUBLE[][],
         [0, 0, 0]::DOUBLE[],
         []::STRUCT(t_ms BIGINT, seq BIGINT, step VARCHAR, x DOUBLE, y DOUBLE, phi DOUBLE, landmarks INTEGER)[]
  FROM _in
  UNION ALL
  SELECT vehicle, nth, t_ms, after, cov, base,
    CASE WHEN closes THEN list_append(track, {{'t_ms': t_ms, 'seq': seq, 'step': step, 'x': after[1], 'y': after[2],
      'phi': after[3], 'landmarks': ((len(after) - 3) // 2)::INTEGER}}) ELSE track END
  FROM (
    SELECT * EXCLUDE (cov),
      CASE WHEN step = 'prediction' THEN [mean[1] + dx, mean[2] + dy, mean[3] + dphi] || mean[4:]
           WHEN place IS NULL THEN mean
           ELSE list_transform(range(1, n + 1), lambda i: mean[i] + g0[i] * miss + g1[i] * ({turn})) END AS after,
      CASE WHEN step = 'prediction' THEN [
             [c1[1] - 2 * dy * c1[3] + dy * dy * c3[3] + 0.5::DOUBLE, {pxy}, c1[3] - dy * c3[3]] || {tail_x},
             [{pxy}, c2[2] + 2 * dx * c2[3] + dx * dx * c3[3] + 0.5::DOUBLE, c2[3] + dx * c3[3]] || {tail_y},
             [c1[3] - dy * c3[3], c2[3] + dx * c3[3], c3[3] + 0.5::DOUBLE] || c3[4:]] || {rest}
           WHEN place IS NULL THEN cov
           ELSE list_transform(cov[:wide], lambda v, i: list_transform(v, lambda c, j: c - (w0[i] * g0[j] + w1[i] * g1[j])))
           END AS cov
    FROM (
      SELECT *, list_transform(range(1, wide + 1), lambda i: (w0[i] * sc - w1[i] * sb) / (sa * sc - sb * sb)) AS g0,
             list_transform(range(1, wide + 1), lambda i: (w1[i] * sa - w0[i] * sb) / (sa * sc - sb * sb)) AS g1
      FROM (
        SELECT *, orange - r AS miss, bearing - (atan2(sy, sx) - mean[3]) AS turn,
          (sx * (w0[place + 1] - w0[1]) + sy * (w0[place + 2] - w0[2])) / r + 0.01::DOUBLE AS sa,
          (sx * (w1[place + 1] - w1[1]) + sy * (w1[place + 2] - w1[2])) / r AS sb,
          (sx * (w1[place + 2] - w1[2]) - sy * (w1[place + 1] - w1[1])) / q - w1[3] + 0.01::DOUBLE AS sc
        FROM (
          SELECT *, list_transform(range(1, wide + 1), lambda i: (sx * (cp[i] - c1[i]) + sy * (cq[i] - c2[i])) / r) AS w0,
                    list_transform(range(1, wide + 1), lambda i: (sx * (cq[i] - c2[i]) - sy * (cp[i] - c1[i])) / q - c3[i]) AS w1
          FROM (
            SELECT *, len(mean) AS n, CASE WHEN place IS NULL THEN 0 ELSE len(mean) END AS wide,
                   sx * sx + sy * sy AS q, sqrt(sx * sx + sy * sy) AS r,
                   cov[1] AS c1, cov[2] AS c2, cov[3] AS c3, cov[place + 1] AS cp, cov[place + 2] AS cq
            FROM (
              SELECT * EXCLUDE (mean, cov), CASE WHEN fresh THEN ox ELSE {seen_x} END AS sx,
                CASE WHEN fresh THEN oy ELSE {seen_y} END AS sy,
                CASE WHEN fresh THEN mean || [{new_x}, {new_y}] ELSE mean END AS mean,
                CASE WHEN fresh THEN list_transform(cov, lambda v: v || [0, 0]::DOUBLE[]) || [
                  list_resize([]::DOUBLE[], place, 0) || [1000000, 0]::DOUBLE[],
                  list_resize([]::DOUBLE[], place, 0) || [0, 1000000]::DOUBLE[]] ELSE cov END AS cov
              FROM (
                SELECT *, sqrt(ox * ox + oy * oy) AS orange, atan2(oy, ox) - base[3] AS bearing,
                  ox IS NOT NULL AND hit IS NULL AND NOT close AS fresh,
                  CASE WHEN hit IS NOT NULL THEN 2 * hit + 1 WHEN ox IS NOT NULL AND NOT close THEN len(mean) END AS place
                FROM (
                  SELECT *, list_position(list_transform({marks}, lambda i: {away} < 0.4::DOUBLE), true) AS hit,
                    list_contains(list_transform({marks}, lambda i: {away} > 0.4::DOUBLE AND {away} < 2), true) AS close,
                    dt * (speed - rate * {B}) * cos(wrapped) - dt * rate * {A} * sin(wrapped) AS dx,
                    dt * (speed - rate * {B}) * sin(wrapped) + dt * rate * {A} * cos(wrapped) AS dy, dt * rate AS dphi
                  FROM (
                    SELECT *, CASE WHEN step = 'update' THEN {ox} END AS ox, CASE WHEN step = 'update' THEN {oy} END AS oy,
                           speed / {L} * tan(m1) AS rate
                    FROM (
                      SELECT r.*, s.mean, s.cov, s.track, CASE WHEN r.opens THEN s.mean ELSE s.base END AS base,
                             (r.t_ms - s.t_ms) / 1000::DOUBLE AS dt, s.mean[3] % {TWO_PI} AS wrapped,
                             r.m0 / (1 - tan(r.m1) * {H} / {L}) AS speed
                      FROM _slam s JOIN _in r ON r.vehicle = s.vehicle AND r.nth = s.nth + 1)))))))))))"""


def slam_track_sql(frame: str = "world", predict: str = "full") -> str:
    rounded = ", ".join(_r(c, 3) for c in ("x", "y", "phi"))
    return f"""{_slam(frame, predict)}
        SELECT vehicle, t_ms, seq, step, {rounded}, landmarks
        FROM (SELECT vehicle, unnest(track, recursive := true) FROM _slam)"""


def _slam_map() -> str:
    return f"""{_slam()}
        SELECT vehicle, idx::INTEGER AS idx, {_r('x', 3, 'mean[2 * idx + 2]')}, {_r('y', 3, 'mean[2 * idx + 3]')}
        FROM (SELECT vehicle, mean, unnest(range(1, (len(mean) - 3) // 2 + 1)) AS idx FROM _slam)"""


def oracle_sql() -> dict[str, str]:
    sensor_columns = "vehicle, t_ms, kind, speed, steering, gps_x, gps_y"
    tagged = f"WITH {SENSOR} SELECT seq, {sensor_columns} FROM sensor WHERE kind IN ('odo', 'gps')"
    files = f"WITH {SENSOR} SELECT {sensor_columns} FROM sensor WHERE kind IN ('odo', 'gps')"
    out = {
        "parse_tagged": tagged,
        "parse_rejected": f"""WITH {SENSOR} SELECT 'kind' AS reason,
            kind || CASE WHEN seq % 2 = 0 THEN ',' ELSE ';' END || t_ms || CASE WHEN seq % 2 = 0 THEN ',' ELSE ';' END
            || seq AS line FROM sensor WHERE kind NOT IN ('odo', 'gps')""",
        "parse_scan": f"""WITH {SCANS} SELECT 'data' AS vehicle, t_ms, b.seq, beam::INTEGER AS beam, r AS reading
            FROM beams b JOIN scans s ON s.seq = b.seq""",
        "parse_increments": f"""WITH {SCANS} SELECT 'full' AS vehicle, t_ms + 1 AS t_ms, s.seq, x_inc, y_inc, s.phi_inc,
            count(*)::INTEGER AS n_beams, max(r) AS farthest
            FROM beams b JOIN scans s ON s.seq = b.seq GROUP BY ALL""",
        "text_files": files,
        "text_stream": files,
        "vehicle_files": f"""WITH {SENSOR} SELECT kind AS vehicle, {sensor_columns.replace('vehicle, ', '')}
            FROM sensor WHERE kind IN ('odo', 'gps')""",
        "merge_sensors": f"""WITH {SENSOR} SELECT vehicle,
            CASE WHEN kind = 'odo' THEN t_ms + 20967 ELSE t_ms END AS t_ms, seq, kind, speed, steering, gps_x, gps_y
            FROM sensor WHERE kind IN ('odo', 'gps')""",
        "union_vehicles": tagged,
        "rekeyed_rows": f"""WITH {SENSOR} SELECT 'data' AS vehicle, t_ms, seq, kind, speed, steering, gps_x, gps_y
            FROM sensor WHERE kind = 'odo'""",
        "kind_counts": f"WITH {SENSOR} SELECT vehicle, kind, count(*) AS n_rows FROM sensor GROUP BY vehicle, kind",
        "scalar_functions": f"""WITH {SENSOR}, f AS (
            SELECT *, t_ms / 1000::DOUBLE AS dt, speed / (1 - tan(steering) * {H} / {L}) AS v FROM sensor WHERE kind = 'odo')
            SELECT seq, {_r('centre_speed', 9, 'v')},
            {_r('dx', 8, f"dt * (v * cos(steering) - v / {L} * tan(steering) * ({A} * sin(steering) + {B} * cos(steering)))")},
            {_r('dy', 8, f"dt * (v * sin(steering) + v / {L} * tan(steering) * ({A} * cos(steering) - {B} * sin(steering)))")},
            {_r('dphi', expr=f"dt * v / {L} * tan(steering)")},
            {_r('wrapped', expr=f"(seq * steering) % {TWO_PI}")},
            t_ms + 20967 AS aligned,
            CAST(floor(steering * 50 + 0.5) AS BIGINT) AS half_up,
            {_r('away', expr='sqrt((speed - 3) * (speed - 3) + (steering - 4) * (steering - 4))')},
            {_r('degrees', expr='degrees(steering)')},
            {_r('beam_x', expr=_beam('degrees(steering)', 'speed', 'steering')[0])},
            {_r('beam_y', expr=_beam('degrees(steering)', 'speed', 'steering')[1])},
            {_r('sight_range', expr='sqrt(speed * speed + steering * steering)')},
            {_r('sight_bearing', expr='atan2(steering, speed) - 0.25')} FROM f""",
        "time_steps": f"""WITH {SENSOR} SELECT vehicle, t_ms, seq, kind,
            (t_ms - lag(t_ms, 1, 0) OVER (PARTITION BY vehicle ORDER BY t_ms, seq)) / 1000::DOUBLE AS dt
            FROM sensor WHERE kind IN ('odo', 'gps')""",
        "dead_reckoning": f"""WITH {SENSOR},
            a AS (SELECT *, (t_ms - lag(t_ms, 1, 0) OVER w) / 1000::DOUBLE AS dt,
                         speed / (1 - tan(steering) * {H} / {L}) AS v
                  FROM sensor WHERE kind = 'odo' WINDOW w AS (PARTITION BY vehicle ORDER BY t_ms, seq)),
            b AS (SELECT *, v / {L} * tan(steering) AS rate FROM a),
            c AS (SELECT *, sum(dt * rate) OVER (PARTITION BY vehicle ORDER BY t_ms, seq) AS phi FROM b),
            d AS (SELECT *, coalesce(lag(phi) OVER (PARTITION BY vehicle ORDER BY t_ms, seq), 0) AS h FROM c)
            SELECT vehicle, t_ms, seq,
              {_r('x', expr=f"{START.x}::DOUBLE + sum(dt * (v * cos(h) - rate * ({A} * sin(h) + {B} * cos(h)))) OVER w")},
              {_r('y', expr=f"{START.y}::DOUBLE + sum(dt * (v * sin(h) + rate * ({A} * cos(h) - {B} * sin(h)))) OVER w")},
              {_r('sin_phi', expr='sin(phi)')}, {_r('cos_phi', expr='cos(phi)')}
            FROM d WINDOW w AS (PARTITION BY vehicle ORDER BY t_ms, seq)""",
        "pose_accumulate": f"""WITH {SCANS} SELECT vehicle, t_ms, seq, {_r('x')}, {_r('y')}, {_r('phi')} FROM posed""",
        "discrete_kalman": f"""WITH {SENSOR},
            a AS (SELECT *, t_ms - lag(t_ms, 1, 0) OVER w AS dt, lag(speed, 1, 0) OVER w AS v, row_number() OVER w AS n
                  FROM sensor WHERE kind = 'odo' WINDOW w AS (PARTITION BY vehicle ORDER BY t_ms, seq)),
            b AS (SELECT *, v * dt * tan(steering) / ({L} * 1000) AS phi FROM a),
            c AS (SELECT *, lag(phi, 1, 0) OVER (PARTITION BY vehicle ORDER BY t_ms, seq) AS h FROM b)
            SELECT vehicle, t_ms, seq, {_r('x', 8, 'sum(v * cos(h) * dt / 1000) OVER w')},
              {_r('y', 8, 'sum(v * sin(h) * dt / 1000) OVER w')}, {_r('phi', 8)},
              {_r('gain', 8, '1 / (1 + 10 * (n - 1)) / (1 / (1 + 10 * (n - 1)) + 0.1::DOUBLE)')},
              {_r('variance', 8, '1 / (1 + 10 * n)')}
            FROM c WINDOW w AS (PARTITION BY vehicle ORDER BY t_ms, seq)""",
        "clean_scan": f"WITH {SCANS} SELECT vehicle, seq, beam::INTEGER AS beam, {_r('range', expr='r')} FROM raw_beams",
        "segment_scan": f"""WITH {SCANS}, {_segments('beams', 1.1, 'parts')}
            SELECT vehicle, seq, first::INTEGER AS first, last::INTEGER AS last,
            {_r('width')}, {_r('mean')}, {_r('nearest')}, {_r('diameter')} FROM parts""",
        "extract_objects": f"""WITH {SCANS}, {_segments('beams', 1.1, 'parts')},
            joined AS (SELECT parts.*, posed.phi FROM parts JOIN posed ON posed.seq = parts.seq),
            {_objects('joined', 'phi', 'objects')}
            SELECT vehicle, seq, first::INTEGER AS first, last::INTEGER AS last,
            {_r('phi')}, {_r('x')}, {_r('y')}, {_r('diameter')} FROM objects""",
        "extract_objects_raw": f"""WITH {SCANS}, {_segments('raw_beams', 2.0, 'parts')},
            {_objects('parts', 'phi_inc', 'objects')}
            SELECT vehicle, seq, first::INTEGER AS first, last::INTEGER AS last,
            {_r('x')}, {_r('y')}, {_r('diameter')}, {_r('range')}, {_r('bearing')} FROM objects""",
        "associate_landmarks": f"""WITH {SCANS}, {_segments('raw_beams', 2.0, 'raw_parts')},
            {_segments('beams', 1.1, 'parts')},
            {_objects('raw_parts', '0', 'seen')}, {_objects('parts', '0', 'known')},
            pairs AS (SELECT s.vehicle, (s.seq - {SCAN_SEQ}) * 1000 + s.first AS obs_id, s.x, s.y,
                        (k.seq - {SCAN_SEQ}) * 1000 + k.first AS idx, k.x AS lx, k.y AS ly,
                        sqrt((k.x - s.x) * (k.x - s.x) + (k.y - s.y) * (k.y - s.y)) AS d
                      FROM seen s LEFT JOIN known k ON k.vehicle = s.vehicle),
            found AS (SELECT vehicle, obs_id, x, y, min(CASE WHEN d < 0.4 THEN idx END) AS landmark,
                        arg_min(lx, idx) FILTER (WHERE d < 0.4) AS lx, arg_min(ly, idx) FILTER (WHERE d < 0.4) AS ly,
                        coalesce(bool_or(d > 0.4 AND d < 2.0), false) AS close
                      FROM pairs GROUP BY vehicle, obs_id, x, y)
            SELECT vehicle, obs_id, {_r('x')}, {_r('y')}, landmark, {_r('lx')}, {_r('ly')},
              CASE WHEN landmark IS NOT NULL THEN 'match' WHEN close THEN 'ambiguous' ELSE 'new' END AS status
            FROM found""",
        "ekf_track": f"{_ekf()} SELECT vehicle, t_ms, seq, step, {_POSE}, {_COV} FROM track",
        "ekf_final": f"""{_ekf()} SELECT vehicle, t_ms, {_POSE}, {_COV} FROM track
            QUALIFY n = max(n) OVER (PARTITION BY vehicle)""",
        "ekf_updates_only": _ekf_track(where="step = 'update'"),
        "ekf_predictions_only": _ekf_track(kinds="'odo'"),
        "ekf_observer": _ekf_track("observer"),
        "ekf_difference": _ekf_track("difference"),
        "ekf_gps_only": _ekf_track("gps_only"),
        "ekf_pose_only": _ekf_track("pose_only"),
        "ekf_stream": _ekf_track(),
        "ekf_text_stream": f"{_ekf()} SELECT vehicle, t_ms, step, {_POSE} FROM track",
        "export_points": f"""WITH {SENSOR} SELECT 'speed\\ of\\ car,key=' || vehicle || ' value=' || printf('%.6f', speed)
            || ' ' || t_ms AS value FROM sensor WHERE speed IS NOT NULL""",
        "export_gps_points": f"""WITH {SENSOR} SELECT 'gps,key=' || vehicle || ' latitude=' || printf('%.6f', gps_x)
            || ',longitude=' || printf('%.6f', gps_y) || ' ' || t_ms AS value FROM sensor WHERE gps_x IS NOT NULL""",
        "export_sensor_points": f"""WITH {SENSOR} SELECT 'sensor,key=' || vehicle || ' ' || CASE WHEN kind = 'gps'
            THEN 'latitude=' || printf('%.6f', gps_x) || ',longitude=' || printf('%.6f', gps_y)
            ELSE 'steering=' || printf('%.6f', steering) END || ' ' || t_ms AS value
            FROM sensor WHERE kind IN ('odo', 'gps')""",
        "fix_windows": _windows("true"),
        "window_stream": _windows("true"),
    }
    x, y = _beam("beam * 0.5::DOUBLE", "r", "phi")
    cloud = f"""WITH {SCANS} SELECT {{columns}} FROM (
        SELECT p.vehicle, p.t_ms, p.seq, p.x, p.y, b.beam::INTEGER AS beam, p.x + ({x}) AS lx, p.y + ({y}) AS ly, r
        FROM posed p JOIN beams b ON b.seq = p.seq) WHERE r <> 0 AND r <= {{limit}}"""
    points = f"{_r('lx')}, {_r('ly')}"
    out["landmark_cloud"] = cloud.format(columns=f"vehicle, t_ms, seq, beam, {_r('x')}, {_r('y')}, {points}", limit=45)
    out["track_landmark_files"] = cloud.format(columns=f"t_ms, {_r('x')}, {_r('y')}, {points}", limit=45)
    out["parse_landmarks"] = cloud.format(columns=f"t_ms, seq, {points}", limit=80)
    marked = f"""WITH {SENSOR},
        a AS (SELECT vehicle, t_ms, seq, gps_x, gps_y,
                sqrt(pow(gps_x - lag(gps_x) OVER w, 2) + pow(gps_y - lag(gps_y) OVER w, 2)) > {MAX_JUMP} AS far
              FROM sensor WHERE kind = 'gps' WINDOW w AS (PARTITION BY vehicle ORDER BY t_ms, seq)),
        b AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY t_ms, seq)::BIGINT
                AS "group" FROM a),
        c AS (SELECT *, count(*) OVER (PARTITION BY vehicle, "group") AS group_size FROM b)"""
    out["gps_outliers"] = f"""{marked} SELECT vehicle, t_ms, seq, gps_x, gps_y, "group", group_size,
        group_size < {MIN_GROUP} AS outlier FROM c"""
    out["gps_cleaned"] = f"{marked} SELECT vehicle, t_ms, seq, gps_x, gps_y FROM c WHERE group_size >= {MIN_GROUP}"
    out["step_shift"] = f"""{_ekf()}, s AS (
        SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM track
        WINDOW w AS (PARTITION BY vehicle ORDER BY t_ms, seq))
        SELECT vehicle, step, t_ms, seq, {_r('distance', 4, 'sqrt((x - px) * (x - px) + (y - py) * (y - py))')}
        FROM s WHERE px IS NOT NULL"""
    pairs = f"""{_ekf()}, s AS (
        SELECT *, last_value(CASE WHEN step = 'prediction' THEN n END IGNORE NULLS) OVER (
          PARTITION BY vehicle ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pn FROM track),
        e AS (SELECT u.vehicle, u.t_ms, u.seq, p.t_ms AS pred_t_ms, p.x AS pred_x, p.y AS pred_y, u.x AS upd_x,
                u.y AS upd_y, sqrt((p.x - u.x) * (p.x - u.x) + (p.y - u.y) * (p.y - u.y)) AS error
              FROM s u LEFT JOIN s p ON p.vehicle = u.vehicle AND p.n = u.pn WHERE u.step = 'update')"""
    rounded = ", ".join(_r(c, 4) for c in ("pred_x", "pred_y", "upd_x", "upd_y"))
    out["prediction_error"] = f"""{pairs} SELECT vehicle, t_ms, seq, pred_t_ms, {rounded}, {_r('error', 4)} FROM e"""
    out["evaluation_rows"] = f"{pairs} SELECT vehicle, {rounded}, {_r('distance', 4, 'error')} FROM e"
    out["merged_files"] = f"""WITH {SENSOR} SELECT CASE WHEN kind = 'odo' THEN t_ms + 20967 ELSE t_ms END AS t_ms,
        kind, speed, steering, gps_x, gps_y FROM sensor WHERE kind IN ('odo', 'gps')"""
    out["gps_seconds_files"] = f"WITH {SENSOR} SELECT t_ms, gps_x, gps_y FROM sensor WHERE kind = 'gps'"
    out["odometry_files"] = f"WITH {SENSOR} SELECT t_ms, steering, speed FROM sensor WHERE kind = 'odo'"
    out["ekf_step_xy"] = f"{_ekf()} SELECT step, {_r('x', 4)}, {_r('y', 4)} FROM track"
    out["ekf_time_xy"] = f"{_ekf()} SELECT t_ms, {_r('x', 4)}, {_r('y', 4)} FROM track"
    steps = f"{_ekf()} SELECT vehicle, step, t_ms, {_r('x', 4)}, {_r('y', 4)} FROM track"
    out["track_csv_roundtrip"] = out["track_parquet_roundtrip"] = steps
    # the mapping filter keeps phi unwrapped, which its sine and cosine do not show
    odometry = _ekf(kinds="'odo'", start=(0.0, 0.0))
    out["slam_predictions_only"] = f"{odometry} SELECT vehicle, t_ms, seq, step, {_pose(8)} FROM track"
    out["slam_track"] = out["slam_stream"] = slam_track_sql()
    out["slam_relative"] = slam_track_sql(frame="relative")
    out["slam_map"] = _slam_map()
    out["move_stream"] = out["pose_accumulate"]
    out["objects_stream"] = out["extract_objects"]
    out["discrete_stream"] = out["discrete_kalman"]
    out["track_steps_roundtrip"] = out["track_csv_roundtrip"]
    out["discrete_from_files"] = f"""WITH {SENSOR},
        s AS (SELECT 'full' AS vehicle, seq AS t_ms, speed, steering FROM sensor WHERE kind = 'odo'),
        a AS (SELECT *, t_ms - lag(t_ms, 1, 0) OVER w AS dt, lag(speed, 1, 0) OVER w AS v, row_number() OVER w AS n
              FROM s WINDOW w AS (ORDER BY t_ms)),
        b AS (SELECT *, v * dt * tan(steering) / ({L} * 1000) AS phi FROM a),
        c AS (SELECT *, lag(phi, 1, 0) OVER (ORDER BY t_ms) AS h FROM b)
        SELECT vehicle, t_ms, {_r('x', 6, 'sum(v * cos(h) * dt / 1000) OVER w')},
          {_r('y', 6, 'sum(v * sin(h) * dt / 1000) OVER w')}, {_r('phi', 6)},
          {_r('gain', 6, '1 / (1 + 10 * (n - 1)) / (1 / (1 + 10 * (n - 1)) + 0.1::DOUBLE)')},
          {_r('variance', 6, '1 / (1 + 10 * n)')}
        FROM c WINDOW w AS (ORDER BY t_ms)"""
    return out


def _windows(where: str) -> str:
    order = "t_ms::HUGEINT * 1000000000000 + seq"
    return f"""WITH {SENSOR}, w AS (
        SELECT vehicle, t_ms // 200 * 200 AS window_ms, count(*) AS n_rows,
          arg_max(gps_x, {order}) FILTER (WHERE kind = 'gps') AS gps_x,
          arg_max(gps_y, {order}) FILTER (WHERE kind = 'gps') AS gps_y
        FROM sensor GROUP BY vehicle, t_ms // 200)
        SELECT * FROM w WHERE {where}"""
