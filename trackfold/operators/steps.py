"""One step of each sequential filter, as plain arithmetic.

Batch and streaming wrappers call the same functions. The functions of the GPS filter take
the module ``m`` to use. The wrappers give ``NUMBERS`` for one vehicle and for many at once, so a
vehicle's numbers do not hang on the company it is computed in, nor on the machine.
"""

from __future__ import annotations

import math

import numpy as np

from trackfold.schema import EkfConfig, SlamConfig, Vehicle

# state of the GPS filter: pose, upper triangle of the covariance, time of the last row
EKF_FIELDS = ("x", "y", "phi", "p_xx", "p_xy", "p_xphi", "p_yy", "p_yphi", "p_phiphi", "t_ms")
TWO_PI = 2.0 * math.pi


def _each(f):
    """A function of the C library for numbers and arrays; NaN where it has no value."""
    def safe(*values):
        try:
            return f(*values)
        except ValueError:
            return math.nan

    def run(*values):
        if not any(isinstance(v, np.ndarray) for v in values):
            return np.float64(safe(*values))
        arrays = np.broadcast_arrays(*values)
        return np.fromiter(map(safe, *(a.tolist() for a in arrays)), float, arrays[0].size)

    return staticmethod(run)


class NUMBERS:
    """numpy, but with the C library's angles.

    numpy's own differ in the last bit from one kind of processor to another, and filters that no
    fix holds back make much of it.
    """

    fmod, sqrt = np.fmod, np.sqrt
    sin, cos, tan, atan2 = _each(math.sin), _each(math.cos), _each(math.tan), _each(math.atan2)


def ekf_start(config: EkfConfig) -> tuple:
    s = config.start
    return (s.x, s.y, s.phi, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, float(s.t_ms))


def motion(m, phi, dt, speed, steering, car: Vehicle):
    """(dx, dy, dphi) of one odometry row for a car heading ``phi``."""
    slope = m.tan(steering)
    v = speed / (1.0 - slope * car.wheel_offset / car.wheelbase)
    rate = v / car.wheelbase * slope
    forward = dt * (v - rate * car.sensor_left)
    left = dt * rate * car.sensor_ahead
    c, s = m.cos(phi), m.sin(phi)
    return c * forward - s * left, s * forward + c * left, dt * rate


def ekf_predict(m, state, t_ms, speed, steering, config: EkfConfig):
    x, y, phi, pxx, pxy, pxh, pyy, pyh, phh, before = state
    phi = m.fmod(phi, TWO_PI)
    dx, dy, dphi = motion(m, phi, (t_ms - before) / 1000.0, speed, steering, config.vehicle)
    # the motion's slope in phi is (-dy, dx); covariance is G P G' + noise
    r = config.motion_noise
    return (
        x + dx,
        y + dy,
        phi + dphi,
        pxx - 2.0 * dy * pxh + dy * dy * phh + r,
        pxy + dx * pxh - dy * pyh - dx * dy * phh,
        pxh - dy * phh,
        pyy + 2.0 * dx * pyh + dx * dx * phh + r,
        pyh + dx * phh,
        phh + r,
        t_ms,
    )


def ekf_innovation(m, x, y, gps_x, gps_y, kind: str):
    if kind == "position":
        return gps_x - x, gps_y - y
    if kind == "observer":
        return (
            m.sqrt(gps_x * gps_x + gps_y * gps_y) - m.sqrt(x * x + y * y),
            m.atan2(gps_y, gps_x) - m.atan2(y, x),
        )
    if kind == "difference":
        ex, ey = gps_x - x, gps_y - y
        return m.sqrt(ex * ex + ey * ey), m.atan2(ey, ex)
    if kind == "gps_only":
        return m.sqrt(gps_x * gps_x + gps_y * gps_y), m.atan2(gps_y, gps_x)
    if kind == "pose_only":
        return m.sqrt(x * x + y * y), m.atan2(y, x)
    raise ValueError(f"unknown innovation: {kind}")


def ekf_update(m, state, t_ms, gps_x, gps_y, config: EkfConfig):
    x, y, phi, pxx, pxy, pxh, pyy, pyh, phh, _ = state
    u, v = ekf_innovation(m, x, y, gps_x, gps_y, config.innovation)
    sxx, syy = pxx + config.gps_noise_x, pyy + config.gps_noise_y
    det = sxx * syy - pxy * pxy
    kx0, kx1 = (pxx * syy - pxy * pxy) / det, (pxy * sxx - pxx * pxy) / det
    ky0, ky1 = (pxy * syy - pyy * pxy) / det, (pyy * sxx - pxy * pxy) / det
    kh0, kh1 = (pxh * syy - pyh * pxy) / det, (pyh * sxx - pxh * pxy) / det
    return (
        x + kx0 * u + kx1 * v,
        y + ky0 * u + ky1 * v,
        phi + kh0 * u + kh1 * v,
        pxx - (pxx * kx0 + pxy * kx1),
        pxy - (pxx * ky0 + pxy * ky1),
        pxh - (pxx * kh0 + pxy * kh1),
        pyy - (pxy * ky0 + pyy * ky1),
        pyh - (pxy * kh0 + pyy * kh1),
        phh - (pxh * kh0 + pyh * kh1),
        t_ms,
    )


# --- simple trackers, used by the streaming jobs; their batch forms are windows ---


def move(state, x_inc, y_inc, phi_inc):
    x, y, phi = state
    c, s = math.cos(phi + phi_inc / 2), math.sin(phi + phi_inc / 2)
    return (x + c * x_inc - s * y_inc, y + s * x_inc + c * y_inc, phi + phi_inc)


def discrete_kalman(state, t_ms, speed, steering, wheelbase: float, noise: float):
    """State: x, y, phi, variance, last time, last speed. Returns (state, gain)."""
    x, y, phi, variance, before, last_speed = state
    reach = last_speed * (t_ms - before)
    gain = variance / (variance + noise)
    after = (
        x + math.cos(phi) * reach / 1000.0,
        y + math.sin(phi) * reach / 1000.0,
        reach * math.tan(steering) / (wheelbase * 1000.0),
        (1.0 - gain) * variance,
        t_ms,
        speed,
    )
    return after, gain


# --- mapping filter: mean (3 + 2N), covariance, time of the last row ---


class SlamState:
    """Mean and covariance with room to grow, so a new landmark seldom copies the matrix."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, t_ms: float):
        self.size = len(mean)
        self._mean, self._cov = mean, cov
        self.t_ms = t_ms

    @classmethod
    def first(cls, config: SlamConfig) -> "SlamState":
        s = config.start
        return cls(np.array([s.x, s.y, s.phi], dtype=float), np.zeros((3, 3)), float(s.t_ms))

    @property
    def mean(self) -> np.ndarray:
        return self._mean[: self.size]

    @property
    def cov(self) -> np.ndarray:
        return self._cov[: self.size, : self.size]

    def grow(self, x: float, y: float, variance: float) -> int:
        """Append a landmark and return its position in the mean."""
        at, self.size = self.size, self.size + 2
        if self.size > len(self._mean):
            room = max(2 * at, 64)
            mean, cov = np.zeros(room), np.zeros((room, room))
            mean[:at], cov[:at, :at] = self._mean[:at], self._cov[:at, :at]
            self._mean, self._cov = mean, cov
        self._mean[at: at + 2] = x, y
        self._cov[at, at] = self._cov[at + 1, at + 1] = variance
        return at

    def pack(self) -> np.ndarray:
        """Time, size, mean and the upper triangle as one vector."""
        upper = self.cov[np.triu_indices(self.size)]
        return np.concatenate(([self.t_ms, float(self.size)], self.mean, upper))

    @classmethod
    def unpack(cls, packed: np.ndarray) -> "SlamState":
        size = int(packed[1])
        cov = np.zeros((size, size))
        rows, cols = np.triu_indices(size)
        cov[rows, cols] = cov[cols, rows] = packed[2 + size:]
        return cls(np.array(packed[2: 2 + size]), cov, float(packed[0]))


def slam_predict(state: SlamState, t_ms: float, speed: float, steering: float, config: SlamConfig) -> None:
    """Move the car. Only its rows and columns of the covariance change."""
    mean, cov = state.mean, state.cov
    x, y, phi = mean[:3].tolist()
    dx, dy, dphi = motion(
        math, math.fmod(phi, TWO_PI), (t_ms - state.t_ms) / 1000.0, speed, steering, config.vehicle
    )
    mean[:3] = x + dx, y + dy, phi + dphi
    (pxx, pxy, pxh), (_, pyy, pyh), (_, _, phh) = cov[:3, :3].tolist()
    r = config.motion_noise
    pxx += -2.0 * dy * pxh + dy * dy * phh + r
    pxy += dx * pxh - dy * pyh - dx * dy * phh
    pyy += 2.0 * dx * pyh + dx * dx * phh + r
    pxh -= dy * phh
    pyh += dx * phh
    cov[:3, :3] = (pxx, pxy, pxh), (pxy, pyy, pyh), (pxh, pyh, phh + r)
    if config.predict == "full" and state.size > 3:
        # (-dy, dx) is the slope of the motion in phi
        turned = cov[2, 3:]
        cov[0, 3:] -= dy * turned
        cov[1, 3:] += dx * turned
        cov[3:, :2] = cov[:2, 3:].T
    state.t_ms = t_ms


def match_landmarks(xs, ys, marks_x, marks_y, match_below: float, ambiguous_below: float) -> np.ndarray:
    """Index of the first landmark near enough, -10 for ambiguous, -2 for new."""
    out = np.full(len(xs), -2, dtype=np.int64)
    if not len(marks_x):
        return out
    # one row of distances per object of this scan, against this vehicle's map
    away = np.sqrt((marks_x[None, :] - xs[:, None]) ** 2 + (marks_y[None, :] - ys[:, None]) ** 2)
    out[((away > match_below) & (away < ambiguous_below)).any(axis=1)] = -10
    near = away < match_below
    hit = near.any(axis=1)
    out[hit] = near[hit].argmax(axis=1)
    return out


def slam_update(state: SlamState, t_ms: float, reach, degrees, config: SlamConfig) -> None:
    """Correct car and map by the objects of one scan, given by distance and angle."""
    relative = config.frame == "relative"
    mean = state.mean
    phi = mean[2]
    angle = np.radians(degrees) - math.radians(90.0) + phi
    xs = reach * np.cos(angle) + config.vehicle.sensor_ahead
    ys = reach * np.sin(angle) + config.vehicle.sensor_left
    ranges, bearings = np.sqrt(xs * xs + ys * ys), np.arctan2(ys, xs) - phi
    shift = (0.0, 0.0) if relative else (mean[0], mean[1])
    marks = mean[3:].copy()
    hits = match_landmarks(
        xs + shift[0], ys + shift[1], marks[0::2], marks[1::2], config.match_below, config.ambiguous_below
    )
    for k, hit in enumerate(hits):
        if hit == -10:
            continue
        car = state.mean[:2].copy()
        if hit == -2:
            # relative frame: the landmark is kept as seen from the car
            at = state.grow(*((xs[k], ys[k]) if relative else (xs[k] + car[0], ys[k] + car[1])),
                            config.new_landmark_variance)
            dx, dy = xs[k], ys[k]
        else:
            at = 3 + 2 * int(hit)
            if relative:
                dx, dy = marks[2 * hit], marks[2 * hit + 1]
            else:
                dx, dy = state.mean[at: at + 2] - car
        _correct(state, at, dx, dy, ranges[k], bearings[k], config)
    state.t_ms = t_ms


def _correct(state: SlamState, at: int, dx, dy, seen_range, seen_bearing, config: SlamConfig) -> None:
    mean, cov = state.mean, state.cov
    q = dx * dx + dy * dy
    r = math.sqrt(q)
    h = np.array([
        [-dx / r, -dy / r, 0.0, dx / r, dy / r],
        [dy / q, -dx / q, -1.0, -dy / q, dx / q],
    ])
    five = [0, 1, 2, at, at + 1]
    wide = cov[:, five] @ h.T
    (sa, sb), (_, sc) = (h @ wide[five]).tolist()
    sa, sc = sa + config.sight_noise, sc + config.sight_noise
    turn = seen_bearing - (math.atan2(dy, dx) - mean[2])
    if config.frame != "relative":
        turn = math.remainder(turn, TWO_PI)
    det = sa * sc - sb * sb
    if sa > 0.0 and det > 0.0:
        # S = L L', so wide S^-1 wide' is the square of wide L'^-1: symmetric also after rounding
        la = math.sqrt(sa)
        lb = sb / la
        lc = math.sqrt(det) / la
        root = np.empty_like(wide)
        root[:, 0] = wide[:, 0] / la
        root[:, 1] = (wide[:, 1] - lb * root[:, 0]) / lc
        u = (seen_range - r) / la
        mean += root @ np.array([u, (turn - lb * u) / lc])
        cov -= root @ root.T
    else:
        # the fast prediction can leave a covariance that is none, and S with it
        gain = wide @ (np.array([[sc, -sb], [-sb, sa]]) / det)
        mean += gain @ np.array([seen_range - r, turn])
        change = gain @ wide.T
        cov -= 0.5 * (change + change.T)
