"""Travel times and loads of many legs at once, and tables that stand in for them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from meridian.functions.ship import Ship
from meridian.kernels import sphere


def _speed(ship: Ship, sin, cos, u, v, load):
    """Speed on a bearing (its sine and cosine) in a wind with the motor at a load."""
    wind = np.hypot(u, v)
    across = np.abs(sin * v - cos * u) / np.where(wind == 0, 1.0, wind)
    if ship.polar_power != 1:
        across = across**ship.polar_power
    sail = ship.polar_c * (1 + across) / 2 * wind
    return np.cbrt(sail * sail * sail + load * (ship.mcr_w / (0.5 * ship.drag)))


class Lines:
    """Substeps of legs (arrays): places, middles and bearings, which no load or departure changes."""

    def __init__(self, x1, y1, x2, y2, cap: float):
        x, y, x2, y2 = (a.astype(float) for a in np.broadcast_arrays(x1, y1, x2, y2))
        with np.errstate(all="ignore"):
            self.total = sphere.haversine(x, y, x2, y2)
            known = np.isfinite(self.total)
            self.steps = np.where(known, np.maximum(np.ceil(self.total / cap), 1), 0).astype(int)
            self.step = self.total / np.maximum(self.steps, 1)
            self.lost = np.array(~known)
            self.parts = []
            for k in range(int(self.steps.max(initial=0))):
                on = (k < self.steps) & (self.total > 0)
                angle = sphere.bearing(x, y, x2, y2)
                mx, my = sphere.destination(x, y, self.step / 2, angle)
                nx, ny = sphere.destination(x, y, self.step, angle)
                self.lost |= on & ~np.isfinite(nx)
                self.parts.append((on, x, y, np.sin(angle), np.cos(angle), mx, my))
                x, y = np.where(on, nx, x), np.where(on, ny, y)

    def seconds(self, ship: Ship, wind, start, load):
        """Travel times by the midpoint rule for departures and loads of any shape that fits the legs'."""
        start, load = np.asarray(start, float), np.asarray(load, float)
        shape = np.broadcast_shapes(self.total.shape, start.shape, load.shape)
        t, bad = np.broadcast_to(start, shape).copy(), np.broadcast_to(self.lost, shape).copy()
        with np.errstate(all="ignore"):
            for on, x, y, sin, cos, mx, my in self.parts:
                first = _speed(ship, sin, cos, *wind.sample(x, y, t), load)
                second = _speed(ship, sin, cos, *wind.sample(mx, my, t + 0.5 * self.step / first), load)
                bad |= on & ~((first > 0) & (second > 0))
                t = np.where(on, t + self.step / second, t)
            took = np.where(self.total <= 0, 0.0, t - start)
            return np.where(bad | np.isnan(took), np.inf, took)

    def slowest(self, ship: Ship, wind, start):
        """(load, seconds) without motor, or at a tenth of its power where the wind alone does not do."""
        idle = self.seconds(ship, wind, start, 0.0)
        stuck = np.isinf(idle)
        if not stuck.any():
            return np.zeros(idle.shape), idle
        return np.where(stuck, 0.1, 0.0), np.where(stuck, self.seconds(ship, wind, start, 0.1), idle)


def travel_time(ship: Ship, wind, x1, y1, x2, y2, start, load, cap: float):
    """Seconds of legs in substeps of at most cap metres; infinite where the ship cannot go on."""
    return Lines(x1, y1, x2, y2, cap).seconds(ship, wind, start, load)


def slowest(ship: Ship, wind, x1, y1, x2, y2, start, cap: float):
    return Lines(x1, y1, x2, y2, cap).slowest(ship, wind, start)


def time_range(ship: Ship, wind, x1, y1, x2, y2, start, cap: float):
    """(least, most) seconds of legs."""
    lines = Lines(x1, y1, x2, y2, cap)
    fast, (_, slow) = lines.seconds(ship, wind, start, 1.0), lines.slowest(ship, wind, start)
    return np.minimum(fast, slow), np.maximum(fast, slow)


def solve_load(ship: Ship, wind, x1, y1, x2, y2, start, seconds, cap: float, halvings: int = 12):
    """The constant load at which each leg takes its seconds, or the nearest possible."""
    lines = Lines(x1, y1, x2, y2, cap)
    fast = lines.seconds(ship, wind, start, 1.0)
    least, slow = lines.slowest(ship, wind, start)
    lo, hi = least.copy(), np.ones(least.shape)
    for _ in range(halvings):
        mid = (lo + hi) / 2
        late = lines.seconds(ship, wind, start, mid) > seconds
        lo, hi = np.where(late, mid, lo), np.where(late, hi, mid)
    found = np.where(seconds <= fast, 1.0, np.where(seconds >= slow, least, (lo + hi) / 2))
    return np.where(lines.total <= 0, 0.0, found)


def fuel_used(ship: Ship, load, seconds):
    a, b, c = ship.fuel
    burnt = load * (a + b * load + c * load * load) * seconds
    return np.where((seconds <= 0) | (load <= 0) | (ship.mcr_w <= 0), 0.0, burnt)


def land_metres(land, x1, y1, x2, y2, cap: float):
    """Metres of legs over land, judged at the middle of each substep."""
    x1, y1, x2, y2 = np.broadcast_arrays(*(np.asarray(a, float) for a in (x1, y1, x2, y2)))
    with np.errstate(all="ignore"):
        total = sphere.haversine(x1, y1, x2, y2)
        steps = np.where(np.isfinite(total), np.maximum(np.ceil(total / cap), 1), 0).astype(int)
        step = total / np.maximum(steps, 1)
        x, y, out = x1.copy(), y1.copy(), np.zeros(x1.shape)
        for k in range(int(steps.max(initial=0))):
            on = (k < steps) & (total > 0) & np.isfinite(out)
            if not on.any():
                break
            angle = sphere.bearing(x[on], y[on], x2[on], y2[on])
            mx, my = sphere.destination(x[on], y[on], step[on] / 2, angle)
            over = np.where(np.isfinite(mx), np.where(land.distance(np.nan_to_num(mx), np.nan_to_num(my)) < 0, step[on], 0.0), np.inf)
            out[on] += over
            x[on], y[on] = sphere.destination(x[on], y[on], step[on], angle)
        return out


@dataclass
class Tables:
    """Travel times of every segment of many paths by departure and load, in place of integrating.

    times[path, segment, departure, load]; departures lie evenly between first and last of a segment, loads
    between its least and 1.
    """

    first: np.ndarray
    last: np.ndarray
    least: np.ndarray
    times: np.ndarray

    @classmethod
    def build(cls, ship: Ship, wind, x, y, cap: float, departure: float = 0.0, buckets: int = 8, loads: int = 8, pad: float = 0.15) -> "Tables":
        """x, y: [path, waypoint]. Each segment's departures follow from the range of the one before, padded."""
        if buckets < 2 or loads < 2:
            raise ValueError("tables need two departures and two loads at least")
        paths, n = x.shape
        first, last, least = (np.zeros((paths, n - 1)) for _ in range(3))
        times = np.zeros((paths, n - 1, buckets, loads))
        lo = hi = np.full(paths, float(departure))
        part = np.arange(loads) / (loads - 1)
        for s in range(n - 1):
            span = np.nan_to_num(np.maximum(hi - lo, 0.0), posinf=0.0, nan=0.0)
            a, b = np.where(np.isfinite(lo), lo, departure) - pad * span, np.where(np.isfinite(hi), hi, departure) + pad * span
            leave = a[:, None] + (b - a)[:, None] * (np.arange(buckets) / (buckets - 1))
            lines = Lines(*(c[:, None, None] for c in (x[:, s], y[:, s], x[:, s + 1], y[:, s + 1])), cap)
            took = lines.seconds(ship, wind, leave[:, :, None], part)
            weak = np.where(np.isinf(took[:, :, 0]).any(axis=1), 0.1, 0.0)  # one load range for all departures
            if weak.any():
                took = lines.seconds(ship, wind, leave[:, :, None], weak[:, None, None] + part * (1 - weak[:, None, None]))
            first[:, s], last[:, s], least[:, s], times[:, s] = a, b, weak, took
            lo, hi = a + took[:, :, -1].min(axis=1), b + took[:, :, 0].max(axis=1)
        return cls(first, last, least, times)

    def _rows(self, s: int, leave):
        """Times [load, path, ...] of segment s at departures [path, ...], straight between the tabled ones."""
        buckets = self.times.shape[2]
        shape = (-1,) + (1,) * (leave.ndim - 1)
        a, b = self.first[:, s].reshape(shape), self.last[:, s].reshape(shape)
        scale = np.where(b > a, (buckets - 1) / np.where(b > a, b - a, 1.0), 0.0)
        at = np.clip(np.nan_to_num((leave - a) * scale), 0, buckets - 1)
        k = np.minimum(at.astype(np.intp), buckets - 2)
        f = at - k
        table = np.ascontiguousarray(self.times[:, s].reshape(-1, self.times.shape[3]).T)
        where = k + np.arange(len(self.first)).reshape(shape) * buckets
        low, high = table.take(where, axis=1), table.take(where + 1, axis=1)
        if np.isfinite(self.times[:, s]).all():
            return low + (high - low) * f
        return np.where(f == 0, low, low * (1 - f) + high * f)

    def _range(self, rows):
        low, high = rows.min(axis=0), rows.max(axis=0)
        odd = np.isnan(low) | np.isnan(high)
        return (np.where(odd, np.inf, low), np.where(odd, np.inf, high)) if odd.any() else (low, high)

    def range(self, s: int, leave):
        """(least, most) seconds of segment s."""
        with np.errstate(all="ignore"):
            return self._range(self._rows(s, leave))

    def _load(self, s: int, rows, seconds):
        n = len(rows)
        least = self.least[:, s].reshape((-1,) + (1,) * (seconds.ndim - 1))
        quick = rows[1:] <= seconds
        k = np.where(quick[-1] | quick.any(axis=0), quick.argmax(axis=0), n - 2)
        slow, fast = (np.take_along_axis(rows, i[None], 0)[0] for i in (k, k + 1))
        f = np.where(slow - fast > 0, (slow - seconds) / (slow - fast), 0.0)
        mixed = least + (k + f) / (n - 1) * (1 - least)
        return np.where(seconds >= rows[0], least, np.where(seconds <= rows[-1], 1.0, mixed))

    def load(self, s: int, leave, seconds):
        """The load at which segment s takes its seconds, straight between the tabled loads."""
        with np.errstate(all="ignore"):
            return self._load(s, self._rows(s, leave), seconds)

    def settle(self, s: int, leave, seconds):
        """(seconds kept in what segment s can take, the load for them)."""
        rows = self._rows(s, leave)
        low, high = self._range(rows)
        kept = np.minimum(np.maximum(seconds, low), high)
        return kept, self._load(s, rows, kept)
