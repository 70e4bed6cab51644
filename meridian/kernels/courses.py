"""Courses to start a search from: samples of a path over sea, room to either side, offsets."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from meridian.functions.geo import Box
from meridian.kernels import legs, sphere


@dataclass(frozen=True)
class Bounds:
    """Where a voyage begins, ends and may go; cap: metres of a substep, a share of the box's diagonal."""

    origin: tuple[float, float]
    destination: tuple[float, float]
    box: Box
    fraction: float = 0.01

    @property
    def cap(self) -> float:
        return self.box.diagonal_m() * self.fraction

    def line(self, n: int):
        f = np.arange(n) / (n - 1)
        x = sphere.wrap_lon(self.origin[0] + sphere.lon_delta(self.origin[0], self.destination[0]) * f)
        return x, self.origin[1] + (self.destination[1] - self.origin[1]) * f

    def pin(self, x, y):
        """[path, waypoint] kept in the box, ends in place."""
        x, y = sphere.clamp(self.box, x, y)
        x[..., 0], y[..., 0] = self.origin
        x[..., -1], y[..., -1] = self.destination
        return x, y


#: Metres along a line that two places differ by at least.
CLOSEST = 1e-9


def arc_lengths(line) -> np.ndarray:
    x, y = np.array(line, float).T
    return np.concatenate([[0.0], np.cumsum(sphere.haversine(x[:-1], y[:-1], x[1:], y[1:]))])


def at_arc(line, arcs: np.ndarray, target):
    """Places along a line at lengths."""
    x, y = np.array(line, float).T
    k = np.clip(np.searchsorted(arcs, target, "left") - 1, 0, len(arcs) - 2)
    f = np.clip((target - arcs[k]) / np.maximum(arcs[k + 1] - arcs[k], 1e-12), 0.0, 1.0)
    return x[k] * (1 - f) + x[k + 1] * f, y[k] * (1 - f) + y[k + 1] * f


def evenly(line, n: int, bounds: Bounds):
    """n places evenly along a line, ends in place."""
    if len(line) < 2 or n < 3:
        return bounds.line(n)
    arcs = arc_lengths(line)
    if arcs[-1] <= 0:
        x, y = np.full(n, line[0][0], float), np.full(n, line[0][1], float)
    else:
        x, y = at_arc(line, arcs, np.arange(n) / (n - 1) * arcs[-1])
    return bounds.pin(x, y)


def over_sea(line, n: int, bounds: Bounds, land):
    """n places along a line so that the straight legs between them touch as little land as can be.

    Legs wait in a queue: those over land first, the one with most of it at the head, then the clear ones by length.
    The head is broken in two until there are n places; a leg that cannot be broken to advantage is left as it is.
    A line that cannot be filled so is sampled evenly.
    """
    if len(line) < 2 or n < 3:
        return bounds.line(n)
    arcs = arc_lengths(line)
    if arcs[-1] <= 0:
        return evenly(line, n, bounds)

    def over(a: float, b: float) -> float:
        (x, y), (x2, y2) = spots[a], spots[b]
        return float(legs.land_metres(land, x, y, x2, y2, bounds.cap))

    def spot(s: float) -> float:
        if s not in spots:
            spots[s] = tuple(float(v) for v in at_arc(line, arcs, s))
        return s

    def offer(a: float, b: float, metres: float) -> None:
        heapq.heappush(queue, (metres <= 0, -metres if metres > 0 else a - b, a, b))

    spots, queue, picked = {0.0: tuple(line[0]), float(arcs[-1]): tuple(line[-1])}, [], [0.0, float(arcs[-1])]
    offer(*picked, over(*picked))
    while queue and len(picked) < n:
        clear, rank, a, b = heapq.heappop(queue)
        if b - a <= 2 * CLOSEST:
            continue
        middle = (a + b) / 2
        turns = [] if clear else [float(s) for s in arcs[(arcs - a > CLOSEST) & (b - arcs > CLOSEST)]]
        halves = min(((max(h := (over(a, spot(s)), over(s, b))), s, h) for s in [*turns, middle]), key=lambda x: x[0])
        worst, s, both = halves
        if clear and worst > 0:
            continue
        if not clear and worst >= -rank:  # no turn lessens the land: halve, and try again from nearer
            s, both = middle, (over(a, middle), over(middle, b))
        picked.append(s)
        offer(a, s, both[0])
        offer(s, b, both[1])
    if len(picked) < n:
        return evenly(line, n, bounds)
    x, y = np.array([spots[s] for s in sorted(picked)], float).T
    return bounds.pin(x, y)


def perpendiculars(x, y):
    """(east, north): unit vectors to the left of the course."""
    before, after = np.r_[0, np.arange(len(x) - 1)], np.r_[np.arange(1, len(x)), len(x) - 1]
    e, n = sphere.to_tangent(y, sphere.lon_delta(x[before], x[after]), y[after] - y[before])
    size = np.hypot(e, n)
    some = size > 1e-12
    safe = np.where(some, size, 1.0)
    return np.where(some, -n / safe, 0.0), np.where(some, e / safe, 1.0)


# Distances at which room is probed; least room, and most as a share of the way, in metres.
PROBES = (100_000.0, 300_000.0, 1_000_000.0, 3_000_000.0)
LEAST_ROOM, ROOM_SHARE = 5_000.0, 0.2


def room(land, x: float, y: float, east: float, north: float, most: float) -> float:
    """Metres of open water in a direction, up to ``most``: doubling probes, then six halvings."""
    clear = lambda d: float(land.distance(*sphere.offset(x, y, east * d, north * d))) >= 0
    good = 0.0
    for d in [*(min(p, most) for p in PROBES), most]:
        if not clear(d):
            lo, hi = good, d
            for _ in range(6):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if clear(mid) else (lo, mid)
            return lo
        good = d
    return most


@dataclass
class Course:
    """A starting course: places, vectors across it, and room to either side."""

    x: np.ndarray
    y: np.ndarray
    east: np.ndarray
    north: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def straight(cls, n: int, bounds: Bounds) -> "Course":
        x, y = bounds.line(n)
        way = float(sphere.haversine(*bounds.origin, *bounds.destination))
        return cls(x, y, *perpendiculars(x, y), *(np.full(n, max(way * ROOM_SHARE, 2 * LEAST_ROOM)) for _ in range(2)))

    @classmethod
    def along(cls, line, n: int, bounds: Bounds, land) -> "Course":
        x, y = over_sea(line, n, bounds, land)
        east, north = perpendiculars(x, y)
        way = max(float(sphere.haversine(x[0], y[0], x[-1], y[-1])), 4 * LEAST_ROOM)
        most = max(way * ROOM_SHARE, 2 * LEAST_ROOM)
        side = lambda s: np.array([max(room(land, a, b, s * e, s * n_, most), LEAST_ROOM) for a, b, e, n_ in zip(x, y, east, north, strict=True)])
        return cls(x, y, east, north, side(1), side(-1))

    def shifted(self, share: np.ndarray, bounds: Bounds):
        """The course moved across by shares of its room; the ends stay."""
        amount = share * np.where(share >= 0, self.left, self.right)
        return bounds.pin(*sphere.offset(self.x, self.y, self.east * amount, self.north * amount))


def waves(k: int, index: int, count: int, n: int) -> np.ndarray:
    middle = (count - 1) / 2
    size = (index - middle) / middle / k if count > 1 else 0.0
    return np.where((np.arange(n) > 0) & (np.arange(n) < n - 1), np.sin(k * np.pi * np.arange(n) / n) * size, 0.0)


def bend(n: int, rng: np.random.Generator) -> np.ndarray:
    at, size = rng.uniform(0.2, 0.8), rng.uniform(-1.0, 1.0)
    return size * np.maximum(0.0, 1 - np.abs(np.arange(n) / n - at) / max(at, 1 - at))


def noise(n: int, rng: np.random.Generator) -> np.ndarray:
    return rng.normal(0.0, 0.2, n)


def off_land(land, x, y, buffer: float = 50_000.0, most: float = 100_000.0, rounds: int = 8):
    """Places pushed along the slope of the distance until they are a buffer off the coast."""
    x, y = np.array(x, float), np.array(y, float)
    for _ in range(rounds):
        d = land.distance(x, y)
        near = d < buffer
        if not near.any():
            break
        e, n = land.slope(x, y)
        size = np.hypot(e, n)
        flat = near & (size <= 1e-6)
        if flat.any():  # look around instead
            grow, pick = np.zeros(x.shape), np.zeros((2, *x.shape))
            for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                more = land.distance(*sphere.offset(x, y, a * buffer, b * buffer)) - d
                better = more > grow
                grow, pick[0], pick[1] = np.where(better, more, grow), np.where(better, a, pick[0]), np.where(better, b, pick[1])
            e, n, size = np.where(flat, pick[0], e), np.where(flat, pick[1], n), np.where(flat, 1.0, size)
        step = np.where(near, np.clip(buffer - d, 0.0, most), 0.0) / np.maximum(size, 1e-12)
        x, y = sphere.offset(x, y, e * step, n * step)
    return x, y
