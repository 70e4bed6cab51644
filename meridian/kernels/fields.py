"""Winds and land as arrays or formulas.

A wind has sample(lon, lat, t) -> (u, v) on arrays; land has distance(lon, lat), metres to
the coast and negative inside, and slope(lon, lat), the (east, north) in which it grows.
"""

from __future__ import annotations

import heapq
from collections import deque
from dataclasses import dataclass

import numpy as np

from meridian.functions.geo import METRES_PER_DEGREE, Box
from meridian.kernels import sphere


class FormulaWind:
    """A wind from a function of (lon, lat, t)."""

    def __init__(self, formula):
        self.sample = formula


@dataclass
class GridWind:
    """uv[iy, ix, frame, 2] in metres a second on a lattice; the nearest cell, straight between looped frames."""

    uv: np.ndarray
    lon: float
    lat: float
    step: float
    step_s: float
    crossfade_s: float | None = None

    def sample(self, lon, lat, t):
        ny, nx, nt, _ = self.uv.shape
        far = lambda x: np.maximum(np.maximum(self.lon - x, x - (self.lon + (nx - 1) * self.step)), 0.0)
        lon = np.asarray(lon, float)
        for turn in (360.0, -360.0):
            lon = np.where(far(lon + turn) < far(lon), lon + turn, lon)
        near = lambda x, n: np.clip(np.floor(np.nan_to_num(x) + 0.5), 0, n - 1).astype(int)
        ix, iy = near((lon - self.lon) / self.step, nx), near((np.asarray(lat, float) - self.lat) / self.step, ny)
        lo, hi, a = looped(np.asarray(t, float), nt, self.step_s, self.crossfade_s)
        pick = lambda c: self.uv[iy, ix, lo, c] * (1 - a) + self.uv[iy, ix, hi, c] * a
        return pick(0), pick(1)


def looped(t, frames: int, step: float, crossfade: float | None = None):
    """(lo, hi, alpha) as winds.bracket()."""
    if frames <= 1:
        z = np.zeros(np.shape(t), int)
        return z, z, np.zeros(np.shape(t))
    fade, span = 5 * step if crossfade is None else crossfade, (frames - 1) * step
    w = np.mod(np.nan_to_num(t), span + fade if fade > 0 else span)
    lo = np.minimum(np.floor(w / step), frames - 2).astype(int)
    data = w < span
    return np.where(data, lo, frames - 1), np.where(data, lo + 1, 0), np.where(data, w / step - lo, (w - span) / (fade or 1.0))


class NoLand:
    def distance(self, lon, lat):
        return np.full(np.shape(lon), np.inf)

    def slope(self, lon, lat):
        return np.zeros(np.shape(lon)), np.zeros(np.shape(lon))

    def sea_path(self, origin, destination, box, bias=None):
        return None


class BoxLand:
    """A box of land, its distance measured in degrees of 111 km."""

    def __init__(self, lon_min: float, lon_max: float, lat_min: float, lat_max: float):
        self.box = (lon_min, lon_max, lat_min, lat_max)

    def distance(self, lon, lat):
        w, e, s, n = self.box
        dx, dy = np.maximum(w - lon, lon - e), np.maximum(s - lat, lat - n)
        outside = np.hypot(np.maximum(dx, 0), np.maximum(dy, 0))
        return np.where((dx > 0) | (dy > 0), outside, np.maximum(dx, dy)) * 111_000.0

    def slope(self, lon, lat):
        h = 1e-3
        x = self.distance(lon + h, lat) - self.distance(lon - h, lat)
        y = self.distance(lon, lat + h) - self.distance(lon, lat - h)
        size = np.hypot(x, y)
        return np.where(size > 0, x / np.maximum(size, 1e-12), 0.0), np.where(size > 0, y / np.maximum(size, 1e-12), 0.0)

    def sea_path(self, origin, destination, box, bias=None):
        return None


class GridLand:
    """A land mask mask[j, i] on square cells, with distances, slopes and paths over sea."""

    def __init__(self, mask: np.ndarray, cell: float):
        self.mask, self.cell = mask, cell
        ny, nx = mask.shape
        metres = cell * METRES_PER_DEGREE
        self.sdf = np.where(mask, -np.sqrt(nearest(~mask)), np.sqrt(nearest(mask))) * metres
        flat = np.nan_to_num(self.sdf, posinf=1e12, neginf=-1e12)
        cos = np.maximum(np.cos(np.radians((np.arange(ny) + 0.5) * cell - 90)), 1e-9)[:, None]
        dx = (np.roll(flat, -1, 1) - np.roll(flat, 1, 1)) / (2 * metres * cos)
        padded = np.concatenate([flat[:1], flat, flat[-1:]])
        dy = (padded[2:] - padded[:-2]) / (2 * metres)
        size = np.hypot(dx, dy)
        self.east, self.north = (np.where(size > 1e-12, d / np.maximum(size, 1e-12), 0.0) for d in (dx, dy))

    def _bilinear(self, grid, lon, lat):
        ny, nx = grid.shape
        x = np.mod(np.asarray(lon, float) + 180, 360.0) / self.cell - 0.5
        y = np.clip((np.asarray(lat, float) + 90) / self.cell - 0.5, 0, ny - 1)
        x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
        a, b = x - x0, y - y0
        i0, i1, j1 = x0 % nx, (x0 + 1) % nx, np.minimum(y0 + 1, ny - 1)
        return (grid[y0, i0] * (1 - a) + grid[y0, i1] * a) * (1 - b) + (grid[j1, i0] * (1 - a) + grid[j1, i1] * a) * b

    def distance(self, lon, lat):
        return self._bilinear(self.sdf, lon, lat)

    def slope(self, lon, lat):
        return self._bilinear(self.east, lon, lat), self._bilinear(self.north, lon, lat)

    def centre(self, i, j):
        return (i + 0.5) * self.cell - 180, (j + 0.5) * self.cell - 90

    def _around(self, i: int, j: int):
        ny, nx = self.mask.shape
        for dj in (-1, 0, 1):
            for di in (-1, 0, 1):
                if (di or dj) and 0 <= j + dj < ny:
                    yield (i + di) % nx, j + dj

    def snapped(self, lon: float, lat: float, rings: int = 32) -> tuple[int, int] | None:
        """The nearest sea cell by breadth, at most so many rings away."""
        ny, nx = self.mask.shape
        start = int(np.floor(np.mod(lon + 180, 360.0) / self.cell)) % nx, int(np.clip(np.floor((lat + 90) / self.cell), 0, ny - 1))
        seen, queue = {start}, deque([(start, 0)])
        while queue:
            (i, j), ring = queue.popleft()
            if not self.mask[j, i]:
                return i, j
            if ring < rings:
                for c in self._around(i, j):
                    if c not in seen:
                        seen.add(c)
                        queue.append((c, ring + 1))
        return None

    def sea_path(self, origin, destination, box: Box, bias: str | None = None, slack: float = 0.5, most: int = 1_000_000):
        """[(lon, lat)] over sea cells of a box by A*, both ends as given; None if there is none.

        bias "north" or "south" keeps the path on that side of the straight line, up to ``slack`` degrees.
        """
        start, goal = self.snapped(*origin), self.snapped(*destination)
        if start is None or goal is None:
            return None
        if start == goal:
            return [tuple(origin), tuple(destination)]
        span = float(sphere.lon_delta(origin[0], destination[0]))

        def allowed(c) -> bool:
            if c in (start, goal):
                return True
            lon, lat = self.centre(*c)
            inside = (lon >= box.lon_min or lon <= box.lon_max) if box.wraps else box.lon_min <= lon <= box.lon_max
            if self.mask[c[1], c[0]] or not inside or not box.lat_min <= lat <= box.lat_max:
                return False
            if bias is None:
                return True
            f = 0.5 if abs(span) < 1e-12 else min(1.0, max(0.0, float(sphere.lon_delta(origin[0], lon)) / span))
            above = lat - (origin[1] + (destination[1] - origin[1]) * f)
            return above >= -slack if bias == "north" else above <= slack

        aim = self.centre(*goal)
        cost, came, closed = {start: 0.0}, {}, set()
        queue = [(float(sphere.haversine(*self.centre(*start), *aim)), start)]
        while queue:
            _, here = heapq.heappop(queue)
            if here in closed:
                continue
            closed.add(here)
            if here == goal:
                cells = [here]
                while cells[-1] in came:
                    cells.append(came[cells[-1]])
                inner = [self.centre(*c) for c in cells[::-1][1:-1]]
                return [tuple(origin), *inner, tuple(destination)]
            if len(closed) > most:
                return None
            at = self.centre(*here)
            near = [c for c in self._around(*here) if c not in closed and allowed(c)]
            if not near:
                continue
            x, y = np.array([self.centre(*c) for c in near]).T
            step, ahead = sphere.haversine(at[0], at[1], x, y), sphere.haversine(x, y, *aim)
            for c, s, h in zip(near, step.tolist(), ahead.tolist(), strict=True):
                g = cost[here] + s
                if g < cost.get(c, np.inf):
                    cost[c], came[c] = g, here
                    heapq.heappush(queue, (g + h, c))
        return None


def nearest(seeds: np.ndarray) -> np.ndarray:
    """Squared cells to the nearest seed of seeds[j, i], exact, columns wrapping; infinite without seeds."""
    ny, nx = seeds.shape
    rows = np.arange(ny)[:, None]
    below = np.maximum.accumulate(np.where(seeds, rows, -(10**6)), axis=0)
    above = np.minimum.accumulate(np.where(seeds, rows, 10**6)[::-1], axis=0)[::-1]
    gap = np.minimum(rows - below, above - rows).astype(float)
    gap[gap > 10**5] = np.inf
    gap *= gap
    out = gap.copy()
    for d in range(1, nx // 2 + 1):
        np.minimum(out, np.minimum(np.roll(gap, d, 1), np.roll(gap, -d, 1)) + d * d, out=out)
    return out
