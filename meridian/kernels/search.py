"""Particle-swarm search for a voyage of least weighted time, fuel and land, in one task.

Places move as a swarm over the sphere; for every particle the times of its segments are
then optimized by a swarm of their own, on tables of travel times. All particles are
worked on together as arrays, and one generator makes a run repeatable.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from meridian.functions.geo import POLE_LAT, Box
from meridian.functions.ship import Ship
from meridian.kernels import courses, legs, sphere
from meridian.kernels.courses import Bounds, Course
from meridian.operators.swarm import shared_out, torus_shape

# Shares of the starting families (four waves, bends, noise) and courses (straight, north, south).
FAMILIES = (0.30, 0.20, 0.15, 0.10, 0.15, 0.10)
COURSES = (0.2, 0.4, 0.4)
TOPOLOGIES = ("gbest", "niched", "ring", "von_neumann")


# The default settings.
@dataclass(frozen=True)
class Settings:
    waypoints: int = 30
    time_weight: float = 1.0
    fuel_weight: float = 10.0
    land_weight: float = 50.0
    particles: int = 80
    iterations: int = 60
    time_particles: int = 40
    time_iterations: int = 30
    inertia: float = 0.33
    cognitive: float = 2.0
    social: float = 2.0
    jitter: tuple[float, float] = (0.0, 0.0)
    kick_probability: float = 0.1
    kick: tuple[float, float] = (0.05, 0.005)
    seed: int = 0
    departure: float = 0.0
    buckets: int = 8
    loads: int = 8
    topology: str = "gbest"

    def checked(self) -> "Settings":
        """Itself, or ValueError naming the first field that is wrong."""
        if self.topology.lower() not in TOPOLOGIES:
            raise ValueError(f"topology: {self.topology} is not one of {', '.join(TOPOLOGIES)}")
        for name in ("time_weight", "fuel_weight", "land_weight"):
            if not math.isfinite(v := getattr(self, name)) or v < 0:
                raise ValueError(f"{name}: {v} must be finite and not negative")
        for name in ("inertia", "cognitive", "social", "departure"):
            if not math.isfinite(v := getattr(self, name)):
                raise ValueError(f"{name}: {v} must be finite")
        for name, least in (("particles", 1), ("iterations", 1), ("time_particles", 1), ("time_iterations", 1), ("waypoints", 3)):
            if getattr(self, name) < least:
                raise ValueError(f"{name}: {getattr(self, name)} must be at least {least}")
        # Limits of the tables of travel times.
        for name in ("buckets", "loads"):
            if not 2 <= getattr(self, name) <= 256:
                raise ValueError(f"{name}: {getattr(self, name)} must be between 2 and 256")
        if not 0 <= self.kick_probability <= 1:
            raise ValueError(f"kick_probability: {self.kick_probability} must be between 0 and 1")
        for name in ("jitter", "kick"):
            start, end = getattr(self, name)
            if not (math.isfinite(start) and math.isfinite(end)) or min(start, end) < 0:
                raise ValueError(f"{name}: {(start, end)} must be finite and not negative")
            if end > start:
                raise ValueError(f"{name}: it may not grow from {start} to {end}")
        return self


# The swarm that older published timings were taken with.
LEGACY = {"particles": 40, "iterations": 40, "inertia": 0.2, "cognitive": 1.6, "social": 0.85}


@dataclass
class Problem:
    ship: Ship
    wind: object
    land: object
    bounds: Bounds
    settings: Settings

    def segments(self, x, y):
        return x[..., :-1], y[..., :-1], x[..., 1:], y[..., 1:]

    def metrics(self, x, y, t):
        """(load, fuel, land metres) of every segment of paths [path, waypoint]; t[..., 1:] are their seconds."""
        leave = self.settings.departure + np.cumsum(t, axis=-1)[..., :-1]
        load = legs.solve_load(self.ship, self.wind, *self.segments(x, y), leave, t[..., 1:], self.bounds.cap)
        over = legs.land_metres(self.land, *self.segments(x, y), self.bounds.cap)
        return load, legs.fuel_used(self.ship, load, t[..., 1:]), over

    def fitness(self, x, y, t):
        s = self.settings
        _, fuel, over = self.metrics(x, y, t)
        cost = t[..., 1:].sum(-1) * s.time_weight + fuel.sum(-1) * s.fuel_weight
        with np.errstate(invalid="ignore"):
            cost = cost + over.sum(-1) * s.land_weight if s.land_weight else cost
        return np.where(np.isnan(cost), -np.inf, -cost)


@dataclass
class Found:
    """The best voyage and, by iteration, the swarm: x, y, t, fit and personal bests."""

    x: np.ndarray
    y: np.ndarray
    t: np.ndarray
    fit: float
    frames: list[dict] = field(default_factory=list)
    niches: np.ndarray | None = None


class NoRoute(Exception):
    """No particle found a voyage that can be sailed."""


def best_times(problem: Problem, x, y, outer, rng: np.random.Generator, iterations: int | None = None):
    """Seconds [path, waypoint] of least time and fuel for given places, by a swarm on tables for each path."""
    s = problem.settings
    tables = legs.Tables.build(problem.ship, problem.wind, x, y, problem.bounds.cap, s.departure, s.buckets, s.loads)
    paths, n = x.shape
    m = s.time_particles
    still = sphere.haversine(*problem.segments(x, y)) <= 0

    def settled(t):
        """Times kept within what each segment can take, and their fitness."""
        leave, out, cost = np.full((paths, m), s.departure), np.empty_like(t), np.zeros((paths, m))
        for k in range(n - 1):
            kept, load = tables.settle(k, leave, t[:, :, k])
            load = np.where(still[:, k, None], 0.0, load)
            cost += kept * s.time_weight + legs.fuel_used(problem.ship, load, kept) * s.fuel_weight
            leave = leave + kept
            out[:, :, k] = kept
        return out, np.where(np.isnan(cost), -np.inf, -cost)

    with np.errstate(all="ignore"):
        pos, leave = np.empty((paths, m, n - 1)), np.full((paths, m), s.departure)
        for k in range(n - 1):
            low, high = tables.range(k, leave)
            pos[:, :, k] = np.where(low < high, low + rng.random((paths, m)) * np.where(np.isfinite(high), high - low, 0.0), low)
            leave = leave + pos[:, :, k]
        scale = np.where(outer[:, None, 1:] > 0, outer[:, None, 1:] * 0.1, 1.0)
        vel = (rng.random((paths, m, n - 1)) - 0.5) * 2 * np.where(np.isfinite(scale), scale, 1.0)
        pos, fit = settled(pos)
        own, own_fit = pos.copy(), fit.copy()
        for _ in range(iterations or s.time_iterations):
            top = own[np.arange(paths), own_fit.argmax(axis=1)][:, None]
            r1, r2 = rng.random((paths, m, 1)), rng.random((paths, m, 1))
            vel = np.nan_to_num(vel * s.inertia + (own - pos) * (s.cognitive * r1) + (top - pos) * (s.social * r2))
            pos, fit = settled(pos + vel)
            better = fit > own_fit
            own[better], own_fit[better] = pos[better], fit[better]
    top = own[np.arange(paths), own_fit.argmax(axis=1)]
    return np.concatenate([np.zeros((paths, 1)), top], axis=1)


def started(problem: Problem, rng: np.random.Generator):
    """(x, y, niches): the first swarm, by courses and within each by families of shapes."""
    s, b = problem.settings, problem.bounds
    made = [(Course.straight(s.waypoints, b), COURSES[0])]
    for bias, share in zip(("north", "south"), COURSES[1:], strict=True):
        if line := problem.land.sea_path(b.origin, b.destination, b.box, bias):
            made.append((Course.along(line, s.waypoints, b, problem.land), share))
    x, y, niche = [], [], []
    for k, ((course, _), count) in enumerate(zip(made, shared_out(s.particles, [w for _, w in made]), strict=True)):
        for family, n in enumerate(shared_out(count, list(FAMILIES))):
            for i in range(n):
                share = courses.waves(family + 1, i, n, s.waypoints) if family < 4 else courses.bend(s.waypoints, rng) if family == 4 else courses.noise(s.waypoints, rng)
                px, py = course.shifted(share, b)
                x.append(px)
                y.append(py)
                niche.append(k)
    return np.array(x), np.array(y), np.array(niche)


def first_times(problem: Problem, x, y, rng: np.random.Generator):
    """Random seconds that each segment can take."""
    t = np.zeros(x.shape)
    leave = np.full(len(x), problem.settings.departure)
    for k in range(x.shape[1] - 1):
        low, high = legs.time_range(problem.ship, problem.wind, x[:, k], y[:, k], x[:, k + 1], y[:, k + 1], leave, cap=problem.bounds.cap)
        with np.errstate(invalid="ignore"):
            t[:, k + 1] = np.where(low < high, low + rng.random(len(x)) * np.where(np.isfinite(high), high - low, 0.0), low)
        leave = leave + t[:, k + 1]
    return t


def attractors(fit: np.ndarray, niches: np.ndarray, topology: str) -> np.ndarray:
    """For each particle the one that draws it: the best of all, of its niche, or of its neighbours."""
    n = len(fit)
    me = np.arange(n)
    if topology == "gbest":
        return np.full(n, fit.argmax())
    if topology == "niched":
        return np.array([me[niches == k][fit[niches == k].argmax()] for k in niches])
    shape = torus_shape(n) if topology == "von_neumann" else None
    if shape:
        rows, cols = shape
        r, c = me // cols, me % cols
        near = np.stack([(r + 1) % rows * cols + c, (r - 1) % rows * cols + c, r * cols + (c + 1) % cols, r * cols + (c - 1) % cols])
    else:
        near = np.stack([(me - 1) % n, (me + 1) % n])
    return near[fit[near].argmax(axis=0), me]


def decay(step: int, steps: int, start: float, end: float) -> float:
    t = min(1.0, max(0.0, (step - 1) / max(steps - 1, 1)))
    return end + (start - end) * 0.5 * (1 + math.cos(math.pi * t))


def search(problem: Problem) -> Found:
    s, b = problem.settings.checked(), problem.bounds
    problem.ship.checked()
    rng = np.random.default_rng(s.seed)
    topology = s.topology.lower()
    x, y, niches = started(problem, rng)
    n, w = x.shape
    t = first_times(problem, x, y, rng)
    inner = np.zeros(w, bool)
    inner[1:-1] = True
    d = rng.random((2, n, w)) - 0.5
    ve, vn = np.where(inner, d / np.maximum(np.hypot(*d), 1e-12) * (0.3 * b.box.diagonal_m()), 0.0)
    fit = problem.fitness(x, y, t)
    px, py, pt, pf = x.copy(), y.copy(), t.copy(), fit.copy()
    way = float(sphere.haversine(*b.origin, *b.destination))
    course = float(np.nan_to_num(sphere.bearing(*map(np.float64, (*b.origin, *b.destination)))))
    across = math.sin(course - math.pi / 2), math.cos(course - math.pi / 2)
    cauchy = lambda *shape: np.tan(math.pi * (np.clip(rng.random(shape), 1e-10, 1 - 1e-10) - 0.5))
    out = Found(x[0], y[0], t[0], -np.inf, niches=niches)
    for step in range(1, s.iterations + 1):
        lead = attractors(pf, niches, topology)
        r1, r2 = rng.random((n, 1)), rng.random((n, 1))
        own = sphere.to_tangent(y, sphere.lon_delta(x, px), py - y)
        others = sphere.to_tangent(y, sphere.lon_delta(x, px[lead]), py[lead] - y)
        ve, vn = (v * s.inertia + a * (s.cognitive * r1) + c * (s.social * r2) for v, a, c in zip((ve, vn), own, others, strict=True))
        x, y = sphere.offset(x, y, ve, vn)
        if (g := decay(step, s.iterations, *(f * way for f in s.jitter))) > 0:
            x, y = sphere.offset(x, y, *np.where(inner, g * cauchy(2, n, w), 0.0))
        kicked = rng.random(n) < s.kick_probability
        k, size = rng.integers(2, 5, n), decay(step, s.iterations, *(f * way for f in s.kick)) * cauchy(n)
        wave = np.where(inner & kicked[:, None], size[:, None] * np.sin(k[:, None] * math.pi * np.arange(w) / w), 0.0)
        x, y = sphere.offset(x, y, wave * across[0], wave * across[1])
        x, y = b.pin(x, y)
        x, y = b.pin(*courses.off_land(problem.land, x, y))
        t = best_times(problem, x, y, t, rng)
        fit = problem.fitness(x, y, t)
        better = fit > pf
        px[better], py[better], pt[better], pf[better] = x[better], y[better], t[better], fit[better]
        out.frames.append({"x": x.copy(), "y": y.copy(), "t": t.copy(), "fit": fit.copy(), "best_x": px.copy(), "best_y": py.copy(), "best_t": pt.copy(), "best_fit": pf.copy()})
    k = int(pf.argmax())
    out.x, out.y, out.t, out.fit = px[k], py[k], pt[k], float(pf[k])
    if not math.isfinite(out.fit):
        raise NoRoute("no voyage could be sailed within the bounds")
    return out


def reoptimized(problem: Problem, x, y, t) -> tuple[np.ndarray, float]:
    """(seconds, fitness) of fixed places, optimized anew."""
    x, y, t = (np.atleast_2d(np.asarray(a, float)) for a in (x, y, t))
    new = best_times(problem, x, y, t, np.random.default_rng(problem.settings.seed))
    return new[0], float(problem.fitness(x, y, new)[0])


def benchmark(problem: Problem) -> Found | None:
    """The shortest path over sea, its times optimized; None without a path."""
    b, s = problem.bounds, problem.settings
    line = problem.land.sea_path(b.origin, b.destination, b.box, None)
    if not line:
        return None
    x, y = courses.over_sea(line, s.waypoints, b, problem.land)
    t, fit = reoptimized(problem, x, y, np.zeros(len(x)))
    return Found(x, y, t, fit)


def auto_box(land, origin, destination, pad: float = 0.2, least: float = 3.0):
    """A box around the shortest path over the whole sea, padded; None without a path or without a way to go."""
    line = land.sea_path(origin, destination, Box(-180.0, 180.0, -POLE_LAT, POLE_LAT), None)
    if not line or tuple(origin) == tuple(destination):
        return None
    x, y = np.array(line, float).T
    far = x[0] + np.concatenate([[0.0], np.cumsum(sphere.lon_delta(x[:-1], x[1:]))])
    dx, dy = max((far.max() - far.min()) * pad, least), max((y.max() - y.min()) * pad, least)
    west, east = far.min() - dx, far.max() + dx
    lat = max(y.min() - dy, -POLE_LAT), min(y.max() + dy, POLE_LAT)
    return Box(-180.0, 180.0, *lat) if east - west >= 360 else Box(float(sphere.wrap_lon(west)), float(sphere.wrap_lon(east)), *map(float, lat))
