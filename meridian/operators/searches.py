"""Many voyage searches at once: one row a search, one task for as many rows as come to it.

A search is sequential inside and independent of all others, so jobs are dealt one by one
over many tasks and each search runs whole where it lands. A search that fails gives a row
with its error instead of failing the job.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.geo import Box
from meridian.functions.ship import Ship
from meridian.kernels import search as kernel
from meridian.kernels.courses import Bounds
from meridian.kernels.fields import GridLand, GridWind
from meridian.operators.land import rasterized

#: Columns of a job: what is searched. Further columns named like a setting override it.
JOB = ("run", "lon1", "lat1", "lon2", "lat2", "lon_min", "lon_max", "lat_min", "lat_max")
WAYPOINTS = "run long, k int, lon double, lat double, seconds double, load double, fuel double, land_m double, fitness double, error string"


def wind_of(cells: DataFrame, lon: float, lat: float, step: float, step_s: float, crossfade_s: float | None = None, most: int = 64_000_000) -> GridWind:
    """A task's wind from baked cells (ix, iy, uv), at most ``most`` cells times frames (8 bytes each): 61 frames of
    a bake of the largest size, 1024 cells a side. It goes to the executors as one broadcast."""
    shape = cells.agg(F.max("ix"), F.max("iy"), F.max(F.size("uv"))).first()
    nx, ny, nt = (0 if v is None else int(v) + d for v, d in zip(shape, (1, 1, 0), strict=True))
    if not 0 < nx * ny * nt <= most:
        raise ValueError(f"a wind of {nx} x {ny} x {nt} cells does not fit a task")
    uv = np.full((ny, nx, nt, 2), np.nan, np.float32)
    part = lambda c: F.transform("uv", lambda s: s[c].cast("float")).alias(c)
    for b in cells.filter(F.size("uv") == nt).select("ix", "iy", part("u"), part("v")).toArrow().to_batches():
        ix, iy = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for k in (0, 1):
            uv[iy, ix, :, k] = b.column(2 + k).flatten().to_numpy(zero_copy_only=False).reshape(-1, nt)
    return GridWind(uv, lon, lat, step, step_s, crossfade_s)


def land_of(grid: DataFrame, cell: float) -> GridLand:
    """A task's land from a mask (i, j, is_land): at most 360 * 180 / cell^2 cells."""
    mask = np.zeros((round(180 / cell), round(360 / cell)), bool)
    for b in grid.filter("is_land").select("i", "j").toArrow().to_batches():
        mask[b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)] = True
    return GridLand(mask, cell)


class Lands:
    """Masks of one coastline by cell size: each is rasterized and measured once, then kept on the driver."""

    def __init__(self, vertices: DataFrame):
        self.vertices, self.known = vertices, {}

    def at(self, cell: float) -> GridLand:
        if cell not in self.known:
            self.known[cell] = land_of(rasterized(self.vertices, cell).withColumn("is_land", F.lit(True)), cell)
        return self.known[cell]


class Counters:
    """What searches did, as accumulators: searches and failures, seconds of them, evaluations of voyages and of times.

    Tasks that are tried again count again.
    """

    def __init__(self, spark: SparkSession):
        self.sums = {name: spark.sparkContext.accumulator(0.0 if name == "seconds" else 0) for name in ("searches", "failures", "seconds", "voyages", "times")}

    def add(self, settings: kernel.Settings, seconds: float, failed: bool) -> None:
        self.sums["failures" if failed else "searches"].add(1)
        self.sums["seconds"].add(seconds)
        if not failed:
            rounds = settings.particles * settings.iterations
            self.sums["voyages"].add(rounds + settings.particles)
            self.sums["times"].add(rounds * settings.time_particles * (settings.time_iterations + 1))

    def values(self) -> dict[str, float]:
        return {name: total.value for name, total in self.sums.items()}


def dealt(jobs: DataFrame, tasks: int | None = None) -> DataFrame:
    """jobs in so many tasks, by default a few for each core, one by one in turn; adaptive execution leaves a stated
    number as it is. A search outweighs its row by far, so none should wait for another while a core is idle."""
    return jobs.repartition(tasks or 4 * jobs.sparkSession.sparkContext.defaultParallelism)


def _problem(job, ship: Ship, wind, land, settings: kernel.Settings) -> kernel.Problem:
    known = {k: getattr(job, k) for k in kernel.Settings.__dataclass_fields__ if hasattr(job, k)}
    cast = {k: type(getattr(settings, k))(v) for k, v in known.items() if v is not None and v == v}
    box = Box(job.lon_min, job.lon_max, job.lat_min, job.lat_max)
    return kernel.Problem(ship, wind, land, Bounds((job.lon1, job.lat1), (job.lon2, job.lat2), box), replace(settings, **cast))


def _rows(run: int, problem: kernel.Problem, found: kernel.Found) -> pd.DataFrame:
    load, fuel, over = (np.concatenate([[0.0], a[0]]) for a in problem.metrics(found.x[None], found.y[None], found.t[None]))
    return pd.DataFrame({"run": run, "k": np.arange(len(found.x), dtype=np.int32), "lon": found.x, "lat": found.y, "seconds": found.t, "load": load, "fuel": fuel, "land_m": over, "fitness": found.fit, "error": None})


def _failed(run: int, error: str) -> pd.DataFrame:
    nan = float("nan")
    return pd.DataFrame({"run": [run], "k": np.array([-1], np.int32), "lon": nan, "lat": nan, "seconds": nan, "load": nan, "fuel": nan, "land_m": nan, "fitness": -math.inf, "error": error})


def _each(jobs: DataFrame, work: Callable, tasks: int | None, counters: Counters | None = None, settings: kernel.Settings | None = None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for jobs_ in batches:
            for job in jobs_.itertuples(index=False):
                began = time.monotonic()
                try:
                    out, failed = work(job), False
                except (kernel.NoRoute, ValueError) as e:
                    out, failed = _failed(job.run, f"{type(e).__name__}: {e}"), True
                if counters is not None:
                    counters.add(settings, time.monotonic() - began, failed)
                yield out

    return dealt(jobs, tasks).mapInPandas(run, WAYPOINTS)


def searched(jobs: DataFrame, ship: Ship, wind, land, settings: kernel.Settings = kernel.Settings(), tasks: int | None = None, counters: Counters | None = None) -> DataFrame:
    """Waypoints of the best voyage of each job, with seconds, load, fuel and land of the segment that ends there."""

    def work(job):
        problem = _problem(job, ship, wind, land, settings)
        return _rows(job.run, problem, kernel.search(problem))

    return _each(jobs, work, tasks, counters, settings)


def benchmarked(jobs: DataFrame, ship: Ship, wind, land, settings: kernel.Settings = kernel.Settings(), tasks: int | None = None) -> DataFrame:
    """As searched(), for the shortest path over sea with its times optimized."""

    def work(job):
        problem = _problem(job, ship, wind, land, settings)
        found = kernel.benchmark(problem)
        return _failed(job.run, "no path over sea") if found is None else _rows(job.run, problem, found)

    return _each(jobs, work, tasks)


def retimed(waypoints: DataFrame, jobs: DataFrame, ship: Ship, wind, land, settings: kernel.Settings = kernel.Settings()) -> DataFrame:
    """waypoints (run, k, lon, lat, seconds) with their times optimized anew; places stay. One group a voyage."""
    lists = waypoints.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("k", "lon", "lat", "seconds"))).alias("path"))

    def work(job):
        problem = _problem(job, ship, wind, land, settings)
        x, y, t = (np.array([p[c] for p in job.path], float) for c in ("lon", "lat", "seconds"))
        new, fit = kernel.reoptimized(problem, x, y, t)
        return _rows(job.run, problem, kernel.Found(x, y, new, fit))

    return _each(jobs.join(lists, "run"), work, None)


def spliced(waypoints: DataFrame, times: DataFrame) -> DataFrame:
    """waypoints with the seconds of times (run, k, seconds), for runs where both have as many waypoints."""
    n, m = (d.groupBy("run").agg(F.count("*").alias(c)) for d, c in ((waypoints, "n"), (times, "m")))
    fits = n.join(m, "run").filter("n = m").select("run")
    new = times.join(fits, "run", "left_semi").select("run", "k", F.col("seconds").alias("new_seconds"))
    return waypoints.join(new, ["run", "k"], "left").withColumn("seconds", F.coalesce("new_seconds", "seconds")).drop("new_seconds")


def evolutions(jobs: DataFrame, ship: Ship, wind, land, settings: kernel.Settings = kernel.Settings()) -> DataFrame:
    """(run, iteration, particle, niche, fit, best_fit) of whole searches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for jobs_ in batches:
            for job in jobs_.itertuples(index=False):
                found = kernel.search(_problem(job, ship, wind, land, settings))
                for k, f in enumerate(found.frames):
                    n = len(f["fit"])
                    yield pd.DataFrame({"run": job.run, "iteration": np.full(n, k, np.int32), "particle": np.arange(n, dtype=np.int32), "niche": found.niches.astype(np.int32), "fit": f["fit"], "best_fit": f["best_fit"]})

    return dealt(jobs).mapInPandas(run, "run long, iteration int, particle int, niche int, fit double, best_fit double")


def sea_paths(jobs: DataFrame, land: GridLand) -> DataFrame:
    """(run, k, lon, lat) of the shortest path over sea of jobs (JOB columns, and bias: north, south or null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for jobs_ in batches:
            for job in jobs_.itertuples(index=False):
                line = land.sea_path((job.lon1, job.lat1), (job.lon2, job.lat2), Box(job.lon_min, job.lon_max, job.lat_min, job.lat_max), getattr(job, "bias", None))
                if line:
                    x, y = np.array(line, float).T
                    yield pd.DataFrame({"run": job.run, "k": np.arange(len(x), dtype=np.int32), "lon": x, "lat": y})

    return dealt(jobs).mapInPandas(run, "run long, k int, lon double, lat double")


# ---- studies


# What a study varies, as (setting, least, most).
RANGES = (("inertia", 0.0, 1.2), ("cognitive", 0.0, 4.0), ("social", 0.0, 4.0), ("kick_probability", 0.0, 0.5), ("kick_start", 0.0, 0.2), ("kick_ratio", 0.0, 1.0))


def slots(tune: dict, pinned: dict) -> dict[str, float | tuple[float, float]]:
    """What each setting of RANGES is held at or drawn from: a pin or a range of the study first, then a pin of the
    search, then the default range."""
    out: dict[str, float | tuple[float, float]] = {}
    for name, low, high in RANGES:
        v = tune.get(name, pinned.get(name, (low, high)))
        if isinstance(v, dict):
            v = (v["min"], v["max"])
        if isinstance(v, tuple):
            if not (math.isfinite(v[0]) and math.isfinite(v[1]) and 0 <= v[0] < v[1]):
                raise ValueError(f"{name}: {v} is not a range")
        elif not math.isfinite(v) or v < 0:
            raise ValueError(f"{name}: {v} must be finite and not negative")
        out[name] = v
    return out


def proposed(space: dict, history: list[tuple[dict, float]], rng: np.random.Generator, startup: int = 10, tries: int = 24, good: float = 0.25) -> dict:
    """The next trial's settings by a tree-structured Parzen estimator; scores are the smaller the better.

    After some random trials, each free setting is drawn around the good ones and the draw kept that is likeliest
    among the good against the others.
    """
    free = {k: v for k, v in space.items() if isinstance(v, tuple)}
    out = {k: v for k, v in space.items() if not isinstance(v, tuple)}
    ranked = sorted((h for h in history if math.isfinite(h[1])), key=lambda h: h[1])
    for name, (low, high) in free.items():
        if len(ranked) < startup:
            out[name] = float(rng.uniform(low, high))
            continue
        cut = max(1, math.ceil(good * len(ranked)))
        best, rest = (np.array([h[0][name] for h in part]) for part in (ranked[:cut], ranked[cut:]))
        width = max((high - low) / math.sqrt(len(ranked)), 1e-12)
        draws = np.clip(rng.choice(best, tries) + rng.normal(0, width, tries), low, high)
        dense = lambda at: np.exp(-0.5 * ((draws[:, None] - at) / width) ** 2).mean(axis=1) + 1e-12
        out[name] = float(draws[np.argmax(dense(best) / dense(rest))])
    return out


def overrides(trial: dict) -> dict:
    """Settings of a trial: the end of the kick is a share of its start."""
    known = {k: v for k, v in trial.items() if k not in ("kick_start", "kick_ratio")}
    start = trial.get("kick_start", 0.05)
    return known | {"kick": (start, start * trial.get("kick_ratio", 0.1))}
