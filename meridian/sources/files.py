"""Row, solution, coastline, journal and scenario files."""

from __future__ import annotations

import json
import tomllib
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.functions.ship import Ship
from meridian.kernels.search import Settings

# Field names and types of the JSON forms.
ROWS = "lon float, lat float, sample struct<speed: float, direction: float>"
TIMED_ROWS = f"t_seconds float, {ROWS}"
SOLUTION = "n int, xs array<double>, ys array<double>, ts array<double>, best_fit double, time_weight double, fuel_weight double, particles_space int, particles_time int, iter_space int, iter_time int, seed decimal(20,0), topology string, path_kick_probability double, path_kick_gamma_0_fraction double, path_kick_gamma_min_fraction double"
SOLUTION_DEFAULTS = {"topology": "gbest", "path_kick_probability": 0.1, "path_kick_gamma_0_fraction": 0.05, "path_kick_gamma_min_fraction": 0.005}
WAYPOINT_COUNTS = (5, 8, 10, 15, 20, 30, 40, 50, 60)


def read_rows(spark: SparkSession, path: str, timed: bool = True) -> DataFrame:
    """(t_seconds,) lon, lat, speed, direction from JSON lines."""
    rows = spark.read.schema(TIMED_ROWS if timed else ROWS).json(path)
    return rows.select(*[c for c in rows.columns if c != "sample"], "sample.speed", "sample.direction")


def write_rows(rows: DataFrame, path: str) -> None:
    plain = [c for c in ("t_seconds", "lon", "lat") if c in rows.columns]
    rows.select(*plain, F.struct("speed", "direction").alias("sample")).write.mode("overwrite").json(path)


def read_solutions(spark: SparkSession, path: str) -> DataFrame:
    """Saved solutions, one JSON object a file, with later fields at their defaults, and ``error`` for what is wrong."""
    rows = spark.read.schema(SOLUTION).json(path, multiLine=True).fillna(SOLUTION_DEFAULTS)
    return rows.withColumn("error", solution_error())


def solution_error() -> Column:
    lengths = [F.size(c) != F.col("n") for c in ("xs", "ys", "ts")]
    return F.when(F.col("n").isNull() | ~F.col("n").isin(*WAYPOINT_COUNTS), F.lit("waypoint count")).when(lengths[0] | lengths[1] | lengths[2], F.lit("length"))


def solution_waypoints(solutions: DataFrame, run: str = "run") -> DataFrame:
    """(run, k, lon, lat, seconds) of sound solutions; ts are the seconds of segments, not arrival times."""
    zipped = F.posexplode(F.arrays_zip("xs", "ys", "ts")).alias("k", "p")
    return solutions.filter("error is null").select(run, zipped).select(run, "k", F.col("p.xs").alias("lon"), F.col("p.ys").alias("lat"), F.col("p.ts").alias("seconds"))


def write_solutions(solutions: DataFrame, path: str) -> None:
    solutions.drop("error").write.mode("overwrite").json(path)


def read_coastline(spark: SparkSession, path: str) -> DataFrame:
    """(poly, ring, k, lon, lat) of the polygons of a GeoJSON file, rings open; other geometries are left out."""
    point = T.ArrayType(T.DoubleType())
    base = "struct<type: string, geometry: struct<type: string, coordinates: string>>"
    features = spark.read.schema(f"features array<{base}>").json(path, multiLine=True).select(F.posexplode("features").alias("feature", "f"))
    ring, shape = T.ArrayType(T.ArrayType(point)), T.ArrayType(T.ArrayType(T.ArrayType(point)))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    many = F.when(kind == "MultiPolygon", F.from_json(raw, shape)).when(kind == "Polygon", F.array(F.from_json(raw, ring)))
    polys = features.select("feature", F.posexplode(many).alias("part", "rings"))
    polys = polys.withColumn("poly", (F.row_number().over(Window.orderBy("feature", "part")) - 1).cast("int"))
    rings = polys.select("poly", F.posexplode("rings").alias("ring", "points"))
    closed = (F.size("points") > 1) & (F.get("points", F.lit(0)) == F.element_at("points", -1))
    points = rings.select("poly", "ring", F.posexplode(F.when(closed, F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(F.col("points"))).alias("k", "p"))
    return points.select("poly", "ring", "k", F.get("p", F.lit(0)).alias("lon"), F.get("p", F.lit(1)).alias("lat"))


def journal(trials: DataFrame, path: str) -> None:
    """Append trials as JSON lines."""
    trials.write.mode("append").json(path)


# ---- scenarios

# Sections and fields of a scenario.
SECTIONS = {
    "run": {"map", "start", "end", "bounds", "waypoints", "time_weight", "fuel_weight", "land_weight"},
    "boat": {"mcr_kw", "k", "polar_c", "polar_sin_power", "fuel_a", "fuel_b", "fuel_c"},
    "search": {"particles_space", "particles_time", "iter_space", "iter_time", "inertia", "cognitive_coeff", "social_coeff", "path_kick_probability", "path_kick_gamma_0_fraction", "path_kick_gamma_min_fraction", "seed", "step_distance_fraction", "bake_step_deg", "sdf_resolution_deg", "range_k", "k_mcr", "topology"},
    "tune": {"inertia", "cognitive_coeff", "social_coeff", "path_kick_probability", "path_kick_gamma_0_fraction", "path_kick_decay_ratio"},
}


def read_scenario(text: str) -> dict[str, dict]:
    """The sections of a TOML scenario; ValueError for a field that none has, or a tuned one that is no number or range."""
    out = tomllib.loads(text)
    for section, fields in out.items():
        if section not in SECTIONS:
            raise ValueError(f"unknown section {section}")
        for name in fields:
            if name not in SECTIONS[section]:
                raise ValueError(f"{section}: unknown field {name}")
    for name, v in out.get("tune", {}).items():
        if isinstance(v, dict):
            if set(v) != {"min", "max"} or not 0 <= v["min"] < v["max"] < float("inf"):
                raise ValueError(f"tune: {name} is not a range")
        elif isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v < float("inf"):
            raise ValueError(f"tune: {name} must be finite and not negative")
    return out


def merged(*scenarios: dict[str, dict]) -> dict[str, dict]:
    """Scenarios from left to right: what a later one sets, wins."""
    out: dict[str, dict] = {}
    for s in scenarios:
        for section, fields in s.items():
            out.setdefault(section, {}).update(fields)
    return out


# A scenario's fields and the settings they are.
SEARCH_FIELDS = {"particles_space": "particles", "particles_time": "time_particles", "iter_space": "iterations", "iter_time": "time_iterations", "inertia": "inertia", "cognitive_coeff": "cognitive", "social_coeff": "social", "path_kick_probability": "kick_probability", "seed": "seed", "range_k": "buckets", "k_mcr": "loads", "topology": "topology"}
RUN_FIELDS = {"waypoints": "waypoints", "time_weight": "time_weight", "fuel_weight": "fuel_weight", "land_weight": "land_weight"}
STEP_FIELDS = {"step_distance_fraction": (1e-6, 1.0), "bake_step_deg": (1e-3, 10.0), "sdf_resolution_deg": (0.05, 5.0)}
BOAT_FIELDS = {"k": "drag", "polar_c": "polar_c", "polar_sin_power": "polar_power"}


def applied(scenario: dict[str, dict], settings: Settings, ship: Ship) -> tuple[Settings, Ship]:
    """Settings and ship with what the scenario sets; the rest stays. ValueError for values out of range."""
    search, run, boat = (scenario.get(k, {}) for k in ("search", "run", "boat"))
    new = {to: search[name] for name, to in SEARCH_FIELDS.items() if name in search} | {to: run[name] for name, to in RUN_FIELDS.items() if name in run}
    kick = tuple(search.get(f"path_kick_gamma_{end}_fraction", old) for end, old in zip(("0", "min"), settings.kick, strict=True))
    for name, (low, high) in STEP_FIELDS.items():
        if name in search and not low <= search[name] <= high:
            raise ValueError(f"{name}: {search[name]} must be between {low} and {high}")
    made = {to: float(boat[name]) for name, to in BOAT_FIELDS.items() if name in boat}
    fuel = tuple(float(boat.get(f"fuel_{c}", old)) for c, old in zip("abc", ship.fuel, strict=True))
    power = float(boat["mcr_kw"]) * 1000 if "mcr_kw" in boat else ship.mcr_w
    return replace(settings, **new, kick=kick).checked(), replace(ship, **made, fuel=fuel, mcr_w=power).checked()


def write_scenario(scenario: dict[str, dict]) -> str:
    def value(v) -> str:
        if isinstance(v, dict):
            return "{ " + ", ".join(f"{k} = {value(x)}" for k, x in v.items()) + " }"
        if isinstance(v, list | tuple):
            return "[" + ", ".join(map(value, v)) + "]"
        return json.dumps(v)

    return "\n".join(f"[{section}]\n" + "".join(f"{k} = {value(v)}\n" for k, v in fields.items()) for section, fields in scenario.items())


def float_list(text: str, n: int) -> list[float]:
    """``a, b, c`` as numbers; ValueError unless there are n."""
    parts = [float(p.strip()) for p in text.split(",")]
    if len(parts) != n:
        raise ValueError(f"expected {n} numbers, got {len(parts)}")
    return parts
