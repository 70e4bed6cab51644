"""Registered queries that run whole searches, and queries that check what they return.

What a search finds is beyond SQL. Each ``..._checks`` query runs one of the searches and holds
its result, run by run, against what must be true of it: ends and numbers of waypoints, times,
loads, fuel and land worked out anew by the column expressions of meridian.operators.voyages,
and the weighted cost. Its SQL says which runs there are and that all of it holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.functions import ship as physics
from meridian.functions.ship import Ship
from meridian.kernels.fields import BoxLand, FormulaWind, GridLand
from meridian.kernels.search import LEGACY, TOPOLOGIES, Settings
from meridian.operators import grids, searches, study, voyages
from meridian.plans.search_queries import vertices
from meridian.plans.voyage_queries import r
from meridian.plans.wind_queries import GRID, ONTO, frames
from meridian.session import table

TINY = Settings(waypoints=5, particles=6, iterations=2, time_particles=4, time_iterations=2)
SMALL = Settings(waypoints=6, particles=8, iterations=4, time_particles=6, time_iterations=3)
#: The sizes of the published single searches; what bench.py times.
PUBLISHED = Settings(waypoints=20, **LEGACY)


def _gap(lon, lat, t):
    # A calm around (-5, 50) in a wind of 8 m/s.
    return 8.0 * (1 - np.exp(-0.5 * ((lon + 5) ** 2 + (lat - 50) ** 2) / 9)), np.zeros(np.shape(lon))


WIND, LAND = FormulaWind(_gap), BoxLand(4.0, 6.0, 46.0, 52.0)


def _bar() -> GridLand:
    lon, lat = np.arange(360) + 0.5 - 180, np.arange(180) + 0.5 - 90
    return GridLand((np.abs(lat) < 10)[:, None] & (np.abs(lon) < 2)[None, :], 1.0)


def _jobs(spark, sf_dir):
    """A voyage for each nation: from west to east, at latitudes that differ."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("run"), (F.lit(-10.0) - n % 3).alias("lon1"), (F.lit(46.0) + n % 7).alias("lat1"), (F.lit(10.0) + n % 4).alias("lon2"), (F.lit(47.0) + n % 5).alias("lat2"), F.lit(-15.0).alias("lon_min"), F.lit(16.0).alias("lon_max"), F.lit(40.0).alias("lat_min"), F.lit(58.0).alias("lat_max"), n.cast("long").alias("seed"))


def search_voyages(spark, sf_dir):
    return searches.searched(_jobs(spark, sf_dir), Ship(), WIND, LAND, SMALL)


def search_topologies(spark, sf_dir):
    each = F.explode(F.array(*[F.lit(t) for t in ("gbest", "niched", "ring", "von_neumann")]))
    jobs = _jobs(spark, sf_dir).withColumn("topology", each).withColumn("run", F.xxhash64("run", "topology"))
    return searches.searched(jobs, Ship(), WIND, LAND, TINY).filter("k = 0").select("run", "fitness", "error")


def search_evolution(spark, sf_dir):
    return searches.evolutions(_jobs(spark, sf_dir), Ship(), WIND, LAND, TINY)


def reoptimized_times(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    lines = jobs.select("run", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"), "lon1", "lat1", "lon2", "lat2")
    points = lines.select("run", "k", (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * F.col("k") / 5).alias("lon"), (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * F.col("k") / 5).alias("lat"), F.lit(0.0).alias("seconds"))
    new = searches.retimed(points, jobs, Ship(), WIND, LAND, SMALL)
    return searches.spliced(points, new)


def _bar_jobs(spark, sf_dir):
    n = F.col("n_nationkey")
    jobs = table(spark, sf_dir, "nation").select(n.cast("long").alias("run"), (F.lit(-12.0) - n % 4).alias("lon1"), (n % 5 - 2.0).alias("lat1"), (F.lit(12.0) + n % 3).alias("lon2"), (n % 4 - 1.0).alias("lat2"), F.lit(-25.0).alias("lon_min"), F.lit(25.0).alias("lon_max"), F.lit(-20.0).alias("lat_min"), F.lit(20.0).alias("lat_max"))
    return jobs.withColumn("bias", F.element_at(F.array(F.lit(None).cast("string"), F.lit("north"), F.lit("south")), (F.col("run") % 3 + 1).cast("int")))


def sea_paths(spark, sf_dir):
    return searches.sea_paths(_bar_jobs(spark, sf_dir), _bar())


def benchmark_routes(spark, sf_dir):
    return searches.benchmarked(_bar_jobs(spark, sf_dir).drop("bias"), Ship(), WIND, _bar(), SMALL)


def trial_search(spark, sf_dir):
    """A study of two trials on every route with two seeds, and its statistics."""
    jobs = _jobs(spark, sf_dir).drop("seed").withColumnRenamed("run", "route")
    trials = spark.createDataFrame([(0, 0.33, 2.0), (1, 0.2, 1.6)], "trial int, inertia double, cognitive double")
    work = study.planned(jobs, spark.range(2).withColumnRenamed("id", "seed"), trials)
    work = work.withColumn("run", F.xxhash64("trial", "route", "seed"))
    found = searches.searched(work, Ship(), WIND, LAND, TINY).filter("k <= 0").select("run", "fitness")
    out = study.by_route(work.select("run", "trial", F.col("route").cast("string"), "seed").join(found, "run"))
    return out.select("trial", "route", "seeds", r("mean", 3).alias("mean"), r("deviation", 3).alias("deviation"))


# ---- searches on a baked wind and a rasterized land


def _baked_jobs(spark, sf_dir):
    """A voyage for each nation from west to east, south of the island."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("run"), (F.lit(-50.0) - n % 5).alias("lon1"), (F.lit(-22.0) + n % 4).alias("lat1"), (F.lit(40.0) + n % 6).alias("lon2"), (F.lit(-26.0) + n % 5).alias("lat2"), F.lit(-60.0).alias("lon_min"), F.lit(55.0).alias("lon_max"), F.lit(-40.0).alias("lat_min"), F.lit(34.0).alias("lat_max"), n.cast("long").alias("seed"))


def _baked_world(spark):
    """The baked wind of bake_grid, and the land of rasterize_land."""
    cells = grids.packed(grids.bake(frames(spark), GRID, ONTO))
    wind = searches.wind_of(cells, ONTO.lon, ONTO.lat, ONTO.step_lon, GRID.step_s, GRID.crossfade_s)
    return wind, searches.Lands(vertices(spark)).at(2.0)


def search_baked(spark, sf_dir):
    return searches.searched(_baked_jobs(spark, sf_dir), Ship(), *_baked_world(spark), SMALL)


def search_published(spark, sf_dir):
    """A voyage of each nation with the sizes of the published searches."""
    return searches.searched(_jobs(spark, sf_dir), Ship(), WIND, LAND, PUBLISHED)


# ---- checks


def _gap_columns(lon, lat, t):
    # As _gap().
    return 8.0 * (1 - F.exp(-0.5 * ((lon + 5) * (lon + 5) + (lat - 50) * (lat - 50)) / 9)), F.lit(0.0)


def _near(a, b, part):
    return F.coalesce(F.abs(a - b) <= part * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)), F.lit(False))


def checked(found, jobs, settings: Settings):
    """By run, whether its waypoints are a voyage of the job and add up to its fitness."""
    known = jobs.select("run", "lon1", "lat1", "lon2", "lat2")
    first = lambda c: F.min_by(c, "k")
    last = lambda c: F.max_by(c, "k")
    later = F.when(F.col("k") > 0, F.col("seconds"))
    burnt = Ship().fuel_used(F.col("load"), F.col("seconds"))
    rows = found.withColumn("same_fuel", (F.col("k") == 0) | _near(F.col("fuel"), burnt, 1e-9))
    each = rows.groupBy("run").agg(
        F.count("*").alias("waypoints"),
        first("lon").alias("x1"), first("lat").alias("y1"), last("lon").alias("x2"), last("lat").alias("y2"),
        F.sum("seconds").alias("seconds"), F.sum("fuel").alias("fuel"), F.sum("land_m").alias("land"), F.max("fitness").alias("fitness"),
        (F.min(later) > 0).alias("timed"), F.min("load").alias("low"), F.max("load").alias("high"), F.bool_and("same_fuel").alias("fuelled"), F.max("error").isNull().alias("sailed"),
    )
    cost = physics.fitness(F.col("seconds"), F.col("fuel"), F.col("land"), settings.time_weight, settings.fuel_weight, settings.land_weight)
    pinned = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-9
    return each.join(known, "run").select("run", "waypoints", (pinned("x1", "lon1") & pinned("y1", "lat1")).alias("starts"), (pinned("x2", "lon2") & pinned("y2", "lat2")).alias("ends"), "timed", F.expr("low >= 0 and high <= 1").alias("loaded"), "fuelled", _near(F.col("fitness"), cost, 1e-9).alias("weighed"), "sailed")


def _checks_sql(waypoints: int) -> str:
    return f"SELECT CAST(n_nationkey AS BIGINT) AS run, CAST({waypoints} AS BIGINT) AS waypoints, {', '.join(f'true AS {c}' for c in ('starts', 'ends', 'timed', 'loaded', 'fuelled', 'weighed', 'sailed'))} FROM nation"


def search_voyages_checks(spark, sf_dir):
    return checked(search_voyages(spark, sf_dir), _jobs(spark, sf_dir), SMALL)


def search_published_checks(spark, sf_dir):
    return checked(search_published(spark, sf_dir), _jobs(spark, sf_dir), PUBLISHED)


def search_baked_checks(spark, sf_dir):
    return checked(search_baked(spark, sf_dir), _baked_jobs(spark, sf_dir), SMALL)


def benchmark_routes_checks(spark, sf_dir):
    """As checked(), and that the path keeps off the land but for a substep's width."""
    found = benchmark_routes(spark, sf_dir)
    jobs = _bar_jobs(spark, sf_dir)
    over = found.groupBy("run").agg((F.sum("land_m") < 100_000).alias("at_sea"))
    return checked(found, jobs, SMALL).join(over, "run")


def leg_physics_checks(spark, sf_dir):
    """Each leg that the searches return, sailed anew by the column expressions: its seconds at its load unless it
    waits at the least one, and its metres over land."""
    found = search_voyages(spark, sf_dir).withColumnRenamed("run", "voyage")
    here = voyages.running_clock(found)
    ahead = [F.lead(c).over(voyages.along()).alias(f"next_{c}") for c in ("seconds", "load", "land_m")]
    legs = voyages.legs(here.select("voyage", "k", "lon", "lat", "arrive", *ahead))
    ends = [F.col(c) for c in ("lon", "lat", "lon2", "lat2")]
    substeps = 200
    took = voyages.travel_time(*ends, F.col("next_load"), F.col("arrive"), Ship(), _gap_columns, substeps)
    box = LAND.box
    over = voyages.land_metres(*ends, lambda x, y: x.between(box[0], box[1]) & y.between(box[2], box[3]), substeps)
    cap = F.lit(50_000.0)  # a substep of the search's own is no longer
    late = (F.col("next_load") <= 0.1) & (F.col("next_seconds") >= took * 0.99)
    return legs.select(F.col("voyage").alias("run"), "k", (_near(took, F.col("next_seconds"), 0.02) | late).alias("timed"), (F.abs(over - F.col("next_land_m")) <= 2 * cap).alias("over_land"))


def search_topologies_checks(spark, sf_dir):
    """How many nations have a finite voyage in each topology."""
    each = F.explode(F.array(*[F.lit(t) for t in TOPOLOGIES])).alias("topology")
    names = _jobs(spark, sf_dir).select("run", each).select(F.xxhash64("run", "topology").alias("run"), "topology")
    found = search_topologies(spark, sf_dir).filter("error is null and not isnan(fitness) and fitness > double('-inf') and fitness < 0")
    return names.join(found, "run").groupBy("topology").agg(F.count("*").alias("voyages"))


def search_evolution_checks(spark, sf_dir):
    """By run: iterations and particles, and that a particle's best never falls and is never under what it has."""
    rows = search_evolution(spark, sf_dir)
    before = F.lag("best_fit").over(Window.partitionBy("run", "particle").orderBy("iteration"))
    rows = rows.withColumn("rises", F.coalesce(F.col("best_fit") >= before, F.lit(True))).withColumn("best", F.col("best_fit") >= F.col("fit"))
    return rows.groupBy("run").agg(F.count_distinct("iteration").alias("iterations"), F.count_distinct("particle").alias("particles"), F.bool_and("rises").alias("rises"), F.bool_and("best").alias("best"))


def reoptimized_times_checks(spark, sf_dir):
    """By run: places as they were, and times that the same legs take no longer than at the least load."""
    rows = reoptimized_times(spark, sf_dir).join(_jobs(spark, sf_dir).select("run", "lon1", "lat1", "lon2", "lat2"), "run")
    on_line = lambda c: F.abs(F.col(c) - (F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col("k") / 5)) < 1e-9
    timed = F.when(F.col("k") == 0, F.col("seconds") == 0).otherwise(F.col("seconds") > 0)
    return rows.groupBy("run").agg(F.count("*").alias("waypoints"), F.bool_and(on_line("lon") & on_line("lat")).alias("in_place"), F.bool_and(timed).alias("timed"))


def sea_paths_checks(spark, sf_dir):
    """By run: a path from end to end, no place or middle of a leg on the bar, around the end it is sent to, and a
    bit longer at most than over the corner of the bar."""
    jobs = _bar_jobs(spark, sf_dir)
    paths = sea_paths(spark, sf_dir).withColumnRenamed("run", "voyage")
    dry = lambda x, y: (F.abs(x) < 1.9) & (F.abs(y) < 9.9)
    legs = voyages.legs(paths).withColumn("wet", ~dry((F.col("lon") + F.col("lon2")) / 2, (F.col("lat") + F.col("lat2")) / 2))
    metres = legs.groupBy("voyage").agg(F.sum("metres").alias("metres"), F.bool_and("wet").alias("wet"))
    each = paths.groupBy("voyage").agg(F.min_by(F.struct("lon", "lat"), "k").alias("a"), F.max_by(F.struct("lon", "lat"), "k").alias("b"), F.max("lat").alias("top"), F.min("lat").alias("bottom"))
    rows = each.join(metres, "voyage").join(jobs, F.col("voyage") == F.col("run"))
    off = lambda p, x, y: F.hypot(F.col(p)["lon"] - F.col(x), F.col(p)["lat"] - F.col(y)) < 1.0
    around = F.when(F.col("bias") == "north", F.col("top") > 9).when(F.col("bias") == "south", F.col("bottom") < -9).otherwise((F.col("top") > 9) | (F.col("bottom") < -9))
    corner = lambda lat: geo.haversine(F.col("lon1"), F.col("lat1"), F.lit(0.0), F.lit(lat)) + geo.haversine(F.lit(0.0), F.lit(lat), F.col("lon2"), F.col("lat2"))
    way = F.when(F.col("bias") == "north", corner(10.0)).when(F.col("bias") == "south", corner(-10.0)).otherwise(F.least(corner(10.0), corner(-10.0)))
    return rows.select("run", (off("a", "lon1", "lat1") & off("b", "lon2", "lat2")).alias("ends"), "wet", around.alias("around"), (F.col("metres") <= way * 1.15).alias("short"))


def trial_search_checks(spark, sf_dir):
    """By trial and route: two seeds, a mean that is a cost, and a deviation."""
    return trial_search(spark, sf_dir).select("trial", "route", "seeds", F.expr("mean < 0 and mean > double('-inf')").alias("costs"), F.expr("deviation >= 0").alias("varies"))


QUERIES = {
    "search_voyages": search_voyages,
    "search_topologies": search_topologies,
    "search_evolution": search_evolution,
    "search_baked": search_baked,
    "search_published": search_published,
    "reoptimized_times": reoptimized_times,
    "sea_paths": sea_paths,
    "benchmark_routes": benchmark_routes,
    "trial_search": trial_search,
    "search_voyages_checks": search_voyages_checks,
    "search_published_checks": search_published_checks,
    "search_baked_checks": search_baked_checks,
    "leg_physics_checks": leg_physics_checks,
    "search_topologies_checks": search_topologies_checks,
    "search_evolution_checks": search_evolution_checks,
    "reoptimized_times_checks": reoptimized_times_checks,
    "sea_paths_checks": sea_paths_checks,
    "benchmark_routes_checks": benchmark_routes_checks,
    "trial_search_checks": trial_search_checks,
}
_RUN = "CAST(n_nationkey AS BIGINT) AS run"
ORACLES: dict[str, str] = {
    "search_voyages_checks": _checks_sql(SMALL.waypoints),
    "search_published_checks": _checks_sql(PUBLISHED.waypoints),
    "search_baked_checks": _checks_sql(SMALL.waypoints),
    "leg_physics_checks": f"SELECT {_RUN}, CAST(k AS INTEGER) AS k, true AS timed, true AS over_land FROM nation, range({SMALL.waypoints - 1}) s(k)",
    "search_topologies_checks": f"SELECT topology, count(*) AS voyages FROM nation, (VALUES {', '.join(f"('{t}')" for t in TOPOLOGIES)}) t(topology) GROUP BY topology",
    "search_evolution_checks": f"SELECT {_RUN}, CAST({TINY.iterations} AS BIGINT) AS iterations, CAST({TINY.particles} AS BIGINT) AS particles, true AS rises, true AS best FROM nation",
    "reoptimized_times_checks": f"SELECT {_RUN}, CAST(6 AS BIGINT) AS waypoints, true AS in_place, true AS timed FROM nation",
    "sea_paths_checks": f"SELECT {_RUN}, true AS ends, true AS wet, true AS around, true AS short FROM nation",
    "benchmark_routes_checks": f"SELECT *, true AS at_sea FROM ({_checks_sql(SMALL.waypoints)})",
    "trial_search_checks": "SELECT CAST(trial AS INTEGER) AS trial, CAST(n_nationkey AS VARCHAR) AS route, CAST(2 AS BIGINT) AS seeds, true AS costs, true AS varies FROM nation, range(2) t(trial)",
}
