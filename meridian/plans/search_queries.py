"""Registered queries on land, swarms and studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.operators import land, study, swarm
from meridian.plans.sqltext import MPD, delta, mod, rnd, tangent, wrap
from meridian.plans.voyage_queries import r
from meridian.session import table
from meridian.sources.observations import OBSERVATIONS_SQL, wind_observations

CELL = 4.0
# An island with a lake and a triangle, as (poly, ring, lon, lat).
VERTICES = [(0, 0, -20.0, -10.0), (0, 0, 20.0, -10.0), (0, 0, 20.0, 30.0), (0, 0, -20.0, 30.0), (0, 1, -5.0, 0.0), (0, 1, 5.0, 0.0), (0, 1, 5.0, 12.0), (0, 1, -5.0, 12.0), (1, 0, 60.0, -40.0), (1, 0, 101.0, -41.0), (1, 0, 80.0, 11.0)]


def vertices(spark):
    rows = [(p, q, k, x, y) for k, (p, q, x, y) in enumerate(VERTICES)]
    return spark.createDataFrame(rows, "poly int, ring int, k int, lon double, lat double")


def rasterize_land(spark, sf_dir):
    return land.rasterized(vertices(spark), 2.0)


def _mask_sql(cell: float) -> str:
    nx, ny = round(360 / cell), round(180 / cell)
    rows = ", ".join(f"({p}, {q}, {k}, {x}::DOUBLE, {y}::DOUBLE)" for k, (p, q, x, y) in enumerate(VERTICES))
    return f"""vx(poly, ring, k, lon, lat) AS (VALUES {rows}), ed AS (SELECT poly, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first(lat) OVER w) AS y2 FROM vx WINDOW w AS (PARTITION BY poly, ring ORDER BY k)),
ce AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, (i + 0.5::DOUBLE) * {cell} - 180 AS lon, (j + 0.5::DOUBLE) * {cell} - 90 AS lat FROM range({nx}) a(i), range({ny}) b(j)),
ins AS (SELECT i, j, poly FROM ce, ed WHERE (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1) GROUP BY i, j, poly HAVING count(*) % 2 = 1),
mk AS (SELECT ce.*, EXISTS (SELECT 1 FROM ins WHERE ins.i = ce.i AND ins.j = ce.j) AS is_land FROM ce)"""


def _raster_sql(cell: float) -> str:
    """Land by scan lines: the cuts of each row's centre line, paired in order."""
    nx, ny = round(360 / cell), round(180 / cell)
    edges = _mask_sql(cell).split("ce AS")[0]
    return f"""{edges}ln AS (SELECT j, (j + 0.5::DOUBLE) * {cell} - 90 AS lat FROM range({ny}) b(j)),
cut AS (SELECT poly, j, x1 + (lat - y1) / (y2 - y1) * (x2 - x1) AS x FROM ed JOIN ln ON (y1 > lat) <> (y2 > lat)),
num AS (SELECT poly, j, x, row_number() OVER (PARTITION BY poly, j ORDER BY x) AS n FROM cut),
pr AS (SELECT a.j, a.x AS lo, b.x AS hi FROM num a JOIN num b ON a.poly = b.poly AND a.j = b.j AND b.n = a.n + 1 WHERE a.n % 2 = 1),
ras AS (SELECT DISTINCT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM pr, range({nx}) c(i) WHERE (i + 0.5::DOUBLE) * {cell} - 180 >= lo AND (i + 0.5::DOUBLE) * {cell} - 180 < hi)"""


RASTERIZE = f"WITH {_raster_sql(2.0)} SELECT i, j FROM ras"


def _sdf(spark):
    return land.signed_distance(land.mask(vertices(spark), CELL), CELL)


def edt_signed(spark, sf_dir):
    return _sdf(spark).select("i", "j", "is_land", r("sdf", 2).alias("sdf"))


_DI = "least(abs(a.i - b.i), 90 - abs(a.i - b.i))"
_SDF = f"""{_mask_sql(CELL)}, sd AS (SELECT a.i, a.j, any_value(a.lon) AS lon, any_value(a.lat) AS lat, any_value(a.is_land) AS is_land, (CASE WHEN any_value(a.is_land) THEN -1 ELSE 1 END) * sqrt(min({_DI} * {_DI} + (a.j - b.j) * (a.j - b.j))) * ({CELL} * {MPD}) AS sdf
  FROM mk a JOIN mk b ON a.is_land <> b.is_land GROUP BY a.i, a.j)"""
EDT = f"WITH {_SDF} SELECT i, j, is_land, {rnd('sdf', 2)} AS sdf FROM sd"


def sdf_gradient(spark, sf_dir):
    return land.gradient(_sdf(spark), CELL).select("i", "j", r("g_east", 5).alias("g_east"), r("g_north", 5).alias("g_north"))


_GRAD = f"""{_SDF}, gr AS (SELECT i, j, lat, (coalesce(lead(sdf) OVER x, first(sdf) OVER xa) - coalesce(lag(sdf) OVER x, last(sdf) OVER xa)) / (greatest(cos(radians(lat)), 1e-9) * {2 * CELL} * {MPD}) AS dx,
  (coalesce(lead(sdf) OVER y, sdf) - coalesce(lag(sdf) OVER y, sdf)) / ({2 * CELL} * {MPD}) AS dy FROM sd WINDOW x AS (PARTITION BY j ORDER BY i), xa AS (PARTITION BY j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), y AS (PARTITION BY i ORDER BY j))"""
GRADIENT = f"WITH {_GRAD} SELECT i, j, {rnd('CASE WHEN sqrt(dx * dx + dy * dy) > 1e-12 THEN dx / sqrt(dx * dx + dy * dy) ELSE 0.0 END', 5)} AS g_east, {rnd('CASE WHEN sqrt(dx * dx + dy * dy) > 1e-12 THEN dy / sqrt(dx * dx + dy * dy) ELSE 0.0 END', 5)} AS g_north FROM gr"


def bilinear_sdf(spark, sf_dir):
    p = wind_observations(spark, sf_dir).select("id", "lon", "lat")
    return land.looked_up(p, _sdf(spark), "sdf", CELL).select("id", r("sdf", 1).alias("sdf"))


BILINEAR = f"""WITH {OBSERVATIONS_SQL}, {_SDF}, p AS (SELECT id, {mod('lon + 180', '360.0::DOUBLE')} / 4 - 0.5::DOUBLE AS x, least(greatest((lat + 90) / 4 - 0.5::DOUBLE, 0.0::DOUBLE), 44.0::DOUBLE) AS y FROM obs),
c AS (SELECT id, CAST({mod('floor(x) + di', 90)} AS INTEGER) AS i, CAST(least(floor(y) + dj, 44) AS INTEGER) AS j, abs(1 - di - (x - floor(x))) * abs(1 - dj - (y - floor(y))) AS w FROM p, range(2) a(di), range(2) b(dj))
SELECT id, {rnd('sum(w * sdf)', 1)} AS sdf FROM c JOIN sd USING (i, j) GROUP BY id"""


def neighbours8(spark, sf_dir):
    grid = land.mask(vertices(spark), CELL)
    near = land.neighbours(grid, CELL).join(grid.select(F.col("i").alias("ni"), F.col("j").alias("nj"), "is_land"), ["ni", "nj"])
    return near.groupBy("i", "j").agg(F.count("*").alias("n"), F.count_if("is_land").alias("land"))


NEIGHBOURS = f"WITH {_mask_sql(CELL)} SELECT a.i, a.j, count(*) AS n, count(*) FILTER (b.is_land) AS land FROM mk a JOIN mk b ON {_DI} <= 1 AND abs(a.j - b.j) <= 1 AND NOT (a.i = b.i AND a.j = b.j) GROUP BY a.i, a.j"


def polygon_boxes(spark, sf_dir):
    return land.boxes(vertices(spark))


POLYGON_BOXES = f"WITH {_mask_sql(CELL)} SELECT poly, min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max FROM vx GROUP BY poly"


def _swarm(spark, sf_dir):
    """Runs of 30 particles; the last may have fewer."""
    o = wind_observations(spark, sf_dir)
    return o.select(F.floor(F.col("id") / 30).alias("run"), (F.col("id") % 30).alias("particle"), (-F.round("speed", 1)).alias("fit"), "lat")


_SWARM = f"WITH {OBSERVATIONS_SQL}, sw AS (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM (SELECT id // 30 AS run, id % 30 AS particle, -round(speed, 1) AS fit, lat FROM obs))"


def gbest_per_iter(spark, sf_dir):
    return swarm.best(_swarm(spark, sf_dir), "run")


GBEST = f"{_SWARM} SELECT run, arg_max(particle, (fit, particle)) AS particle, max(fit) AS fit FROM sw GROUP BY run"


def niche_best(spark, sf_dir):
    return swarm.best(_swarm(spark, sf_dir).withColumn("niche", F.when(F.col("particle") < 6, 0).when(F.col("particle") < 18, 1).otherwise(2)), "run", "niche")


NICHE = f"{_SWARM} SELECT run, CASE WHEN particle < 6 THEN 0 WHEN particle < 18 THEN 1 ELSE 2 END AS niche, arg_max(particle, (fit, particle)) AS particle, max(fit) AS fit FROM sw GROUP BY 1, 2"


def ring_best(spark, sf_dir):
    return swarm.ring_best(_swarm(spark, sf_dir))


RING = f"{_SWARM} SELECT a.run, a.particle, arg_max(b.particle, (b.fit, b.particle)) AS social, max(b.fit) AS social_fit FROM sw a JOIN sw b ON a.run = b.run AND b.particle IN ((a.particle + 1) % a.n, (a.particle + a.n - 1) % a.n) GROUP BY a.run, a.particle"


def torus_best(spark, sf_dir):
    rows = _swarm(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("run")))
    return swarm.torus_best(rows.filter("n = 30"), 30).unionByName(swarm.ring_best(rows.filter("n != 30")))


TORUS = f"""{_SWARM} SELECT a.run, a.particle, arg_max(b.particle, (b.fit, b.particle)) AS social, max(b.fit) AS social_fit FROM sw a JOIN sw b ON a.run = b.run
  AND CASE WHEN a.n = 30 THEN b.particle IN ((a.particle + 6) % 30, (a.particle + 24) % 30, a.particle // 6 * 6 + (a.particle % 6 + 1) % 6, a.particle // 6 * 6 + (a.particle % 6 + 5) % 6)
    ELSE b.particle IN ((a.particle + 1) % a.n, (a.particle + a.n - 1) % a.n) END GROUP BY a.run, a.particle"""


def swarm_spread(spark, sf_dir):
    return swarm.spread(_swarm(spark, sf_dir), "lat").select("run", r("spread", 6).alias("spread"))


SPREAD = f"{_SWARM} SELECT run, {rnd('stddev_pop(lat)', 6)} AS spread FROM sw GROUP BY run"


def pso_step(spark, sf_dir):
    i = F.col("id")
    o = wind_observations(spark, sf_dir).withColumns(
        {"vel_east": (i * 37 % 2000 - 1000) * 50.0, "vel_north": (i * 91 % 2000 - 1000) * 50.0, "best_lon": geo.wrap_lon(F.col("lon") + (i % 40)), "best_lat": F.col("lat") * 0.9, "social_lon": geo.wrap_lon(F.col("lon") - (i % 25)), "social_lat": F.col("lat") * 0.8 + 2, "r1": (i * 7919 % 1000) / 1000.0, "r2": (i * 104729 % 1000) / 1000.0}
    )
    return swarm.stepped(o, 0.33, 2.0, 2.0).select("id", r("lon", 6).alias("lon"), r("lat", 6).alias("lat"), r("vel_east", 2).alias("vel_east"), r("vel_north", 2).alias("vel_north"))


_CE, _CN = tangent("lat", delta("lon", "bx"), "own_y - lat")
_SE, _SN = tangent("lat", delta("lon", "sx"), "sy - lat")
PSO_STEP = f"""WITH {OBSERVATIONS_SQL}, p AS (SELECT id, lon, lat, ((id * 37) % 2000 - 1000) * 50.0::DOUBLE AS ve, ((id * 91) % 2000 - 1000) * 50.0::DOUBLE AS vn, {wrap('lon + id % 40')} AS bx, lat * 0.9::DOUBLE AS own_y, {wrap('lon - id % 25')} AS sx, lat * 0.8::DOUBLE + 2 AS sy, ((id * 7919) % 1000) / 1000.0::DOUBLE AS r1, ((id * 104729) % 1000) / 1000.0::DOUBLE AS r2 FROM obs),
v AS (SELECT id, lon, lat, ve * 0.33::DOUBLE + {_CE} * (2 * r1) + {_SE} * (2 * r2) AS ve, vn * 0.33::DOUBLE + {_CN} * (2 * r1) + {_SN} * (2 * r2) AS vn FROM p)
SELECT id, {rnd(wrap(f'lon + ve / (greatest(cos(radians(lat)), 1e-9) * {MPD})'), 6)} AS lon, {rnd(f'least(greatest(lat + vn / {MPD}, -89.99::DOUBLE), 89.99::DOUBLE)', 6)} AS lat, {rnd('ve', 2)} AS vel_east, {rnd('vn', 2)} AS vel_north FROM v"""


def shape_kick(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    i = F.col("id")
    amount = swarm.shape_offset(i % 20, 20, i % 3 + 2, F.lit(40000.0))
    lon, lat = geo.offset(F.col("lon"), F.col("lat"), amount * 0.6, amount * 0.8)
    return o.select("id", r(amount, 3).alias("amount"), r(lon, 6).alias("lon"), r(lat, 6).alias("lat"))


SHAPE_KICK = f"""WITH {OBSERVATIONS_SQL}, a AS (SELECT id, lon, lat, CASE WHEN id % 20 > 0 AND id % 20 < 19 THEN 40000.0::DOUBLE * sin((id % 3 + 2) * pi() * (id % 20) / 20) ELSE 0.0 END AS m FROM obs)
SELECT id, {rnd('m', 3)} AS amount, {rnd(wrap(f'lon + m * 0.6::DOUBLE / (greatest(cos(radians(lat)), 1e-9) * {MPD})'), 6)} AS lon, {rnd(f'least(greatest(lat + m * 0.8::DOUBLE / {MPD}, -89.99::DOUBLE), 89.99::DOUBLE)', 6)} AS lat FROM a"""


def _results(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("trial"), F.col("o_orderpriority").alias("route"), (F.col("o_custkey") % 5).alias("seed"), (-F.col("o_totalprice")).alias("fitness"))


def _baseline(spark, sf_dir):
    """Every route but one, by its mean over all trials."""
    return _results(spark, sf_dir).filter("route != '5-LOW'").groupBy("route").agg(F.avg("fitness").alias("mean"))


_STUDY = "WITH rs AS (SELECT o_orderkey % 7 AS trial, o_orderpriority AS route, o_custkey % 5 AS seed, -o_totalprice AS fitness FROM orders), br AS (SELECT trial, route, count(*) AS seeds, avg(fitness) AS mean, stddev_pop(fitness) AS deviation FROM rs GROUP BY trial, route), bl AS (SELECT route, avg(fitness) AS mean FROM rs WHERE route <> '5-LOW' GROUP BY route)"


def trial_stats(spark, sf_dir):
    return study.by_route(_results(spark, sf_dir)).select("trial", "route", "seeds", r("mean", 3).alias("mean"), r("deviation", 3).alias("deviation"))


TRIAL_STATS = f"{_STUDY} SELECT trial, route, seeds, {rnd('mean', 3)} AS mean, {rnd('deviation', 3)} AS deviation FROM br"


def trial_totals(spark, sf_dir):
    return study.by_trial(study.by_route(_results(spark, sf_dir))).select("trial", "routes", r("mean", 3).alias("mean"), r("deviation", 3).alias("deviation"))


TRIAL_TOTALS = f"{_STUDY} SELECT trial, count(*) AS routes, {rnd('avg(mean)', 3)} AS mean, {rnd('stddev_pop(mean)', 3)} AS deviation FROM br GROUP BY trial"


def study_score(spark, sf_dir):
    return study.scores(study.by_route(_results(spark, sf_dir)), _baseline(spark, sf_dir)).select("trial", r("score", 9).alias("score"))


STUDY_SCORE = f"{_STUDY} SELECT trial, {rnd('avg(br.mean / bl.mean)', 9)} AS score FROM br JOIN bl USING (route) GROUP BY trial"


def routes_missing_baseline(spark, sf_dir):
    return study.unknown_routes(_results(spark, sf_dir), _baseline(spark, sf_dir))


MISSING = f"{_STUDY} SELECT DISTINCT route FROM rs WHERE route NOT IN (SELECT route FROM bl)"


def trial_plan(spark, sf_dir):
    rs = _results(spark, sf_dir)
    pick = lambda c: rs.select(c).distinct()
    return study.planned(pick("route"), pick("seed"), pick("trial")).select("trial", "route", "seed")


TRIAL_PLAN = f"{_STUDY} SELECT trial, route, seed FROM (SELECT DISTINCT trial FROM rs), (SELECT DISTINCT route FROM rs), (SELECT DISTINCT seed FROM rs)"

QUERIES = {
    "rasterize_land": rasterize_land,
    "edt_signed": edt_signed,
    "sdf_gradient": sdf_gradient,
    "bilinear_sdf": bilinear_sdf,
    "neighbours8": neighbours8,
    "polygon_boxes": polygon_boxes,
    "gbest_per_iter": gbest_per_iter,
    "niche_best": niche_best,
    "ring_best": ring_best,
    "torus_best": torus_best,
    "swarm_spread": swarm_spread,
    "pso_step": pso_step,
    "shape_kick": shape_kick,
    "trial_stats": trial_stats,
    "trial_totals": trial_totals,
    "study_score": study_score,
    "routes_missing_baseline": routes_missing_baseline,
    "trial_plan": trial_plan,
}
ORACLES = {
    "rasterize_land": RASTERIZE,
    "edt_signed": EDT,
    "sdf_gradient": GRADIENT,
    "bilinear_sdf": BILINEAR,
    "neighbours8": NEIGHBOURS,
    "polygon_boxes": POLYGON_BOXES,
    "gbest_per_iter": GBEST,
    "niche_best": NICHE,
    "ring_best": RING,
    "torus_best": TORUS,
    "swarm_spread": SPREAD,
    "pso_step": PSO_STEP,
    "shape_kick": SHAPE_KICK,
    "trial_stats": TRIAL_STATS,
    "trial_totals": TRIAL_TOTALS,
    "study_score": STUDY_SCORE,
    "routes_missing_baseline": MISSING,
    "trial_plan": TRIAL_PLAN,
}
