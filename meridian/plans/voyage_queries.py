"""Registered queries on voyages: geometry, clocks, shapes, physics, integrals and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions import geo, ship as physics, text
from meridian.operators import voyages as ops
from meridian.plans.sqltext import MPD, brg, delta, dest, hav, mod, rnd, tangent, wrap
from meridian.session import spread
from meridian.sources.observations import OBSERVATIONS_SQL, VOYAGES_SQL, voyages, wind_observations

SHIP = physics.Ship()


def r(c, n):
    """Rounded, without a negative zero."""
    return F.round(c, n) + F.lit(0.0)


def leg_geometry(spark, sf_dir) -> DataFrame:
    out = ops.legs(voyages(spark, sf_dir))
    return out.select("voyage", "k", r("metres", 3).alias("metres"), r("bearing", 6).alias("bearing"), r(geo.lon_delta(F.col("lon"), F.col("lon2")), 6).alias("dlon"))


_LEGS = f"WITH {VOYAGES_SQL}, leg AS (SELECT * FROM (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(seconds) OVER w AS seconds2 FROM voy WINDOW w AS (PARTITION BY voyage ORDER BY k)) WHERE lon2 IS NOT NULL)"
LEG_GEOMETRY = f"{_LEGS} SELECT voyage, k, {rnd(hav('lon', 'lat', 'lon2', 'lat2'), 3)} AS metres, {rnd(brg('lon', 'lat', 'lon2', 'lat2'), 6)} AS bearing, {rnd(delta('lon', 'lon2'), 6)} AS dlon FROM leg"


def running_clock(spark, sf_dir):
    out = ops.running_clock(voyages(spark, sf_dir))
    return out.select("voyage", "k", "seconds", "depart", "arrive", F.pmod(F.round(F.col("arrive") / 3600), F.lit(24.0)).cast("int").alias("frame"))


RUNNING_CLOCK = f"WITH {VOYAGES_SQL}, c AS (SELECT *, sum(seconds) OVER (PARTITION BY voyage ORDER BY k) AS arrive FROM voy) SELECT voyage, k, seconds, arrive - seconds AS depart, arrive, CAST({mod('round(arrive / 3600)', 24)} AS INTEGER) AS frame FROM c"


def cumulative_arc(spark, sf_dir):
    return ops.arc_lengths(voyages(spark, sf_dir)).select("voyage", "k", r("arc", 2).alias("arc"))


_ARC = f"""{VOYAGES_SQL}, st AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM voy WINDOW w AS (PARTITION BY voyage ORDER BY k)),
arc AS (SELECT *, sum(CASE WHEN lon0 IS NULL THEN 0.0::DOUBLE ELSE {hav('lon0', 'lat0', 'lon', 'lat')} END) OVER (PARTITION BY voyage ORDER BY k) AS arc FROM st)"""
CUMULATIVE_ARC = f"WITH {_ARC} SELECT voyage, k, {rnd('arc', 2)} AS arc FROM arc"


def arc_resample(spark, sf_dir):
    out = ops.resample(voyages(spark, sf_dir), 20)
    return out.select("voyage", "i", r("lon", 5).alias("lon"), r("lat", 5).alias("lat"))


ARC_RESAMPLE = f"""WITH {_ARC}, seg AS (SELECT *, lag(arc) OVER (PARTITION BY voyage ORDER BY k) AS lo, max(arc) OVER (PARTITION BY voyage) AS total FROM arc),
t AS (SELECT DISTINCT voyage, i, i / 19.0::DOUBLE * total AS target FROM seg, range(1, 19) g(i)),
mid AS (SELECT t.voyage, i, lon0 * (1 - f) + lon * f AS lon, lat0 * (1 - f) + lat * f AS lat
        FROM (SELECT t.*, s.*, (target - lo) / greatest(arc - lo, 1e-12) AS f FROM t JOIN seg s ON s.voyage = t.voyage AND s.lo IS NOT NULL AND target > lo AND target <= arc) t),
ends AS (SELECT voyage, 0 AS i, arg_min(lon, k) AS lon, arg_min(lat, k) AS lat FROM voy GROUP BY voyage UNION ALL SELECT voyage, 19, arg_max(lon, k), arg_max(lat, k) FROM voy GROUP BY voyage)
SELECT voyage, CAST(i AS INTEGER) AS i, {rnd('lon', 5)} AS lon, {rnd('lat', 5)} AS lat FROM (SELECT * FROM mid UNION ALL SELECT * FROM ends)"""


def unwrapped_voyage_bbox(spark, sf_dir):
    # courses of a dozen waypoints, or most boxes would be the whole circle
    parts = voyages(spark, sf_dir).withColumn("voyage", F.col("voyage") * 100_000 + F.floor(F.col("k") / 12))
    return ops.unwrapped_box(parts).select("voyage", *[r(c, 6).alias(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")])


UNWRAPPED_BBOX = f"""WITH {VOYAGES_SQL}, s AS (SELECT *, lag(lon) OVER (PARTITION BY voyage ORDER BY k) AS lon0 FROM (SELECT * REPLACE (voyage * 100000 + k // 12 AS voyage) FROM voy)),
u AS (SELECT *, sum(CASE WHEN lon0 IS NULL THEN lon ELSE {delta('lon0', 'lon')} END) OVER (PARTITION BY voyage ORDER BY k) AS far FROM s),
b AS (SELECT voyage, min(far) AS w, max(far) AS e, min(lat) AS s, max(lat) AS n FROM u GROUP BY voyage),
p AS (SELECT voyage, w - greatest((e - w) * 0.2, 3.0) AS w, e + greatest((e - w) * 0.2, 3.0) AS e, s - greatest((n - s) * 0.2, 3.0) AS s, n + greatest((n - s) * 0.2, 3.0) AS n FROM b)
SELECT voyage, {rnd(f"CASE WHEN e - w >= 360 THEN -180.0::DOUBLE ELSE {wrap('w')} END", 6)} AS lon_min, {rnd(f"CASE WHEN e - w >= 360 THEN 180.0::DOUBLE ELSE {wrap('e')} END", 6)} AS lon_max,
  {rnd('greatest(s, -89.99)', 6)} AS lat_min, {rnd('least(n, 89.99)', 6)} AS lat_max FROM p"""


def destination_points(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    lon, lat = geo.destination(F.col("lon"), F.col("lat"), F.col("speed") * 1000, F.radians("direction"))
    return o.select("id", r(lon, 6).alias("lon"), r(lat, 6).alias("lat"))


_X, _Y = dest("lon", "lat", "speed * 1000", "radians(direction)")
DESTINATION = f"WITH {OBSERVATIONS_SQL} SELECT id, {rnd(_X, 6)} AS lon, {rnd(_Y, 6)} AS lat FROM obs"


def tangent_offsets(spark, sf_dir):
    out = ops.legs(voyages(spark, sf_dir))
    east, north = geo.delta_to_tangent(F.col("lat"), geo.lon_delta(F.col("lon"), F.col("lon2")), F.col("lat2") - F.col("lat"))
    out = out.withColumn("east", east).withColumn("north", north)
    lon, lat = geo.offset(F.col("lon"), F.col("lat"), F.col("east") / 2, F.col("north") / 2)
    line = geo.line_latitude(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"), lon)
    return out.select("voyage", "k", r("east", 2).alias("east"), r("north", 2).alias("north"), r(lon, 6).alias("mid_lon"), r(lat, 6).alias("mid_lat"), r(line, 6).alias("line_lat"))


_E, _N = tangent("lat", delta("lon", "lon2"), "lat2 - lat")
TANGENT = f"""{_LEGS}, t AS (SELECT *, {_E} AS east, {_N} AS north FROM leg),
m AS (SELECT *, {wrap(f"lon + east / 2 / (greatest(cos(radians(lat)), 1e-9) * {MPD})")} AS mid_lon, least(greatest(lat + north / 2 / {MPD}, -89.99), 89.99) AS mid_lat, {delta('lon', 'lon2')} AS span FROM t)
SELECT voyage, k, {rnd('east', 2)} AS east, {rnd('north', 2)} AS north, {rnd('mid_lon', 6)} AS mid_lon, {rnd('mid_lat', 6)} AS mid_lat,
  {rnd(f"CASE WHEN abs(span) < 1e-12 THEN (lat + lat2) / 2 ELSE lat + (lat2 - lat) * least(greatest({delta('lon', 'mid_lon')} / span, 0.0), 1.0) END", 6)} AS line_lat FROM m"""


def path_perpendiculars(spark, sf_dir):
    return ops.perpendiculars(voyages(spark, sf_dir)).select("voyage", "k", r("perp_east", 6).alias("perp_east"), r("perp_north", 6).alias("perp_north"))


_PE, _PN = tangent("lat", delta("px", "nx"), "ny - py")
PERPENDICULARS = f"""WITH {VOYAGES_SQL}, l AS (SELECT *, coalesce(lag(lon) OVER w, lon) AS px, coalesce(lag(lat) OVER w, lat) AS py, coalesce(lead(lon) OVER w, lon) AS nx, coalesce(lead(lat) OVER w, lat) AS ny FROM voy WINDOW w AS (PARTITION BY voyage ORDER BY k)),
t AS (SELECT *, {_PE} AS e, {_PN} AS n FROM l), s AS (SELECT *, sqrt(e * e + n * n) AS z FROM t)
SELECT voyage, k, {rnd('CASE WHEN z > 1e-12 THEN -n / z ELSE 0.0 END', 6)} AS perp_east, {rnd('CASE WHEN z > 1e-12 THEN e / z ELSE 1.0 END', 6)} AS perp_north FROM s"""


def endpoint_pin(spark, sf_dir):
    out = ops.pinned(voyages(spark, sf_dir), geo.Box(150.0, -120.0, -40.0, 50.0), (160.0, 10.0, -130.0, 20.0))
    return out.select("voyage", "k", r("lon", 6).alias("lon"), r("lat", 6).alias("lat"))


_CLAMP = f"CASE WHEN lon >= 150 OR lon <= -120 THEN lon WHEN abs({delta('lon', '150.0::DOUBLE')}) <= abs({delta('lon', '-120.0::DOUBLE')}) THEN 150.0::DOUBLE ELSE -120.0::DOUBLE END"
ENDPOINT_PIN = f"""WITH {VOYAGES_SQL}, m AS (SELECT *, max(k) OVER (PARTITION BY voyage) AS last FROM voy)
SELECT voyage, k, {rnd(f'CASE WHEN k = 0 THEN 160.0 WHEN k = last THEN -130.0 ELSE {_CLAMP} END', 6)} AS lon,
  {rnd('CASE WHEN k = 0 THEN 10.0 WHEN k = last THEN 20.0 ELSE least(greatest(lat, -40.0), 50.0) END', 6)} AS lat FROM m"""


def closest_waypoint(spark, sf_dir):
    return ops.nearest_waypoint(voyages(spark, sf_dir), 12.5, 20.25, 60.0)


CLOSEST = f"WITH {VOYAGES_SQL}, d AS (SELECT *, (lon - 12.5::DOUBLE) * (lon - 12.5::DOUBLE) + (lat - 20.25::DOUBLE) * (lat - 20.25::DOUBLE) AS d2 FROM voy) SELECT voyage, arg_min(k, (d2, k)) AS k FROM d GROUP BY voyage HAVING min(d2) <= 3600"


def bbox_filter_wrap(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    return o.filter(geo.Box(170.0, -150.0, -30.0, 40.0).holds(F.col("lon"), F.col("lat"))).select("id", "lon", "lat")


BBOX_FILTER = f"WITH {OBSERVATIONS_SQL} SELECT id, lon, lat FROM obs WHERE (lon >= 170 OR lon <= -150) AND lat BETWEEN -30 AND 40"


def bbox_clamp(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    lon, lat = geo.Box(150.0, -120.0, -40.0, 50.0).clamp(F.col("lon"), F.col("lat"))
    x, y = geo.Box(-20.0, 35.0, -89.999, 10.0).clamp(F.col("lon"), F.col("lat"))
    return o.select("id", lon.alias("lon_wrapped"), lat.alias("lat_wrapped"), x.alias("lon_plain"), y.alias("lat_plain"))


BBOX_CLAMP = f"WITH {OBSERVATIONS_SQL} SELECT id, {_CLAMP} AS lon_wrapped, least(greatest(lat, -40.0::DOUBLE), 50.0::DOUBLE) AS lat_wrapped, least(greatest(lon, -20.0::DOUBLE), 35.0::DOUBLE) AS lon_plain, least(greatest(lat, -89.99::DOUBLE), 10.0::DOUBLE) AS lat_plain FROM obs"


def segment_fuel(spark, sf_dir):
    out = ops.legs(voyages(spark, sf_dir)).withColumn("load", (F.col("k") % 11) / 10.0).withColumn("seconds", (F.col("k") % 7) * 3600.0)
    out = ops.segment_metrics(out, SHIP)
    u, v = F.lit(3.0) + F.col("k") % 5, F.lit(-2.0) + F.col("k") % 3
    sail = SHIP.wind_speed(F.col("bearing"), u, v)
    return out.select("voyage", "k", r("fuel", 6).alias("fuel"), r("speed_kmh", 4).alias("speed_kmh"), r(sail, 6).alias("sail"), r(SHIP.motor_speed(sail, F.col("load")), 6).alias("speed"))


_FUEL = "(CASE WHEN load <= 0 THEN 0.0 ELSE load * (0.0875::DOUBLE - 0.0555::DOUBLE * load + 0.0347::DOUBLE * load * load) END)"


def _sail(b, u, v):
    return f"(CASE WHEN sqrt(({u}) * ({u}) + ({v}) * ({v})) = 0 THEN 0.0 ELSE 1.5::DOUBLE * (1 + abs(sin({b}) * ({v}) - cos({b}) * ({u})) / sqrt(({u}) * ({u}) + ({v}) * ({v}))) / 2 * sqrt(({u}) * ({u}) + ({v}) * ({v})) END)"


SEGMENT_FUEL = f"""{_LEGS}, s AS (SELECT voyage, k, (k % 11) / 10.0::DOUBLE AS load, (k % 7) * 3600.0::DOUBLE AS seconds, {hav('lon', 'lat', 'lon2', 'lat2')} AS metres, {brg('lon', 'lat', 'lon2', 'lat2')} AS b, 3.0::DOUBLE + k % 5 AS u, -2.0::DOUBLE + k % 3 AS v FROM leg),
w AS (SELECT *, {_sail('b', 'u', 'v')} AS sail FROM s)
SELECT voyage, k, {rnd(f'CASE WHEN seconds <= 0 OR load <= 0 THEN 0.0 ELSE {_FUEL} * seconds END', 6)} AS fuel, {rnd('CASE WHEN seconds > 0 THEN metres / seconds * 3.6 ELSE 0.0 END', 4)} AS speed_kmh,
  {rnd('sail', 6)} AS sail, {rnd('cbrt(sail * sail * sail + load * 1000000.0::DOUBLE / 2000.0::DOUBLE)', 6)} AS speed FROM w"""

# A wind gap around a centre, in degrees and metres per second.
GAP = (-5.0, 50.0, 3.0, 8.0)
SUBSTEPS = 20


def gap_wind(lon, lat, t):
    x, y, s, base = GAP
    r2 = (lon - x) * (lon - x) + (lat - y) * (lat - y)
    return base * (1 - F.exp(-0.5 * r2 / (s * s))), F.lit(0.0)


def short_legs(spark, sf_dir):
    """Legs of a few degrees that start at an observation, away from the antimeridian."""
    o = spread(wind_observations(spark, sf_dir), "id").withColumn("lon", F.col("lon") / 2).withColumn("lat", F.col("lat") / 2)
    return o.withColumn("lon2", F.col("lon") + 1 + F.col("id") % 7).withColumn("lat2", F.col("lat") + F.col("id") % 5 - 2)


_SHORT = f"WITH RECURSIVE {OBSERVATIONS_SQL}, sl AS (SELECT id, lon / 2 AS lon, lat / 2 AS lat, lon / 2 + 1 + id % 7 AS lon2, lat / 2 + id % 5 - 2 AS lat2 FROM obs)"


def travel_time_gap(spark, sf_dir):
    c = [F.col(x) for x in ("lon", "lat", "lon2", "lat2")]
    t = ops.travel_time(*c, F.lit(0.5), F.lit(0.0), SHIP, gap_wind, SUBSTEPS)
    return short_legs(spark, sf_dir).select("id", r(t, 3).alias("seconds"))


def _gap_u(x, y):
    return f"(8.0::DOUBLE * (1 - exp(-0.5::DOUBLE * ((({x}) + 5) * (({x}) + 5) + (({y}) - 50) * (({y}) - 50)) / 9)))"


_MX, _MY = dest("lon", "lat", "step / 2", "b")
_NX, _NY = dest("lon", "lat", "step", "b")
_V1 = f"cbrt(pow({_sail('b', _gap_u('lon', 'lat'), '0.0::DOUBLE')}, 3) + 250.0::DOUBLE)"
_V2 = f"cbrt(pow({_sail('b', _gap_u('mx', 'my'), '0.0::DOUBLE')}, 3) + 250.0::DOUBLE)"
TRAVEL_TIME = f"""{_SHORT}, f AS (
  SELECT id, 0 AS n, lon, lat, lon2, lat2, {hav('lon', 'lat', 'lon2', 'lat2')} / {SUBSTEPS} AS step, 0.0::DOUBLE AS t FROM sl
  UNION ALL SELECT id, n + 1, nx, ny, lon2, lat2, step, t + step / v FROM (SELECT *, {_V2} AS v FROM (SELECT *, {_MX} AS mx, {_MY} AS my, {_NX} AS nx, {_NY} AS ny FROM (SELECT *, {brg('lon', 'lat', 'lon2', 'lat2')} AS b FROM f WHERE n < {SUBSTEPS}))))
SELECT id, {rnd('t', 3)} AS seconds FROM f WHERE n = {SUBSTEPS}"""


def box_land(lon, lat):
    return lon.between(-10.0, 30.0) & lat.between(-20.0, 15.0)


def land_metres(spark, sf_dir):
    c = [F.col(x) for x in ("lon", "lat", "lon2", "lat2")]
    return short_legs(spark, sf_dir).select("id", r(ops.land_metres(*c, box_land, SUBSTEPS), 2).alias("land_m"))


LAND_METRES = f"""{_SHORT}, f AS (
  SELECT id, 0 AS n, lon, lat, lon2, lat2, {hav('lon', 'lat', 'lon2', 'lat2')} / {SUBSTEPS} AS step, 0.0::DOUBLE AS m FROM sl
  UNION ALL SELECT id, n + 1, nx, ny, lon2, lat2, step, m + CASE WHEN mx BETWEEN -10 AND 30 AND my BETWEEN -20 AND 15 THEN step ELSE 0 END FROM (SELECT *, {_MX} AS mx, {_MY} AS my, {_NX} AS nx, {_NY} AS ny FROM (SELECT *, {brg('lon', 'lat', 'lon2', 'lat2')} AS b FROM f WHERE n < {SUBSTEPS})))
SELECT id, {rnd('m', 2)} AS land_m FROM f WHERE n = {SUBSTEPS}"""


def solve_throttle(spark, sf_dir):
    """In a steady wind, where one substep is exact."""
    still = lambda lon, lat, t: (F.lit(5.0), F.lit(0.0))
    legs = short_legs(spark, sf_dir).withColumn("seconds", geo.haversine(*[F.col(x) for x in ("lon", "lat", "lon2", "lat2")]) / (4.0 + F.col("id") % 6))
    c = [F.col(x) for x in ("lon", "lat", "lon2", "lat2")]
    return legs.select("id", r(ops.throttle(*c, F.col("seconds"), F.lit(0.0), SHIP, still, 1), 6).alias("load"))


_T = lambda load: f"(d / cbrt(pow(w, 3) + ({load}) * 500.0::DOUBLE))"
SOLVE_THROTTLE = f"""{_SHORT}, b AS (SELECT id, {hav('lon', 'lat', 'lon2', 'lat2')} AS d, {_sail(brg('lon', 'lat', 'lon2', 'lat2'), '5.0::DOUBLE', '0.0::DOUBLE')} AS w FROM sl),
s AS (SELECT id, d, w, d / (4.0::DOUBLE + id % 6) AS want, 0 AS n, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM b
  UNION ALL SELECT id, d, w, want, n + 1, CASE WHEN {_T('(lo + hi) / 2')} > want THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_T('(lo + hi) / 2')} > want THEN hi ELSE (lo + hi) / 2 END FROM s WHERE n < 12)
SELECT id, {rnd(f"CASE WHEN want <= {_T('1.0')} THEN 1.0 WHEN want >= {_T('0.0')} THEN 0.0 ELSE (lo + hi) / 2 END", 6)} AS load FROM s WHERE n = 12"""


def _segments(spark, sf_dir):
    out = ops.legs(voyages(spark, sf_dir)).withColumn("load", (F.col("k") % 11) / 10.0).withColumn("seconds", (F.col("k") % 7) * 3600.0)
    return ops.segment_metrics(out, SHIP).withColumn("land_m", F.when(box_land(F.col("lon"), F.col("lat")), F.lit(1000.0)).otherwise(F.lit(0.0)))


def route_totals(spark, sf_dir):
    return ops.totals(_segments(spark, sf_dir)).select("voyage", "seconds", r("fuel", 4).alias("fuel"), "land_m")


_SEGMENTS = f"""{_LEGS}, sg AS (SELECT voyage, (k % 7) * 3600.0::DOUBLE AS seconds, (k % 11) / 10.0::DOUBLE AS load, CASE WHEN lon BETWEEN -10 AND 30 AND lat BETWEEN -20 AND 15 THEN 1000.0::DOUBLE ELSE 0.0 END AS land_m FROM leg),
tot AS (SELECT voyage, sum(seconds) AS seconds, sum(CASE WHEN seconds <= 0 OR load <= 0 THEN 0.0 ELSE {_FUEL} * seconds END) AS fuel, sum(land_m) AS land_m FROM sg GROUP BY voyage)"""
ROUTE_TOTALS = f"{_SEGMENTS} SELECT voyage, seconds, {rnd('fuel', 4)} AS fuel, land_m FROM tot"


def weighted_fitness(spark, sf_dir):
    t = ops.totals(_segments(spark, sf_dir))
    a = physics.fitness(F.col("seconds"), F.col("fuel"), F.col("land_m"), 1.0, 10.0, 50.0)
    b = physics.fitness(F.col("seconds"), F.col("fuel"), F.col("land_m") * float("inf"), 1.0, 10.0, 0.0)
    return t.select("voyage", r(a, 2).alias("fitness"), r(b, 2).alias("fitness_no_land"))


WEIGHTED_FITNESS = f"{_SEGMENTS} SELECT voyage, {rnd('-(seconds + fuel * 10 + land_m * 50)', 2)} AS fitness, {rnd('-(seconds + fuel * 10)', 2)} AS fitness_no_land FROM tot"


def formats(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    s = (F.col("id") * 97 % 200000).cast("double")
    kg, metres, fit = (F.col("id") * 13 % 40000) / 17.0, (F.col("id") * 7 % 90000 + 0.3) / 19.0, -(F.col("id") * 1009 % 30000000) / 23.0
    return o.select("id", text.duration(s).alias("duration"), text.fuel(kg).alias("fuel"), text.land_km(metres).alias("land"), text.magnitude(fit).alias("fitness"), text.against(s, s + (F.col("id") % 3 - 1) * 10, False).alias("delta"), text.box_flag(F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat") + 1).alias("box"))


def kick_schedule(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    step, u = F.col("id") % 41, ((F.col("id") * 7919 % 9973) + 0.5) / 9973.0
    gamma = physics.cosine_decay(step, 40, 60000.0, 5000.0)
    return o.select("id", r(gamma, 3).alias("gamma"), r(physics.cauchy(u), 5).alias("cauchy"))


KICK_SCHEDULE = f"""WITH {OBSERVATIONS_SQL} SELECT id, {rnd("5000 + 55000 * 0.5::DOUBLE * (1 + cos(least(greatest((id % 41 - 1) / 39.0::DOUBLE, 0.0), 1.0) * pi()))", 3)} AS gamma,
  {rnd("tan((((id * 7919) % 9973 + 0.5::DOUBLE) / 9973.0::DOUBLE - 0.5::DOUBLE) * pi())", 5)} AS cauchy FROM obs"""


def fuel_curve(spark, sf_dir):
    load = F.col("i") / 64.0
    return spark.range(65).withColumnRenamed("id", "i").select("i", load.alias("load"), r(SHIP.fuel_rate(load), 9).alias("rate"))


FUEL_CURVE = f"SELECT i, load, {rnd(_FUEL, 9)} AS rate FROM (SELECT i, i / 64.0::DOUBLE AS load FROM range(65) t(i))"

QUERIES = {
    "leg_geometry": leg_geometry,
    "running_clock": running_clock,
    "cumulative_arc": cumulative_arc,
    "arc_resample": arc_resample,
    "unwrapped_voyage_bbox": unwrapped_voyage_bbox,
    "destination_points": destination_points,
    "tangent_offsets": tangent_offsets,
    "path_perpendiculars": path_perpendiculars,
    "endpoint_pin": endpoint_pin,
    "closest_waypoint": closest_waypoint,
    "bbox_filter_wrap": bbox_filter_wrap,
    "bbox_clamp": bbox_clamp,
    "segment_fuel": segment_fuel,
    "travel_time_gap": travel_time_gap,
    "land_metres": land_metres,
    "solve_throttle": solve_throttle,
    "route_totals": route_totals,
    "weighted_fitness": weighted_fitness,
    "formats": formats,
    "kick_schedule": kick_schedule,
    "fuel_curve": fuel_curve,
}
FORMATS = f"""WITH {OBSERVATIONS_SQL}, v AS (SELECT *, (id * 97) % 200000 AS s, ((id * 13) % 40000) / 17.0::DOUBLE AS kg, ((id * 7) % 90000 + 0.3::DOUBLE) / 19.0::DOUBLE AS m, ((id * 1009) % 30000000) / 23.0::DOUBLE AS f, (id % 3 - 1) * 10 AS d FROM obs)
SELECT id, CASE WHEN s >= 86400 THEN printf('%dd %dh %dm %ds', s // 86400, (s % 86400) // 3600, (s % 3600) // 60, s % 60) WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, (s % 3600) // 60, s % 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration,
  CASE WHEN kg >= 1000 THEN printf('%.3f t', kg / 1000) ELSE printf('%.2f kg', kg) END AS fuel, printf('%.2f km', m / 1000) AS land,
  CASE WHEN f >= 1e6 THEN printf('%.3fM', f / 1e6) ELSE printf('%.3fK', f / 1e3) END AS fitness,
  CASE WHEN abs(s + d) < 1e-12 THEN 'PSO N/A' WHEN d = 0 THEN 'PSO equal' WHEN d > 0 THEN printf('PSO %.1f%% better', abs(d) / abs(s + d)::DOUBLE * 100) ELSE printf('PSO %.1f%% worse', abs(d) / abs(s + d)::DOUBLE * 100) END AS delta,
  printf('%.4f,%.4f,%.4f,%.4f', lon, lat, lon + 1, lat + 1) AS box FROM v"""
ORACLES = {
    "leg_geometry": LEG_GEOMETRY,
    "running_clock": RUNNING_CLOCK,
    "cumulative_arc": CUMULATIVE_ARC,
    "arc_resample": ARC_RESAMPLE,
    "unwrapped_voyage_bbox": UNWRAPPED_BBOX,
    "destination_points": DESTINATION,
    "tangent_offsets": TANGENT,
    "path_perpendiculars": PERPENDICULARS,
    "endpoint_pin": ENDPOINT_PIN,
    "closest_waypoint": CLOSEST,
    "bbox_filter_wrap": BBOX_FILTER,
    "bbox_clamp": BBOX_CLAMP,
    "segment_fuel": SEGMENT_FUEL,
    "travel_time_gap": TRAVEL_TIME,
    "land_metres": LAND_METRES,
    "solve_throttle": SOLVE_THROTTLE,
    "route_totals": ROUTE_TOTALS,
    "weighted_fitness": WEIGHTED_FITNESS,
    "formats": FORMATS,
    "kick_schedule": KICK_SCHEDULE,
    "fuel_curve": FUEL_CURVE,
}
