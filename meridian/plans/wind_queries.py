"""Registered queries on wind: ingest, grids, lookups in space and time, resampling and drift."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from meridian.functions import geo, text, winds
from meridian.operators import grids as ops
from meridian.plans.sqltext import circ, mod, rnd
from meridian.plans.voyage_queries import r
from meridian.session import table
from meridian.sources import archive, grib
from meridian.sources.observations import OBSERVATIONS_SQL, wind_observations

# The grid that queries look up, by whole-number rules.
GRID = ops.Grid(-180.0, -80.0, 10.0, 10.0, 36, 17, 6, 21600.0)
ONTO = ops.Grid(-60.0, -40.0, 7.5, 7.5, 17, 11)


def frames(spark):
    f, i, j = F.col("f"), F.col("i"), F.col("j")
    speed = ((i * 7 + j * 13 + f * 5) % 30) + 0.5
    return ops.lattice(spark, GRID).withColumn("speed", speed.cast("double")).withColumn("direction", ((i * 37 + j * 53 + f * 91) % 360).cast("double"))


FRAMES_SQL = """fr AS (SELECT f, i, j, i * 10 - 180.0::DOUBLE AS lon, j * 10 - 80.0::DOUBLE AS lat, ((i * 7 + j * 13 + f * 5) % 30) + 0.5::DOUBLE AS speed, CAST((i * 37 + j * 53 + f * 91) % 360 AS DOUBLE) AS direction
  FROM (SELECT CAST(f AS INTEGER) AS f, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM range(6) a(f), range(36) b(i), range(17) c(j)))"""


def points(spark, sf_dir):
    return wind_observations(spark, sf_dir).select("id", "lon", "lat", F.col("t_seconds").cast("double").alias("t"))


def uv_from_dir(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    u, v = winds.components(F.col("speed"), F.col("direction"))
    x, y = winds.toward(F.col("speed"), F.col("direction"))
    return o.select("id", r(u, 6).alias("u"), r(v, 6).alias("v"), r(x, 6).alias("toward_u"), r(y, 6).alias("toward_v"))


UV_FROM_DIR = f"""WITH {OBSERVATIONS_SQL} SELECT id, {rnd('speed * cos(radians(270 - direction))', 6)} AS u, {rnd('speed * sin(radians(270 - direction))', 6)} AS v,
  {rnd('-speed * (1852.0::DOUBLE / 3600) * sin(radians(direction))', 6)} AS toward_u, {rnd('-speed * (1852.0::DOUBLE / 3600) * cos(radians(direction))', 6)} AS toward_v FROM obs"""


def uv_roundtrip(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    u, v = winds.components(F.col("speed"), F.col("direction"))
    rows = o.withColumn("u", u).withColumn("v", v)
    back = F.pmod(winds.direction_or_north(F.col("u"), F.col("v")) + 0.00005, F.lit(360.0)) - 0.00005  # 360 counts as 0
    return rows.select("id", r(winds.speed(F.col("u"), F.col("v")), 6).alias("speed"), r(back, 4).alias("direction"))


UV_ROUNDTRIP = f"WITH {OBSERVATIONS_SQL} SELECT id, {rnd('speed', 6)} AS speed, {rnd('CASE WHEN speed = 0 THEN 0.0 ELSE direction END', 4)} AS direction FROM obs"


def quantize10(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    u, _ = winds.components(F.col("speed") * 3, F.col("direction"))
    code = winds.encode(r(u, 4))
    return o.select("id", code.alias("code"), r(winds.decode(code), 6).alias("back"), (GRID.ny - 1 - F.col("id") % GRID.ny).alias("row"))


QUANTIZE = f"""WITH {OBSERVATIONS_SQL}, c AS (SELECT id, CAST(least(greatest(round((({rnd('speed * 3 * cos(radians(270 - direction))', 4)}) + 60) / 120 * 1023), 0), 1023) AS INTEGER) AS code FROM obs)
SELECT id, code, {rnd('code / 1023.0::DOUBLE * 120 - 60', 6)} AS back, 16 - id % 17 AS row FROM c"""


def stride_decimate(spark, sf_dir):
    o = wind_observations(spark, sf_dir).filter(F.col("lon").between(-60.0, 60.0) & F.col("lat").between(-40.0, 40.0))
    cells = o.withColumn("lon", F.floor("lon").cast("double")).withColumn("lat", F.floor("lat").cast("double"))
    return ops.stride(cells, 3).select("id", "lon", "lat")


STRIDE = f"""WITH {OBSERVATIONS_SQL}, c AS (SELECT id, floor(lon) AS lon, floor(lat) AS lat FROM obs WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -40 AND 40),
x AS (SELECT lon, row_number() OVER (ORDER BY lon) - 1 AS k FROM (SELECT DISTINCT lon FROM c)), y AS (SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS k FROM (SELECT DISTINCT lat FROM c))
SELECT c.id, c.lon, c.lat FROM c JOIN x ON x.lon = c.lon AND x.k % 3 = 0 JOIN y ON y.lat = c.lat AND y.k % 3 = 0"""


def _hourly(spark, sf_dir):
    return wind_observations(spark, sf_dir).withColumn("t_seconds", F.floor(F.col("t_seconds") / 10800) * 10800)


_HOURLY = f"{OBSERVATIONS_SQL}, h AS (SELECT * REPLACE (CAST(floor(t_seconds / 10800) * 10800 AS BIGINT) AS t_seconds) FROM obs)"


def frame_group(spark, sf_dir):
    out = ops.frames_of(_hourly(spark, sf_dir))
    return out.groupBy("f", "t_seconds").agg(F.count("*").alias("n"), r(F.sum("speed"), 4).alias("speed_sum"))


FRAME_GROUP = f"WITH {_HOURLY}, f AS (SELECT *, CAST(dense_rank() OVER (ORDER BY t_seconds) - 1 AS INTEGER) AS f FROM h) SELECT f, t_seconds, count(*) AS n, {rnd('sum(speed)', 4)} AS speed_sum FROM f GROUP BY f, t_seconds"


def median_gap_upper(spark, sf_dir):
    return ops.upper_median_gap(_hourly(spark, sf_dir))


MEDIAN_GAP = f"WITH {_HOURLY}, g AS (SELECT t_seconds - lag(t_seconds) OVER (ORDER BY t_seconds) AS g FROM (SELECT DISTINCT t_seconds FROM h)), l AS (SELECT list(g ORDER BY g) AS l FROM g WHERE g > 0) SELECT coalesce(CAST(l[len(l) // 2 + 1] AS DOUBLE), 1.0::DOUBLE) AS gap FROM l"


def map_info(spark, sf_dir):
    return ops.info(_hourly(spark, sf_dir))


MAP_INFO = f"""WITH {_HOURLY}, b AS (SELECT count(*) AS samples, min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max FROM h WHERE t_seconds = (SELECT min(t_seconds) FROM h))
SELECT count(DISTINCT t_seconds) AS frames, count(*) AS rows, min(t_seconds) AS t_min, max(t_seconds) AS t_max, any_value(samples) AS samples, any_value(lon_min) AS lon_min, any_value(lon_max) AS lon_max, any_value(lat_min) AS lat_min, any_value(lat_max) AS lat_max FROM h, b"""


def grid_detect(spark, sf_dir):
    one = frames(spark).filter("f = 0")
    whole, holed, scattered = ops.detected(one), ops.detected(one.filter("not (i = 3 and j = 4)")), ops.detected(wind_observations(spark, sf_dir))
    cells = ops.on_lattice(one, GRID).agg(F.count_distinct("cell").alias("cells"))
    name = lambda d, n: d.select(F.lit(n).alias("case"), "is_grid", "nx", "ny")
    return name(whole, "whole").unionByName(name(holed, "holed")).unionByName(name(scattered, "scattered")).crossJoin(cells)


GRID_DETECT = f"""WITH {OBSERVATIONS_SQL}, d AS (SELECT count(DISTINCT lon) AS nx, count(DISTINCT lat) AS ny FROM obs)
SELECT 'whole' AS "case", true AS is_grid, 36 AS nx, 17 AS ny, 612 AS cells UNION ALL SELECT 'holed', false, 36, 17, 612 UNION ALL SELECT 'scattered', false, nx, ny, 612 FROM d"""


def circular_mean(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    return o.groupBy("user_id").agg(r(winds.mean_direction(F.col("direction"), F.col("speed") + 1), 4).alias("direction"), r(winds.mean_direction(F.col("direction")), 4).alias("plain"))


CIRCULAR = f"""WITH {OBSERVATIONS_SQL} SELECT user_id, {rnd(circ('sum(sin(radians(direction)) * (speed + 1))', 'sum(cos(radians(direction)) * (speed + 1))'), 4)} AS direction, {rnd(circ('sum(sin(radians(direction)))', 'sum(cos(radians(direction)))'), 4)} AS plain FROM obs GROUP BY user_id"""


def idw_four_corner(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("f", (F.col("id") % 6).cast("int"))
    return ops.corners(p, frames(spark), GRID).select("id", r("speed", 6).alias("speed"), r("direction", 4).alias("direction"))


def _idw(src: str, frame: str) -> str:
    """Blend of the corners of rows (id, lon, lat, <frame>) of a relation."""
    return f"""(SELECT id, frame, CASE WHEN min(d2) = 0 THEN max(speed) FILTER (d2 = 0) ELSE sum(speed / nullif(d2, 0)) / sum(1 / nullif(d2, 0)) END AS speed,
  CASE WHEN min(d2) = 0 THEN max(direction) FILTER (d2 = 0) ELSE {circ('sum(sin(radians(direction)) / nullif(d2, 0))', 'sum(cos(radians(direction)) / nullif(d2, 0))')} END AS direction FROM (
  SELECT DISTINCT p.id, p.frame, fr.i, fr.j, fr.speed, fr.direction, (p.lon - fr.lon) * (p.lon - fr.lon) + (p.lat - fr.lat) * (p.lat - fr.lat) AS d2 FROM (
    SELECT id, lon, lat, {frame} AS frame, least(greatest(floor((lon + 180) / 10), 0), 35) AS i0, least(greatest(ceil((lon + 180) / 10), 0), 35) AS i1, least(greatest(floor((lat + 80) / 10), 0), 16) AS j0, least(greatest(ceil((lat + 80) / 10), 0), 16) AS j1 FROM {src}) p
  JOIN fr ON fr.f = p.frame AND fr.i IN (p.i0, p.i1) AND fr.j IN (p.j0, p.j1)) GROUP BY id, frame)"""


IDW_FOUR = f"WITH {OBSERVATIONS_SQL}, {FRAMES_SQL} SELECT id, {rnd('speed', 6)} AS speed, {rnd('direction', 4)} AS direction FROM {_idw('obs', 'CAST(id % 6 AS INTEGER)')}"


def idw_knn4(spark, sf_dir):
    """Every customer asks for the wind where it is, by whole-number rules."""
    c = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(c.alias("id"), ((c * 6007 % 36000) / 100.0 - 179.995).alias("lon"), ((c * 50021 % 17000) / 100.0 - 84.995).alias("lat"))
    out = ops.blended_nearest(asked, wind_observations(spark, sf_dir))
    return out.select("id", r("speed", 6).alias("speed"), r("direction", 4).alias("direction"))


IDW_KNN = f"""WITH {OBSERVATIONS_SQL}, cu AS (SELECT c_custkey AS id, ((c_custkey * 6007) % 36000) / 100.0::DOUBLE - 179.995::DOUBLE AS lon, ((c_custkey * 50021) % 17000) / 100.0::DOUBLE - 84.995::DOUBLE AS lat FROM customer),
n AS (SELECT p.id, s.speed, s.direction, (p.lon - s.lon) * (p.lon - s.lon) + (p.lat - s.lat) * (p.lat - s.lat) AS d2 FROM cu p, obs s
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY d2, s.id) <= 4)
SELECT id, {rnd('CASE WHEN min(d2) = 0 THEN max(speed) FILTER (d2 = 0) ELSE sum(speed / nullif(d2, 0)) / sum(1 / nullif(d2, 0)) END', 6)} AS speed,
  {rnd(f"CASE WHEN min(d2) = 0 THEN max(direction) FILTER (d2 = 0) ELSE {circ('sum(sin(radians(direction)) / nullif(d2, 0))', 'sum(cos(radians(direction)) / nullif(d2, 0))')} END", 4)} AS direction FROM n GROUP BY id"""


def circle_query(spark, sf_dir):
    return wind_observations(spark, sf_dir).filter(ops.in_circle(20.0, 20.0, 12.0)).select("id", "lon", "lat")


CIRCLE = f"WITH {OBSERVATIONS_SQL} SELECT id, lon, lat FROM obs WHERE (lon - 20) * (lon - 20) + (lat - 20) * (lat - 20) <= 144"


def within_radius(spark, sf_dir):
    """How many observations lie within two degrees of each, and how far the farthest is."""
    o = wind_observations(spark, sf_dir).select("id", "lon", "lat")
    return ops.within(o, o, 2.0).groupBy("id").agg(F.count("*").alias("n"), F.max("d2").alias("d2")).select("id", "n", r("d2", 6).alias("d2"))


_D2 = "(a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)"
WITHIN = f"WITH {OBSERVATIONS_SQL} SELECT a.id, count(*) AS n, {rnd(f'max({_D2})', 6)} AS d2 FROM obs a JOIN obs b ON b.lon BETWEEN a.lon - 2.001 AND a.lon + 2.001 AND {_D2} <= 4 GROUP BY a.id"


def brush_edit(spark, sf_dir):
    o = wind_observations(spark, sf_dir).select("id", "lon", "lat", "speed", "direction")
    out = ops.brushed(ops.brushed(ops.brushed(o, 20.0, 20.0, 25.0, add=-30.0), -40.0, 0.0, 15.0, put=12.5), 0.0, -30.0, 20.0, direction=270.0)
    return out.select("id", "speed", "direction")


BRUSH = f"""WITH {OBSERVATIONS_SQL}, a AS (SELECT id, lon, lat, direction, CASE WHEN (lon - 20) * (lon - 20) + (lat - 20) * (lat - 20) <= 625 THEN greatest(speed - 30, 0.0::DOUBLE) ELSE speed END AS speed FROM obs)
SELECT id, CASE WHEN (lon + 40) * (lon + 40) + lat * lat <= 225 THEN 12.5::DOUBLE ELSE speed END AS speed, CASE WHEN lon * lon + (lat + 30) * (lat + 30) <= 400 THEN 270.0::DOUBLE ELSE direction END AS direction FROM a"""


def time_bracket(spark, sf_dir):
    lo, hi, alpha = winds.bracket(F.col("t"), GRID.frames, GRID.step_s)
    label = winds.frame_label(F.col("t"), GRID.frames, GRID.step_s)
    return points(spark, sf_dir).select("id", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), r(alpha, 9).alias("alpha"), label.alias("label"))


_INSIDE = mod("t", "216000.0::DOUBLE")
BRACKET_SQL = f"""pt AS (SELECT id, lon, lat, CAST(t_seconds AS DOUBLE) AS t FROM obs), br AS (SELECT id, lon, lat, t, CASE WHEN w < 108000 THEN CAST(least(floor(w / 21600), 4) AS INTEGER) ELSE 5 END AS lo, CASE WHEN w < 108000 THEN CAST(least(floor(w / 21600), 4) AS INTEGER) + 1 ELSE 0 END AS hi,
  CASE WHEN w < 108000 THEN w / 21600 - least(floor(w / 21600), 4) ELSE (w - 108000) / 108000 END AS alpha FROM (SELECT *, {_INSIDE} AS w FROM pt))"""
TIME_BRACKET = f"WITH {OBSERVATIONS_SQL}, {BRACKET_SQL} SELECT id, lo, hi, {rnd('alpha', 9)} AS alpha, CAST({mod('round(t / 21600)', 6)} AS INTEGER) AS label FROM br"


def timed_wind_query(spark, sf_dir):
    return ops.at_time(points(spark, sf_dir), frames(spark), GRID).select("id", r("speed", 6).alias("speed"), r("direction", 4).alias("direction"))


TIMED = f"""WITH {OBSERVATIONS_SQL}, {FRAMES_SQL}, {BRACKET_SQL}, q AS (SELECT * FROM br), a AS (SELECT * FROM {_idw('q', 'lo')}), b AS (SELECT * FROM {_idw('q', 'hi')})
SELECT q.id, {rnd('CASE WHEN alpha = 0 THEN a.speed ELSE a.speed * (1 - alpha) + b.speed * alpha END', 6)} AS speed,
  {rnd(f"CASE WHEN alpha = 0 THEN a.direction ELSE {circ('sin(radians(a.direction)) * (1 - alpha) + sin(radians(b.direction)) * alpha', 'cos(radians(a.direction)) * (1 - alpha) + cos(radians(b.direction)) * alpha')} END", 4)} AS direction
FROM q JOIN a ON a.id = q.id JOIN b ON b.id = q.id"""


def synth_frame(spark, sf_dir):
    return ops.frame_at(frames(spark), GRID, 130000.0).select("i", "j", r("speed", 6).alias("speed"), r("direction", 4).alias("direction"))


SYNTH = f"""WITH {FRAMES_SQL}, a AS (SELECT * FROM fr WHERE f = 5), b AS (SELECT * FROM fr WHERE f = 0), c AS (SELECT (130000 - 108000) / 108000.0::DOUBLE AS g)
SELECT a.i, a.j, {rnd('a.speed * (1 - g) + b.speed * g', 6)} AS speed, {rnd(circ('sin(radians(a.direction)) * (1 - g) + sin(radians(b.direction)) * g', 'cos(radians(a.direction)) * (1 - g) + cos(radians(b.direction)) * g'), 4)} AS direction FROM a JOIN b USING (i, j), c"""


def bake_grid(spark, sf_dir):
    return ops.bake(frames(spark), GRID, ONTO).select("ix", "iy", "f", r("u", 6).alias("u"), r("v", 6).alias("v"))


_BAKED = f"""{FRAMES_SQL}, cell AS (SELECT CAST((f * 17 + ix) * 11 + iy AS BIGINT) AS id, f, ix, iy, ix * 7.5::DOUBLE - 60 AS lon, iy * 7.5::DOUBLE - 40 AS lat FROM (SELECT CAST(f AS INTEGER) AS f, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy FROM range(6) a(f), range(17) b(ix), range(11) c(iy))),
bk AS (SELECT ix, iy, f, -speed * (1852.0::DOUBLE / 3600) * sin(radians(direction)) AS u, -speed * (1852.0::DOUBLE / 3600) * cos(radians(direction)) AS v FROM cell JOIN {_idw('cell', 'f')} w ON w.id = cell.id)"""
BAKE = f"WITH {_BAKED} SELECT ix, iy, f, {rnd('u', 6)} AS u, {rnd('v', 6)} AS v FROM bk"


def baked_sample(spark, sf_dir):
    cells = ops.packed(ops.bake(frames(spark), GRID, ONTO))
    p = points(spark, sf_dir).withColumn("lon", F.col("lon") / 3).withColumn("lat", F.col("lat") / 2)
    return ops.sample_baked(p, cells, ONTO, GRID).select("id", r("u", 5).alias("u"), r("v", 5).alias("v"))


BAKED_SAMPLE = f"""WITH {OBSERVATIONS_SQL}, {_BAKED}, {BRACKET_SQL}, q AS (SELECT *, CAST(least(greatest(round((lon / 3 + 60) / 7.5::DOUBLE), 0), 16) AS INTEGER) AS ix, CAST(least(greatest(round((lat / 2 + 40) / 7.5::DOUBLE), 0), 10) AS INTEGER) AS iy FROM br)
SELECT q.id, {rnd('a.u * (1 - alpha) + b.u * alpha', 5)} AS u, {rnd('a.v * (1 - alpha) + b.v * alpha', 5)} AS v FROM q JOIN bk a ON a.ix = q.ix AND a.iy = q.iy AND a.f = q.lo JOIN bk b ON b.ix = q.ix AND b.iy = q.iy AND b.f = q.hi"""


def pair_uv(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    m = o.select(F.floor(F.col("t_seconds") / 86400).alias("t"), (F.col("user_id") % 40).alias("cell"), (F.col("id") % 3 != 0).alias("is_u"), F.col("speed").alias("value"), F.col("id").alias("msg"))
    return ops.paired(m).select("t", "cell", "u", "v", r(winds.speed(F.col("u"), F.col("v")), 6).alias("speed"), r(winds.direction_or_north(F.col("u"), F.col("v")), 4).alias("direction"))


PAIR_UV = f"""WITH {OBSERVATIONS_SQL}, m AS (SELECT CAST(floor(t_seconds / 86400) AS BIGINT) AS t, user_id % 40 AS cell, arg_max(speed, id) FILTER (id % 3 <> 0) AS u, arg_max(speed, id) FILTER (id % 3 = 0) AS v FROM obs GROUP BY 1, 2)
SELECT t, cell, u, v, {rnd('sqrt(u * u + v * v)', 6)} AS speed, {rnd(f"CASE WHEN u = 0 AND v = 0 THEN 0.0 ELSE {mod('270 - degrees(atan2(v, u))', '360.0::DOUBLE')} END", 4)} AS direction FROM m WHERE u IS NOT NULL AND v IS NOT NULL"""


def _baked_pair(spark):
    a = ops.bake(frames(spark), GRID, ONTO).withColumnsRenamed({"ix": "i", "iy": "j"})
    code = lambda c: winds.decode(winds.encode(F.col(c))) * 0.9  # noqa: E731  a tenth lost, so that errors reach the limits
    return a, a.withColumn("u", code("u")).withColumn("v", code("v"))


# Speed buckets and error limits of drift reports.
EDGES = [0.5, 1.0, 2.0, 5.0, 10.0, 20.0]
LIMITS = [0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0]


def drift_buckets(spark, sf_dir):
    out = ops.drift_by_speed(ops.drift(*_baked_pair(spark)), EDGES)
    return out.select("bucket", "n", r("mean_deg", 5).alias("mean_deg"), r("max_deg", 5).alias("max_deg"))


_Q = lambda c: f"((least(greatest(round(({c} + 60) / 120 * 1023), 0), 1023) / 1023.0::DOUBLE * 120 - 60) * 0.9::DOUBLE)"
_D = lambda u, v: f"(CASE WHEN {u} = 0 AND {v} = 0 THEN 0.0 ELSE {mod(f'270 - degrees(atan2({v}, {u}))', '360.0::DOUBLE')} END)"
_DRIFT = f"""WITH {_BAKED}, q AS (SELECT u, v, {_Q('u')} AS u1, {_Q('v')} AS v1 FROM bk),
dr AS (SELECT sqrt((u - u1) * (u - u1) + (v - v1) * (v - v1)) AS err_uv, sqrt(u * u + v * v) AS speed, abs({mod(f"{_D('u', 'v')} - {_D('u1', 'v1')} + 540", '360.0::DOUBLE')} - 180) AS err_deg FROM q)"""
DRIFT_BUCKETS = f"{_DRIFT} SELECT CASE {' '.join(f'WHEN speed < {e} THEN {k}' for k, e in enumerate(EDGES))} ELSE {len(EDGES)} END AS bucket, count(*) AS n, {rnd('avg(err_deg)', 5)} AS mean_deg, {rnd('max(err_deg)', 5)} AS max_deg FROM dr GROUP BY 1"


def drift_thresholds(spark, sf_dir):
    out = ops.drift_over(ops.drift(*_baked_pair(spark)), LIMITS)
    return out.withColumn("mean", r("mean", 6)).withColumn("largest", r("largest", 6))


DRIFT_THRESHOLDS = f"{_DRIFT} SELECT {', '.join(f'count(*) FILTER (err_uv >= {t}) AS over_{k}' for k, t in enumerate(LIMITS))}, {rnd('avg(err_uv)', 6)} AS mean, {rnd('max(err_uv)', 6)} AS largest FROM dr"


def lod_decimate(spark, sf_dir):
    x, y = ops.to_view(F.col("lon"), F.col("lat"), 10.0, 45.0, 4.0)
    lon, lat = ops.from_view(F.col("x"), F.col("y"), 10.0, 45.0, 4.0)
    out = ops.visible(frames(spark).filter("f = 2"), 5, 30, 2, 14, 4).withColumns({"x": x, "y": y})
    return out.select("i", "j", r("x", 6).alias("x"), r("y", 6).alias("y"), r(lon, 6).alias("lon"), r(lat, 6).alias("lat"))


LOD = f"WITH {FRAMES_SQL} SELECT i, j, {rnd('(lon - 10) * cos(radians(45)) * 4', 6)} AS x, {rnd('-(lat - 45) * 4', 6)} AS y, {rnd('lon', 6)} AS lon, {rnd('lat', 6)} AS lat FROM fr WHERE f = 2 AND i BETWEEN 5 AND 30 AND j BETWEEN 2 AND 14 AND i % 4 = 0 AND j % 4 = 0"

# ---- forecast files

FORECAST = ops.Grid(-30.0, -20.0, 2.5, 2.5, 25, 17, 6, 10800.0)
#: How the file of each frame is packed: data template, order of differences, order of points.
PACKINGS = ((0, 0, 0x40), (2, 0, 0x60), (3, 1, 0x50), (3, 2, 0x70), (4, 0, 0x40), (41, 4, 0x40))


def _forecast_files(spark):
    """(path, content): a file for each frame of whole metres a second, packed in different ways."""
    i, j, f = F.col("i"), F.col("j"), F.col("f")
    cells = ops.lattice(spark, FORECAST).withColumns({"u": (i * 7 + j * 3 + f * 5) % 41 - 20, "v": (i * 5 + j * 11 + f * 3) % 37 - 18})

    def made(cells):
        cells, f = cells.sort_values(["j", "i"]), int(cells["f"].iloc[0])
        template, order, scan = PACKINGS[f]
        lat, lon = cells["lat"].unique(), cells["lon"].unique()
        grid = lambda c: cells[c].to_numpy(float).reshape(len(lat), len(lon))
        parts = [grib.write_message(lat, lon, grid(c), p, dt.datetime(2024, 1, 1), 3 * f, template=template, order=order, scan=scan) for c, p in (("u", 2), ("v", 3))]
        return pd.DataFrame({"path": [f"f{f}"], "content": [b"".join(parts)]})

    return cells.groupBy("f").applyInPandas(made, "path string, content binary")


def forecast_scan(spark, sf_dir):
    """The winds of forecast files of all packings, in a box, every second row and column of it."""
    rows = grib.winds_of(grib.unpacked(_forecast_files(spark), 2, geo.Box(-20.0, 21.0, -12.0, 16.0)))
    return rows.select("t_seconds", "lon", "lat", r("speed", 6).alias("speed"), r("direction", 6).alias("direction"))


FORECAST_SCAN = f"""WITH c AS (SELECT f, i, j, i * 2.5::DOUBLE - 30 AS lon, j * 2.5::DOUBLE - 20 AS lat, CAST((i * 7 + j * 3 + f * 5) % 41 - 20 AS DOUBLE) AS u, CAST((i * 5 + j * 11 + f * 3) % 37 - 18 AS DOUBLE) AS v FROM range(6) a(f), range(25) b(i), range(17) d(j)),
k AS (SELECT *, dense_rank() OVER (ORDER BY lon) AS x, dense_rank() OVER (ORDER BY lat) AS y FROM c WHERE lon BETWEEN -20 AND 21 AND lat BETWEEN -12 AND 16)
SELECT 1704067200 + f * 10800 AS t_seconds, lon, lat, {rnd('sqrt(u * u + v * v)', 6)} AS speed, {rnd(f"CASE WHEN u = 0 AND v = 0 THEN 0.0 ELSE {mod('270 - degrees(atan2(v, u))', '360.0::DOUBLE')} END", 6)} AS direction FROM k WHERE x % 2 = 1 AND y % 2 = 1"""

# Index lines of a small archive file.
INDEX_LINES = ["1:0:d=2024010100:HGT:500 mb:anl:", "2:5482:d=2024010100:UGRD:10 m above ground:anl:", "3:11034:d=2024010100:VGRD:10 m above ground:anl:", "4:16500:d=2024010100:TMP:2 m above ground:anl:", "5:22000:d=2024010100:UGRD:10 m above ground:anl:"]


def idx_byte_ranges(spark, sf_dir):
    rows = [(f"f{k}", i, line) for k in range(3) for i, line in enumerate(INDEX_LINES[k:])]
    return archive.byte_ranges(spark.createDataFrame(rows, "file string, line_no int, line string"))


IDX = "SELECT * FROM (VALUES " + ", ".join(
    f"('f{k}', {m}, {lo}::BIGINT, {hi}, '{v}')" for k in range(3) for m, lo, hi, v in ((2, 5482, "11034::BIGINT", "UGRD"), (3, 11034, "16500::BIGINT", "VGRD"), (5, 22000, "NULL", "UGRD")) if m > k
) + ") t(file, msg, lo, hi, var)"


def gfs_frame_plan(spark, sf_dir):
    return archive.frame_plan(spark, 1704067200 + 3600, 1704067200 + 40 * 3600 + 1, 5)


GFS_PLAN = """SELECT k, valid, CAST(h // 6 * 6 AS INTEGER) AS cycle, CAST(h % 6 AS INTEGER) AS ahead, printf('https://archive.example/gfs.%s/%02d/atmos/gfs.t%02dz.pgrb2.0p25.f%03d', strftime(make_timestamp(valid * 1000000), '%Y%m%d'), h // 6 * 6, h // 6 * 6, h % 6) AS url
FROM (SELECT k, 1704070800 + k * 18000 AS valid, ((1704070800 + k * 18000) % 86400) // 3600 AS h FROM range(8) t(k))"""


def time_codes(spark, sf_dir):
    """Reference times, forecast offsets and day-hour texts."""
    o = wind_observations(spark, sf_dir)
    i = F.col("id")
    ref = text.reference_seconds((i * 7 % 60 + 1960).cast("int"), (i % 14).cast("int"), (i * 3 % 33).cast("int"), (i % 26).cast("int"), (i % 60).cast("int"), (i % 61).cast("int"))
    ahead = text.forecast_seconds((i % 15).cast("int"), (i % 9).cast("long"))
    stamp = F.format_string("%04d%02d%02d%s", (i % 90 + 1970).cast("int"), (i % 14).cast("int"), (i * 5 % 33).cast("int"), F.when(i % 3 == 0, F.format_string("%02d", (i % 27).cast("int"))).when(i % 7 == 0, F.lit("1")).otherwise(F.lit("")))
    parsed = text.day_hour(stamp)
    return o.select("id", ref.alias("reference"), ahead.alias("ahead"), parsed["seconds"].alias("seconds"), parsed["error"].alias("error"))


TIME_CODES = f"""WITH {OBSERVATIONS_SQL}, x AS (SELECT id, printf('%04d-%02d-%02d', (id * 7) % 60 + 1960, id % 14, (id * 3) % 33) AS d, id % 26 AS h, id % 60 AS mi, id % 61 AS s,
  printf('%04d%02d%02d', id % 90 + 1970, id % 14, (id * 5) % 33) || CASE WHEN id % 3 = 0 THEN printf('%02d', id % 27) WHEN id % 7 = 0 THEN '1' ELSE '' END AS st FROM obs),
y AS (SELECT *, try_cast(d AS DATE) AS ref, try_cast(st[1:4] || '-' || st[5:6] || '-' || st[7:8] AS DATE) AS sd, CASE WHEN len(st) = 10 THEN CAST(st[9:10] AS INTEGER) ELSE 0 END AS sh FROM x),
z AS (SELECT *, CASE WHEN len(st) NOT IN (8, 10) THEN 'length' WHEN sd IS NULL THEN 'date' WHEN sh > 23 THEN 'hour' END AS error FROM y)
SELECT id, CASE WHEN h <= 23 AND s <= 59 THEN CAST(date_diff('day', DATE '1970-01-01', ref) AS BIGINT) * 86400 + h * 3600 + mi * 60 + s END AS reference,
  CASE id % 15 WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN 86400 WHEN 10 THEN 10800 WHEN 11 THEN 21600 WHEN 12 THEN 43200 WHEN 13 THEN 1 END * (id % 9) AS ahead,
  CASE WHEN error IS NULL THEN CAST(date_diff('day', DATE '1970-01-01', sd) AS BIGINT) * 86400 + sh * 3600 END AS seconds, error FROM z"""


def archive_inspect(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    m = o.select((F.col("user_id") % 5).alias("t"), F.when(F.col("id") % 2 == 0, "UGRD").otherwise("VGRD").alias("var"), (F.floor(F.col("lat") / 10) * 10.0).alias("lat"), "lon", F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("speed")).alias("value"))
    return archive.inspected(m).select("t", "var", "cells", "finite", "lats", "uneven")


ARCHIVE_INSPECT = f"""WITH {OBSERVATIONS_SQL}, m AS (SELECT user_id % 5 AS t, CASE WHEN id % 2 = 0 THEN 'UGRD' ELSE 'VGRD' END AS var, floor(lat / 10) * 10.0::DOUBLE AS lat, id FROM obs),
g AS (SELECT t, var, lat - lag(lat) OVER (PARTITION BY t, var ORDER BY lat) AS gap FROM (SELECT DISTINCT t, var, lat FROM m)), a AS (SELECT t, var, count(*) AS lats, max(gap) - min(gap) AS uneven FROM g GROUP BY t, var)
SELECT m.t, m.var, count(*) AS cells, count(*) FILTER (id % 11 <> 0) AS finite, any_value(lats) AS lats, any_value(uneven) AS uneven FROM m JOIN a ON a.t = m.t AND a.var = m.var GROUP BY m.t, m.var"""


def fetch_stats(spark, sf_dir):
    o = wind_observations(spark, sf_dir)
    return archive.fetch_totals(o.select(F.when(F.col("id") % 7 != 0, F.col("id") * 10).alias("bytes")))


FETCH_STATS = f"WITH {OBSERVATIONS_SQL} SELECT count(*) FILTER (id % 7 <> 0) AS fetched, count(*) FILTER (id % 7 = 0) AS skipped, CAST(sum(id * 10) FILTER (id % 7 <> 0) AS BIGINT) AS bytes FROM obs"

QUERIES = {
    "uv_from_dir": uv_from_dir,
    "uv_roundtrip": uv_roundtrip,
    "quantize10": quantize10,
    "stride_decimate": stride_decimate,
    "frame_group": frame_group,
    "median_gap_upper": median_gap_upper,
    "map_info": map_info,
    "grid_detect": grid_detect,
    "circular_mean": circular_mean,
    "idw_four_corner": idw_four_corner,
    "idw_knn4": idw_knn4,
    "circle_query": circle_query,
    "within_radius": within_radius,
    "brush_edit": brush_edit,
    "time_bracket": time_bracket,
    "timed_wind_query": timed_wind_query,
    "synth_frame": synth_frame,
    "bake_grid": bake_grid,
    "baked_sample": baked_sample,
    "pair_uv": pair_uv,
    "forecast_scan": forecast_scan,
    "drift_buckets": drift_buckets,
    "drift_thresholds": drift_thresholds,
    "lod_decimate": lod_decimate,
    "idx_byte_ranges": idx_byte_ranges,
    "gfs_frame_plan": gfs_frame_plan,
    "time_codes": time_codes,
    "archive_inspect": archive_inspect,
    "fetch_stats": fetch_stats,
}
ORACLES = {
    "uv_from_dir": UV_FROM_DIR,
    "uv_roundtrip": UV_ROUNDTRIP,
    "quantize10": QUANTIZE,
    "stride_decimate": STRIDE,
    "frame_group": FRAME_GROUP,
    "median_gap_upper": MEDIAN_GAP,
    "map_info": MAP_INFO,
    "grid_detect": GRID_DETECT,
    "circular_mean": CIRCULAR,
    "idw_four_corner": IDW_FOUR,
    "idw_knn4": IDW_KNN,
    "circle_query": CIRCLE,
    "within_radius": WITHIN,
    "brush_edit": BRUSH,
    "time_bracket": TIME_BRACKET,
    "timed_wind_query": TIMED,
    "synth_frame": SYNTH,
    "bake_grid": BAKE,
    "baked_sample": BAKED_SAMPLE,
    "pair_uv": PAIR_UV,
    "forecast_scan": FORECAST_SCAN,
    "drift_buckets": DRIFT_BUCKETS,
    "drift_thresholds": DRIFT_THRESHOLDS,
    "lod_decimate": LOD,
    "idx_byte_ranges": IDX,
    "gfs_frame_plan": GFS_PLAN,
    "time_codes": TIME_CODES,
    "archive_inspect": ARCHIVE_INSPECT,
    "fetch_stats": FETCH_STATS,
}
