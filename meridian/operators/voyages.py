"""Voyages: ordered waypoints, their legs, clocks, lengths, shapes and totals.

Waypoints are a long table (voyage, k, lon, lat[, seconds]); every operator partitions by
voyage, so a table of many voyages is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import geo
from meridian.functions.ship import Ship, speed_kmh


def along():
    """The window of a voyage's waypoints in order."""
    return Window.partitionBy("voyage").orderBy("k")


def so_far():
    return along().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def legs(points: DataFrame) -> DataFrame:
    """A row for each pair of successive waypoints: (voyage, k, lon, lat, lon2, lat2, metres, bearing) and other
    columns of the first."""
    out = points.withColumn("lon2", F.lead("lon").over(along())).withColumn("lat2", F.lead("lat").over(along())).filter("lon2 is not null")
    ends = [F.col(c) for c in ("lon", "lat", "lon2", "lat2")]
    return out.withColumn("metres", geo.haversine(*ends)).withColumn("bearing", geo.bearing(*ends))


def running_clock(points: DataFrame) -> DataFrame:
    """With ``arrive`` and ``depart``: ``seconds`` is the time of the segment that ends at a waypoint."""
    return points.withColumn("arrive", F.sum("seconds").over(so_far())).withColumn("depart", F.col("arrive") - F.col("seconds"))


def arc_lengths(points: DataFrame) -> DataFrame:
    """With ``arc``: metres sailed up to each waypoint."""
    before = [F.lag(c).over(along()) for c in ("lon", "lat")]
    step = F.coalesce(geo.haversine(*before, F.col("lon"), F.col("lat")), F.lit(0.0))
    return points.withColumn("step_m", step).withColumn("arc", F.sum("step_m").over(so_far())).drop("step_m")


def resample(points: DataFrame, n: int) -> DataFrame:
    """(voyage, i, lon, lat): n places evenly spaced along each voyage, its ends kept.

    A target falls into the first segment that ends at or beyond it; a voyage without length stays at its
    first waypoint.
    """
    line = arc_lengths(points).withColumn("lo", F.lag("arc").over(along())).withColumn("lon0", F.lag("lon").over(along())).withColumn("lat0", F.lag("lat").over(along()))
    total = F.max("arc").over(Window.partitionBy("voyage"))
    line = line.withColumn("total", total).filter("lo is not null")
    # A segment knows which targets it holds, so targets are made where they belong instead of joined.
    at = F.sequence(F.floor(F.col("lo") * (n - 1) / F.col("total")).cast("int"), F.ceil(F.col("arc") * (n - 1) / F.col("total")).cast("int"))
    rows = line.filter("total > 0").select("*", F.explode(at).alias("i")).filter((F.col("i") > 0) & (F.col("i") < n - 1))
    target = F.col("i") / (n - 1) * F.col("total")
    rows = rows.withColumn("target", target).filter((F.col("target") > F.col("lo")) & (F.col("target") <= F.col("arc")))
    f = (F.col("target") - F.col("lo")) / F.greatest(F.col("arc") - F.col("lo"), F.lit(1e-12))
    inner = rows.select("voyage", "i", (F.col("lon0") * (1 - f) + F.col("lon") * f).alias("lon"), (F.col("lat0") * (1 - f) + F.col("lat") * f).alias("lat"))
    ends = points.groupBy("voyage").agg(F.min_by(F.struct("lon", "lat"), "k").alias("a"), F.max_by(F.struct("lon", "lat"), "k").alias("b"))
    first = ends.select("voyage", F.lit(0).alias("i"), "a.lon", "a.lat")
    last = ends.select("voyage", F.lit(n - 1).alias("i"), "b.lon", "b.lat")
    still = line.groupBy("voyage").agg(F.max("total").alias("total"), F.min_by(F.struct("lon0", "lat0"), "k").alias("a")).filter("total <= 0")
    still = still.select("voyage", F.explode(F.sequence(F.lit(1), F.lit(n - 2))).alias("i"), F.col("a.lon0").alias("lon"), F.col("a.lat0").alias("lat"))
    return first.unionByName(inner).unionByName(still).unionByName(last)


def perpendiculars(points: DataFrame) -> DataFrame:
    """With (perp_east, perp_north): unit vectors to the left of the course at each waypoint."""
    look = lambda f, c: F.coalesce(f(c).over(along()), F.col(c))
    out = points.withColumns({f"{side}_{c}": look(f, c) for side, f in (("p", F.lag), ("n", F.lead)) for c in ("lon", "lat")})
    east, north = geo.delta_to_tangent(F.col("lat"), geo.lon_delta(F.col("p_lon"), F.col("n_lon")), F.col("n_lat") - F.col("p_lat"))
    size = F.hypot(east, north)
    some, safe = size > 1e-12, F.when(size > 1e-12, size).otherwise(F.lit(1.0))
    out = out.withColumn("perp_east", F.when(some, -north / safe).otherwise(F.lit(0.0))).withColumn("perp_north", F.when(some, east / safe).otherwise(F.lit(1.0)))
    return out.drop("p_lon", "p_lat", "n_lon", "n_lat")


def unwrapped_box(points: DataFrame, pad: float = 0.2, least: float = 3.0) -> DataFrame:
    """(voyage, lon_min, lon_max, lat_min, lat_max): the padded box of a course followed across the antimeridian.

    Longitudes are unwrapped along the course; a box that goes all the way round is the whole circle.
    """
    step = F.coalesce(geo.lon_delta(F.lag("lon").over(along()), F.col("lon")), F.col("lon"))
    out = points.withColumn("step_lon", step).withColumn("far_lon", F.sum("step_lon").over(so_far()))
    box = out.groupBy("voyage").agg(F.min("far_lon").alias("w"), F.max("far_lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    dx = F.greatest((F.col("e") - F.col("w")) * pad, F.lit(least))
    dy = F.greatest((F.col("n") - F.col("s")) * pad, F.lit(least))
    west, east = F.col("w") - dx, F.col("e") + dx
    round_ = east - west >= 360
    return box.select(
        "voyage",
        F.when(round_, F.lit(-180.0)).otherwise(geo.wrap_lon(west)).alias("lon_min"),
        F.when(round_, F.lit(180.0)).otherwise(geo.wrap_lon(east)).alias("lon_max"),
        F.greatest(F.col("s") - dy, F.lit(-geo.POLE_LAT)).alias("lat_min"),
        F.least(F.col("n") + dy, F.lit(geo.POLE_LAT)).alias("lat_max"),
    )


def pinned(points: DataFrame, box: geo.Box, ends: tuple[float, float, float, float]) -> DataFrame:
    """Waypoints kept in a box, first and last put at (lon1, lat1, lon2, lat2)."""
    spot = F.row_number().over(along())
    many = F.count("*").over(Window.partitionBy("voyage"))
    lon, lat = box.clamp(F.col("lon"), F.col("lat"))
    pick = lambda inner, a, b: F.when(spot == 1, F.lit(a)).when(spot == many, F.lit(b)).otherwise(inner)
    return points.withColumns({"lon": pick(lon, ends[0], ends[2]), "lat": pick(lat, ends[1], ends[3])})


def nearest_waypoint(points: DataFrame, lon: float, lat: float, most: float) -> DataFrame:
    """(voyage, k): each voyage's waypoint nearest to a place in the plane, if within ``most`` degrees."""
    d2 = (F.col("lon") - lon) * (F.col("lon") - lon) + (F.col("lat") - lat) * (F.col("lat") - lat)
    return points.withColumn("d2", d2).groupBy("voyage").agg(F.min_by("k", F.struct("d2", "k")).alias("k"), F.min("d2").alias("d2")).filter(F.col("d2") <= most * most).select("voyage", "k")


def totals(segments: DataFrame) -> DataFrame:
    """(voyage, seconds, fuel, land_m) over a voyage's segments."""
    return segments.groupBy("voyage").agg(F.sum("seconds").alias("seconds"), F.sum("fuel").alias("fuel"), F.sum("land_m").alias("land_m"))


# ---- integrals along a leg, as folds


def bind(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def travel_time(lon: Column, lat: Column, lon2: Column, lat2: Column, load: Column, start: Column, ship: Ship, wind, substeps: int) -> Column:
    """Seconds over a leg by the midpoint rule in equal substeps; infinite where the ship cannot go on.

    wind(lon, lat, t) gives the (u, v) columns. The bearing is taken anew at each substep.
    """
    def speed(at, angle, t):
        def sail(air: Column) -> Column:
            return bind(ship.wind_speed(angle, air["u"], air["v"]), lambda w: bind(ship.motor_speed(w, load), lambda s: F.when(F.isnan(s) | (s <= 0), F.lit(None)).otherwise(s)))

        u, v = wind(at["lon"], at["lat"], t)
        return bind(F.struct(u.alias("u"), v.alias("v")), sail)

    def place(at, metres, angle) -> Column:
        x, y = geo.destination(at["lon"], at["lat"], metres, angle)
        return F.struct(x.alias("lon"), y.alias("lat"))

    def over(step: Column) -> Column:
        def advance(state: Column, _: Column) -> Column:
            t = state["t"]

            def go(angle: Column) -> Column:
                def second(first: Column) -> Column:
                    return bind(place(state, step / 2, angle), lambda mid: speed(mid, angle, t + 0.5 * step / first))

                later = bind(speed(state, angle, t), lambda first: bind(second(first), lambda s: t + step / s))
                return bind(place(state, step, angle), lambda on: F.struct(on["lon"].alias("lon"), on["lat"].alias("lat"), later.alias("t")))

            return bind(geo.bearing(state["lon"], state["lat"], lon2, lat2), go)

        began = F.struct(lon.alias("lon"), lat.alias("lat"), start.cast("double").alias("t"))
        ended = F.aggregate(F.sequence(F.lit(1), F.lit(substeps)), began, advance, lambda state: state["t"])
        return F.when(step <= 0, F.lit(0.0)).otherwise(F.coalesce(ended - start, F.lit(float("inf"))))

    return bind(geo.haversine(lon, lat, lon2, lat2) / substeps, over)


def throttle(lon: Column, lat: Column, lon2: Column, lat2: Column, seconds: Column, start: Column, ship: Ship, wind, substeps: int, halvings: int = 12) -> Column:
    """The motor load that makes a leg take ``seconds``, by bisection; the nearest one possible otherwise."""
    takes = lambda load: travel_time(lon, lat, lon2, lat2, load, start, ship, wind, substeps)
    stuck = float("inf")

    def halve(s: Column, _: Column) -> Column:
        def narrow(mid: Column) -> Column:
            pick = lambda late: F.struct(F.when(late, mid).otherwise(s["lo"]).alias("lo"), F.when(late, s["hi"]).otherwise(mid).alias("hi"))
            return bind(takes(mid) > seconds, pick)

        return bind((s["lo"] + s["hi"]) / 2, narrow)

    def solve(b: Column) -> Column:
        middle = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), F.struct(b["least"].alias("lo"), F.lit(1.0).alias("hi")), halve, lambda g: (g["lo"] + g["hi"]) / 2)
        return F.when(seconds >= b["slow"], b["least"]).otherwise(middle)

    def slowest(idle: Column) -> Column:
        return F.when(idle == stuck, F.struct(F.lit(0.1).alias("least"), takes(F.lit(0.1)).alias("slow"))).otherwise(F.struct(F.lit(0.0).alias("least"), idle.alias("slow")))

    found = F.when(seconds <= takes(F.lit(1.0)), F.lit(1.0)).otherwise(bind(bind(takes(F.lit(0.0)), slowest), solve))
    return F.when(geo.haversine(lon, lat, lon2, lat2) <= 0, F.lit(0.0)).otherwise(found)


def land_metres(lon: Column, lat: Column, lon2: Column, lat2: Column, is_land, substeps: int) -> Column:
    """Metres of a leg over land, judged at the middle of equal substeps; infinite across a pole."""

    def over(step: Column) -> Column:
        def advance(state: Column, _: Column) -> Column:
            here = (state["lon"], state["lat"])

            def go(angle: Column) -> Column:
                mid, on = geo.destination(*here, step / 2, angle), geo.destination(*here, step, angle)
                return F.struct(on[0].alias("lon"), on[1].alias("lat"), (state["m"] + F.when(is_land(*mid), step).otherwise(F.when(mid[1].isNotNull(), F.lit(0.0)))).alias("m"))

            return bind(geo.bearing(*here, lon2, lat2), go)

        began = F.struct(lon.alias("lon"), lat.alias("lat"), F.lit(0.0).alias("m"))
        ended = F.aggregate(F.sequence(F.lit(1), F.lit(substeps)), began, advance, lambda state: state["m"])
        return F.when(step <= 0, F.lit(0.0)).otherwise(F.coalesce(ended, F.lit(float("inf"))))

    return bind(geo.haversine(lon, lat, lon2, lat2) / substeps, over)


def segment_metrics(legs: DataFrame, ship: Ship) -> DataFrame:
    """legs (metres, seconds, load) with fuel and speed_kmh."""
    return legs.withColumn("fuel", ship.fuel_used(F.col("load"), F.col("seconds"))).withColumn("speed_kmh", speed_kmh(F.col("metres"), F.col("seconds")))
