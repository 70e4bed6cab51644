"""Wind frames on regular grids and scattered places: detection, lookup, blending, resampling.

Frames are a long table (f, i, j, lon, lat, speed, direction). Lookups join on whole-number
cell keys that are computed, never on distances, so they are equi-joins at any size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions import winds
from meridian.functions.geo import angle_between


@dataclass(frozen=True)
class Grid:
    """A regular lattice in degrees and the spacing of its frames in seconds."""

    lon: float
    lat: float
    step_lon: float
    step_lat: float
    nx: int
    ny: int
    frames: int = 1
    step_s: float = 3600.0
    crossfade_s: float | None = None

    @property
    def duration_s(self) -> float:
        """Seconds from the first frame to the last."""
        return (self.frames - 1) * self.step_s

    @property
    def cycle_s(self) -> float:
        """Seconds after which looped time starts again: the frames and the blend back to the first."""
        return 0.0 if self.frames <= 1 else self.duration_s + (5 * self.step_s if self.crossfade_s is None else self.crossfade_s)

    def with_crossfade(self, seconds: float) -> "Grid":
        """The grid with another blend back to its first frame, not a negative one."""
        return replace(self, crossfade_s=max(0.0, seconds))


# ---- making and recognizing grids


def lattice(spark: SparkSession, grid: Grid) -> DataFrame:
    """(f, i, j, lon, lat) of every cell of every frame."""
    cells = spark.range(grid.frames * grid.nx * grid.ny)
    i, j = F.col("id") % grid.nx, F.floor(F.col("id") / grid.nx) % grid.ny
    return cells.select(
        F.floor(F.col("id") / (grid.nx * grid.ny)).cast("int").alias("f"),
        i.cast("int").alias("i"),
        j.cast("int").alias("j"),
        (i * grid.step_lon + grid.lon).alias("lon"),
        (j * grid.step_lat + grid.lat).alias("lat"),
    )


def random_frames(spark: SparkSession, grid: Grid, least: float, most: float, seed: int) -> DataFrame:
    """Frames of uniform speeds and directions; least = most = 0 is a calm."""
    return lattice(spark, grid).withColumn("speed", F.rand(seed) * (most - least) + least).withColumn("direction", F.rand(seed + 1) * 360.0)


def axes(rows: DataFrame, column: str) -> DataFrame:
    """(value, rank): the distinct values of an axis in order. An axis is short, whatever the table holds."""
    return rows.select(F.col(column).alias("value")).distinct().withColumn("rank", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))


def stride(rows: DataFrame, n: int) -> DataFrame:
    """Rows on every n-th distinct longitude and latitude; 0 and 1 keep all."""
    if n <= 1:
        return rows
    keep = lambda c: axes(rows, c).filter(F.col("rank") % n == 0).select(F.col("value").alias(c))
    return rows.join(keep("lon"), "lon", "left_semi").join(keep("lat"), "lat", "left_semi")


def detected(rows: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """One row (is_grid, nx, ny, lon, lat, step_lon, step_lat): whether (lon, lat) rows are a regular lattice.

    Both axes need two values at least and even steps, and each cell exactly one row.
    """

    def axis(c: str) -> DataFrame:
        gap = F.col("value") - F.lag("value").over(Window.orderBy("value"))
        rows_ = axes(rows, c).withColumn("gap", gap)
        step = (F.max("value") - F.min("value")) / F.greatest(F.count("*") - 1, F.lit(1))
        return rows_.agg(F.count("*").alias("n"), F.min("value").alias("first"), step.alias("step"), F.min("gap").alias("least"), F.max("gap").alias("most")).select(F.struct("*").alias(c))

    both = axis("lon").crossJoin(axis("lat"))  # one row each
    counts = rows.groupBy("lon", "lat").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("fullest"), F.count("*").alias("cells"))
    even = lambda a: (a["most"] - a["step"] <= tolerance * a["step"]) & (a["step"] - a["least"] <= tolerance * a["step"])
    x, y = F.col("lon"), F.col("lat")
    fine = (F.col("rows") >= 4) & (x["n"] >= 2) & (y["n"] >= 2) & (F.col("fullest") == 1) & (x["n"] * y["n"] == F.col("rows")) & even(x) & even(y)
    return both.crossJoin(counts).select(F.coalesce(fine, F.lit(False)).alias("is_grid"), x["n"].alias("nx"), y["n"].alias("ny"), x["first"].alias("lon"), y["first"].alias("lat"), x["step"].alias("step_lon"), y["step"].alias("step_lat"))


def on_lattice(rows: DataFrame, grid: Grid) -> DataFrame:
    """Rows with their cell (i, j) and its column-major number."""
    i = F.round((F.col("lon") - grid.lon) / grid.step_lon).cast("int")
    j = F.round((F.col("lat") - grid.lat) / grid.step_lat).cast("int")
    return rows.withColumn("i", i).withColumn("j", j).withColumn("cell", F.col("i") * grid.ny + F.col("j"))


def frames_of(rows: DataFrame) -> DataFrame:
    """rows (t_seconds, ...) with f, the number of their time among all distinct times."""
    times = axes(rows, "t_seconds").select(F.col("value").alias("t_seconds"), F.col("rank").alias("f"))
    return rows.join(times, "t_seconds")


def upper_median_gap(rows: DataFrame) -> DataFrame:
    """One row (gap): the upper median of the steps between distinct times; 1 if there are none."""
    gap = F.col("value") - F.lag("value").over(Window.orderBy("value"))
    gaps = axes(rows, "t_seconds").withColumn("gap", gap).filter("gap > 0").agg(F.array_sort(F.collect_list("gap")).alias("g"))
    return gaps.select(F.coalesce(F.get("g", F.floor(F.size("g") / 2).cast("int")).cast("double"), F.lit(1.0)).alias("gap"))


def info(rows: DataFrame) -> DataFrame:
    """One row: frames, samples, span of time, and the box of the first frame."""
    first = rows.agg(F.min("t_seconds").alias("t0"))
    start = rows.join(F.broadcast(first), F.col("t_seconds") == F.col("t0"))  # one row
    b = start.agg(F.count("*").alias("samples"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))
    t = rows.agg(F.count_distinct("t_seconds").alias("frames"), F.count("*").alias("rows"), F.min("t_seconds").alias("t_min"), F.max("t_seconds").alias("t_max"))
    return t.crossJoin(b)


# ---- lookup


def blocks(frames: DataFrame) -> DataFrame:
    """Each cell with the samples of its right, upper and diagonal neighbour (itself at an edge), so that a place
    needs a single cell."""
    s = F.struct("speed", "direction")
    right = F.coalesce(F.lead(s).over(Window.partitionBy("f", "j").orderBy("i")), s)
    out = frames.select("f", "i", "j", s.alias("s00"), right.alias("s10"))
    up = lambda c: F.coalesce(F.lead(c).over(Window.partitionBy("f", "i").orderBy("j")), F.col(c))
    return out.select("f", "i", "j", "s00", "s10", up("s00").alias("s01"), up("s10").alias("s11"))


def corners(points: DataFrame, frames: DataFrame, grid: Grid) -> DataFrame:
    """points (f, lon, lat, ...) with speed and direction by inverse squared distance (in degrees) to the cell's
    corners; a corner that is hit counts alone. Places outside are held at the edge."""
    x, y = (F.col("lon") - grid.lon) / grid.step_lon, (F.col("lat") - grid.lat) / grid.step_lat
    low = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("int")
    high = lambda v, n: F.least(F.greatest(F.ceil(v), F.lit(0)), F.lit(n - 1)).cast("int")
    at = points.withColumns({"i": low(x, grid.nx), "j": low(y, grid.ny), "i_hi": high(x, grid.nx), "j_hi": high(y, grid.ny)})
    rows = at.join(blocks(frames), ["f", "i", "j"])

    def corner(s: str, i: Column, j: Column, used: Column) -> Column:
        dx, dy = F.col("lon") - (i * grid.step_lon + grid.lon), F.col("lat") - (j * grid.step_lat + grid.lat)
        return F.struct(F.col(s).alias("s"), (dx * dx + dy * dy).alias("d2"), used.alias("used"))

    i, j, wide, tall = F.col("i"), F.col("j"), F.col("i_hi") > F.col("i"), F.col("j_hi") > F.col("j")
    four = F.array(corner("s00", i, j, F.lit(True)), corner("s10", i + 1, j, wide), corner("s01", i, j + 1, tall), corner("s11", i + 1, j + 1, wide & tall))
    return weighed(rows.withColumn("near", F.filter(four, lambda c: c["used"]))).drop("i", "j", "i_hi", "j_hi", "s00", "s10", "s01", "s11")


def weighed(rows: DataFrame) -> DataFrame:
    """rows with near, an array of (s, d2), blended into speed and direction."""
    hit = F.get(F.filter("near", lambda c: c["d2"] == 0), F.lit(0))["s"]
    total = lambda g: F.aggregate("near", F.lit(0.0), lambda a, c: a + g(c["s"]) / c["d2"])
    exact = F.exists("near", lambda c: c["d2"] == 0)
    speed = total(lambda s: s["speed"]) / total(lambda s: F.lit(1.0))
    direction = winds.turn(F.degrees(F.atan2(total(lambda s: F.sin(F.radians(s["direction"]))), total(lambda s: F.cos(F.radians(s["direction"]))))))
    # evaluated only without a hit: a corner at no distance would divide by zero
    return rows.withColumns({"speed": F.when(exact, hit["speed"]).otherwise(speed), "direction": F.when(exact, hit["direction"]).otherwise(direction)}).drop("near")


def nearest(points: DataFrame, sites: DataFrame, k: int = 4) -> DataFrame:
    """(id, site, d2, place): each point's k nearest sites in the plane, exactly; ties to the smaller site.

    Sites lie in square buckets of about k each. A point looks at the buckets around it and is done when its
    k-th neighbour is nearer than anything outside them; the others look twice as far, until none is left. What a
    round leaves is kept, so that a round starts from the last one and not from the beginning.
    """
    spark = points.sparkSession
    # of sites in one place only the k smallest can be among the nearest
    smallest = Window.partitionBy("x", "y").orderBy("site")
    sites = sites.select(F.col("id").alias("site"), F.col("lon").alias("x"), F.col("lat").alias("y")).filter("x is not null and y is not null")
    sites = sites.withColumn("copy", F.row_number().over(smallest)).filter(F.col("copy") <= k).drop("copy").persist(StorageLevel.DISK_ONLY)
    box = sites.agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
    if not box.n:
        return spark.createDataFrame([], "id long, site long, d2 double, place int")
    size = max(((box.b - box.a) * (box.d - box.c) * k / box.n) ** 0.5, (box.b - box.a + box.d - box.c) / box.n, 1e-9)
    cell = lambda c: F.floor(F.col(c) / size)
    placed = sites.withColumn("bx", cell("x")).withColumn("by", cell("y"))
    left, reach, done = points.select("id", "lon", "lat"), 1, None
    order = Window.partitionBy("id").orderBy("d2", "site")
    while True:
        ring = lambda c: F.explode(F.sequence(cell(c) - reach, cell(c) + reach))  # noqa: E731, B023
        asked = left.select("*", ring("lon").alias("bx")).select("*", ring("lat").alias("by"))
        # compressed rows look few enough for the driver to broadcast when they are not
        met = asked.join(placed.hint("merge"), ["bx", "by"])
        d2 = (F.col("lon") - F.col("x")) * (F.col("lon") - F.col("x")) + (F.col("lat") - F.col("y")) * (F.col("lat") - F.col("y"))
        best = met.select("id", "site", d2.alias("d2")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).persist(StorageLevel.DISK_ONLY)
        sure = best.groupBy("id").agg(F.count("*").alias("n"), F.max("d2").alias("far")).filter((F.col("n") >= min(k, box.n)) & (F.col("far") <= (reach * size) ** 2)).select("id")
        whole = reach * size >= max(box.b - box.a, box.d - box.c) + 720  # nothing lies outside
        got = best if whole else best.join(sure.hint("merge"), "id", "left_semi")
        done = got if done is None else done.unionByName(got)
        if whole:
            return done
        left = left.join(sure.hint("merge"), "id", "left_anti").persist(StorageLevel.DISK_ONLY)
        if left.isEmpty():
            return done
        reach *= 2


def blended_nearest(points: DataFrame, sites: DataFrame, k: int = 4) -> DataFrame:
    """points (id, lon, lat) with speed and direction of their k nearest sites (id, lon, lat, speed, direction)."""
    near = nearest(points, sites, k).join(sites.select(F.col("id").alias("site"), F.struct("speed", "direction").alias("s")).hint("merge"), "site")
    lists = near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s", "d2"))), lambda x: F.struct(x["s"].alias("s"), x["d2"].alias("d2"))).alias("near"))
    return points.join(weighed(lists).hint("merge"), "id")


def first_frames(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the first n frames."""
    return rows.filter(F.col("f") < n)


def within(points: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """(id, site, d2): the sites (id, lon, lat) within a radius in degrees of each point (id, lon, lat), its edge included.

    Sites lie in square buckets of the radius, so a point meets the nine around it and nothing else. A null place is
    near nothing.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    placed = sites.select(F.col("id").alias("site"), F.col("lon").alias("x"), F.col("lat").alias("y"), cell("lon").alias("bx"), cell("lat").alias("by"))
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    asked = points.select("id", "lon", "lat", around("lon").alias("bx")).select("*", around("lat").alias("by"))
    d2 = (F.col("lon") - F.col("x")) * (F.col("lon") - F.col("x")) + (F.col("lat") - F.col("y")) * (F.col("lat") - F.col("y"))
    return asked.join(placed, ["bx", "by"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).select("id", "site", "d2")


def in_circle(lon: float, lat: float, radius: float) -> Column:
    """Whether a row lies within a circle in degrees, its edge included."""
    dx, dy = F.col("lon") - lon, F.col("lat") - lat
    return dx * dx + dy * dy <= radius * radius


def brushed(rows: DataFrame, lon: float, lat: float, radius: float, add: float | None = None, put: float | None = None, direction: float | None = None) -> DataFrame:
    """rows with speeds raised by ``add`` (never under 0) or put to ``put``, or directions set, inside a circle."""
    inside = in_circle(lon, lat, radius)
    if direction is not None:
        return rows.withColumn("direction", F.when(inside, F.lit(direction)).otherwise(F.col("direction")))
    new = F.greatest(F.col("speed") + add, F.lit(0.0)) if put is None else F.greatest(F.lit(put), F.lit(0.0))
    return rows.withColumn("speed", F.when(inside, new).otherwise(F.col("speed")))


def at_time(points: DataFrame, frames: DataFrame, grid: Grid) -> DataFrame:
    """points (id, lon, lat, t) with speed and direction of the looped field at their time."""
    lo, hi, alpha = winds.bracket(F.col("t"), grid.frames, grid.step_s, grid.crossfade_s)
    asked = points.withColumns({"f_lo": lo, "f_hi": hi, "alpha": alpha})
    first = corners(asked.withColumn("f", F.col("f_lo")), frames, grid).withColumnsRenamed({"speed": "s0", "direction": "d0"}).drop("f")
    second = corners(asked.select("id", "lon", "lat", F.col("f_hi").alias("f")), frames, grid).select("id", F.col("speed").alias("s1"), F.col("direction").alias("d1"))
    both = first.join(second, "id")
    still = F.col("alpha") == 0
    speed = F.when(still, F.col("s0")).otherwise(F.col("s0") * (1 - F.col("alpha")) + F.col("s1") * F.col("alpha"))
    direction = F.when(still, F.col("d0")).otherwise(winds.blend(F.col("d0"), F.col("d1"), F.col("alpha")))
    return both.withColumns({"speed": speed, "direction": direction}).drop("s0", "s1", "d0", "d1", "f_lo", "f_hi", "alpha")


def frame_at(frames: DataFrame, grid: Grid, t: float) -> DataFrame:
    """(i, j, lon, lat, speed, direction): the field at a time on the frames' own cells."""
    lo, hi, alpha = winds.bracket(F.lit(float(t)), grid.frames, grid.step_s, grid.crossfade_s)
    a = frames.filter(F.col("f") == lo).select("i", "j", "lon", "lat", F.col("speed").alias("s0"), F.col("direction").alias("d0"))
    b = frames.filter(F.col("f") == hi).select("i", "j", F.col("speed").alias("s1"), F.col("direction").alias("d1"))
    still = alpha == 0
    return a.join(b, ["i", "j"]).select(
        "i", "j", "lon", "lat",
        F.when(still, F.col("s0")).otherwise(F.col("s0") * (1 - alpha) + F.col("s1") * alpha).alias("speed"),
        F.when(still, F.col("d0")).otherwise(winds.blend(F.col("d0"), F.col("d1"), alpha)).alias("direction"),
    )


# ---- resampling


def bake(frames: DataFrame, grid: Grid, onto: Grid, factor: float = winds.MPS_PER_KNOT) -> DataFrame:
    """(ix, iy, f, u, v): the frames resampled onto another lattice, as the air's movement in metres a second."""
    cells = lattice(frames.sparkSession, Grid(onto.lon, onto.lat, onto.step_lon, onto.step_lat, onto.nx, onto.ny, grid.frames))
    cells = cells.select("f", F.col("i").alias("ix"), F.col("j").alias("iy"), "lon", "lat")
    u, v = winds.toward(F.col("speed"), F.col("direction"), factor)
    return corners(cells, frames, grid).select("ix", "iy", "f", u.alias("u"), v.alias("v"))


def packed(baked: DataFrame) -> DataFrame:
    """(ix, iy, uv): each cell's frames in one array, in order."""
    return baked.groupBy("ix", "iy").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "u", "v"))), lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"))).alias("uv"))


def sample_baked(points: DataFrame, cells: DataFrame, onto: Grid, grid: Grid) -> DataFrame:
    """points (id, lon, lat, t) with u and v of the nearest baked cell (ix, iy, uv), straight between frames."""
    shift = F.when(F.col("lon") < onto.lon - 1e-9, 360.0).when(F.col("lon") > onto.lon + (onto.nx - 1) * onto.step_lon + 1e-9, -360.0).otherwise(0.0)
    far = lambda x: F.greatest(F.lit(onto.lon) - x, x - (onto.lon + (onto.nx - 1) * onto.step_lon), F.lit(0.0))
    lon = F.when(far(F.col("lon") + shift) < far(F.col("lon")), F.col("lon") + shift).otherwise(F.col("lon"))
    ix = F.least(F.greatest(F.round((lon - onto.lon) / onto.step_lon), F.lit(0.0)), F.lit(onto.nx - 1.0)).cast("int")
    iy = F.least(F.greatest(F.round((F.col("lat") - onto.lat) / onto.step_lat), F.lit(0.0)), F.lit(onto.ny - 1.0)).cast("int")
    lo, hi, alpha = winds.bracket(F.col("t"), grid.frames, grid.step_s, grid.crossfade_s)
    rows = points.withColumns({"ix": ix, "iy": iy, "lo": lo, "hi": hi, "alpha": alpha}).join(cells, ["ix", "iy"])
    mixed = lambda c: F.get("uv", F.col("lo"))[c] * (1 - F.col("alpha")) + F.get("uv", F.col("hi"))[c] * F.col("alpha")
    return rows.withColumns({"u": mixed("u"), "v": mixed("v")}).drop("ix", "iy", "lo", "hi", "alpha", "uv")


def bake_shape(lon_extent: float, lat_extent: float, step: float, most: int = 1024) -> tuple[float, int, int]:
    """(step, nx, ny) of a bake: the step grows so that no side has more than ``most`` cells."""
    step = max(step, max(lon_extent, lat_extent) / most)
    return step, math.ceil(lon_extent / step) + 1, math.ceil(lat_extent / step) + 1


# ---- pairs, drift and drawing


def paired(messages: DataFrame) -> DataFrame:
    """messages (t, cell, is_u, value, msg) as (t, cell, u, v): the last of each kind; what lacks one is left out."""
    last = lambda kind: F.max_by(F.when(kind, F.col("value")), F.when(kind, F.col("msg")))
    out = messages.groupBy("t", "cell").agg(last(F.col("is_u")).alias("u"), last(~F.col("is_u")).alias("v"))
    return out.filter("u is not null and v is not null and not isnan(u) and not isnan(v)")


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(f, i, j, err_uv, err_deg, speed): how two fields on the same cells differ; a missing cell is an error."""
    left = a.select("f", "i", "j", F.col("u").alias("u0"), F.col("v").alias("v0"))
    right = b.select("f", "i", "j", F.col("u").alias("u1"), F.col("v").alias("v1"))
    both = left.join(right, ["f", "i", "j"], "full")
    gone = F.col("u0").isNull() | F.col("u1").isNull()
    err = F.when(gone, F.raise_error(F.lit("the fields have different cells"))).otherwise(F.hypot(F.col("u0") - F.col("u1"), F.col("v0") - F.col("v1")))
    d0, d1 = winds.direction_or_north(F.col("u0"), F.col("v0")), winds.direction_or_north(F.col("u1"), F.col("v1"))
    return both.select("f", "i", "j", err.alias("err_uv"), angle_between(d0, d1).alias("err_deg"), F.hypot("u0", "v0").alias("speed"))


def drift_by_speed(rows: DataFrame, edges: list[float]) -> DataFrame:
    """(bucket, n, mean_deg, max_deg) by half-open speed buckets below each edge, the last without one."""
    bucket = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        bucket = F.when(F.col("speed") < edges[k], F.lit(k)).otherwise(bucket)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("err_deg").alias("mean_deg"), F.max("err_deg").alias("max_deg"))


def drift_over(rows: DataFrame, limits: list[float]) -> DataFrame:
    """One row: how many errors reach each limit, their mean and the largest."""
    return rows.agg(*[F.count_if(F.col("err_uv") >= t).alias(f"over_{k}") for k, t in enumerate(limits)], F.avg("err_uv").alias("mean"), F.max("err_uv").alias("largest"))


def visible(rows: DataFrame, i0: int, i1: int, j0: int, j1: int, step: int) -> DataFrame:
    """Rows of a window of cells, thinned on a fixed stride of the whole grid."""
    return rows.filter(F.col("i").between(i0, i1) & F.col("j").between(j0, j1) & (F.col("i") % step == 0) & (F.col("j") % step == 0))


def to_view(lon: Column, lat: Column, lon0: float, lat0: float, scale: float) -> tuple[Column, Column]:
    """Screen place of an equirectangular view around (lon0, lat0), y down."""
    return (lon - lon0) * math.cos(math.radians(lat0)) * scale, -(lat - lat0) * scale


def from_view(x: Column, y: Column, lon0: float, lat0: float, scale: float) -> tuple[Column, Column]:
    return x / (math.cos(math.radians(lat0)) * scale) + lon0, -y / scale + lat0
