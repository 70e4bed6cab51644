"""Land masks from polygons, signed distances to the coast, their gradient and lookups.

A land grid has square cells; cell (i, j) is centred at (-180 + (i + 1/2) c, -90 + (j + 1/2) c).
Longitude wraps, latitude ends at the poles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions.geo import METRES_PER_DEGREE


def cells(spark: SparkSession, cell: float) -> DataFrame:
    """(i, j, lon, lat) of a land grid."""
    nx, ny = round(360 / cell), round(180 / cell)
    i, j = (F.col("id") % nx).cast("int"), F.floor(F.col("id") / nx).cast("int")
    return spark.range(nx * ny).select(i.alias("i"), j.alias("j"), ((i + 0.5) * cell - 180).alias("lon"), ((j + 0.5) * cell - 90).alias("lat"))


def edges(vertices: DataFrame) -> DataFrame:
    """(poly, ring, x1, y1, x2, y2) of open rings (poly, ring, k, lon, lat)."""
    order = Window.partitionBy("poly", "ring").orderBy("k")
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(order))
    return vertices.select("poly", "ring", F.col("lon").alias("x1"), F.col("lat").alias("y1"), after("lon").alias("x2"), after("lat").alias("y2"))


def boxes(vertices: DataFrame) -> DataFrame:
    """(poly, lon_min, lon_max, lat_min, lat_max)."""
    return vertices.groupBy("poly").agg(F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))


def rasterized(vertices: DataFrame, cell: float) -> DataFrame:
    """(i, j) of the cells whose centre lies in a polygon, holes left out, by scan lines.

    Each edge is cut by the rows it spans; a row's cuts, in order, open and close its land. Nothing is compared
    with cells that are not land.
    """
    nx, ny = round(360 / cell), round(180 / cell)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.floor((low + 90) / cell - 0.5) - 1, F.lit(0))
    last = F.least(F.ceil((high + 90) / cell - 0.5) + 1, F.lit(ny - 1))
    rows = edges(vertices).filter("y1 != y2").select("*", F.explode(F.when(first <= last, F.sequence(first, last))).alias("j"))
    lat = (F.col("j") + 0.5) * cell - 90
    rows = rows.filter((F.col("y1") > lat) != (F.col("y2") > lat))
    x = F.col("x1") + (lat - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    cuts = rows.groupBy("poly", "j").agg(F.array_sort(F.collect_list(x)).alias("x"))
    pair = F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda k: F.struct(F.get("x", k * 2).alias("a"), F.get("x", k * 2 + 1).alias("b")))
    land = cuts.select("j", F.explode(pair).alias("p"))
    start = F.greatest(F.floor((F.col("p.a") + 180) / cell - 0.5), F.lit(0))
    end = F.least(F.ceil((F.col("p.b") + 180) / cell - 0.5), F.lit(nx - 1))
    found = land.select("j", "p", F.explode(F.when(start <= end, F.sequence(start, end))).alias("i"))
    lon = (F.col("i") + 0.5) * cell - 180
    return found.filter((lon >= F.col("p.a")) & (lon < F.col("p.b"))).select(F.col("i").cast("int"), F.col("j").cast("int")).distinct()


def mask(vertices: DataFrame, cell: float) -> DataFrame:
    """(i, j, lon, lat, is_land) of the whole grid."""
    land = rasterized(vertices, cell).withColumn("is_land", F.lit(True))
    return cells(vertices.sparkSession, cell).join(land, ["i", "j"], "left").withColumn("is_land", F.coalesce("is_land", F.lit(False)))


def _squared_distance(grid: DataFrame, seed: Column, nx: int) -> DataFrame:
    """(i, j, d2): squared cells to the nearest seed. Rows first: the nearest seed of each column by two windows;
    then each row's columns are compared, the short way round."""
    order = Window.partitionBy("i").orderBy("j")
    below = F.last(F.when(seed, F.col("j")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(F.when(seed, F.col("j")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("j") - below, above - F.col("j"))
    column = grid.select("i", "j", gap.alias("gap"))
    rows = column.groupBy("j").agg(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("i", "gap"))).alias("row"))
    across = lambda c: F.least(F.abs(c["i"] - F.col("i")), nx - F.abs(c["i"] - F.col("i")))
    d2 = F.array_min(F.transform("row", lambda c: across(c) * across(c) + c["gap"] * c["gap"]))
    return column.select("i", "j").join(rows, "j").select("i", "j", d2.alias("d2"))


def signed_distance(grid: DataFrame, cell: float) -> DataFrame:
    """grid (i, j, lon, lat, is_land) with sdf: metres to the coast, negative on land, on a uniform cell size.

    A grid without land is infinitely far from it, and the other way round.
    """
    nx = round(360 / cell)
    to_land, to_sea = _squared_distance(grid, F.col("is_land"), nx), _squared_distance(grid, ~F.col("is_land"), nx)
    both = grid.join(to_land.withColumnRenamed("d2", "land2"), ["i", "j"]).join(to_sea.withColumnRenamed("d2", "sea2"), ["i", "j"])
    far = F.lit(float("inf"))
    metres = F.when(F.col("is_land"), -F.coalesce(F.sqrt("sea2"), far)).otherwise(F.coalesce(F.sqrt("land2"), far)) * (cell * METRES_PER_DEGREE)
    return both.withColumn("sdf", metres).drop("land2", "sea2")


def gradient(field: DataFrame, cell: float) -> DataFrame:
    """field (i, j, lat, sdf) with (g_east, g_north): the unit direction in which sdf grows."""
    ring = Window.partitionBy("j").orderBy("i")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    west = F.coalesce(F.lag("sdf").over(ring), F.last("sdf").over(whole))
    east = F.coalesce(F.lead("sdf").over(ring), F.first("sdf").over(whole))
    line = Window.partitionBy("i").orderBy("j")
    south, north = F.coalesce(F.lag("sdf").over(line), F.col("sdf")), F.coalesce(F.lead("sdf").over(line), F.col("sdf"))
    size = cell * METRES_PER_DEGREE * 2
    out = field.withColumns({"dx": (east - west) / (F.greatest(F.cos(F.radians("lat")), F.lit(1e-9)) * size), "dy": (north - south) / size})
    length = F.hypot("dx", "dy")
    unit = lambda c: F.when(length > 1e-12, F.col(c) / F.when(length > 1e-12, length).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    return out.withColumns({"g_east": unit("dx"), "g_north": unit("dy")}).drop("dx", "dy")


def looked_up(points: DataFrame, field: DataFrame, column: str, cell: float) -> DataFrame:
    """points (id, lon, lat, ...) with a column of the grid, bilinear between cell centres."""
    nx, ny = round(360 / cell), round(180 / cell)
    x = F.pmod(F.col("lon") + 180, F.lit(360.0)) / cell - 0.5
    y = F.least(F.greatest((F.col("lat") + 90) / cell - 0.5, F.lit(0.0)), F.lit(ny - 1.0))
    asked = points.withColumns({"x": x, "y": y})
    part = lambda di, dj: F.struct(
        F.pmod(F.floor("x") + di, F.lit(nx)).cast("int").alias("i"),
        F.least(F.floor("y") + dj, F.lit(ny - 1)).cast("int").alias("j"),
        (F.abs(1 - di - (F.col("x") - F.floor("x"))) * F.abs(1 - dj - (F.col("y") - F.floor("y")))).alias("w"),
    )
    four = asked.select("id", F.inline(F.array(part(0, 0), part(1, 0), part(0, 1), part(1, 1))))
    blend = four.join(field.select("i", "j", column), ["i", "j"]).groupBy("id").agg(F.sum(F.when(F.col("w") > 0, F.col("w") * F.col(column)).otherwise(F.lit(0.0))).alias(column))
    return points.join(blend, "id")


def neighbours(grid: DataFrame, cell: float) -> DataFrame:
    """(i, j, ni, nj): the up to eight cells around each."""
    nx, ny = round(360 / cell), round(180 / cell)
    steps = [(di, dj) for dj in (-1, 0, 1) for di in (-1, 0, 1) if di or dj]
    each = grid.select("i", "j", F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in steps])).alias("s"))
    out = each.select("i", "j", F.pmod(F.col("i") + F.col("s.di"), F.lit(nx)).cast("int").alias("ni"), (F.col("j") + F.col("s.dj")).alias("nj"))
    return out.filter(F.col("nj").between(0, ny - 1))
