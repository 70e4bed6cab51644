"""What a viewer of voyages asks for: edits of a waypoint, boxes to show, tables of segments, frame access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions import geo, text
from meridian.operators.grids import Grid


def frame(frames: DataFrame, k: int) -> DataFrame:
    """One frame of a field."""
    return frames.filter(F.col("f") == k)


def moved(points: DataFrame, voyage: int, k: int, dlon: float, dlat: float) -> DataFrame:
    """Waypoints with one of them moved by degrees."""
    here = (F.col("voyage") == voyage) & (F.col("k") == k)
    return points.withColumns({"lon": F.when(here, F.col("lon") + dlon).otherwise(F.col("lon")), "lat": F.when(here, F.col("lat") + dlat).otherwise(F.col("lat"))})


def shown_box(points: DataFrame, pad: float = 0.15, least: float = 1.0) -> DataFrame:
    """(voyage, lon_min, lon_max, lat_min, lat_max) to show a voyage with some room around it."""
    box = points.groupBy("voyage").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    dx, dy = F.greatest((F.col("e") - F.col("w")) * pad, F.lit(least)), F.greatest((F.col("n") - F.col("s")) * pad, F.lit(least))
    return box.select("voyage", (F.col("w") - dx).alias("lon_min"), (F.col("e") + dx).alias("lon_max"), F.greatest(F.col("s") - dy, F.lit(-geo.POLE_LAT)).alias("lat_min"), F.least(F.col("n") + dy, F.lit(geo.POLE_LAT)).alias("lat_max"))


def box_of(grid: Grid) -> geo.Box:
    """The box that a baked grid covers."""
    east = grid.lon + (grid.nx - 1) * grid.step_lon
    wrapped = east - 360.0 if east > 180.0 else east
    return geo.Box(grid.lon, wrapped, grid.lat, grid.lat + (grid.ny - 1) * grid.step_lat)


def ends_or_corners(box: geo.Box, start: tuple[float, float] | None, end: tuple[float, float] | None):
    """Where a voyage begins and ends: as asked, else the box's south-west and north-east corner."""
    return start or (box.lon_min, box.lat_min), end or (box.lon_max, box.lat_max)


def segment_table(segments: DataFrame) -> DataFrame:
    """(voyage, k, line): segments (seconds, load, fuel, speed_kmh, land_m) as text, columns even within a voyage."""
    parts = {
        "p0": text.duration(F.col("seconds")),
        "p1": F.format_string("motor=%.2f", F.bround("load", 2)),
        "p2": F.concat(F.lit("fuel="), text.fuel(F.col("fuel"))),
        "p3": F.format_string("speed=%.1f km/h", F.bround("speed_kmh", 1)),
        "p4": F.concat(F.lit("land="), text.land_km(F.col("land_m"))),
    }
    rows = segments.select("voyage", "k", F.col("k").cast("string").alias("no"), *[v.alias(n) for n, v in parts.items()])
    wide = lambda n: f"max(length({n})) over (partition by voyage)"
    number = F.expr(f"concat('[', lpad(no, {wide('no')}, ' '), ']')")
    cells = F.concat_ws(" | ", *[F.expr(f"rpad({n}, {wide(n)}, ' ')") for n in parts])
    return rows.select("voyage", "k", F.concat_ws(" ", number, cells).alias("line"))
