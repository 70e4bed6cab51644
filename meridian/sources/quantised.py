"""Compact wind archives: 10-bit component codes in Parquet, a frame a row group, rows from the north.

It keeps what a video-coded archive keeps of the data (codes, grid, times) without its
picture codec, which no Spark session can decode.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import winds
from meridian.operators.grids import Grid


def one_grid(layouts: DataFrame) -> DataFrame:
    """One row (same): whether all frames (f, lon, lat, step_lon, step_lat, nx, ny) share one layout, bit for bit."""
    return layouts.agg((F.count_distinct("lon", "lat", "step_lon", "step_lat", "nx", "ny") <= 1).alias("same"))


def encoded(frames: DataFrame, grid: Grid) -> DataFrame:
    """frames (f, i, j, speed, direction) as (f, row, i, u, v): codes, the first row the northernmost.

    Every frame must have every cell of the grid once; one that has not is an error.
    """
    u, v = winds.components(F.col("speed"), F.col("direction"))
    out = frames.select("f", (F.lit(grid.ny - 1) - F.col("j")).alias("row"), "i", winds.encode(u).cast("short").alias("u"), winds.encode(v).cast("short").alias("v"))
    whole = frames.groupBy("f").agg(F.count("*").alias("n"), F.count_distinct("i", "j").alias("cells"))
    wrong = whole.filter((F.col("n") != grid.nx * grid.ny) | (F.col("cells") != F.col("n"))).limit(1).collect()
    if wrong:
        raise ValueError(f"frame {wrong[0].f} has {wrong[0].cells} of {grid.nx * grid.ny} cells")
    return out


def write(frames: DataFrame, grid: Grid, path: str) -> None:
    """Parquet by frame, with the grid beside it as one JSON row."""
    encoded(frames, grid).repartition("f").sortWithinPartitions("f", "row", "i").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/codes")
    frames.sparkSession.createDataFrame([(json.dumps(vars(grid)),)], "grid string").coalesce(1).write.mode("overwrite").text(f"{path}/grid")


def read_grid(spark: SparkSession, path: str) -> Grid:
    return Grid(**json.loads(spark.read.text(f"{path}/grid").first()[0]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(f, i, j, lon, lat, speed, direction) of an archive; a calm comes from the north."""
    g = read_grid(spark, path)
    j = F.lit(g.ny - 1) - F.col("row")
    rows = spark.read.parquet(f"{path}/codes").select("f", "i", j.alias("j"), winds.decode(F.col("u")).alias("u"), winds.decode(F.col("v")).alias("v"))
    return rows.select("f", "i", "j", (F.col("i") * g.step_lon + g.lon).alias("lon"), (F.col("j") * g.step_lat + g.lat).alias("lat"), winds.speed(F.col("u"), F.col("v")).alias("speed"), winds.direction_or_north(F.col("u"), F.col("v")).alias("direction"))
