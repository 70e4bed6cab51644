"""Forecast archives: index lines, download plans, inspection of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions.text import cycle


def byte_ranges(lines: DataFrame) -> DataFrame:
    """lines (file, line_no, line) of an index as (file, msg, lo, hi, var): the wind components at 10 m.

    A message ends where the next line of any kind begins; the last has no end.
    """
    part = F.split("line", ":")
    rows = lines.select("file", "line_no", F.get(part, 0).cast("int").alias("msg"), F.get(part, 1).cast("long").alias("lo"), F.get(part, 3).alias("var"), F.get(part, 4).alias("level"))
    rows = rows.withColumn("hi", F.lead("lo").over(Window.partitionBy("file").orderBy("line_no")))
    return rows.filter(F.col("var").isin("UGRD", "VGRD") & (F.col("level") == "10 m above ground")).select("file", "msg", "lo", "hi", "var")


def frame_plan(spark: SparkSession, start: int, end: int, interval_h: int, base: str = "https://archive.example/gfs") -> DataFrame:
    """(k, valid, cycle, ahead, url) for each frame of [start, end) in Unix seconds."""
    n = max(0, -(-(end - start) // (interval_h * 3600)))
    rows = spark.range(n).select(F.col("id").alias("k"), (F.lit(start) + F.col("id") * interval_h * 3600).alias("valid"))
    first, ahead = cycle(F.floor(F.pmod(F.col("valid"), F.lit(86400)) / 3600).cast("int"))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("valid") / 86400).cast("int")), "yyyyMMdd")
    url = F.format_string(base + ".%s/%02d/atmos/gfs.t%02dz.pgrb2.0p25.f%03d", day, first, first, ahead)
    return rows.select("k", "valid", first.alias("cycle"), ahead.alias("ahead"), url.alias("url"))


def fetch_totals(frames: DataFrame) -> DataFrame:
    """One row (fetched, skipped, bytes) over frames (bytes, null where skipped); no fetched frame is an error."""
    out = frames.agg(F.count("bytes").alias("fetched"), F.count_if(F.col("bytes").isNull()).alias("skipped"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return out.withColumn("fetched", F.when(F.col("fetched") == 0, F.raise_error(F.lit("no frame could be fetched")).cast("long")).otherwise(F.col("fetched")))


def ten_metre_wind(messages: DataFrame) -> DataFrame:
    """messages (discipline, category, number, surface, height) of the wind at 10 m; meant to be pushed to the scan."""
    return messages.filter("discipline = 0 and category = 2 and number in (2, 3) and surface = 103 and abs(height - 10) <= 0.5")


def inspected(messages: DataFrame) -> DataFrame:
    """(t, var, cells, finite, lats, uneven): each message's size, finite values and axis, from (t, var, lat, lon, value)."""
    gap = F.col("lat") - F.lag("lat").over(Window.partitionBy("t", "var").orderBy("lat"))
    steps = messages.select("t", "var", "lat").distinct().withColumn("gap", gap).groupBy("t", "var").agg(F.count("*").alias("lats"), (F.max("gap") - F.min("gap")).alias("uneven"))
    sizes = messages.groupBy("t", "var").agg(F.count("*").alias("cells"), F.count_if(~F.isnan("value") & (F.abs("value") < float("inf"))).alias("finite"))
    return sizes.join(steps, ["t", "var"])
