"""Wind observations and voyages derived from the driver's tables, by whole-number rules.

Each event is an observation: its place and direction follow from event_id, its speed in
knots is the event's value. A user's events in order of time are a voyage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.session import table


def seconds_since_2024(ts: Column) -> Column:
    """Whole seconds, whatever the session's time zone."""
    days = F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def wind_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, lon, lat, speed, direction, t_seconds)."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"),
        "user_id",
        ((e * 7919 % 36000).cast("double") / 100.0 - 180.0).alias("lon"),
        ((e * 104729 % 17000).cast("double") / 100.0 - 85.0).alias("lat"),
        F.col("value").alias("speed"),
        (e * 31 % 360).cast("double").alias("direction"),
        seconds_since_2024(F.col("ts")).alias("t_seconds"),
    )


OBSERVATIONS_SQL = """obs AS (
  SELECT event_id AS id, user_id, CAST((event_id * 7919) % 36000 AS DOUBLE) / 100.0::DOUBLE - 180.0::DOUBLE AS lon,
         CAST((event_id * 104729) % 17000 AS DOUBLE) / 100.0::DOUBLE - 85.0::DOUBLE AS lat, value AS speed,
         CAST((event_id * 31) % 360 AS DOUBLE) AS direction,
         CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS t_seconds FROM events)"""


def voyages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(voyage, k, lon, lat, seconds): waypoints by user, k from 0; seconds since the waypoint before."""
    order = Window.partitionBy("user_id").orderBy("t_seconds", "id")
    rows = wind_observations(spark, sf_dir)
    step = F.coalesce(F.col("t_seconds") - F.lag("t_seconds").over(order), F.lit(0)).cast("double")
    return rows.select(F.col("user_id").alias("voyage"), (F.row_number().over(order) - 1).alias("k"), "lon", "lat", step.alias("seconds"))


VOYAGES_SQL = OBSERVATIONS_SQL + """,
voy AS (
  SELECT user_id AS voyage, CAST(row_number() OVER w - 1 AS INTEGER) AS k, lon, lat,
         CAST(coalesce(t_seconds - lag(t_seconds) OVER w, 0) AS DOUBLE) AS seconds
  FROM obs WINDOW w AS (PARTITION BY user_id ORDER BY t_seconds, id))"""
