"""Swarm tables: bests over a swarm and its neighbourhoods, and one step of its movement.

A swarm is a long table (run, particle, fit, ...); particles are numbered from 0 in each run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import geo


def best(swarm: DataFrame, *by: str) -> DataFrame:
    """(by..., particle, fit): the particle with the largest fit, the later of equals; NaN never wins."""
    return swarm.filter(~F.isnan("fit")).groupBy(*by).agg(F.max(F.struct("fit", "particle")).alias("b")).select(*by, F.col("b.particle").alias("particle"), F.col("b.fit").alias("fit"))


def ring_best(swarm: DataFrame) -> DataFrame:
    """(run, particle, social, social_fit): the better of each particle's two neighbours on a ring."""
    order = Window.partitionBy("run").orderBy("particle")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("fit", "particle")
    before, after = F.coalesce(F.lag(me).over(order), F.last(me).over(whole)), F.coalesce(F.lead(me).over(order), F.first(me).over(whole))
    return swarm.withColumn("s", F.greatest(before, after)).select("run", "particle", F.col("s.particle").alias("social"), F.col("s.fit").alias("social_fit"))


def torus_shape(n: int) -> tuple[int, int] | None:
    """The most nearly square rows and columns of n places, both at least 2; None if there are none."""
    for rows in range(math.isqrt(n), 1, -1):
        if n % rows == 0:
            return rows, n // rows
    return None


def torus_best(swarm: DataFrame, n: int) -> DataFrame:
    """As ring_best() with the four neighbours on a torus of n places; a ring where n makes no torus."""
    shape = torus_shape(n)
    if shape is None:
        return ring_best(swarm)
    rows, cols = shape
    row, col = F.floor(F.col("particle") / cols), F.col("particle") % cols
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    asked = swarm.select("run", "particle", F.explode(steps).alias("s"), row.alias("row"), col.alias("col"))
    near = F.pmod(F.col("row") + F.col("s.a"), F.lit(rows)) * cols + F.pmod(F.col("col") + F.col("s.b"), F.lit(cols))
    asked = asked.select("run", "particle", near.cast("long").alias("near"))
    other = swarm.select("run", F.col("particle").cast("long").alias("near"), "fit")
    out = asked.join(other, ["run", "near"]).groupBy("run", "particle").agg(F.max(F.struct("fit", "near")).alias("s"))
    return out.select("run", "particle", F.col("s.near").alias("social"), F.col("s.fit").alias("social_fit"))


def stepped(rows: DataFrame, inertia: float, cognitive: float, social: float) -> DataFrame:
    """Waypoints (lon, lat, vel_east, vel_north, best_lon, best_lat, social_lon, social_lat, r1, r2) moved one step.

    Velocities are metres in the tangent plane of the waypoint; places wrap and stay off the poles.
    """
    pull = lambda x, y: geo.delta_to_tangent(F.col("lat"), geo.lon_delta(F.col("lon"), F.col(x)), F.col(y) - F.col("lat"))
    own, others = pull("best_lon", "best_lat"), pull("social_lon", "social_lat")
    east, north = (F.col(v) * inertia + a * (F.col("r1") * cognitive) + b * (F.col("r2") * social) for v, a, b in zip(("vel_east", "vel_north"), own, others, strict=True))
    moved = rows.withColumns({"vel_east": east, "vel_north": north})
    lon, lat = geo.offset(F.col("lon"), F.col("lat"), F.col("vel_east"), F.col("vel_north"))
    return moved.withColumns({"lon": lon, "lat": lat})


def shape_offset(i: Column, n: int, k: Column, size: Column) -> Column:
    """Metres across the course of waypoint i of n in a wave of k half-turns; the ends stay."""
    return F.when((i > 0) & (i < n - 1), size * F.sin(k * math.pi * i / n)).otherwise(F.lit(0.0))


def spread(swarm: DataFrame, column: str) -> DataFrame:
    """(run, spread): population deviation of a column over a run's particles."""
    return swarm.groupBy("run").agg(F.coalesce(F.stddev_pop(column), F.lit(0.0)).alias("spread"))


def shared_out(n: int, shares: list[float]) -> list[int]:
    """n particles by shares: each rounded, the largest share takes up the difference."""
    total = sum(shares)
    if total <= 0:
        return [n] + [0] * (len(shares) - 1)
    counts = [math.floor(n * s / total + 0.5) for s in shares]
    largest = max(range(len(shares)), key=lambda k: (shares[k], k))
    counts[largest] = max(0, counts[largest] + n - sum(counts))
    return counts
