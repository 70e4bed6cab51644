"""Parameter studies: trials over routes and seeds, their statistics and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def planned(routes: DataFrame, seeds: DataFrame, trials: DataFrame) -> DataFrame:
    """Every route with every seed and trial; three short lists whose product is the work to do."""
    return trials.crossJoin(routes).crossJoin(seeds)


def by_route(results: DataFrame) -> DataFrame:
    """results (trial, route, seed, fitness) as (trial, route, seeds, mean, deviation), population deviation."""
    return results.groupBy("trial", "route").agg(F.count("*").alias("seeds"), F.avg("fitness").alias("mean"), F.coalesce(F.stddev_pop("fitness"), F.lit(0.0)).alias("deviation"))


def by_trial(routes: DataFrame) -> DataFrame:
    """by_route() as (trial, routes, mean, deviation) of the route means."""
    return routes.groupBy("trial").agg(F.count("*").alias("routes"), F.avg("mean").alias("mean"), F.coalesce(F.stddev_pop("mean"), F.lit(0.0)).alias("deviation"))


def scores(routes: DataFrame, baseline: DataFrame) -> DataFrame:
    """(trial, score): mean ratio of a trial's route means to the baseline (route, mean); routes without one are
    skipped, and a trial that has none left scores infinity."""
    known = routes.join(baseline.select("route", F.col("mean").alias("base")), "route", "left")
    return known.groupBy("trial").agg(F.coalesce(F.avg(F.col("mean") / F.col("base")), F.lit(float("inf"))).alias("score"))


def unknown_routes(routes: DataFrame, baseline: DataFrame) -> DataFrame:
    """(route): what a study asks for and the baseline lacks; must be empty before it starts."""
    return routes.select("route").distinct().join(baseline, "route", "left_anti")
