"""Studies that look for good search settings: propose, search as Spark rows, score, keep a journal."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions.ship import Ship
from meridian.kernels.search import Settings
from meridian.operators import searches, study


@dataclass
class Study:
    """What a study found: (settings, score) of each trial, the smaller the better; the best of them."""

    history: list[tuple[dict, float]] = field(default_factory=list)

    @property
    def best(self) -> tuple[dict, float] | None:
        return min(self.history, key=lambda h: h[1], default=None)

    def summary(self) -> str:
        settings, score = self.best or ({}, math.inf)
        return json.dumps({"trials": len(self.history), "best_score": score, "best": settings})


def baseline(routes: DataFrame, seeds: int, ship: Ship, wind, land, settings: Settings) -> DataFrame:
    """(route, mean): mean fitness of each route under some settings."""
    return _results(routes, seeds, ship, wind, land, settings, 0).select("route", "mean")


def _results(routes: DataFrame, seeds: int, ship: Ship, wind, land, settings: Settings, trial: int) -> DataFrame:
    spark = routes.sparkSession
    work = study.planned(routes, spark.range(seeds).withColumnRenamed("id", "seed"), spark.range(trial, trial + 1).withColumnRenamed("id", "trial"))
    work = work.withColumn("run", F.xxhash64("trial", "route", "seed"))
    found = searches.searched(work, ship, wind, land, settings).filter("k <= 0").select("run", "fitness")
    return study.by_route(work.select("run", "trial", "route", "seed").join(found, "run"))


def tuned(routes: DataFrame, base: DataFrame, trials: int, seeds: int, ship: Ship, wind, land, settings: Settings, tune: dict | None = None, pinned: dict | None = None, seed: int = 0, journal: str | None = None) -> Study:
    """A study over routes (route and searches.JOB columns but run). Each trial's routes and seeds run in parallel;
    trials follow each other, since each learns from those before. A few numbers a trial come to the driver."""
    missing = study.unknown_routes(routes, base).limit(1).collect()
    if missing:
        raise ValueError(f"the baseline lacks route {missing[0].route}")
    space, rng, out = searches.slots(tune or {}, pinned or {}), np.random.default_rng(seed), Study()
    for k in range(trials):
        asked = searches.proposed(space, out.history, rng)
        chosen = Settings(**{**vars(settings), **searches.overrides(asked)})
        rows = study.scores(_results(routes, seeds, ship, wind, land, chosen, k), base).collect()
        score = rows[0].score if rows and not math.isnan(rows[0].score) else math.inf
        out.history.append((asked, score))
        if journal:
            routes.sparkSession.createDataFrame([(k, json.dumps(asked), float(score))], "trial int, settings string, score double").coalesce(1).write.mode("append").json(journal)
    return out
