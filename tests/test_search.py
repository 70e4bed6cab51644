"""Search kernels: tables, land, paths, and the invariants of whole searches."""

import numpy as np
import pytest

from meridian.functions.geo import Box
from meridian.functions.ship import Ship
from meridian.kernels import courses, legs, sphere
from meridian.kernels import search as kernel
from meridian.kernels.courses import Bounds
from meridian.kernels.fields import BoxLand, FormulaWind, GridLand, NoLand, nearest
from meridian.operators import searches
from meridian.operators.swarm import shared_out, torus_shape

GAP = FormulaWind(lambda x, y, t: (8 * (1 - np.exp(-0.5 * ((x + 5) ** 2 + (y - 50) ** 2) / 9)), np.zeros(np.shape(x))))
STEADY = FormulaWind(lambda x, y, t: (np.full(np.shape(x), 5.0), np.zeros(np.shape(x))))


def bar():
    lon, lat = np.arange(360) + 0.5 - 180, np.arange(180) + 0.5 - 90
    return GridLand((np.abs(lat) < 10)[:, None] & (np.abs(lon) < 2)[None, :], 1.0)


def test_steady_wind_has_a_closed_form():
    s, d = Ship(), float(sphere.haversine(0.0, 0.0, 5.0, 0.0))
    for load in (0.1, 0.5, 1.0):
        speed = np.cbrt(s.polar_c / 2 * 5.0) ** 3  # straight downwind: no part across
        want = d / np.cbrt((s.polar_c / 2 * 5.0) ** 3 + load * s.mcr_w / (0.5 * s.drag))
        assert speed > 0 and float(legs.travel_time(s, STEADY, 0.0, 0.0, 5.0, 0.0, 0.0, load, 20_000.0)) == pytest.approx(want, rel=1e-6)


def test_no_way_without_wind_or_motor():
    calm = FormulaWind(lambda x, y, t: (np.zeros(np.shape(x)), np.zeros(np.shape(x))))
    leg = (0.0, 0.0, 1.0, 0.0, 0.0)
    assert np.isinf(legs.travel_time(Ship(), calm, *leg, 0.0, 50_000.0))
    load, seconds = legs.slowest(Ship(), calm, *(np.array([v]) for v in leg), cap=50_000.0)
    assert load[0] == 0.1 and np.isfinite(seconds[0])


def test_load_inverts_time():
    leg = [np.array([v]) for v in (-8.0, 46.0, -3.0, 48.0, 0.0)]
    took = legs.travel_time(Ship(), GAP, *leg, 0.37, 20_000.0)
    assert legs.solve_load(Ship(), GAP, *leg, took, 20_000.0)[0] == pytest.approx(0.37, abs=5e-4)


def test_tables_follow_integration():
    x, y = np.array([[-10.0, -7, -4, -2, 0]]), np.array([[45.0, 46, 45, 44, 45]])
    cap = 20_000.0
    tables = legs.Tables.build(Ship(), GAP, x, y, cap)
    leave = np.zeros((1, 1))
    for s in range(4):
        low, high = tables.range(s, leave)
        a, b = legs.time_range(Ship(), GAP, x[:, s], y[:, s], x[:, s + 1], y[:, s + 1], leave[:, 0], cap=cap)
        assert low[0, 0] == pytest.approx(a[0], rel=0.02) and high[0, 0] == pytest.approx(b[0], rel=0.02)
        leave = leave + (low + high) / 2


def test_distances_equal_brute_force():
    rng = np.random.default_rng(2)
    seeds = rng.random((9, 14)) < 0.1
    j, i = np.nonzero(seeds)
    for y in range(9):
        for x in range(14):
            dx = np.abs(i - x)
            assert nearest(seeds)[y, x] == (np.minimum(dx, 14 - dx) ** 2 + (j - y) ** 2).min()
    assert np.isinf(nearest(np.zeros((3, 4), bool))).all()


def test_land_and_paths():
    land = bar()
    assert land.distance(0.0, 0.0) < -50_000 and land.distance(60.0, 0.0) > 1_000_000
    e, n = land.slope(5.0, 0.0)
    assert e > 0.5
    world = Box(-180.0, 180.0, -89.0, 89.0)
    paths = {b: np.array(land.sea_path((-10.0, 0.0), (10.0, 0.0), world, b)) for b in (None, "north", "south")}
    for p in paths.values():
        assert (land.distance(*p[1:-1].T) > -1).all()
    assert paths["north"][:, 1].max() > 9 and paths["south"][:, 1].min() < -9
    assert np.array(land.sea_path((-10.0, 0.0), (10.0, 0.0), Box(-20.0, 20.0, -20.0, 9.0)))[:, 1].min() < -9
    pond = GridLand(~((np.abs(np.arange(180) - 89.5) < 2)[:, None] & (np.abs(np.arange(360) - 179.5) < 2)[None, :]), 1.0)
    assert pond.sea_path((0.0, 0.0), (100.0, 0.0), world) is None


@pytest.mark.parametrize("n", [12, 20])
def test_sampled_chords_stay_at_sea(n):
    land, bounds = bar(), Bounds((-15.0, 0.0), (15.0, 0.0), Box(-20.0, 20.0, -15.0, 15.0))
    x, y = courses.over_sea(land.sea_path((-15.0, 0.0), (15.0, 0.0), bounds.box), n, bounds, land)
    assert legs.land_metres(land, x[:-1], y[:-1], x[1:], y[1:], bounds.cap).sum() == 0


def test_room_to_either_side():
    slab = FormulaWind(None)
    slab.distance = lambda x, y: np.maximum(-2 - x, x - 2) * 111_000.0
    assert courses.room(slab, 3.0, 0.0, -1.0, 0.0, 1e6) == pytest.approx(111_000, abs=30_000)
    assert courses.room(slab, 3.0, 0.0, 1.0, 0.0, 1e6) > 5 * 111_000


def test_pushed_off_land():
    x, y = courses.off_land(bar(), np.array([1.0, 60.0]), np.array([0.0, 0.0]))
    assert bar().distance(x, y)[0] > 0 and x[1] == 60


@pytest.mark.parametrize("topology", kernel.TOPOLOGIES)
def test_searches_repeat(topology):
    s = kernel.Settings(waypoints=6, particles=8, iterations=5, time_particles=8, time_iterations=4, seed=0xC0FFEE, topology=topology)
    p = kernel.Problem(Ship(), GAP, NoLand(), Bounds((-10.0, 45.0), (0.0, 55.0), Box(-12.0, 2.0, 43.0, 57.0)), s)
    a, b = kernel.search(p), kernel.search(p)
    assert np.isfinite(a.fit) and len(a.frames) == 5
    assert (a.x == b.x).all() and (a.t == b.t).all() and a.fit == b.fit
    best = [f["best_fit"].max() for f in a.frames]
    assert best == sorted(best)


@pytest.mark.parametrize("seed", [0, 1])
def test_searches_avoid_land(seed):
    s = kernel.Settings(waypoints=6, particles=24, iterations=15, time_particles=8, time_iterations=4, seed=seed)
    bounds = Bounds((0.0, 0.0), (10.0, 0.0), Box(-2.0, 12.0, -8.0, 8.0))
    p = kernel.Problem(Ship(), STEADY, BoxLand(4, 6, -3, 3), bounds, s)
    f = kernel.search(p)
    assert legs.land_metres(p.land, f.x[:-1], f.y[:-1], f.x[1:], f.y[1:], bounds.cap).sum() < 2 * bounds.cap


def test_niches_keep_to_themselves():
    lead = kernel.attractors(np.arange(12.0), np.repeat([0, 1, 2], 4), "niched")
    assert lead.tolist() == [3] * 4 + [7] * 4 + [11] * 4
    ring = kernel.attractors(np.arange(5.0), np.zeros(5), "ring")
    assert ring.tolist() == [4, 2, 3, 4, 3]


def test_shares():
    assert sum(shared_out(17, [0.3, 0.2, 0.15, 0.1, 0.15, 0.1])) == 17
    assert torus_shape(30) == (5, 6) and torus_shape(7) is None


def test_settings_are_checked():
    for bad in ({"topology": "star"}, {"time_weight": -1.0}, {"particles": 0}, {"kick_probability": 2.0}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            kernel.Settings(**bad).checked()


def test_study_slots_and_proposals():
    space = searches.slots({"inertia": 0.5, "social": {"min": 1.0, "max": 2.0}}, {"cognitive": 1.2, "inertia": 0.1})
    assert space["inertia"] == 0.5 and space["social"] == (1.0, 2.0) and space["cognitive"] == 1.2
    with pytest.raises(ValueError, match="social"):
        searches.slots({"social": {"min": 2.0, "max": 1.0}}, {})
    rng, history = np.random.default_rng(0), []
    for _ in range(60):
        t = searches.proposed(space, history, rng)
        history.append((t, (t["social"] - 1.3) ** 2))
    assert np.mean([abs(t["social"] - 1.3) for t, _ in history[-15:]]) < np.mean([abs(t["social"] - 1.3) for t, _ in history[:10]])


def test_failures_are_rows(spark):
    jobs = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 0.0, -1.0, 6.0, -3.0, 3.0, "star")], "run long, lon1 double, lat1 double, lon2 double, lat2 double, lon_min double, lon_max double, lat_min double, lat_max double, topology string")
    r = searches.searched(jobs, Ship(), STEADY, NoLand()).first()
    assert r.k == -1 and "topology" in r.error


def test_study_scores(spark):
    from meridian.operators import study

    base = spark.createDataFrame([("a", -1000.0), ("b", -2000.0)], "route string, mean double")
    for rows, want in (([("a", -1000.0), ("b", -2000.0)], 1.0), ([("a", -950.0), ("b", -1900.0)], 0.95), ([("a", -1100.0)], 1.1), ([("c", -1.0)], float("inf"))):
        routes = spark.createDataFrame([(0, *r) for r in rows], "trial int, route string, mean double")
        assert study.scores(routes, base).first().score == pytest.approx(want)


def test_jobs_are_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    jobs = spark.range(100).coalesce(1).withColumnRenamed("id", "run")
    where = searches.dealt(jobs).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(where) > 8 and max(r["count"] for r in where) <= 2 * 100 / len(where)
    assert searches.dealt(jobs, 3).rdd.getNumPartitions() == 3


def test_a_wind_of_many_cells(spark):
    n, frames = 300, 60  # more cells times frames than a few million
    cell = "transform(sequence(0, {}), f -> struct(cast(ix + f / 100 as double) as u, cast(iy - f / 100 as double) as v))".format(frames - 1)
    cells = spark.range(n * n).selectExpr(f"cast(id % {n} as int) as ix", f"cast(id div {n} as int) as iy").selectExpr("ix", "iy", f"{cell} as uv")
    wind = searches.wind_of(cells, 0.0, 0.0, 1.0, 3600.0)
    assert wind.uv.shape == (n, n, frames, 2) and wind.uv.dtype == np.float32
    u, v = wind.sample(np.array([7.0, 299.0]), np.array([9.0, 0.0]), np.array([0.0, 3600.0 * 50]))
    assert u == pytest.approx([7.0, 299.5], rel=1e-6) and v == pytest.approx([9.0, -0.5], rel=1e-6)
    with pytest.raises(ValueError, match="does not fit"):
        searches.wind_of(cells, 0.0, 0.0, 1.0, 3600.0, most=1000)


def test_checks_are_not_vacuous(spark, small):
    from meridian.plans import kernel_queries as q
    from pyspark.sql import functions as F

    found, jobs = q.search_voyages(spark, small).cache(), q._jobs(spark, small)
    for broken, column in (("fitness", "weighed"), ("fuel", "fuelled"), ("lat", "starts")):
        bad = q.checked(found.withColumn(broken, F.col(broken) * 1.01 + 0.001), jobs, q.SMALL)
        assert bad.filter(~F.col(column)).count() == bad.count() > 0
    slow = found.withColumn("seconds", F.when(F.col("k") == 2, -1.0).otherwise(F.col("seconds")))
    assert q.checked(slow, jobs, q.SMALL).filter("not timed").count() == jobs.count()
    found.unpersist()


CORRIDORS = FormulaWind(lambda x, y, t: (12 * np.minimum(np.abs(y) / 2, 1), np.zeros(np.shape(x))))


def _spread(frame):
    """Mean distance of the particles' paths from their centre, in degrees."""
    x, y = frame["x"], frame["y"]
    return float(np.hypot(x - x.mean(axis=0), y - y.mean(axis=0)).mean())


def test_a_ring_keeps_apart_and_loses_little():
    def run(topology, iterations):
        s = kernel.Settings(waypoints=6, particles=24, iterations=iterations, time_particles=8, time_iterations=4, seed=11, topology=topology)
        return kernel.search(kernel.Problem(Ship(), CORRIDORS, NoLand(), Bounds((-14.0, 0.5), (14.0, -0.5), Box(-19.0, 19.0, -9.0, 9.0)), s))

    one, ring = run("gbest", 20), run("ring", 30)
    assert ring.fit >= one.fit * 1.05  # fitness is a negative cost
    assert _spread(ring.frames[19]) > _spread(one.frames[19])


@pytest.mark.parametrize("seed", [0, 3])
def test_cohorts_stay_on_their_side_of_a_bar(seed):
    lon, lat = np.arange(720) / 2 + 0.25 - 180, np.arange(360) / 2 + 0.25 - 90
    land = GridLand((np.abs(lat) < 1)[:, None] & (np.abs(lon) < 14)[None, :], 0.5)
    s = kernel.Settings(waypoints=8, particles=24, iterations=12, time_particles=8, time_iterations=4, kick_probability=0.0, topology="niched", seed=seed)
    uneven = FormulaWind(lambda x, y, t: (np.where(y < 0, 10.0, 0.5), np.zeros(np.shape(x))))
    found = kernel.search(kernel.Problem(Ship(), uneven, land, Bounds((-19.0, 0.0), (19.0, 0.0), Box(-24.0, 24.0, -9.0, 9.0)), s))
    last = found.frames[-1]
    mid = last["best_y"][:, 3:5].mean(axis=1)
    assert (mid[found.niches == 1] > -1).all() and (mid[found.niches == 2] < 1).all()


def test_most_of_the_first_swarm_is_at_sea():
    class Bar(BoxLand):
        def sea_path(self, origin, destination, box, bias=None):
            side = -1 if bias == "south" else 1
            return [origin, (-3.0, 10.5 * side), (0.0, 10.5 * side), (3.0, 10.5 * side), destination]

    bounds = Bounds((-15.0, 0.0), (15.0, 0.0), Box(-20.0, 20.0, -12.0, 12.0))
    for seed in (5, 42):
        p = kernel.Problem(Ship(), STEADY, Bar(-2.0, 2.0, -9.0, 9.0), bounds, kernel.Settings(waypoints=8, particles=32))
        x, y, niche = kernel.started(p, np.random.default_rng(seed))
        over = legs.land_metres(p.land, x[:, :-1], y[:, :-1], x[:, 1:], y[:, 1:], bounds.cap).sum(axis=1)
        assert (over < 50_000).mean() > 0.6 and (over[niche == 0] > 50_000).all()


def test_topologies_cost_about_the_same():
    rng = np.random.default_rng(2)
    uv = rng.normal(0, 4, (20, 20, 1, 2))
    from meridian.kernels.fields import GridWind

    wind, cost = GridWind(uv, 0.0, 0.0, 1.0, 3600.0), {}
    for topology in kernel.TOPOLOGIES:
        s = kernel.Settings(waypoints=12, particles=16, iterations=10, time_particles=8, time_iterations=6, seed=3, topology=topology)
        cost[topology] = -kernel.search(kernel.Problem(Ship(), wind, NoLand(), Bounds((2.0, 3.0), (17.0, 18.0), Box(0.0, 19.0, 0.0, 19.0)), s)).fit
    assert all(np.isfinite(c) and c <= 1.5 * cost["gbest"] for c in cost.values())
