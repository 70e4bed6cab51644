"""Archives, viewer operators and studies."""

import json

import pytest
from pyspark.sql import functions as F

from meridian.functions.geo import Box
from meridian.functions.ship import Ship
from meridian.kernels.search import Settings
from meridian.operators import grids, tuning, views
from meridian.plans.kernel_queries import LAND, WIND
from meridian.sources import quantised


def test_archive_round_trip(spark, tmp_path):
    g = grids.Grid(10.0, 40.0, 1.0, 1.0, 4, 3, 2)
    frames = grids.lattice(spark, g).withColumn("speed", F.col("i") * 3.0 + F.col("f")).withColumn("direction", F.col("j") * 70.0)
    quantised.write(frames, g, str(tmp_path / "a"))
    back = quantised.read(spark, str(tmp_path / "a"))
    both = frames.join(back.select("f", "i", "j", F.col("speed").alias("s"), F.col("lat").alias("y")), ["f", "i", "j"])
    assert both.count() == 24 and both.filter("abs(speed - s) > 0.1 or lat != y").count() == 0
    with pytest.raises(ValueError, match="cells"):
        quantised.encoded(frames.filter("not (f = 1 and i = 2)"), g)
    layout = "f int, lon double, lat double, step_lon double, step_lat double, nx int, ny int"
    rows = [(0, 1.0, 2.0, 1.0, 1.0, 3, 3), (1, 1.0, 2.0, 1.0, 1.0, 3, 3)]
    assert quantised.one_grid(spark.createDataFrame(rows, layout)).first().same
    assert not quantised.one_grid(spark.createDataFrame([*rows, (2, 1.0, 2.0, 1.0, 1.0, 3, 4)], layout)).first().same


def test_views(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 2.0)], "voyage long, k int, lon double, lat double")
    assert views.moved(p, 1, 1, 1.0, -1.0).filter("k = 1").first()[2:] == (11.0, 1.0)
    assert tuple(views.shown_box(p).first()) == (1, -1.5, 11.5, -1.0, 3.0)
    assert views.box_of(grids.Grid(170.0, -5.0, 1.0, 1.0, 21, 11)).lon_max == -170.0
    assert views.ends_or_corners(Box(0.0, 1.0, 2.0, 3.0), None, (9.0, 9.0)) == ((0.0, 2.0), (9.0, 9.0))
    s = spark.createDataFrame([(1, 0, 3661.0, 0.5, 12.0, 20.25, 0.0), (1, 1, 5.0, 1.0, 1500.0, 5.0, 99.0)], "voyage long, k int, seconds double, load double, fuel double, speed_kmh double, land_m double")
    lines = [r.line for r in views.segment_table(s).orderBy("k").collect()]
    assert lines == ["[0] 1h 1m 1s | motor=0.50 | fuel=12.00 kg | speed=20.2 km/h | land=0.00 km", "[1] 5s       | motor=1.00 | fuel=1.500 t  | speed=5.0 km/h  | land=0.10 km"]
    assert vars(Box(170.0, -170.0, 0.0, 9.0).clamped_to(Box(1.0, 2.0, 3.0, 4.0))) == vars(Box(1.0, 2.0, 3.0, 4.0))
    assert not Box(0.0, 1.0, 0.0, 1.0).clamped_to(Box(0.0, 1.0, 5.0, 6.0)).usable()


def test_a_study_learns_and_keeps_a_journal(spark, tmp_path):
    columns = "route string, lon1 double, lat1 double, lon2 double, lat2 double, lon_min double, lon_max double, lat_min double, lat_max double"
    routes = spark.createDataFrame([("a", -10.0, 46.0, 8.0, 47.0, -15.0, 12.0, 40.0, 55.0)], columns)
    settings = Settings(waypoints=5, particles=6, iterations=2, time_particles=4, time_iterations=2)
    base = tuning.baseline(routes, 1, Ship(), WIND, LAND, settings).cache()
    out = tuning.tuned(routes, base, 2, 1, Ship(), WIND, LAND, settings, tune={"inertia": 0.4}, journal=str(tmp_path / "j"))
    assert len(out.history) == 2 and all(s > 0 and h["inertia"] == 0.4 for h, s in out.history)
    assert json.loads(out.summary())["trials"] == 2 and spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(ValueError, match="lacks"):
        tuning.tuned(routes, base.limit(0), 1, 1, Ship(), WIND, LAND, settings)


def test_looped_time_of_a_grid():
    from meridian.operators.grids import Grid

    g = Grid(0.0, 0.0, 1.0, 1.0, 2, 2, 3, 3600.0)
    assert (g.duration_s, g.cycle_s) == (7200.0, 25_200.0)
    assert g.with_crossfade(600.0).cycle_s == 7800.0 and g.with_crossfade(-5.0).cycle_s == 7200.0
    assert Grid(0.0, 0.0, 1.0, 1.0, 2, 2).cycle_s == 0.0


def test_scenarios_are_applied():
    from meridian.functions.ship import Ship
    from meridian.kernels.search import Settings
    from meridian.sources import files

    text = "[run]\nwaypoints = 12\n[boat]\nmcr_kw = 250\nfuel_b = -0.1\n[search]\nparticles_space = 9\npath_kick_gamma_0_fraction = 0.2\nk_mcr = 6\nseed = 4\n"
    settings, ship = files.applied(files.read_scenario(text), Settings(), Ship())
    assert (settings.waypoints, settings.particles, settings.loads, settings.seed, settings.kick) == (12, 9, 6, 4, (0.2, 0.005))
    assert settings.iterations == Settings().iterations
    assert ship.mcr_w == 250_000 and ship.fuel == (0.0875, -0.1, 0.0347) and ship.drag == Ship().drag
    for bad, field in (("[search]\nk_mcr = 1\n", "loads"), ("[boat]\nmcr_kw = 0\n", "mcr_w"), ("[search]\nsdf_resolution_deg = 0.001\n", "sdf_resolution_deg"), ("[search]\npath_kick_gamma_min_fraction = 0.5\n", "kick"), ("[search]\ninertia = nan\n", "inertia")):
        with pytest.raises(ValueError, match=field):
            files.applied(files.read_scenario(bad), Settings(), Ship())


def test_counters_and_kept_lands(spark):
    from meridian.functions.ship import Ship
    from meridian.kernels.fields import FormulaWind, NoLand
    from meridian.kernels.search import Settings
    from meridian.operators import searches
    from meridian.plans.search_queries import vertices

    jobs = spark.createDataFrame([(k, 0.0, 0.0, 5.0, 0.0, -1.0, 6.0, -3.0, 3.0, t) for k, t in enumerate(["gbest", "ring", "star"])], "run long, lon1 double, lat1 double, lon2 double, lat2 double, lon_min double, lon_max double, lat_min double, lat_max double, topology string")
    counters, s = searches.Counters(spark), Settings(waypoints=4, particles=4, iterations=2, time_particles=3, time_iterations=2)
    wind = FormulaWind(lambda x, y, t: (x * 0 + 5.0, x * 0))
    assert searches.searched(jobs, Ship(), wind, NoLand(), s, counters=counters).filter("error is not null").collect()[0].run == 2
    got = counters.values()
    assert (got["searches"], got["failures"], got["voyages"], got["times"]) == (2, 1, 2 * 12, 2 * 8 * 9) and got["seconds"] > 0
    lands = searches.Lands(vertices(spark))
    assert lands.at(4.0) is lands.at(4.0) and lands.at(4.0).mask.shape == (45, 90) and lands.at(4.0).mask.any()


def test_sites_within_a_radius(spark):
    from meridian.operators import grids

    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, None, 0.0)], "id long, lon double, lat double")
    sites = spark.createDataFrame([(7, 3.0, 4.0), (8, -3.0, -4.1), (9, 10.0, 0.0), (10, 5.0, 0.0)], "id long, lon double, lat double")
    assert sorted((r.id, r.site, r.d2) for r in grids.within(points, sites, 5.0).collect()) == [(1, 7, 25.0), (1, 10, 25.0), (2, 9, 0.0), (2, 10, 25.0)]
    assert grids.first_frames(spark.range(5).withColumnRenamed("id", "f"), 2).count() == 2
