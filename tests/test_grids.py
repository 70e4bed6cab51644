"""Grid detection, lookups, looped time and resampling on small cases."""

import pytest
from pyspark.sql import functions as F

from meridian.operators import grids


def cells(spark, rows):
    return spark.createDataFrame(rows, "f int, i int, j int, lon double, lat double, speed double, direction double")


def test_midpoint_of_two(spark):
    sites = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 0.0), (1, 0.0, 2.0, 20.0, 90.0)], "id long, lon double, lat double, speed double, direction double")
    r = grids.blended_nearest(spark.createDataFrame([(7, 0.0, 1.0)], "id long, lon double, lat double"), sites).first()
    assert (r.speed, r.direction) == pytest.approx((15, 45), abs=1e-4)


def test_cell_centre_and_hit(spark):
    g = grids.Grid(0.0, 0.0, 10.0, 10.0, 2, 2)
    frames = cells(spark, [(0, 0, 0, 0.0, 0.0, 10.0, 5.0), (0, 1, 0, 10.0, 0.0, 20.0, 5.0), (0, 0, 1, 0.0, 10.0, 30.0, 5.0), (0, 1, 1, 10.0, 10.0, 40.0, 5.0)])
    p = spark.createDataFrame([(1, 0, 5.0, 5.0), (2, 0, 10.0, 10.0), (3, 0, 99.0, 0.0), (4, 0, 5.0, 0.0)], "id long, f int, lon double, lat double")
    got = {r.id: r.speed for r in grids.corners(p, frames, g).collect()}
    assert got[1] == pytest.approx(25) and got[2] == 40 and got[3] == pytest.approx(20) and got[4] == pytest.approx(15)


def test_detects_shuffled_grids(spark):
    g = grids.Grid(0.0, 0.0, 10.0, 10.0, 5, 4)
    rows = grids.lattice(spark, g).orderBy(F.rand(1)).select("lon", "lat")
    r = grids.detected(rows).first()
    assert (r.is_grid, r.nx, r.ny, r.step_lon) == (True, 5, 4, 10.0)
    assert not grids.detected(rows.unionByName(rows.limit(1))).first().is_grid
    assert not grids.detected(rows.limit(0)).first().is_grid


def test_circle(spark):
    g = grids.Grid(0.0, 0.0, 10.0, 10.0, 5, 5)
    assert grids.lattice(spark, g).filter(grids.in_circle(20.0, 20.0, 12.0)).count() == 5


def test_looped_field(spark):
    g = grids.Grid(0.0, 0.0, 1.0, 1.0, 1, 1, 2, 3600.0)
    frames = cells(spark, [(0, 0, 0, 0.0, 0.0, 10.0, 0.0), (1, 0, 0, 0.0, 0.0, 20.0, 90.0)])
    p = spark.createDataFrame([(1, 0.0, 0.0, 1800.0), (2, 0.0, 0.0, 1800.0 + 21600), (3, 0.0, 0.0, 3600.0)], "id long, lon double, lat double, t double")
    got = {r.id: (r.speed, r.direction) for r in grids.at_time(p, frames, g).collect()}
    assert got[1] == pytest.approx((15, 45)) and got[2] == pytest.approx((15, 45)) and got[3] == pytest.approx((20, 90))


def test_bbox_then_stride(spark):
    rows = grids.lattice(spark, grids.Grid(10.0, 0.0, 1.0, 1.0, 4, 4)).select("lon", "lat")
    kept = grids.stride(rows, 2).collect()
    assert {r.lat for r in kept} == {0.0, 2.0} and {r.lon for r in kept} == {10.0, 12.0} and len(kept) == 4


def test_nearest_equals_brute_force(spark):
    p = spark.range(60).select("id", (F.rand(3) * 300 - 150).alias("lon"), (F.rand(4) * 160 - 80).alias("lat"))
    s = spark.range(200).select("id", (F.rand(5) * F.rand(6) * 300 - 150).alias("lon"), (F.rand(7) * 160 - 80).alias("lat"))
    p, s = p.cache(), s.cache()
    got = {(r.id, r.place): r.site for r in grids.nearest(p, s).collect()}
    sites = s.collect()
    for q in p.collect():
        best = sorted(((q.lon - x.lon) ** 2 + (q.lat - x.lat) ** 2, x.id) for x in sites)[:4]
        assert [got[q.id, k + 1] for k in range(4)] == [i for _, i in best]


def test_bake_shape():
    step, nx, ny = grids.bake_shape(360.0, 180.0, 0.25)
    assert step == 360 / 1024 and nx == 1025 and ny == 513


def test_nearest_sites_in_one_place_meet_no_point_twice_over(spark):
    # 20,000 copies of one place: only the four smallest can be near, and no table is broadcast by its compressed size
    s = spark.range(20000).select("id", F.lit(1.5).alias("lon"), F.lit(-0.5).alias("lat"))
    s = s.unionByName(spark.createDataFrame([(-1, 9.0, 9.0), (-2, None, 1.0)], "id long, lon double, lat double"))
    p = spark.range(500).select("id", (F.col("id") / 100.0).alias("lon"), F.lit(0.0).alias("lat"))
    found = grids.nearest(p, s)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    rows = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "site"))).alias("near")).collect()
    assert len(rows) == 500 and all([x.site for x in r.near] == [0, 1, 2, 3] for r in rows)
    joined = grids.blended_nearest(p, s.withColumns({"speed": F.lit(3.0), "direction": F.lit(90.0)}))
    assert joined.count() == 500 and "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
