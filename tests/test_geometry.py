"""Closed cases of geometry, winds and physics, on columns and on arrays alike."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import geo, ship, text, winds
from meridian.kernels import sphere
from meridian.kernels.fields import looped


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


lit = F.lit


def test_lengths_and_bearings(spark):
    r = one(spark, geo.haversine(lit(0.0), lit(0.0), lit(0.0), lit(1.0)), geo.haversine(lit(0.0), lit(60.0), lit(1.0), lit(60.0)), geo.bearing(lit(0.0), lit(0.0), lit(0.0), lit(1.0)), geo.bearing(lit(0.0), lit(0.0), lit(1.0), lit(0.0)), geo.bearing(lit(0.0), lit(90.0), lit(1.0), lit(0.0)))
    assert r[0] == pytest.approx(111_194.9, abs=1)
    assert r[1] == pytest.approx(111_194.9 / 2, abs=5)
    assert r[2] == 0 and r[3] == pytest.approx(math.pi / 2)
    assert r[4] is None
    assert math.isnan(float(sphere.bearing(0.0, 90.0, 1.0, 0.0)))


def test_wrapping(spark):
    r = one(spark, geo.wrap_lon(lit(540.0)), geo.wrap_lon(lit(-180.0)), geo.lon_delta(lit(0.0), lit(-180.0)), geo.lon_delta(lit(179.0), lit(-179.0)))
    assert tuple(r) == (180.0, 180.0, 180.0, 2.0)
    assert geo.Box(139.0, -122.0, 0.0, 1.0).lon_extent == 99.0


def test_destination_comes_back(spark):
    x, y = geo.destination(lit(170.0), lit(-33.0), lit(2_000_000.0), lit(1.0))
    r = one(spark, x.alias("x"), y.alias("y"))
    assert float(sphere.haversine(170.0, -33.0, r.x, r.y)) == pytest.approx(2_000_000, rel=1e-9)
    a, b = sphere.destination(170.0, -33.0, 2_000_000.0, 1.0)
    assert (float(a), float(b)) == pytest.approx((r.x, r.y))


def test_columns_and_arrays_agree(spark):
    rng = np.random.default_rng(1)
    p = np.column_stack([rng.uniform(-180, 180, 200), rng.uniform(-89, 89, 200), rng.uniform(-180, 180, 200), rng.uniform(-89, 89, 200)])
    df = spark.createDataFrame(p.tolist(), "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    got = np.array(df.select(geo.haversine(*cols), geo.bearing(*cols), geo.lon_delta(cols[0], cols[2])).collect())
    want = np.column_stack([sphere.haversine(*p.T), sphere.bearing(*p.T), sphere.lon_delta(p[:, 0], p[:, 2])])
    assert np.allclose(got, want, rtol=1e-12, atol=1e-9)


def test_winds(spark):
    u, v = winds.components(lit(10.0), lit(0.0))
    n, e = winds.from_direction(lit(0.0), lit(-10.0)), winds.from_direction(lit(-10.0), lit(0.0))
    r = one(spark, u, v, n, e, winds.blend(lit(350.0), lit(10.0), lit(0.5)), winds.components(lit(float("nan")), lit(1.0))[0])
    assert r[0] == pytest.approx(0, abs=1e-12) and r[1] == pytest.approx(-10)
    assert r[2] == pytest.approx(0) and r[3] == pytest.approx(90)
    assert min(r[4], 360 - r[4]) == pytest.approx(0, abs=1e-9)
    assert r[5] == 0


@pytest.mark.parametrize("x", [-50.0, -1.0, 0.0, 0.5, 12.34, 49.9])
def test_codes(spark, x):
    assert one(spark, winds.decode(winds.encode(lit(x))))[0] == pytest.approx(x, abs=0.07)


def test_codes_saturate(spark):
    assert tuple(one(spark, winds.encode(lit(200.0)), winds.encode(lit(-200.0)))) == (1023, 0)


def test_looped_time(spark):
    # two frames an hour apart, five hours of blending back
    for t, want in ((0.0, (0, 1, 0.0)), (1800.0, (0, 1, 0.5)), (3600.0, (1, 0, 0.0)), (12600.0, (1, 0, 0.5)), (21600.0, (0, 1, 0.0))):
        assert tuple(one(spark, *winds.bracket(lit(t), 2, 3600.0))) == want
        assert tuple(float(a) for a in looped(np.array(t), 2, 3600.0)) == want


def test_ship(spark):
    s = ship.Ship()
    r = one(spark, s.wind_speed(lit(0.0), lit(0.0), lit(0.0)), s.motor_speed(lit(0.0), lit(1.0)), s.fuel_used(lit(0.0), lit(10.0)), s.fuel_used(lit(1.0), lit(-1.0)), ship.speed_kmh(lit(10.0), lit(0.0)))
    assert r[0] == 0 and r[1] == pytest.approx((1e6 / 2000) ** (1 / 3)) and tuple(r)[2:] == (0, 0, 0)


def test_texts(spark):
    r = one(spark, text.duration(lit(93784.0)), text.duration(lit(-5.0)), text.fuel(lit(12345.0)), text.fuel(lit(999.0)), text.magnitude(lit(-1825302.28)), text.magnitude(lit(-173235.24)), text.against(lit(1.0), lit(0.0), True), text.against(lit(76.6), lit(100.0), False))
    assert tuple(r) == ("1d 2h 3m 4s", "0s", "12.345 t", "999.00 kg", "1.825M", "173.235K", "PSO N/A", "PSO 23.4% better")


def test_civil_days(spark):
    day = lambda y, m, d: text.reference_seconds(*[lit(v) for v in (y, m, d, 0, 0, 0)])
    r = one(spark, day(1970, 1, 1), day(2000, 1, 1), day(2000, 12, 31), day(1969, 1, 1), day(2001, 2, 29))
    assert [None if v is None else v // 86400 for v in r] == [0, 10957, 11322, -365, None]


def test_forecast_units(spark):
    r = one(spark, *[text.forecast_seconds(lit(u), lit(v)) for u, v in ((1, 6), (10, 4), (2, 2), (3, 1))])
    assert tuple(r) == (21600, 43200, 172800, None)


def test_cycles(spark):
    assert [tuple(one(spark, *text.cycle(lit(h)))) for h in (0, 5, 6)] == [(0, 0), (0, 5), (6, 0)]


def test_numbers_are_rounded_by_their_exact_value(spark):
    # beside ties: what reads as one, real ones, carries, signs, tiny and large ones
    values = [0.05, 1.1335, 1.1545, 1.0785, 2.675, 0.125, 0.375, 2.5, 0.99996, 9.995, 999.99951, -0.00004, -2.675, 0.0005, 0.0015, 1e-300, 123456789012.0625, 4503599627370497.5]
    values += [x * 0.0005 for x in range(1, 400)]
    rows = spark.createDataFrame([(v,) for v in [*values, None, float("inf")]], "v double").coalesce(1).select("v", *[text.fixed(F.col("v"), n).alias(f"p{n}") for n in (1, 2, 3, 4)]).collect()
    assert [tuple(r)[1:] for r in rows[:-2]] == [tuple(f"{v:.{n}f}" for n in (1, 2, 3, 4)) for v in values]
    assert rows[-2]["p2"] is None and rows[-1]["p2"] == "Infinity"
    r = one(spark, text.magnitude(lit(-1133500.0)), text.against(lit(20010.0), lit(20000.0), False))
    assert tuple(r) == ("1.133M", "PSO 0.1% worse")
