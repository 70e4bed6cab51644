"""Round trips of files, and streaming ingest."""

import datetime as dt
import json

import numpy as np
import pytest

from meridian.functions.geo import Box
from meridian.sources import archive, baked, files, grib, registry
from meridian.streaming import ingest


def test_rows(spark, tmp_path):
    rows = spark.createDataFrame([(0.0, 1.5, 2.5, 10.0, 90.0), (3600.0, 1.5, 2.5, 11.0, 91.0)], "t_seconds float, lon float, lat float, speed float, direction float")
    files.write_rows(rows, str(tmp_path / "rows.json"))
    assert sorted(files.read_rows(spark, str(tmp_path / "rows.json")).collect()) == sorted(rows.collect())
    assert registry.load(spark, str(tmp_path / "rows.json")).count() == 2


def test_baked_cache(spark, tmp_path):
    uv = np.random.default_rng(0).normal(size=(3, 4, 2, 2))
    made = baked.Baked(uv, -10.0, 20.0, 0.5, 3600.0)
    raw = baked.encode(made)
    back = baked.decode(raw)
    assert (back.uv == uv).all() and (back.lon, back.lat, back.step, back.crossfade_s) == (-10.0, 20.0, 0.5, 18_000.0)
    (tmp_path / "a.wbaked").write_bytes(raw)
    rows = {(r.ix, r.iy, r.f): (r.u, r.v) for r in registry.load(spark, str(tmp_path / "a.wbaked")).collect()}
    assert len(rows) == 24 and rows[3, 2, 1] == tuple(uv[2, 3, 1])
    for bad in (b"", b"XBAKED01" + raw[8:], raw[:8] + b"\2" + raw[9:]):
        with pytest.raises(ValueError):
            baked.decode(bad)


def test_forecast_files(spark, tmp_path):
    lat, lon = np.arange(3) * 1.0, np.arange(4) * 1.0 + 10
    t0 = dt.datetime(2024, 1, 1, 6)
    u = np.arange(12.0).reshape(3, 4) - 5
    v = -u * 2
    v[0, 0] = np.nan
    raw = b"".join(grib.write_message(lat, lon, a, p, t0, h) for h in (0, 3) for a, p in ((u, 2), (v, 3))) + grib.write_message(lat, lon, u, 2, t0, 0, height=80)
    (tmp_path / "f.GRIB2").write_bytes(raw)
    assert len(list(grib.messages(raw))) == 5
    rows = registry.load(spark, str(tmp_path / "f.GRIB2")).collect()
    assert len(rows) == 2 * 11 and {r.t_seconds for r in rows} == {1704088800, 1704088800 + 10800}
    r = next(r for r in rows if (r.lon, r.lat) == (13.0, 2.0))
    assert r.speed == pytest.approx(np.hypot(6, -12), abs=1e-3)
    cut = registry.load(spark, str(tmp_path / "f.GRIB2"), 2, Box(10.0, 13.0, 0.0, 2.0)).collect()
    assert {r.lat for r in cut} == {0.0, 2.0} and {r.lon for r in cut} == {10.0, 12.0}


PACKINGS = [(0, 0), (2, 0), (3, 1), (3, 2), (4, 0), (41, 0), (41, 1), (41, 2), (41, 3), (41, 4)]


@pytest.mark.parametrize("template, order", PACKINGS)
@pytest.mark.parametrize("scan", [0x40, 0x60, 0x50, 0x70])
def test_packings_and_scan_orders(template, order, scan):
    rng = np.random.default_rng(order)
    lat, lon = np.arange(7) * 0.5 - 1, np.arange(11) * 0.25 + 3
    for values in (rng.integers(-40, 40, (7, 11)), np.zeros((7, 11)), np.cumsum(rng.integers(-3, 4, 77)).reshape(7, 11) * 0.5, np.full((7, 11), -3.0)):
        for hole in (False, template != 41):
            grid = values.astype(float)
            if hole:
                grid[rng.random(grid.shape) < 0.2] = np.nan
            raw = grib.write_message(lat, lon, grid, 2, dt.datetime(2024, 5, 6, 7), 5, template=template, order=order, scan=scan, group=9)
            (m,) = grib.messages(raw)
            assert m.template == template and m.ten_metre_wind and m.parameter == 2
            np.testing.assert_allclose(m.values(), grid, atol=1e-3)
            assert (m.axes[0] == lat).all() and (m.axes[1] == lon).all()


def test_missing_values_of_groups():
    # two groups of four: widths 2 and 0; the largest number of each stands for a missing value
    refs, widths = np.array([5, 7]), np.array([2, 0])
    data = grib._packed(refs, [3, 3]) + grib._packed(widths, [2, 2]) + grib._packed(np.array([0, 1, 2, 3]), [2] * 4)
    for missing, want in ((0, [5, 6, 7, 8, 7, 7, 7, 7]), (1, [5, 6, 7, None] + [None] * 4), (2, [5, 6, None, None] + [None] * 4)):
        rep = bytes(9) + (2).to_bytes(2, "big") + bytes(8) + bytes([3, 0, 1, missing]) + bytes(8) + (2).to_bytes(4, "big") + bytes([0, 2]) + (4).to_bytes(4, "big") + bytes([1]) + (4).to_bytes(4, "big") + bytes([0])
        got = grib.grouped(rep, data, 8)
        assert [None if np.isnan(v) else v for v in got] == want


def test_bad_messages_are_passed_over(spark, tmp_path):
    lat, lon, t0 = np.arange(3) * 1.0, np.arange(4) * 1.0, dt.datetime(2024, 1, 1)
    u, v = np.ones((3, 4)), np.full((3, 4), 2.0)
    good = grib.write_message(lat, lon, u, 2, t0, 0, template=3) + grib.write_message(lat, lon, v, 3, t0, 0, template=41)
    odd = bytearray(grib.write_message(lat, lon, u * 9, 2, t0, 0))
    at = odd.index(b"\x00\x00\x00\x0c\x00\x00", 60)  # the number of the data template is set to one that is not known
    odd[at + 5] = 40
    (tmp_path / "a.grib2").write_bytes(good + bytes(odd) + good[: len(good) // 3])
    (tmp_path / "b.grib2").write_bytes(grib.write_message(lat, lon, u * 5, 2, t0, 0) + b"GRIB" + bytes(20))
    rows = registry.load(spark, str(tmp_path)+"/*.grib2").collect()
    assert len(rows) == 12
    assert {round(r.speed, 6) for r in rows} == {round(float(np.hypot(5, 2)), 6)}  # the last message of the last file
    assert [m.template for m in grib.messages(bytes(odd))] == [40]


def test_registry_errors(spark):
    assert registry.format_of("/a/b.GRB2") == "grib2"
    for path in ("/a/b.txt", "/a.b/c"):
        with pytest.raises(ValueError, match="extension"):
            registry.format_of(path)
    with pytest.raises(ValueError, match="apply"):
        registry.load(spark, "/a/b.json", step=2)


def test_solutions(spark, tmp_path):
    good = {"n": 5, "xs": [0.0] * 5, "ys": [1.0] * 5, "ts": [0.0, 2.0, 3.0, 4.0, 5.0], "best_fit": -1.0, "time_weight": 1.0, "fuel_weight": 10.0, "particles_space": 1, "particles_time": 1, "iter_space": 1, "iter_time": 1, "seed": 2**64 - 1}
    for k, doc in enumerate((good, good | {"n": 8}, good | {"n": 6})):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=1))
    rows = {r.n: r for r in files.read_solutions(spark, str(tmp_path)).collect()}
    assert rows[5].error is None and rows[5].topology == "gbest" and int(rows[5].seed) == 2**64 - 1
    assert rows[8].error == "length" and rows[6].error == "waypoint count"


def test_coastline(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    doc = {"features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring, ring]}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    (tmp_path / "c.geojson").write_text(json.dumps(doc))
    rows = files.read_coastline(spark, str(tmp_path / "c.geojson")).collect()
    assert len(rows) == 4 * 3 and {(r.poly, r.ring) for r in rows} == {(0, 0), (0, 1), (1, 0), (2, 0)}


def test_scenarios():
    a = files.read_scenario('[run]\nstart = [1.0, 2.0]\nwaypoints = 20\n[tune]\ninertia = { min = 0.1, max = 0.5 }\n')
    b = files.read_scenario("[run]\nwaypoints = 40\n")
    both = files.merged(a, b)
    assert both["run"] == {"start": [1.0, 2.0], "waypoints": 40}
    assert files.read_scenario(files.write_scenario(both)) == both
    for bad in ("[run]\nx = 1", "[nope]\n", "[tune]\ninertia = { min = 2.0, max = 1.0 }", "[tune]\ninertia = -1"):
        with pytest.raises(ValueError):
            files.read_scenario(bad)
    assert files.float_list(" 1, 2.5 ", 2) == [1.0, 2.5]
    with pytest.raises(ValueError):
        files.float_list("1", 2)


def test_frame_plan_counts(spark):
    assert archive.frame_plan(spark, 0, 7 * 3600, 1).count() == 7
    assert archive.frame_plan(spark, 0, 12 * 3600, 6).count() == 2
    assert archive.frame_plan(spark, 0, 0, 6).count() == 0


def test_streaming(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(t(12), t(0), 0, 0, 1.0, 0.0), (t(12), t(6), 0, 0, 2.0, 0.0), (t(12), t(6), 0, 0, 2.0, 0.0), (t(13), t(0), 0, 0, 3.0, 0.0)]
    spark.createDataFrame(rows, ingest.FORECAST).write.parquet(str(tmp_path / "in"))
    q = ingest.upsert(ingest.deduplicated(ingest.forecasts(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.valid.hour: r.speed for r in ingest.read_latest(spark, str(tmp_path / "out")).collect()}
    assert got == {12: 2.0, 13: 3.0}
    q = ingest.hourly(ingest.forecasts(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.start.hour: r.n for r in spark.table("hourly").collect()} == {12: 3, 13: 1}
