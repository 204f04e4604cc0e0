"""Synthetic terrain: flat ground, a spike, layers, kernels and whole renders."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspark import mapset
from lumenspark.functions import geometry as G
from lumenspark.operators import frames as T
from lumenspark.operators import raycast as X
from lumenspark.operators.raster import quads
from lumenspark.sources import ephemeris

FAR = 1e7


def ground(spark, size: int, spike: tuple[int, int, float] | None = None):
    z = F.when((F.col("r") == spike[0]) & (F.col("c") == spike[1]), spike[2]).otherwise(0.0) if spike else F.lit(0.0)
    return spark.range(size * size).select(F.expr(f"id div {size}").alias("r"), (F.col("id") % size).alias("c")).withColumn("z", z)


def bodies(spark, degrees: float):
    """Sun and Earth in the same direction, over the middle of the grid: elevation in degrees there."""
    x = (0.0, FAR * math.cos(math.radians(degrees)), -G.MOON_RADIUS_KM - FAR * math.sin(math.radians(degrees)))
    return spark.createDataFrame([(b, *x) for b in (ephemeris.SUN, ephemeris.EARTH)], "body int, x double, y double, z double").withColumn("ts", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))


def times(spark):
    return spark.range(1).select(F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("ts"))


@pytest.mark.parametrize(("degrees", "spike", "sun"), [(1, None, 255), (1, (32, 35, 1000.0), 0), (-6, None, 0), (6, None, 255)])
def test_flat_ground_is_lit_and_a_spike_casts_a_shadow(spark, degrees, spike, sun):
    for size in ((), (64, 64)):
        terrain = mapset.Terrain(ground(spark, 64, spike), G.Grid(31.5, 31.5, 0.02), *size)
        out = mapset.render(terrain, bodies(spark, degrees), times(spark), (32, 32, 1, 1), 0.0, 60.0).collect()
        assert [(r["r"], r["c"], r["sun"]) for r in out] == [(0, 0, sun)]


def test_a_window_of_flat_ground_is_uniform(spark):
    terrain = mapset.Terrain(ground(spark, 32), G.Grid(15.5, 15.5, 0.001))
    out = mapset.render(terrain, bodies(spark, 2), times(spark), (8, 8, 16, 16), 0.0, 40.0).collect()
    assert len(out) == 256 and {r["sun"] for r in out} == {255} and max(r["dsn"] for r in out) - min(r["dsn"] for r in out) <= 1


@pytest.mark.parametrize(("spike", "sun"), [(None, 255), ((32, 45, 1000.0), 0)])
def test_a_third_layer_blocks_the_sun(spark, spike, sun):
    site = mapset.Terrain(ground(spark, 16), G.Grid(7.5, 7.5, 0.001))
    middle, outer = mapset.Terrain(ground(spark, 32), G.Grid(15.5, 15.5, 0.005)), mapset.Terrain(ground(spark, 64, spike), G.Grid(31.5, 31.5, 0.02))
    out = mapset.render(site, bodies(spark, 1), times(spark), (8, 8, 1, 1), 0.0, 40.0, farther=(middle, outer)).collect()
    assert [r["sun"] for r in out] == [sun]
    with pytest.raises(ValueError, match="three"):
        mapset.render(site, bodies(spark, 1), times(spark), (8, 8, 1, 1), 0.0, 40.0, farther=(middle, outer, outer))


def test_cutoff_drops_terrain_outside_the_window(spark):
    terrain = mapset.Terrain(ground(spark, 64, (32, 50, 1000.0)), G.Grid(31.5, 31.5, 0.02))
    args = (bodies(spark, 1), times(spark), (24, 24, 16, 16), 0.0, 60.0)
    assert min(r["sun"] for r in mapset.render(terrain, *args).collect()) == 0
    assert min(r["sun"] for r in mapset.render(terrain, *args, cutoff=True).collect()) == 255


def test_kernel_equals_the_relational_form(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(0, 60, (40, 48))
    cells = spark.createDataFrame([(int(r), int(c), float(z[r, c])) for r in range(40) for c in range(48)], "r long, c long, z double")
    grid = G.Grid(23.5, 19.5, 0.02)
    rays = cells.select(F.col("r").alias("qr"), F.col("c").alias("qc"), "z", F.lit(0.6).alias("dc"), F.lit(-0.8).alias("dr"), F.lit(0.7).alias("threshold"))
    c, r = F.col("qc").cast("double"), F.col("qr").cast("double")
    q = G.stereo_to_body(c, r, F.col("z"), grid)
    up, _ = G.up_and_depth(c, r, F.col("z"), grid)
    samples = X.march(rays.withColumns({"px": q.x, "py": q.y, "pz": q.z, "ux": up.x, "uy": up.y, "uz": up.z}), quads(cells), F.lit(20.0))
    at, above = (G.Vector(*(F.col(f"{p}{i}") for i in "xyz")) for p in "pu")
    from lumenspark.operators.raster import bilinear

    sloped = samples.withColumn("slope", X.sphere_slope(F.col("x"), F.col("y"), bilinear(F.col("x"), F.col("y")), at, above, grid, 1.5))
    want = {(s["qr"], s["qc"]): s["slope"] for s in X.horizon(sloped, ["qr", "qc"]).collect()}
    got = {(s["qr"], s["qc"]): s["slope"] for s in X.horizon_kernel(rays, cells, 40, 48, grid, 1.5, 20.0, ("qr", "qc")).collect()}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and all(got[k] == -math.inf for k in set(got) - set(want))


def test_hand_off_numbers():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    row = spark.range(1).select(X.next_layer_start(F.lit(300.0), 1.0, 20.0).alias("a"), X.next_layer_start(F.lit(5.0), 1.0, 20.0).alias("b")).first()
    assert tuple(row) == (15.0, 1.0)
    assert sum(2 * half for _, _, half in X.chords()) * X.INV_MAX_PHOTONS == pytest.approx(1, abs=1e-6)


def test_resume_renders_only_what_is_missing(spark, tmp_path):
    terrain = mapset.Terrain(ground(spark, 16), G.Grid(7.5, 7.5, 0.02))
    all_times = T.time_range(spark, "2024-01-01 00:00:00", "2024-01-03 00:00:00", 86400)
    sky = all_times.crossJoin(bodies(spark, 3).drop("ts"))
    first = mapset.generate(terrain, sky, all_times.where("ts < '2024-01-02'"), f"{tmp_path}/m", max_pixels=8.0)
    assert first.select("ts").distinct().count() == 1
    whole = mapset.generate(terrain, sky, all_times, f"{tmp_path}/m", max_pixels=8.0)
    assert whole.count() == 3 * 256
    direct = mapset.render(terrain, sky, all_times, max_pixels=8.0).groupBy().agg(F.sum("sun"), F.sum("dsn")).first()
    assert whole.groupBy().agg(F.sum("sun"), F.sum("dsn")).first() == direct


def test_light_curve_and_series(spark):
    terrain = mapset.Terrain(ground(spark, 32), G.Grid(15.5, 15.5, 0.02))
    t = T.time_range(spark, "2024-01-01 00:00:00", "2024-01-01 00:35:00", 900)
    sky = ephemeris.approximate(t)
    curve = mapset.light_curve(terrain, sky, t, 16, 16, max_pixels=12.0).collect()
    assert len(curve) == 3 and curve[0]["x_m"] == pytest.approx(10) and curve[0]["y_m"] == pytest.approx(-10)
    series = mapset.azel_series(t, sky, curve[0]["latitude_deg"], curve[0]["longitude_deg"], 2.0).collect()
    for a, b in zip(curve, series, strict=True):
        assert a["sun_azimuth_deg"] == pytest.approx(b["rover_to_sun_azimuth_deg"]) and a["sun_elevation_deg"] == pytest.approx(b["rover_to_sun_elevation_deg"])
        assert 0.98 < b["rover_to_sun_dist_au"] < 1.02 and 0.5 < b["sun_angular_diameter_deg"] < 0.55 and 1.7 < b["earth_angular_diameter_deg"] < 2.2


def test_approximate_ephemeris_is_plausible(spark):
    t = T.time_range(spark, "2024-01-01 00:00:00", "2024-03-01 00:00:00", 86400)
    rows = ephemeris.approximate(t).collect()
    for r in rows:
        d = math.sqrt(r["x"] ** 2 + r["y"] ** 2 + r["z"] ** 2)
        if r["body"] == ephemeris.EARTH:
            assert 356000 < d < 407000 and abs(math.degrees(math.atan2(r["y"], r["x"]))) < 9
        else:
            assert 0.97 < d / ephemeris.AU_KM < 1.03


def test_interpolation(spark):
    t = T.time_range(spark, "2024-01-01 00:00:00", "2024-01-01 02:00:00", 3600)
    sky = t.select("ts", F.lit(10).alias("body"), F.hour("ts").cast("double").alias("x"), F.lit(1.0).alias("y"), (-F.hour("ts")).cast("double").alias("z"))
    half = T.time_range(spark, "2024-01-01 00:30:00", "2024-01-01 01:30:00", 1800)
    got = sorted((r["x"], r["z"]) for r in ephemeris.interpolated(half, sky).collect())
    assert got == [(0.5, -0.5), (1.0, -1.0), (1.5, -1.5)]
