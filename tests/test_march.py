"""Rays that meet the terrain block by block."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspark import plans
from lumenspark.operators import raycast as X
from lumenspark.operators.raster import bilinear, quads

ROWS, COLUMNS, LIMIT = 70, 140, 90.0


@pytest.mark.parametrize("fan", [False, True])
def test_samples_over_blocks_and_stretches(spark, fan):
    """Every sample of rays that cross blocks, once, up to the edges."""
    rng = np.random.default_rng(3)
    z = rng.normal(0, 10, (ROWS, COLUMNS))
    cells = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(ROWS) for c in range(COLUMNS)], "r long, c long, z double")
    starts, ways = [(0, 0), (69, 139), (35, 63), (63, 64), (10, 130)], [(0.8, 0.6), (-0.8, -0.6), (0.6, -0.8), (-1.0, 0.0)]
    rays = spark.createDataFrame([(r, c, k, *w) for r, c in starts for k, w in enumerate(ways)], "qr long, qc long, ray int, dc double, dr double")
    if fan:
        rays = rays.groupBy("qr", "qc").agg(F.collect_list(F.struct("ray", "dc", "dr")).alias("fan"))
    rows = X.march(rays, quads(cells), F.lit(LIMIT)).select("qr", "qc", "ray", "d", bilinear(F.col("x"), F.col("y")).alias("e")).collect()
    got = {(s["qr"], s["qc"], s["ray"], round(s["d"], 6)): s["e"] for s in rows}
    want = {}
    for r, c in starts:
        for n, (dc, dr) in enumerate(ways):
            for k in range(int((LIMIT - 1) / X.STEP) + 1):
                d = 1.0 + k * X.STEP
                x, y = c + d * dc, r + d * dr
                i, j = int(y), int(x)
                if x > -1 and y > -1 and i < ROWS - 1 and j < COLUMNS - 1:
                    u, v = x - j, y - i
                    want[r, c, n, round(d, 6)] = (1 - u) * (1 - v) * z[i, j] + u * (1 - v) * z[i, j + 1] + (1 - u) * v * z[i + 1, j] + u * v * z[i + 1, j + 1]
    assert len(rows) == len(want) and got.keys() == want.keys() and all(abs(got[k] - e) < 1e-9 for k, e in want.items())


@pytest.mark.parametrize("name", ["x19_brute_horizon", "x20_blocker", "j3_pyramid_bound", "w8_running_horizon", "x1_samples", "x4_horizon", "x12_relational", "x13_two_layers"])
def test_terrain_is_not_broadcast(spark, name):
    """The rows of a raster unfold to 64 cells and 22 samples each: their file's size says nothing about what a broadcast holds."""
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shape_ends_rays_at_the_edges_only(spark):
    """With the raster's size known, rays have the samples that they have without it."""
    cells = spark.range(70 * 140).selectExpr("id div 140 AS r", "id % 140 AS c", "cast(id % 7 AS double) AS z")
    ways = [(0.8, 0.6), (-0.8, -0.6), (0.6, -0.8), (-1.0, 0.0), (0.0, 1.0)]
    rays = spark.createDataFrame([(r, c, k, *w) for r, c in [(0, 0), (69, 139), (35, 63)] for k, w in enumerate(ways)], "qr long, qc long, ray int, dc double, dr double")
    fans = rays.groupBy("qr", "qc").agg(F.collect_list(F.struct("ray", "dc", "dr")).alias("fan"))
    sets = [sorted(tuple(x) for x in X.march(df, quads(cells), F.lit(400.0), 1.0, shape).select("qr", "qc", "ray", "d", "r", "c").collect()) for df, shape in ((rays, None), (rays, (70, 140)), (fans, (70, 140)))]
    assert len(sets[0]) > 500 and sets[0] == sets[1] == sets[2]


def test_relational_frame_sees_all_of_the_terrain(spark):
    """Rays of x12_relational go on to the raster's edge, as those of the kernel without a bound."""
    from lumenspark.plans import raycast_queries as R

    sf = "/root/testdata/sf0.001"
    cells = R.dem(spark, sf)
    whole = X.illuminate(R.frame_pixels(spark, sf), quads(cells), R.GRID, 2.0, X.HARD_CAP, whole=(cells, R.height(spark, sf), R.W))
    rows = [sorted(tuple(r) for r in df.select("qr", "qc", "sun", "dsn", F.round("horizon", 5)).collect()) for df in (plans.QUERIES["x12_relational"](spark, sf), whole)]
    assert rows[0] and rows[0] == rows[1]
