"""Raster algebra over the elevation raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspark.operators import raster as Q
from lumenspark.plans.registry import DEM, cell_columns, dem, query, table

W = 64
SIZE = f"{DEM}, hw AS (SELECT count(*)::BIGINT AS h, {W} AS w FROM embeddings)"


def height(spark, sf) -> int:
    """Rows of the raster, from the file's metadata."""
    return table(spark, sf, "embeddings").count()


@query("r1_pool", f"""WITH {SIZE}, p AS (SELECT unnest([r // 2, CASE WHEN r % 2 = 0 THEN r // 2 - 1 END]) AS pr, c, z FROM dem), q AS (SELECT pr, unnest([c // 2, CASE WHEN c % 2 = 0 THEN c // 2 - 1 END]) AS pc, z FROM p)
SELECT pr AS r, pc AS c, max(z) AS vmax, min(z) AS vmin FROM q, hw WHERE pr >= 0 AND pc >= 0 AND pr < h // 2 AND pc < w // 2 GROUP BY ALL""")
def _(spark, sf):
    return Q.pool(dem(spark, sf), height(spark, sf), W)


@query("r1_pyramid", f"""WITH {SIZE}, l1 AS (SELECT a.r // 2 AS r, a.c // 2 AS c, max(b.z) AS z FROM dem a JOIN dem b ON b.r BETWEEN a.r AND a.r + 2 AND b.c BETWEEN a.c AND a.c + 2, hw WHERE a.r % 2 = 0 AND a.c % 2 = 0 AND a.r // 2 < h // 2 AND a.c // 2 < w // 2 GROUP BY ALL),
l2 AS (SELECT a.r // 2 AS r, a.c // 2 AS c, max(b.z) AS z FROM l1 a JOIN l1 b ON b.r BETWEEN a.r AND a.r + 2 AND b.c BETWEEN a.c AND a.c + 2, hw WHERE a.r % 2 = 0 AND a.c % 2 = 0 AND a.r // 2 < h // 4 AND a.c // 2 < w // 4 GROUP BY ALL)
SELECT 1::BIGINT AS level, r, c, z FROM l1 UNION ALL SELECT 2, r, c, z FROM l2""")
def _(spark, sf):
    """Two levels of the maximum pyramid."""
    h = height(spark, sf)
    one = Q.pool(dem(spark, sf), h, W).select("r", "c", F.col("vmax").alias("z"))
    two = Q.pool(one, h // 2, W // 2).select("r", "c", F.col("vmax").alias("z"))
    level = lambda n: F.lit(n).cast("long").alias("level")
    return one.select(level(1), "*").union(two.select(level(2), "*"))


QUADS = f"{DEM}, qu AS (SELECT a.r, a.c, a.z AS e11, b.z AS e21, d.z AS e12, f.z AS e22 FROM dem a JOIN dem b ON b.r = a.r AND b.c = a.c + 1 JOIN dem d ON d.r = a.r + 1 AND d.c = a.c JOIN dem f ON f.r = a.r + 1 AND f.c = a.c + 1)"


@query("j2_quads", f"WITH {QUADS} SELECT * FROM qu")
def _(spark, sf):
    return Q.quads(dem(spark, sf))


@query("r2_bilinear", f"WITH {QUADS}, p AS (SELECT r AS pr, c AS pc, c + 0.3 AS x, r + 1.6 AS y FROM dem) SELECT pr, pc, round((1 - (x - c)) * (1 - (y - r)) * e11 + (x - c) * (1 - (y - r)) * e21 + (1 - (x - c)) * (y - r) * e12 + (x - c) * (y - r) * e22, 6) AS z FROM p JOIN qu ON r = floor(y) AND c = floor(x)")
def _(spark, sf):
    """Samples beside every cell; those outside the raster go."""
    points = dem(spark, sf).select(F.col("r").alias("pr"), F.col("c").alias("pc"), (F.col("c") + 0.3).alias("x"), (F.col("r") + 1.6).alias("y"))
    found = points.join(Q.quads(dem(spark, sf)), (F.col("r") == F.floor("y")) & (F.col("c") == F.floor("x")))
    return found.select("pr", "pc", F.round(Q.bilinear(F.col("x"), F.col("y")), 6).alias("z"))


def filtered_sql(columns: str, source: str, name: str) -> str:
    """Two mirrored window passes as SQL."""
    avg = lambda axis, other: ", ".join(f"avg({x}) OVER (PARTITION BY {other} ORDER BY {axis} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS {x}" for x in columns.split(","))
    pad = lambda t, axis, n: f"SELECT * FROM {t} UNION ALL SELECT * REPLACE (-1 - {axis} AS {axis}) FROM {t} WHERE {axis} < 3 UNION ALL SELECT {t}.* REPLACE (2 * {n} - 1 - {axis} AS {axis}) FROM {t}, hw WHERE {axis} >= {n} - 3"
    return f"{name}_c AS ({pad(source, 'c', 'w')}), {name}_h AS (SELECT * FROM (SELECT r, c, {avg('c', 'r')} FROM {name}_c) WHERE c >= 0 AND c < {W}), {name}_r AS ({pad(name + '_h', 'r', 'h')}), {name} AS (SELECT f.* FROM (SELECT r, c, {avg('r', 'c')} FROM {name}_r) f, hw WHERE r >= 0 AND r < h)"


@query("r3_uniform_filter", f"WITH {SIZE}, {filtered_sql('z', 'dem', 'f')} SELECT r, c, round(z, 6) AS z FROM f")
def _(spark, sf):
    return Q.uniform_filter(dem(spark, sf), ["z"], height(spark, sf), W).select("r", "c", F.round("z", 6).alias("z"))


SSIM = f"""{SIZE}, pr AS (SELECT r, c, x, y, x * x AS xx, y * y AS yy, x * y AS xy FROM (SELECT r, c, z / 100 AS x, sin(z) AS y FROM dem)), {filtered_sql('x,y,xx,yy,xy', 'pr', 'f')},
ss AS (SELECT r, c, (2 * x * y + 0.0001) * (2 * (xy - x * y) * 49 / 48 + 0.0009) / ((x * x + y * y + 0.0001) * ((xx - x * x) * 49 / 48 + (yy - y * y) * 49 / 48 + 0.0009)) AS s FROM f)"""


@query("r4_ssim", f"WITH {SSIM} SELECT r, c, round(s, 6) AS ssim FROM ss")
def _(spark, sf):
    pair = dem(spark, sf).select("r", "c", (F.col("z") / 100).alias("x"), F.sin("z").alias("y"))
    return Q.ssim(pair, "x", "y", height(spark, sf), W).select("r", "c", F.round("ssim", 6).alias("ssim"))


@query("r5_erosion", f"""WITH {DEM}, ok AS (SELECT r, c FROM dem WHERE z > -15),
d AS (SELECT unnest(range(-3, 4)) AS i), k AS (SELECT a.i, b.i AS j FROM d a, d b WHERE abs(a.i) + abs(b.i) <= 3)
SELECT o.r, o.c FROM ok o, k JOIN ok n ON n.r = o.r + k.i AND n.c = o.c + k.j GROUP BY ALL HAVING count(*) = 25""")
def _(spark, sf):
    """Three erosions leave the cells whose diamond of radius 3 is set."""
    mask = dem(spark, sf).select("r", "c", (F.col("z") > -15).alias("m"))
    return Q.erode(mask, "m", 3).where("m").select("r", "c")


NEAR = f"""{DEM}, h3 AS (SELECT r, c, z AS m, coalesce(lag(z) OVER w, 2 * z - lead(z) OVER w) AS l, coalesce(lead(z) OVER w, 2 * z - lag(z) OVER w) AS t FROM dem WINDOW w AS (PARTITION BY r ORDER BY c)),
n9 AS (SELECT r, c, l AS d, t AS f, {', '.join(f"coalesce(lag({x}) OVER w, 2 * {x} - lead({x}) OVER w) AS {u}, coalesce(lead({x}) OVER w, 2 * {x} - lag({x}) OVER w) AS {v}" for x, u, v in (('l', 'a', 'g'), ('m', 'b', 'h'), ('t', 'cc', 'i')))} FROM h3 WINDOW w AS (PARTITION BY c ORDER BY r)),
gr AS (SELECT r, c, ((a + 2 * d + g) - (cc + 2 * f + i)) / 160 AS dx, ((g + 2 * h + i) - (a + 2 * b + cc)) / 160 AS dy FROM n9)"""


@query("r6_hillshade", f"WITH {NEAR}, s AS (SELECT r, c, (sin(radians(45)) - cos(radians(45)) * sqrt(dx * dx + dy * dy) * sin(atan2(dy, dx) - radians(315))) / sqrt(1 + dx * dx + dy * dy) AS v FROM gr) SELECT r, c, round(CASE WHEN v <= 0 THEN 1 ELSE 1 + 254 * v END, 4) AS shade FROM s")
def _(spark, sf):
    return Q.slope_and_shade(dem(spark, sf), 20.0).select("r", "c", F.round("shade", 4).alias("shade"))


@query("r7_slope", f"WITH {NEAR} SELECT r, c, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope FROM gr")
def _(spark, sf):
    return Q.slope_and_shade(dem(spark, sf), 20.0).select("r", "c", F.round("slope", 6).alias("slope"))


@query("r8_relief", f"""WITH {DEM}, g AS (SELECT r, c, sqrt(coalesce(lead(z) OVER (PARTITION BY c ORDER BY r) - z, 0) ** 2 + coalesce(lead(z) OVER (PARTITION BY r ORDER BY c) - z, 0) ** 2) / 20 AS s FROM dem), q AS (SELECT quantile_disc(s, 0.95) AS k FROM g)
SELECT r, c, round(least(1.0, s / k), 6) AS steep FROM g, q""")
def _(spark, sf):
    return Q.relief(dem(spark, sf), 20.0).select("r", "c", F.round("steep", 6).alias("steep"))


@query("r9_overview", f"WITH {DEM} SELECT r // 4 AS r, c // 4 AS c, round(z, 6) AS z FROM dem WHERE r % 4 = 0 AND c % 4 = 0")
def _(spark, sf):
    """Down-sampling by a factor of 4 is the operator."""
    return Q.overview(dem(spark, sf), 4).select("r", "c", F.round("z", 6).alias("z"))


@query("r10_crop", f"WITH {DEM} SELECT r - 100 AS r, c - 8 AS c, z FROM dem WHERE r BETWEEN 100 AND 163 AND c BETWEEN 8 AND 55")
def _(spark, sf):
    """A window is the operator."""
    return Q.crop(dem(spark, sf), 100, 8, 64, 48)


@query("r11_tiles", f"WITH {DEM} SELECT r // 128 AS tr, c // 16 AS tc, count(*)::BIGINT AS cells, round(max(z), 6) AS top FROM dem GROUP BY ALL")
def _(spark, sf):
    return dem(spark, sf).groupBy(*Q.tile_of(128, 16)).agg(F.count("*").alias("cells"), F.round(F.max("z"), 6).alias("top"))


@query("r12_neighbourhood_max", f"WITH {DEM} SELECT d::BIGINT AS d, round(max(z), 6) AS top FROM dem, (SELECT unnest([5, 25, 100]) AS d) WHERE abs(r - 250) <= d AND abs(c - 32) <= d GROUP BY d")
def _(spark, sf):
    reach = spark.createDataFrame([(5,), (25,), (100,)], "d long")
    near = dem(spark, sf).join(F.broadcast(reach), (F.abs(F.col("r") - 250) <= F.col("d")) & (F.abs(F.col("c") - 32) <= F.col("d")))
    return near.groupBy("d").agg(F.round(F.max("z"), 6).alias("top"))


@query("r13_difference_summary", f"WITH {DEM}, d AS (SELECT floor(z) - floor(z + 0.25) AS d FROM dem), x AS (SELECT CASE WHEN d <> 0 THEN abs(d) END AS x FROM d) SELECT count(*)::BIGINT AS n, count(x)::BIGINT AS n_diff, min(x) AS least, quantile_cont(x, 0.5) AS median, round(avg(x), 6) AS mean, max(x) AS most FROM x")
def _(spark, sf):
    cells = dem(spark, sf)
    whole = lambda z: F.floor(z).cast("double").alias("z")
    d = Q.difference(cells.select("r", "c", whole(F.col("z"))), cells.select("r", "c", whole(F.col("z") + 0.25)))
    return Q.difference_summary(d).withColumn("mean", F.round("mean", 6))


@query("r15_ascii_patch", f"WITH {DEM}, m AS (SELECT min(z) AS lo, max(z) AS hi FROM dem) SELECT r, string_agg(substr(' .:-=+*#%@', least(floor((z - lo) / greatest(hi - lo, 1e-12) * 10), 9)::INT + 1, 1), '' ORDER BY c) AS line FROM dem, m GROUP BY r")
def _(spark, sf):
    return Q.ascii_patch(dem(spark, sf))


@query("w1_differences", f"WITH {DEM} SELECT r, c, round(z - lag(z) OVER (PARTITION BY r ORDER BY c), 6) AS dc, round(lead(z) OVER (PARTITION BY c ORDER BY r) - z, 6) AS dr FROM dem")
def _(spark, sf):
    return dem(spark, sf).select("r", "c", F.round(F.col("z") - F.lag("z").over(Q._along("c")), 6).alias("dc"), F.round(F.lead("z").over(Q._along("r")) - F.col("z"), 6).alias("dr"))


@query("p20_geometry_grid", f"""WITH {DEM}, g AS (SELECT r, c, (c - 31.5) * 0.02 AS e, (249.5 - r) * 0.02 AS n FROM dem), q AS (SELECT *, (e * e + n * n) / (4 * 1737.4 * 1737.4) AS k FROM g), p AS (SELECT r, c, n / (1 + k) AS x, e / (1 + k) AS y, 1737.4 * (k - 1) / (1 + k) AS zz FROM q),
d AS (SELECT r, c, {', '.join(f"coalesce(lead({v}) OVER {w}, {v}) - coalesce(lag({v}) OVER {w}, {v}) AS {w}{v}" for w in ('wc', 'wr') for v in ('x', 'y', 'zz'))} FROM p WINDOW wc AS (PARTITION BY r ORDER BY c), wr AS (PARTITION BY c ORDER BY r))
SELECT r, c, {', '.join(f"round({w}{v} / sqrt({w}x * {w}x + {w}y * {w}y + {w}zz * {w}zz), 6) AS {w}_{v}" for w in ('wc', 'wr') for v in ('x', 'y', 'zz'))} FROM d""")
def _(spark, sf):
    """Unit vectors along columns and rows of the datum: central differences, one-sided at the edges."""
    from lumenspark.functions.geometry import Grid, stereo_to_body

    C, R, _ = cell_columns()
    v = stereo_to_body(C, R, F.lit(0.0), Grid(31.5, 249.5, 0.02))
    cells = dem(spark, sf).select("r", "c", v.x.alias("x"), v.y.alias("y"), v.z.alias("zz"))
    out = []
    for w, axis in (("wc", "c"), ("wr", "r")):
        d = {n: F.coalesce(F.lead(n).over(Q._along(axis)), F.col(n)) - F.coalesce(F.lag(n).over(Q._along(axis)), F.col(n)) for n in ("x", "y", "zz")}
        size = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["zz"] * d["zz"])
        out += [F.round(d[n] / size, 6).alias(f"{w}_{n}") for n in d]
    return cells.select("r", "c", *out)
