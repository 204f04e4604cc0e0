"""Horizons and illumination over the elevation raster."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenspark.functions import geometry as G
from lumenspark.operators import raycast as X
from lumenspark.operators.raster import bilinear, pool, quads
from lumenspark.plans.raster_queries import QUADS, W, height
from lumenspark.plans.registry import bodies, cell_columns, dem, query

GRID = G.Grid(31.5, 249.5, 0.02)
STEP = X.STEP
FAR = 16.0  # pixels: the raster is 64 wide (x12_relational has no such bound)


def bilerp(x: str = "x", y: str = "y") -> str:
    return f"((1 - ({x} - c)) * (1 - ({y} - r)) * e11 + ({x} - c) * (1 - ({y} - r)) * e21 + (1 - ({x} - c)) * ({y} - r) * e12 + ({x} - c) * ({y} - r) * e22)"


MARCH = f"""{QUADS}, st AS (SELECT 1.0 + k * {STEP} AS d FROM (SELECT unnest(range(0, 22)) AS k) WHERE 1.0 + k * {STEP} <= {FAR}),
sa AS (SELECT dem.r AS qr, dem.c AS qc, dem.z AS qz, d, dem.c + d * 0.8 AS x, dem.r + d * 0.6 AS y FROM dem, st),
sm AS (SELECT qr, qc, qz, d, r, c, {bilerp()} AS e FROM sa JOIN qu ON r = trunc(y)::BIGINT AND c = trunc(x)::BIGINT WHERE x > -1 AND y > -1)"""


def flat_samples(spark, sf, *more):
    """Samples of one ray of fixed direction from every cell; ``more``: further columns of the ray."""
    cells = dem(spark, sf)
    rays = cells.select(F.col("r").alias("qr"), F.col("c").alias("qc"), F.col("z").alias("qz"), F.lit(0.8).alias("dc"), F.lit(0.6).alias("dr"), F.lit(0.3).alias("threshold"))
    samples = X.march(rays, quads(cells), F.lit(FAR))
    e = bilinear(F.col("x"), F.col("y"))
    return samples.select("qr", "qc", *more, "d", "threshold", e.alias("e"), X.flat_slope(e, F.col("qz"), F.col("d") * 20, 1737400.0).alias("slope"))


FLAT = f"{MARCH}, sl AS (SELECT qr, qc, d, e, (e - qz - (d * 20) * (d * 20) / (2 * 1737400.0)) / (d * 20) AS slope FROM sm)"


@query("x1_samples", f"WITH {MARCH} SELECT qr, qc, count(*)::BIGINT AS n, round(max(d), 6) AS exit_d, round(sum(e), 4) AS total FROM sm GROUP BY qr, qc")
def _(spark, sf):
    return flat_samples(spark, sf).groupBy("qr", "qc").agg(F.count("*").alias("n"), F.round(F.max("d"), 6).alias("exit_d"), F.round(F.sum("e"), 4).alias("total"))


@query("x4_horizon", f"WITH {FLAT} SELECT qr, qc, round(coalesce(arg_min(slope, d) FILTER (WHERE slope >= 0.3), max(slope)), 6) AS slope, bool_or(slope >= 0.3) AS hit FROM sl GROUP BY qr, qc")
def _(spark, sf):
    """First slope at or over the threshold, else the largest."""
    return X.horizon(flat_samples(spark, sf), ["qr", "qc"]).select("qr", "qc", F.round("slope", 6).alias("slope"), "hit")


@query("x19_brute_horizon", f"WITH {FLAT} SELECT qr, qc, floor(10 * degrees(atan(max(slope))) + 1e-9)::BIGINT AS tenths, CASE WHEN degrees(atan(max(slope))) < 10 THEN 'lit' WHEN degrees(atan(max(slope))) > 20 THEN 'shadow' ELSE 'partial' END AS verdict FROM sl GROUP BY qr, qc")
def _(spark, sf):
    deg = F.degrees(F.atan(F.max("slope")))
    return flat_samples(spark, sf).groupBy("qr", "qc").agg(F.floor(10 * deg + 1e-9).alias("tenths"), F.when(deg < 10, "lit").when(deg > 20, "shadow").otherwise("partial").alias("verdict"))


@query("x20_blocker", f"WITH {FLAT} SELECT qr, qc, round(arg_max(d, slope), 6) AS d, round(arg_max(e, slope), 4) AS e, round(max(slope), 6) AS slope FROM sl GROUP BY qr, qc")
def _(spark, sf):
    """The sample that sets the horizon."""
    top = F.max_by(F.struct("d", "e"), "slope")
    return flat_samples(spark, sf).groupBy("qr", "qc").agg(top.alias("t"), F.round(F.max("slope"), 6).alias("slope")).select("qr", "qc", F.round("t.d", 6).alias("d"), F.round("t.e", 4).alias("e"), "slope")


@query("w8_running_horizon", f"WITH {FLAT}, m AS (SELECT qr, qc, d, slope, max(slope) OVER (PARTITION BY qr, qc ORDER BY d) AS top FROM sl) SELECT qr, qc, count(DISTINCT top)::BIGINT AS rises, round(max(top), 6) AS top FROM m GROUP BY qr, qc")
def _(spark, sf):
    """How often the running maximum along a ray rises."""
    from pyspark.sql import Window

    top = F.max("slope").over(Window.partitionBy("qr", "qc").orderBy("d"))
    return flat_samples(spark, sf).withColumn("top", top).groupBy("qr", "qc").agg(F.countDistinct("top").alias("rises"), F.round(F.max("top"), 6).alias("top"))


@query("x6_reach", "WITH t AS (SELECT s_suppkey AS id, s_acctbal / 20000 AS thr FROM supplier) SELECT id, round(CASE WHEN thr > 0.005 THEN least(15000.0, 10000.0 * 1.5 / 20 / thr) ELSE 15000.0 END, 6) AS pixels FROM t")
def _(spark, sf):
    from lumenspark.plans.registry import table

    t = F.col("s_acctbal") / 20000
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.round(X.reach(t, 20.0), 6).alias("pixels"))


@query("x16_next_start", "SELECT s_suppkey AS id, round(greatest(1.0, s_suppkey * 1.0 / 20), 6) AS start FROM supplier")
def _(spark, sf):
    from lumenspark.plans.registry import table

    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.round(X.next_layer_start(F.col("s_suppkey").cast("double"), 1.0, 20.0), 6).alias("start"))


def tick_sql(h: str = "h") -> str:
    return " + ".join(f"greatest(0.0, least(el + {half!r} - ({h}[{a + 1}] + {share!r} * ({h}[{a + 2}] - {h}[{a + 1}])), {2 * half!r}))" for a, share, half in X.chords())


@query("x9_sun_fraction", f"WITH q AS (SELECT vec_id AS id, 2 * embedding[9]::DOUBLE AS el, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS h FROM embeddings), f AS (SELECT id, ({tick_sql()}) * {X.INV_MAX_PHOTONS!r} AS f FROM q) SELECT id, round(f, 6) AS fraction, least(greatest(floor(255 * f), 0), 255)::BIGINT AS sun FROM f")
def _(spark, sf):
    """Disk fraction from eight horizon angles (degrees): the first eight components of a vector."""
    from lumenspark.plans.registry import table

    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (2 * F.col("embedding")[8].cast("double")).alias("el"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("h"))
    f = X.sun_fraction(F.col("el"), F.col("h"))
    return v.select("id", F.round(f, 6).alias("fraction"), G.encode_sun(f).alias("sun"))


def frame_pixels(spark, sf):
    """Directions of Sun and Earth over every cell, for a frame with a low Sun."""
    C, R, Z = cell_columns()
    sun, earth = G.Vector.of(1.3e8, 6e7, -2.2e6), G.Vector.of(360000.0, 90000.0, -12000.0)
    s, e = G.grid_direction(C, R, Z, sun, GRID, 2.0), G.grid_direction(C, R, Z, earth, GRID, 2.0)
    return dem(spark, sf).select(F.lit(1).alias("frame"), F.col("r").alias("qr"), F.col("c").alias("qc"), "z", s[0].alias("sun_cos"), s[1].alias("sun_sin"), s[2].alias("sun_el"), e[0].alias("earth_cos"), e[1].alias("earth_sin"), e[2].alias("earth_el"))


def _toward(p: str, x: float, y: float, z: float) -> str:
    return f"({x!r} - px) * sl * co + ({y!r} - py) * sl * so - ({z!r} - pz) * cl AS {p}s, -({x!r} - px) * so + ({y!r} - py) * co AS {p}t, ({x!r} - px) * cl * co + ({y!r} - py) * cl * so + ({z!r} - pz) * sl - 0.002 AS {p}u"


_FAN = ", ".join(f"({i}, {math.cos(math.radians(o * X.SUN_HALF_ANGLE))!r}, {math.sin(math.radians(o * X.SUN_HALF_ANGLE))!r})" for i, o in enumerate(X.RAY_OFFSETS))
ILLUMINATION = f"""{QUADS}, g AS (SELECT r AS qr, c AS qc, z, (c - 31.5) * 0.02 AS e, (249.5 - r) * 0.02 AS n FROM dem), u AS (SELECT *, sqrt(e * e + n * n) AS rho FROM g), w AS (SELECT *, rho / (2 * 1737.4) AS u, 1737.4 + z / 1000 AS t FROM u),
b AS (SELECT *, 2 * u / (1 + u * u) AS cl, (u * u - 1) / (1 + u * u) AS sl, n / rho AS co, e / rho AS so, t / (1737.4 * (1 + u * u)) * n AS px, t / (1737.4 * (1 + u * u)) * e AS py, t * (u * u - 1) / (1 + u * u) AS pz FROM w),
dd AS (SELECT *, {_toward('s', 1.3e8, 6e7, -2.2e6)}, {_toward('e', 360000.0, 90000.0, -12000.0)} FROM b),
az AS (SELECT qr, qc, cl * co AS ux, cl * so AS uy, sl AS uz, px, py, pz, {', '.join(f"(-{p}s * e / rho + {p}t * n / rho) / sqrt({p}s * {p}s + {p}t * {p}t) AS {p}c, -(-{p}s * n / rho - {p}t * e / rho) / sqrt({p}s * {p}s + {p}t * {p}t) AS {p}i, degrees(atan2({p}u, sqrt({p}s * {p}s + {p}t * {p}t))) AS {p}l" for p in 'se')} FROM dd),
fan AS (SELECT * FROM (VALUES {_FAN}) t(ray, fc, fs)),
ry AS (SELECT az.*, ray, sc * fc - si * fs AS dc, sc * fs + si * fc AS dr, tan(radians(sl + {X.SUN_HALF_ANGLE})) AS thr FROM az, fan WHERE sl + {X.SUN_HALF_ANGLE} > -10 UNION ALL SELECT az.*, 8, ec, ei, tan(radians(el)) FROM az WHERE el > -10),
st AS (SELECT 1.0 + k * {STEP} AS d FROM (SELECT unnest(range(0, 22)) AS k)),
sa AS (SELECT ry.*, d, qc + d * dc AS x, qr + d * dr AS y FROM ry, st WHERE d <= least({FAR}, CASE WHEN thr > 0.005 THEN least(15000.0, 750.0 / thr) ELSE 15000.0 END)),
sm AS (SELECT qr, qc, ray, thr, px, py, pz, ux, uy, uz, d, x, y, {bilerp()} AS e FROM sa JOIN qu ON r = trunc(y)::BIGINT AND c = trunc(x)::BIGINT WHERE x > -1 AND y > -1),
po AS (SELECT *, ((x - 31.5) * 0.02) ** 2 + ((249.5 - y) * 0.02) ** 2 AS q2, 1737.4 + e / 1000 AS t FROM sm),
pp AS (SELECT *, t / (1737.4 * (1 + q2 / (4 * 1737.4 * 1737.4))) * (249.5 - y) * 0.02 - px AS vx, t / (1737.4 * (1 + q2 / (4 * 1737.4 * 1737.4))) * (x - 31.5) * 0.02 - py AS vy, t * (q2 / (4 * 1737.4 * 1737.4) - 1) / (1 + q2 / (4 * 1737.4 * 1737.4)) - pz AS vz FROM po),
rs AS (SELECT qr, qc, ray, thr, d, vx * ux + vy * uy + vz * uz AS rise, vx * vx + vy * vy + vz * vz AS vv FROM pp),
sl2 AS (SELECT qr, qc, ray, thr, d, (rise - 0.002) / sqrt(greatest(vv - rise * rise, 1e-18)) AS slope FROM rs),
hz AS (SELECT qr, qc, ray, degrees(atan(coalesce(arg_min(slope, d) FILTER (WHERE slope >= thr), max(slope)))) AS deg FROM sl2 GROUP BY qr, qc, ray),
hh AS (SELECT qr, qc, {', '.join(f"coalesce(max(deg) FILTER (WHERE ray = {i}), -90.0) AS h{i}" for i in range(9))} FROM hz GROUP BY qr, qc),
fr AS (SELECT az.qr, az.qc, az.sl AS el, az.el AS earth, [{', '.join(f"coalesce(h{i}, -90.0)" for i in range(8))}] AS h, coalesce(h8, -90.0) AS h8 FROM az LEFT JOIN hh USING (qr, qc)),
out AS (SELECT qr, qc, CASE WHEN el + {X.SUN_HALF_ANGLE} > -10 THEN ({tick_sql()}) * {X.INV_MAX_PHOTONS!r} ELSE 0 END AS f, h8, CASE WHEN earth > -10 THEN earth - h8 ELSE -90.0 END AS over FROM fr)"""


FRAME = f"WITH {ILLUMINATION} SELECT 1 AS frame, qr, qc, least(greatest(floor(255 * f), 0), 255)::BIGINT AS sun, least(greatest(floor(over * 10), 0), 250)::BIGINT AS dsn, round(h8, 5) AS horizon FROM out"


@query("x12_illumination", FRAME)
def illumination(spark, sf):
    """Flagship: one frame of sun and contact bytes over the whole raster (eight sun rays and one to Earth from each cell)."""
    cells = dem(spark, sf)
    found = X.illuminate(frame_pixels(spark, sf), quads(cells), GRID, 2.0, FAR, whole=(cells, height(spark, sf), W))
    return found.select("frame", "qr", "qc", "sun", "dsn", F.round("horizon", 5).alias("horizon"))


#: Every ray to the raster's edge: it has no cells a pixel beyond.
_NEAR_STEPS = FRAME[FRAME.index("st AS (") : FRAME.index("sm AS (")]
_EDGE = f"least(CASE WHEN dc > 0 THEN ({W} - qc) / dc WHEN dc < 0 THEN (qc + 2) / -dc ELSE 1e9 END, CASE WHEN dr > 0 THEN (h - qr) / dr WHEN dr < 0 THEN (qr + 2) / -dr ELSE 1e9 END)"
_ALL_STEPS = f"""st AS (SELECT ry.*, unnest(range(0, 2 + ({_EDGE} / {STEP})::BIGINT)) AS k FROM ry, (SELECT count(*) AS h FROM embeddings)),
sa AS (SELECT * EXCLUDE k, 1.0 + k * {STEP} AS d, qc + (1.0 + k * {STEP}) * dc AS x, qr + (1.0 + k * {STEP}) * dr AS y FROM st WHERE 1.0 + k * {STEP} <= CASE WHEN thr > 0.005 THEN least({X.HARD_CAP}, 750.0 / thr) ELSE {X.HARD_CAP} END),
"""
WHOLE_FRAME = FRAME.replace(_NEAR_STEPS, _ALL_STEPS)


@query("x12_relational", WHOLE_FRAME)
def _(spark, sf):
    """A frame by joins and aggregates, as for terrain that is too large to broadcast; rays go on to the raster's edge."""
    found = X.illuminate(frame_pixels(spark, sf), quads(dem(spark, sf)), GRID, 2.0, X.HARD_CAP, shape=(height(spark, sf), W))
    return found.select("frame", "qr", "qc", "sun", "dsn", F.round("horizon", 5).alias("horizon"))


@query("x13_two_layers", f"""WITH {FLAT}, far AS (SELECT r // 2 AS r, c // 2 AS c, max(z) AS z FROM dem GROUP BY ALL), fq AS (SELECT a.r, a.c, a.z AS e11, b.z AS e21, d.z AS e12, f.z AS e22 FROM far a JOIN far b ON b.r = a.r AND b.c = a.c + 1 JOIN far d ON d.r = a.r + 1 AND d.c = a.c JOIN far f ON f.r = a.r + 1 AND f.c = a.c + 1),
near AS (SELECT qr, qc, coalesce(arg_min(slope, d) FILTER (WHERE slope >= 0.3), max(slope)) AS slope, bool_or(slope >= 0.3) AS hit, max(d) AS exit_d FROM sl GROUP BY qr, qc),
go AS (SELECT near.*, dem.z AS qz, greatest(1.0, exit_d * 20 / 40) AS d0 FROM near JOIN dem ON dem.r = qr AND dem.c = qc WHERE NOT hit),
fs AS (SELECT qr, qc, qz, d0 + k * {STEP} AS d FROM go, (SELECT unnest(range(0, 40)) AS k) WHERE d0 + k * {STEP} <= 24.0), fx AS (SELECT *, qc / 2.0 + d * 0.8 AS x, qr / 2.0 + d * 0.6 AS y FROM fs),
fsl AS (SELECT qr, qc, d, ({bilerp()} - qz - (d * 40) * (d * 40) / (2 * 1737400.0)) / (d * 40) AS slope FROM fx JOIN fq ON r = trunc(y)::BIGINT AND c = trunc(x)::BIGINT),
fh AS (SELECT qr, qc, coalesce(arg_min(slope, d) FILTER (WHERE slope >= 0.3), max(slope)) AS slope FROM fsl GROUP BY qr, qc)
SELECT near.qr, near.qc, round(greatest(near.slope, coalesce(fh.slope, near.slope)), 6) AS slope, near.hit FROM near LEFT JOIN fh USING (qr, qc)""")
def _(spark, sf):
    """A ray that meets nothing in the near layer goes on in a coarser one, from where it left (the layers are joined by
    the ray's own keys; the larger slope wins)."""
    near = X.horizon(flat_samples(spark, sf, "qz"), ["qr", "qc", "qz"])
    cells = dem(spark, sf)
    far = cells.groupBy(F.expr("r div 2").alias("r"), F.expr("c div 2").alias("c")).agg(F.max("z").alias("z"))
    start = X.next_layer_start(F.col("exit_d"), 20.0, 40.0)
    rays = near.where(~F.col("hit")).select(F.col("qr").alias("kr"), F.col("qc").alias("kc"), "qz", start.alias("d0"), (F.col("qr") / 2).alias("qr"), (F.col("qc") / 2).alias("qc"), F.lit(0.8).alias("dc"), F.lit(0.6).alias("dr"), F.lit(0.3).alias("threshold"))
    samples = X.march(rays, quads(far), F.lit(24.0), F.col("d0"))
    sloped = samples.withColumn("slope", X.flat_slope(bilinear(F.col("x"), F.col("y")), F.col("qz"), F.col("d") * 40, 1737400.0))
    beyond = X.horizon(sloped.select("kr", "kc", "d", "slope", "threshold"), ["kr", "kc"]).select(F.col("kr").alias("qr"), F.col("kc").alias("qc"), F.col("slope").alias("far_slope"))
    return near.join(beyond.hint("merge"), ["qr", "qc"], "left").select("qr", "qc", F.round(F.greatest("slope", F.coalesce("far_slope", "slope")), 6).alias("slope"), "hit")


@query("j3_pyramid_bound", f"WITH {MARCH}, po AS (SELECT r // 2 AS r, c // 2 AS c, max(z) AS top FROM (SELECT dem.r - i AS r, dem.c - j AS c, z FROM dem, (SELECT unnest([0, 1, 2]) AS i), (SELECT unnest([0, 1, 2]) AS j)) WHERE r % 2 = 0 AND c % 2 = 0 AND r >= 0 AND c >= 0 GROUP BY ALL) SELECT count(*)::BIGINT AS n, count_if(e > top + 1e-9)::BIGINT AS broken FROM sm JOIN po ON po.r = sm.r // 2 AND po.c = sm.c // 2, (SELECT count(*) AS h FROM embeddings) WHERE sm.r // 2 < h // 2 AND sm.c // 2 < 32")
def _(spark, sf):
    """No sample rises over its cell of the maximum pyramid: what lets a march skip cells."""
    cells = dem(spark, sf)
    rays = cells.select(F.col("r").alias("qr"), F.col("c").alias("qc"), F.lit(0.8).alias("dc"), F.lit(0.6).alias("dr"))
    up = pool(cells, height(spark, sf), W).select(F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("vmax").alias("top"))
    # Each cell gets its bound before the march, so samples are not shuffled for it; it is not broadcast either.
    bounded = quads(cells).withColumns({"pr": F.shiftright("r", 1), "pc": F.shiftright("c", 1)}).join(up.hint("merge"), ["pr", "pc"]).drop("pr", "pc")
    samples = X.march(rays, bounded, F.lit(FAR)).select("top", bilinear(F.col("x"), F.col("y")).alias("e"))
    return samples.agg(F.count("*").alias("n"), F.count_if(F.col("e") > F.col("top") + 1e-9).alias("broken"))


@query("j1_frames", "WITH p AS (SELECT vec_id AS r FROM embeddings), f AS (SELECT unnest([1, 2, 3]) AS frame) SELECT r, frame FROM p, f")
def _(spark, sf):
    from lumenspark.plans.registry import table

    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("r")).crossJoin(F.broadcast(bodies(spark).select("frame")))
