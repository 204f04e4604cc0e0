"""Projections and scalar geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspark.functions import geometry as G
from lumenspark.plans.registry import BODIES, DEM, FRAMES, bodies, cell_columns, dem, frames, query, table

GRID = G.Grid(31.5, 249.5, 0.02)

PLANE = f"WITH {DEM}, g AS (SELECT r, c, z, (c - 31.5) * 0.02 AS e, (249.5 - r) * 0.02 AS n FROM dem), u AS (SELECT *, sqrt(e * e + n * n) AS rho FROM g), w AS (SELECT *, rho / (2 * 1737.4) AS u, 1737.4 + z / 1000 AS t FROM u)"
XYZ = "t / (1737.4 * (1 + u * u)) * n AS x, t / (1737.4 * (1 + u * u)) * e AS y, t * (u * u - 1) / (1 + u * u) AS zz"


def rounded(digits: int = 6, **columns):
    return [F.round(c, digits).alias(n) for n, c in columns.items()]


@query("p1_stereo_to_body", f"{PLANE} SELECT r, c, round(x, 6) AS x, round(y, 6) AS y, round(zz, 6) AS z FROM (SELECT *, {XYZ} FROM w)")
def _(spark, sf):
    C, R, Z = cell_columns()
    v = G.stereo_to_body(C, R, Z, GRID)
    return dem(spark, sf).select("r", "c", *rounded(x=v.x, y=v.y, z=v.z))


@query("p2_query_setup", f"""{PLANE}, b AS (SELECT *, 2 * u / (1 + u * u) AS cl, (u * u - 1) / (1 + u * u) AS sl, n / rho AS co, e / rho AS so, {XYZ} FROM w)
SELECT r, c, round(sl * co, 9) AS m11, round(sl * so, 9) AS m12, round(-cl, 9) AS m13, round(-so, 9) AS m21, round(co, 9) AS m22, round(cl * co, 9) AS m31, round(cl * so, 9) AS m32, round(sl, 9) AS m33, round(rho, 9) AS rho FROM b""")
def _(spark, sf):
    C, R, _ = cell_columns()
    s, e, u, rho = G.enu_basis(C, R, GRID)
    return dem(spark, sf).select("r", "c", *rounded(9, m11=s.x, m12=s.y, m13=s.z, m21=e.x, m22=e.y, m31=u.x, m32=u.y, m33=u.z, rho=rho))


@query("p3_rootless_setup", f"{PLANE}, q AS (SELECT *, rho * rho / (4 * 1737.4 * 1737.4) AS k FROM w) SELECT r, c, round(n / (1737.4 * (1 + k)), 9) AS m31, round(e / (1737.4 * (1 + k)), 9) AS m32, round((k - 1) / (1 + k), 9) AS m33, round(t * 2 * k / (1 + k), 9) AS depth FROM q")
def _(spark, sf):
    C, R, Z = cell_columns()
    u, depth = G.up_and_depth(C, R, Z, GRID)
    return dem(spark, sf).select("r", "c", *rounded(9, m31=u.x, m32=u.y, m33=u.z, depth=depth))


def _direction_sql(p: str) -> str:
    return f"""(d.{p}x * sl * co + d.{p}y * sl * so - d.{p}z * cl) AS {p}s, (-d.{p}x * so + d.{p}y * co) AS {p}t, (d.{p}x * cl * co + d.{p}y * cl * so + d.{p}z * sl) - 0.002 AS {p}u"""


@query("p4_directions", f"""{PLANE}, {BODIES}, b AS (SELECT *, 2 * u / (1 + u * u) AS cl, (u * u - 1) / (1 + u * u) AS sl, n / rho AS co, e / rho AS so, {XYZ} FROM w),
d AS (SELECT b.*, bo.frame, sx - x AS sx, sy - y AS sy, sz - zz AS sz, ex - x AS ex, ey - y AS ey, ez - zz AS ez FROM b, bo),
h AS (SELECT r, c, frame, e, n, rho, {_direction_sql('s')}, {_direction_sql('e')} FROM d)
SELECT r, c, frame, round((-ss * e / rho + st * n / rho) / sqrt(ss * ss + st * st), 6) AS sun_cos, round(-(-ss * n / rho - st * e / rho) / sqrt(ss * ss + st * st), 6) AS sun_sin, round(degrees(atan2(su, sqrt(ss * ss + st * st))), 6) AS sun_el,
round((-es * e / rho + et * n / rho) / sqrt(es * es + et * et), 6) AS earth_cos, round(-(-es * n / rho - et * e / rho) / sqrt(es * es + et * et), 6) AS earth_sin, round(degrees(atan2(eu, sqrt(es * es + et * et))), 6) AS earth_el FROM h""")
def _(spark, sf):
    """J1: pixels x frames; bodies are three rows."""
    C, R, Z = cell_columns()
    d = dem(spark, sf).crossJoin(F.broadcast(bodies(spark)))
    s = G.grid_direction(C, R, Z, G.Vector.of(F.col("sx"), F.col("sy"), F.col("sz")), GRID, 2.0)
    e = G.grid_direction(C, R, Z, G.Vector.of(F.col("ex"), F.col("ey"), F.col("ez")), GRID, 2.0)
    return d.select("r", "c", "frame", *rounded(sun_cos=s[0], sun_sin=s[1], sun_el=s[2], earth_cos=e[0], earth_sin=e[1], earth_el=e[2]))


PLACES = "pl AS (SELECT s_suppkey AS id, -89.9 + (s_suppkey % 300) / 20.0::DOUBLE AS lat, (s_suppkey * 37 % 3600) / 10.0::DOUBLE AS lon, s_acctbal / 10 AS el FROM supplier)"


def places(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), (-89.9 + (k % 300) / F.lit(20.0)).alias("lat"), ((k * 37 % 3600) / F.lit(10.0)).alias("lon"), (F.col("s_acctbal") / 10).alias("el"))




@query("p7_to_local", f"""WITH {PLACES}, v AS (SELECT id, radians(lat) AS a, radians(lon) AS o, (1737.4 + el / 1000) * cos(radians(lat)) * cos(radians(lon)) AS x, (1737.4 + el / 1000) * cos(radians(lat)) * sin(radians(lon)) AS y, (1737.4 + el / 1000) * sin(radians(lat)) AS z, radians(-85.0) AS a0, radians(30.0) AS o0 FROM pl)
SELECT id, round(-sin(a0) * cos(o0) * x - sin(a0) * sin(o0) * y + cos(a0) * z, 6) AS north, round(-sin(o0) * x + cos(o0) * y, 6) AS east, round(-(cos(a0) * cos(o0) * x + cos(a0) * sin(o0) * y + sin(a0) * z), 6) AS down FROM v""")
def _(spark, sf):
    LAT, LON, EL = F.col("lat"), F.col("lon"), F.col("el")
    v = G.rotate_to_local(G.latlon_to_body(LAT, LON, EL), F.lit(-85.0), F.lit(30.0))
    return places(spark, sf).select("id", *rounded(north=v.x, east=v.y, down=v.z))


@query("p8_from_local", f"WITH {PLACES} SELECT id, round((1737.4 + el / 1000) * cos(radians(lat)) * cos(radians(lon)), 6) AS x, round((1737.4 + el / 1000) * cos(radians(lat)) * sin(radians(lon)), 6) AS y, round((1737.4 + el / 1000) * sin(radians(lat)), 6) AS z FROM pl")
def _(spark, sf):
    """There and back again gives the position itself."""
    LAT, LON, EL = F.col("lat"), F.col("lon"), F.col("el")
    there = G.rotate_to_local(G.latlon_to_body(LAT, LON, EL), F.lit(-85.0), F.lit(30.0))
    v = G.rotate_from_local(there, F.lit(-85.0), F.lit(30.0))
    return places(spark, sf).select("id", *rounded(x=v.x, y=v.y, z=v.z))


@query("p9_body_to_pixel", f"{PLANE} SELECT r, c, round(c::DOUBLE, 5) AS col, round(r::DOUBLE, 5) AS row FROM w")
def _(spark, sf):
    """Projecting and un-projecting any elevation gives the pixel itself."""
    C, R, Z = cell_columns()
    col, row = G.body_to_stereo(G.stereo_to_body(C, R, Z, GRID), GRID)
    return dem(spark, sf).select("r", "c", *rounded(5, col=col, row=row))


@query("p10_hand_off", f"{PLANE} SELECT r, c, round(((c - 31.5) * 0.02) / 0.1 + 20, 6) AS far_col, round(40 - ((249.5 - r) * 0.02) / 0.1, 6) AS far_row FROM w")
def _(spark, sf):
    """The datum position (elevation 0), not the elevated one, is projected into the coarser layer."""
    C, R, _ = cell_columns()
    col, row = G.body_to_stereo(G.stereo_to_body(C, R, F.lit(0.0), GRID), G.Grid(20.0, 40.0, 0.1))
    return dem(spark, sf).select("r", "c", *rounded(far_col=col, far_row=row))


def _azel_sql(p: str, out: str) -> str:
    return f"round(degrees(atan2({p}n, {p}e)) - 360 * floor(degrees(atan2({p}n, {p}e)) / 360), 6) AS {out}_az, round(degrees(atan2({p}u, sqrt({p}e * {p}e + {p}n * {p}n))), 6) AS {out}_el"


def _enu_sql(p: str) -> str:
    return f"-sin(o) * ({p}x - x) + cos(o) * ({p}y - y) AS {p}e, -sin(a) * cos(o) * ({p}x - x) - sin(a) * sin(o) * ({p}y - y) + cos(a) * ({p}z - z) AS {p}n, cos(a) * cos(o) * ({p}x - x) + cos(a) * sin(o) * ({p}y - y) + sin(a) * ({p}z - z) AS {p}u, sqrt(({p}x - x) ** 2 + ({p}y - y) ** 2 + ({p}z - z) ** 2) AS {p}d"


@query("p11_azel_series", f"""WITH {PLACES}, {BODIES}, v AS (SELECT id, radians(lat) AS a, radians(lon) AS o, (1737.4 + el / 1000) * cos(radians(lat)) * cos(radians(lon)) AS x, (1737.4 + el / 1000) * cos(radians(lat)) * sin(radians(lon)) AS y, (1737.4 + el / 1000) * sin(radians(lat)) AS z FROM pl),
q AS (SELECT id, frame, {_enu_sql('s')}, {_enu_sql('e').replace('ex', 'bo.ex').replace(' AS bo.ex', ' AS ex')} FROM v, bo)
SELECT id, frame, {_azel_sql('s', 'sun')}, {_azel_sql('e', 'earth')}, round(sd, 3) AS sun_km, round(sd / 149597870.7, 9) AS sun_au, round(2 * degrees(asin(695700.0 / sd)), 9) AS sun_diameter, round(2 * degrees(asin(6371.0008 / ed)), 9) AS earth_diameter FROM q""")
def _(spark, sf):
    LAT, LON, EL = F.col("lat"), F.col("lon"), F.col("el")
    d = places(spark, sf).crossJoin(F.broadcast(bodies(spark)))
    here = G.latlon_to_body(LAT, LON, EL)
    s = G.azimuth_elevation(here, LAT, LON, G.Vector(F.col("sx"), F.col("sy"), F.col("sz")))
    e = G.azimuth_elevation(here, LAT, LON, G.Vector(F.col("ex"), F.col("ey"), F.col("ez")))
    return d.select("id", "frame", *rounded(sun_az=s[0], sun_el=s[1], earth_az=e[0], earth_el=e[1]), F.round(s[2], 3).alias("sun_km"), *rounded(9, sun_au=s[2] / G.AU_KM, sun_diameter=G.angular_diameter(G.SUN_RADIUS_KM, s[2]), earth_diameter=G.angular_diameter(G.EARTH_RADIUS_KM, e[2])))


@query("p12_latlon_to_pixel", f"WITH {PLACES}, q AS (SELECT *, 2 * 1737.4 * tan((radians(lat) + pi() / 2) / 2) AS rho FROM pl) SELECT id, round(31.5 + rho * sin(radians(lon)) / 0.02, 4) AS col, round(249.5 - rho * cos(radians(lon)) / 0.02, 4) AS row FROM q")
def _(spark, sf):
    LAT, LON = F.col("lat"), F.col("lon")
    col, row = G.latlon_to_pixel(LAT, LON, GRID)
    return places(spark, sf).select("id", *rounded(4, col=col, row=row))


@query("p13_pixel_to_latlon", f"{PLANE} SELECT r, c, round(degrees(2 * atan(rho / (2 * 1737.4))) - 90, 8) AS lat, round(degrees(atan2(e, n)) - 360 * floor(degrees(atan2(e, n)) / 360), 8) AS lon, round(e * 1000, 6) AS x_m, round(n * 1000, 6) AS y_m FROM w")
def _(spark, sf):
    C, R, _ = cell_columns()
    lat, lon = G.pixel_to_latlon(C, R, GRID)
    e, n = G.plane(C, R, GRID)
    return dem(spark, sf).select("r", "c", *rounded(8, lat=lat, lon=lon), *rounded(x_m=e * 1000, y_m=n * 1000))


@query("p15_body_to_latlon", f"WITH {PLACES} SELECT id, round(lat, 8) AS lat, round(lon, 8) AS lon, round(el, 4) AS el FROM pl")
def _(spark, sf):
    LAT, LON, EL = F.col("lat"), F.col("lon"), F.col("el")
    lat, lon, el = G.body_to_latlon(G.latlon_to_body(LAT, LON, EL))
    return places(spark, sf).select("id", *rounded(8, lat=lat, lon=F.pmod(F.round(lon, 8), F.lit(360.0))), F.round(el, 4).alias("el"))


@query("p16_nearest_pixel", f"WITH {DEM}, q AS (SELECT r, c, c + round(z, 1) / 10 AS x FROM dem) SELECT r, c, floor(x + 0.5)::BIGINT AS nearest FROM q WHERE x >= -0.5 AND x < 63.5")
def _(spark, sf):
    C, _, Z = cell_columns()
    x = C + F.round(Z, 1) / 10
    return dem(spark, sf).where((x >= -0.5) & (x < 63.5)).select("r", "c", G.nearest_pixel(x).alias("nearest"))


@query("p17_outline", f"""WITH {PLACES}, k AS (SELECT unnest(range(24))::DOUBLE / 24 AS t, generate_subscripts(range(24), 1) - 1 AS i), s AS (SELECT unnest([0, 1, 2, 3]) AS side),
q AS (SELECT side, i, CASE side WHEN 0 THEN t WHEN 1 THEN 1.0 WHEN 2 THEN 1 - t ELSE 0.0 END * 63 AS c, CASE side WHEN 0 THEN 0.0 WHEN 1 THEN t WHEN 2 THEN 1.0 ELSE 1 - t END * 499 AS r FROM s, k)
SELECT side, i::BIGINT AS i, round(((c - 31.5) * 0.02) / 0.1 + 20, 6) AS col, round(40 - ((249.5 - r) * 0.02) / 0.1, 6) AS row FROM q""")
def _(spark, sf):
    """A grid's outline, 24 samples an edge, in another grid's pixels."""
    t = F.col("i") / F.lit(24.0)
    edge = spark.range(4).select(F.col("id").cast("int").alias("side")).select("side", F.explode(F.expr("sequence(0L, 23L)")).alias("i"))
    c = F.when(F.col("side") == 0, t).when(F.col("side") == 1, 1.0).when(F.col("side") == 2, 1 - t).otherwise(0.0) * 63
    r = F.when(F.col("side") == 0, 0.0).when(F.col("side") == 1, t).when(F.col("side") == 2, 1.0).otherwise(1 - t) * 499
    lat, lon = G.pixel_to_latlon(c, r, GRID)
    col, row = G.latlon_to_pixel(lat, lon, G.Grid(20.0, 40.0, 0.1))
    return edge.select("side", "i", *rounded(6, col=col, row=row))


@query("p18_radius_window", f"WITH {PLACES}, q AS (SELECT *, 2 * 1737.4 * tan((radians(lat) + pi() / 2) / 2) AS rho FROM pl) SELECT id, round_even(31.5 + rho * sin(radians(lon)) / 0.02, 0)::BIGINT - 25 AS col0, round_even(249.5 - rho * cos(radians(lon)) / 0.02, 0)::BIGINT - 25 AS row0, 51::BIGINT AS size FROM q")
def _(spark, sf):
    """The window of a radius of 500 m."""
    LAT, LON = F.col("lat"), F.col("lon")
    col, row = G.latlon_to_pixel(LAT, LON, GRID)
    half = 25
    return places(spark, sf).select("id", (F.bround(col, 0).cast("long") - half).alias("col0"), (F.bround(row, 0).cast("long") - half).alias("row0"), F.lit(2 * half + 1).cast("long").alias("size"))


@query("p21_encode", f"WITH {DEM} SELECT r, c, least(greatest(floor(255 * (z / 20)), 0), 255)::BIGINT AS sun, least(greatest(floor(z * 10), 0), 250)::BIGINT AS dsn FROM dem")
def _(spark, sf):
    _, _, Z = cell_columns()
    return dem(spark, sf).select("r", "c", G.encode_sun(Z / 20).alias("sun"), G.encode_contact(Z).alias("dsn"))


@query("p22_decode", f"WITH {FRAMES} SELECT event_id, round(100 * sun / 255.0::DOUBLE, 2) AS sun_percent, dsn / 10.0::DOUBLE AS dsn_deg, round(sun / 255.0::DOUBLE, 6) AS fraction FROM fr")
def _(spark, sf):
    return frames(spark, sf).select("event_id", G.sun_percent(F.col("sun")).alias("sun_percent"), G.contact_degrees(F.col("dsn")).alias("dsn_deg"), F.round(F.col("sun") / 255, 6).alias("fraction"))


@query("p23_palette", f"WITH {FRAMES}, pal AS (SELECT * FROM (VALUES (0, 0, 'none'), (1, 20, 'low'), (21, 70, 'fair'), (71, 250, 'clear')) t(lo, hi, band)) SELECT event_id, band FROM fr JOIN pal ON dsn BETWEEN lo AND hi")
def _(spark, sf):
    """Bands of contact elevation: a range join with a table of four rows."""
    bands = spark.createDataFrame([(0, 0, "none"), (1, 20, "low"), (21, 70, "fair"), (71, 250, "clear")], "lo int, hi int, band string")
    return frames(spark, sf).join(F.broadcast(bands), F.col("dsn").between(F.col("lo"), F.col("hi"))).select("event_id", "band")


@query("p24_contact_category", f"WITH {FRAMES} SELECT event_id, ((sun > 0)::INT + 2 * (dsn >= 20)::INT)::BIGINT AS category FROM fr")
def _(spark, sf):
    return frames(spark, sf).select("event_id", G.contact_category(F.col("sun"), F.col("dsn"), 20).alias("category"))


@query("p25_describe", f"WITH {FRAMES} SELECT event_id, format('{{:.1f}} % of the Sun', round(100 * sun / 255.0::DOUBLE, 1)) AS sun_text, format('{{:.1f}} deg', dsn / 10.0::DOUBLE) AS dsn_text FROM fr")
def _(spark, sf):
    return frames(spark, sf).select("event_id", F.format_string("%.1f %% of the Sun", F.round(100 * F.col("sun") / 255, 1)).alias("sun_text"), F.format_string("%.1f deg", F.col("dsn") / 10).alias("dsn_text"))


@query("p26_ramp", f"WITH {DEM}, m AS (SELECT max(abs(z)) AS lim FROM dem) SELECT r, c, floor(255 * (1 - greatest(0, -z / lim)))::BIGINT AS green, floor(255 * (1 - abs(z) / lim))::BIGINT AS blue FROM dem, m")
def _(spark, sf):
    """A diverging ramp: white at 0, full colour at the largest magnitude."""
    _, _, Z = cell_columns()
    d = dem(spark, sf)
    d = d.crossJoin(F.broadcast(d.agg(F.max(F.abs(Z)).alias("lim"))))  # one row
    return d.select("r", "c", F.floor(255 * (1 - F.greatest(F.lit(0.0), -Z / F.col("lim")))).alias("green"), F.floor(255 * (1 - F.abs(Z) / F.col("lim"))).alias("blue"))
