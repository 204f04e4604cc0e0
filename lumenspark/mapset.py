"""Renders over many times: mapsets, light curves and azimuth series, as lazily planned DataFrames.

A mapset is a table (ts, r, c, sun, dsn): pixels x times x rays x steps, partitioned by time and tile. What a folder already
holds is left out by an anti-join on time; nothing is shared between times but the terrain's quad table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.functions import geometry as G
from lumenspark.operators import raycast as X
from lumenspark.operators.frames import resume
from lumenspark.operators.raster import crop, quads, tile_of
from lumenspark.sources.ephemeris import at_times, require_positions


@dataclass(frozen=True)
class Terrain:
    """A raster of elevations in metres and its grid. With its size known, small rasters are marched as arrays."""

    cells: DataFrame
    grid: G.Grid
    height: int = 0
    width: int = 0


def directed(pixels: DataFrame, bodies: DataFrame, grid: G.Grid, observer_m: float) -> DataFrame:
    """Pixels (qr, qc, z) x times (ts, sx .. ez) with the directions and elevations of both bodies. The times are the small
    side; Spark broadcasts them if they are small enough."""
    c, r, z = F.col("qc").cast("double"), F.col("qr").cast("double"), F.col("z")
    both = pixels.crossJoin(bodies)
    of = lambda p: G.grid_direction(c, r, z, G.Vector(*(F.col(f"{p}{i}") for i in "xyz")), grid, observer_m)
    s, e = of("s"), of("e")
    return both.select("ts", "qr", "qc", "z", s[0].alias("sun_cos"), s[1].alias("sun_sin"), s[2].alias("sun_el"), e[0].alias("earth_cos"), e[1].alias("earth_sin"), e[2].alias("earth_el"))


def render(terrain: Terrain, ephemeris: DataFrame, times: DataFrame, window: tuple[int, int, int, int] | None = None, observer_m: float = 2.0, max_pixels: float = X.HARD_CAP, cutoff: bool = False, tile: int = 256, farther: tuple[Terrain, ...] = ()) -> DataFrame:
    """Frames (ts, r, c, sun, dsn) over a window (row, column, height, width) of the terrain.

    ``farther``: one or two coarser terrains, near to far, in which rays go on that met nothing.
    ``cutoff``: terrain outside the window casts no shadow; else the window restricts the output only.
    """
    cells = terrain.cells
    r0, c0 = (window or (0, 0, 0, 0))[:2]
    out = crop(cells, *window).withColumns({"r": F.col("r") + r0, "c": F.col("c") + c0}) if window else cells
    ground = out if cutoff else cells
    pixels = out.select(F.col("r").alias("qr"), F.col("c").alias("qc"), "z", *tile_of(tile, tile)).repartition("tr", "tc").drop("tr", "tc")
    facing = directed(pixels, at_times(times, ephemeris), terrain.grid, observer_m)
    found = X.illuminate(facing, quads(ground), terrain.grid, observer_m, max_pixels, ("ts", "qr", "qc"), tuple((quads(t.cells), t.grid, max_pixels) for t in farther), (ground, terrain.height, terrain.width) if terrain.height else None)
    return found.select("ts", (F.col("qr") - r0).alias("r"), (F.col("qc") - c0).alias("c"), "sun", "dsn")


def generate(terrain: Terrain, ephemeris: DataFrame, times: DataFrame, folder: str, **options) -> DataFrame:
    """Renders the times that ``folder`` does not hold yet and returns all of it. One Parquet partition a time."""
    spark = times.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    # A folder that is there but cannot be read is an error, not an empty one.
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        there = spark.read.parquet(folder).select("ts").distinct()
        times = resume(times, there.select(F.col("ts").cast("timestamp_ntz").alias("ts")), ["ts"])
    require_positions(times, ephemeris)
    render(terrain, ephemeris, times, **options).write.mode("append").partitionBy("ts").parquet(folder)
    return spark.read.parquet(folder)


def light_curve(terrain: Terrain, ephemeris: DataFrame, times: DataFrame, row: int, col: int, observer_m: float = 2.0, max_pixels: float = X.HARD_CAP) -> DataFrame:
    """One pixel over all times, over the whole terrain: time, place, sun byte and share, azimuth and elevation."""
    frames = render(terrain, ephemeris, times, (row, col, 1, 1), observer_m, max_pixels)
    g = terrain.grid
    lat, lon = G.pixel_to_latlon(F.lit(float(col)), F.lit(float(row)), g)
    e, n = G.plane(F.lit(float(col)), F.lit(float(row)), g)
    ground = terrain.cells.where((F.col("r") == row) & (F.col("c") == col)).select("z")
    placed = frames.crossJoin(ground).join(at_times(times, ephemeris), "ts")
    seen = G.azimuth_elevation(G.latlon_to_body(lat, lon, F.col("z") + observer_m), lat, lon, G.Vector(F.col("sx"), F.col("sy"), F.col("sz")))
    return placed.select(
        F.col("ts").alias("time_utc"), F.lit(row).alias("row"), F.lit(col).alias("col"), lat.alias("latitude_deg"), lon.alias("longitude_deg"), (e * 1000).alias("x_m"), (n * 1000).alias("y_m"),
        F.col("z").alias("terrain_elevation_m"), F.lit(observer_m).alias("observer_height_m"), F.col("sun").alias("sun_u8"), (F.col("sun") / 255).alias("sun_fraction"), seen[0].alias("sun_azimuth_deg"), seen[1].alias("sun_elevation_deg"),
    ).orderBy("time_utc")


def azel_series(times: DataFrame, ephemeris: DataFrame, lat: float, lon: float, elevation_m: float = 0.0) -> DataFrame:
    """Azimuths, elevations, distance and angular diameters of Sun and Earth from a place, without terrain."""
    la, lo = F.lit(lat), F.lit(lon)
    here = G.latlon_to_body(la, lo, F.lit(elevation_m))
    both = at_times(times, ephemeris)
    s, e = (G.azimuth_elevation(here, la, lo, G.Vector(*(F.col(f"{p}{i}") for i in "xyz"))) for p in "se")
    return both.select(
        F.col("ts").alias("time"), s[0].alias("rover_to_sun_azimuth_deg"), s[1].alias("rover_to_sun_elevation_deg"), e[0].alias("rover_to_earth_azimuth_deg"), e[1].alias("rover_to_earth_elevation_deg"),
        s[2].alias("rover_to_sun_dist_km"), (s[2] / G.AU_KM).alias("rover_to_sun_dist_au"), G.angular_diameter(G.SUN_RADIUS_KM, s[2]).alias("sun_angular_diameter_deg"), G.angular_diameter(G.EARTH_RADIUS_KM, e[2]).alias("earth_angular_diameter_deg"),
    ).orderBy("time")
