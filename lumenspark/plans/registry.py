"""Names of queries, their functions, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Terrain and frames as the star schema holds them: a vector is a raster row; a user is a pixel.
DEM = "dem AS (SELECT vec_id AS r, (generate_subscripts(embedding, 1) - 1)::BIGINT AS c, 100 * unnest(embedding)::DOUBLE AS z FROM embeddings)"
FRAMES = "fr AS (SELECT user_id AS px, ts, event_id, least(255, floor(value))::BIGINT AS sun, least(250, floor(value / 2))::BIGINT AS dsn FROM events)"
BODIES = "bo AS (SELECT * FROM (VALUES (1, 100000000.0::DOUBLE, 90000000.0::DOUBLE, -3000000.0::DOUBLE, 350000.0::DOUBLE, 120000.0::DOUBLE, -30000.0::DOUBLE), (2, -120000000.0, 60000000.0, -1000000.0, 360000.0, -90000.0, 20000.0), (3, 1000000.0, -148000000.0, 5000000.0, 340000.0, 10000.0, -80000.0)) t(frame, sx, sy, sz, ex, ey, ez))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, z): elevation cells in metres."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "v")).select("r", F.col("c").cast("long").alias("c"), (100 * F.col("v").cast("double")).alias("z"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(px, ts, event_id, sun, dsn): encoded frames of pixels over time."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("px"), "ts", "event_id", F.least(F.lit(255), F.floor("value")).cast("long").alias("sun"), F.least(F.lit(250), F.floor(F.col("value") / 2)).cast("long").alias("dsn"))


def bodies(spark: SparkSession) -> DataFrame:
    """Sun and Earth of three frames, in km."""
    rows = [(1, 1e8, 9e7, -3e6, 350000.0, 120000.0, -30000.0), (2, -1.2e8, 6e7, -1e6, 360000.0, -90000.0, 20000.0), (3, 1e6, -1.48e8, 5e6, 340000.0, 10000.0, -80000.0)]
    return spark.createDataFrame(rows, "frame int, sx double, sy double, sz double, ex double, ey double, ez double")


def cell_columns():
    """Column, row and elevation of a cell, as doubles."""
    return F.col("c").cast("double"), F.col("r").cast("double"), F.col("z")
