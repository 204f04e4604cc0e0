"""Horizon masks of ground stations: elevation limits by azimuth, and visibility above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_masks(spark: SparkSession, folder: str) -> DataFrame:
    """(station, link, az_deg, el_deg): files ``<station>_<link>.txt`` with one elevation a degree of azimuth, clockwise
    from north, 0 to 360."""
    lines = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_name"), r"\."), 1).alias("name"), F.split("value", r"\s+").alias("v"))
    numbers = lines.select("name", F.filter(F.transform("v", lambda x: x.try_cast("double")), lambda x: x.isNotNull()).alias("v"))
    station = F.regexp_extract("name", r"^(.*)_([^_]+)$", 1)
    return numbers.select(station.alias("station"), F.regexp_extract("name", r"^(.*)_([^_]+)$", 2).alias("link"), F.posexplode("v").alias("az_deg", "el_deg"))


def above_mask(df: DataFrame, masks: DataFrame, azimuth: Column, elevation: Column) -> DataFrame:
    """Adds ``visible``: the elevation lies above the station's mask, interpolated between whole degrees. ``df`` has
    station and link; azimuths run clockwise from north."""
    az = F.pmod(azimuth, F.lit(360.0))
    low = df.withColumns({"_a": F.floor(az).cast("int"), "_f": az - F.floor(az), "_e": elevation})
    m = masks.select("station", "link", F.col("az_deg").alias("_a"), F.col("el_deg").alias("_lo"))
    n = masks.select("station", "link", (F.col("az_deg") - 1).alias("_a"), F.col("el_deg").alias("_hi"))
    both = low.join(m, ["station", "link", "_a"]).join(n, ["station", "link", "_a"])
    return both.withColumn("visible", F.col("_e") > F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))).drop("_a", "_f", "_e", "_lo", "_hi")
