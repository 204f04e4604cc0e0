"""Statistics of frames over time, and operators on their timestamps.

A frame table has a pixel key, a timestamp and encoded values. Runs are found by windows over one pixel's frames; pixels
are independent, so the only shuffle is by pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600.0


def _seconds(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def runs(df: DataFrame, inside: Column, pixel: str = "px", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(pixel, start, stop, hours) of each maximal run of frames that are ``inside``.

    A run ends at the first frame after it; one that reaches the last frame ends a step of the last two frames later.
    """
    w = Window.partitionBy(pixel).orderBy(*order)
    flagged = df.withColumn("_in", inside)
    flagged = flagged.withColumns({"_new": F.coalesce(F.col("_in") != F.lag("_in").over(w), F.lit(True)).cast("int"), "_next": F.lead("ts").over(w), "_before": F.lag("ts").over(w)})
    grouped = flagged.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # The run's last frame holds its end: the next frame's time, or its own plus the last step.
    stop = F.coalesce(F.max_by(F.when(F.col("_next").isNotNull(), F.col("_next")).otherwise(F.col("ts") + (F.col("ts") - F.coalesce("_before", "ts"))), F.struct(*order)), F.max("ts"))
    found = grouped.where("_in").groupBy(pixel, "_run").agg(F.min("ts").alias("start"), stop.alias("stop"))
    return found.select(pixel, "start", "stop", (_seconds(F.col("start"), F.col("stop")) / HOUR).alias("hours"))


def statistics(df: DataFrame, contact_at_least: int, pixel: str = "px", order: tuple[str, ...] = ("ts",), sun_at_least: int = 1) -> DataFrame:
    """Per pixel, lit from ``sun_at_least`` on: lit, contact and lit-and-contact per cent, mean sun per cent, longest shadow and outage in hours."""
    share = lambda c: 100 * F.avg(c.cast("int"))
    lit, contact = F.col("sun") >= sun_at_least, F.col("dsn") >= contact_at_least
    base = df.groupBy(pixel).agg(share(lit).alias("lit_percent"), (100 * F.avg(F.col("sun") / 255)).alias("mean_sun_percent"), share(contact).alias("contact_percent"), share(lit & contact).alias("lit_and_contact_percent"))
    longest = lambda c, name: runs(df, c, pixel, order).groupBy(pixel).agg(F.max("hours").alias(name))
    out = base.join(longest(~lit, "longest_shadow_hours"), pixel, "left").join(longest(~contact, "longest_outage_hours"), pixel, "left")
    return out.fillna(0.0, ["longest_shadow_hours", "longest_outage_hours"])


def strided(df: DataFrame, stride: int, order: list[str]) -> DataFrame:
    """Every stride-th frame of the distinct times: frames are numbered by the small table of times, not by pixel."""
    times = df.select(*order).distinct()
    kept = times.withColumn("_n", F.row_number().over(Window.orderBy(*order))).where((F.col("_n") - 1) % stride == 0).drop("_n")
    return df.join(kept, order, "left_semi")


def worker_of(order: list[str], workers: int) -> Column:
    """Round-robin worker of each frame in time order."""
    return ((F.row_number().over(Window.orderBy(*order)) - 1) % workers).cast("int")


def regular_steps(times: DataFrame, column: str = "ts") -> DataFrame:
    """One row: number of distinct steps between consecutive times, and whether they are regular."""
    w = Window.orderBy(column)
    step = times.select(_seconds(F.lag(column).over(w), F.col(column)).alias("s")).where("s is not null")
    return step.agg(F.countDistinct("s").alias("steps")).select("steps", (F.col("steps") <= 1).alias("regular"))


def time_range(spark, start: str, stop: str, step_seconds: int) -> DataFrame:
    """Times from start to stop, both included where the steps meet it."""
    return spark.range(1).select(F.explode(F.sequence(F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(stop)), F.make_dt_interval(secs=F.lit(step_seconds)))).alias("ts"))


def tag(ts: Column) -> Column:
    """File tag of a time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")


def time_of_tag(path: Column, kind: str) -> Column:
    """Time in a frame's file name, null where the name is another."""
    found = F.regexp_extract(path, rf"(?:^|/){kind}\.(\d{{4}}-\d\d-\d\dT\d\d-\d\d-\d\d)\.png$", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy-MM-dd'T'HH-mm-ss")).cast("timestamp_ntz")


def period_seconds(text: Column) -> Column:
    """Seconds of a period: HH:MM:SS, or a number with s, m, h or d; null for anything else."""
    clock = r"^(\d+):(\d\d):(\d\d)$"
    unit = F.regexp_extract(text, r"^(\d+)([smhd])$", 2)
    n = F.regexp_extract(text, r"^(\d+)([smhd])$", 1).try_cast("long")
    factor = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    part = lambda i: F.regexp_extract(text, clock, i).try_cast("long")
    return F.when(text.rlike(clock), part(1) * 3600 + part(2) * 60 + part(3)).otherwise(n * factor).cast("long")


def clock_text(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds; of 100 hours or more the first two digits stay, as in the SQL twin."""
    s = seconds.cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def resume(expected: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """What is expected and does not exist yet."""
    return expected.join(existing.select(*keys).distinct(), keys, "left_anti")


def decimated(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Least and greatest value of each plot column."""
    return df.groupBy(F.floor(x).alias("x")).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
