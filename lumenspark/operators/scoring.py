"""Scoring of simulated against observed masks, and comparison of metric tables with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.operators.raster import erode, ssim

#: Whether a larger value of a metric is better (1) or worse (-1). Fixed values.
DIRECTIONS = {"pixel_agree": 1, "iou_shadow": 1, "iou_lit": 1, "missed_rate": -1, "over_rate": -1, "ber": -1, "ssim_binary": 1, "ssim_continuous": 1, "mse": -1, "rmse": -1, "mae": -1, "p99_abs_err": -1}
CORE = ("ber", "iou_shadow", "ssim_continuous", "mae", "p99_abs_err")
TOLERANCE = 1e-10


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def agreement(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, ratios and errors of pixels (obs 0, 255 or 128 for no data; frac observed; sim fraction)."""
    valid = (F.col("obs") != 128) & _finite(F.col("sim"))
    d = df.withColumns({"_v": valid, "_o": valid & (F.col("obs") == 255), "_s": valid & (F.col("sim") >= 0.5)})
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    v, o, s = F.col("_v"), F.col("_o"), F.col("_s")
    err = F.when(v & _finite(F.col("frac")), F.col("sim") - F.col("frac"))
    out = d.groupBy(*by).agg(
        n(v).alias("n_valid"), n(o & s).alias("agree_lit"), n(v & ~o & ~s).alias("agree_dark"), n(v & ~o & s).alias("missed"), n(o & ~s).alias("over"),
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("bias"), F.percentile(F.abs(err), F.lit(0.99)).alias("p99_abs_err"),
    )
    share = lambda a, b: F.col(a) / F.greatest(b, F.lit(1))
    c = F.col
    out = out.withColumns({
        "pixel_agree": (c("agree_lit") + c("agree_dark")) / F.greatest(c("n_valid"), F.lit(1)),
        "iou_shadow": share("agree_dark", c("agree_dark") + c("missed") + c("over")), "iou_lit": share("agree_lit", c("agree_lit") + c("missed") + c("over")),
        "missed_rate": share("missed", c("agree_dark") + c("missed")), "over_rate": share("over", c("agree_lit") + c("over")), "rmse": F.sqrt("mse"),
    })
    return out.withColumn("ber", 0.5 * (c("missed_rate") + c("over_rate")))


def similarity(df: DataFrame, height: int, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean structural similarity, binary and continuous, over cells three or more away from no data."""
    valid = (F.col("obs") != 128) & _finite(F.col("sim"))
    sim = F.when(_finite(F.col("sim")), F.col("sim")).otherwise(0.0)
    lit = (sim >= 0.5).cast("double")
    d = df.select(*by, "r", "c", valid.alias("m"), lit.alias("sb"), F.when(valid, (F.col("obs") == 255).cast("double")).otherwise(lit).alias("ob"), sim.alias("sc"), F.when(valid, F.col("frac")).otherwise(sim).alias("oc"))
    strict = erode(d.select(*by, "r", "c", "m"), "m", 3, by).where("m").select(*by, "r", "c")
    one = lambda a, b, name: ssim(d, a, b, height, width, by=by).withColumnRenamed("ssim", name)
    keys = [*by, "r", "c"]
    return strict.join(one("ob", "sb", "b"), keys).join(one("oc", "sc", "k"), keys).groupBy(*by).agg(F.count("*").alias("n_strict_valid"), F.avg("b").alias("ssim_binary"), F.avg("k").alias("ssim_continuous"))


def melt(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, value) rows."""
    return df.unpivot([key], metrics, "metric", "value")


def direction(metric: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in DIRECTIONS.items() for x in kv)), metric)


def classify(current: Column, baseline: Column, sign: Column) -> Column:
    """improvement, regression or unchanged; where one side is not finite, NaN on both sides is no change."""
    nan = lambda c: F.coalesce(F.isnan(c), F.lit(True))
    d = current - baseline
    return F.when(~_finite(current) | ~_finite(baseline), F.when(nan(current) == nan(baseline), "unchanged").otherwise("regression")).when(F.abs(d) <= TOLERANCE, "unchanged").when(d * sign > 0, "improvement").otherwise("regression")


def deltas(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, metric, baseline, current, delta, direction, classification). Both tables are (key, metric, value); a key of
    one side only raises when the row is computed."""
    b, c = baseline.withColumnRenamed("value", "baseline"), current.withColumnRenamed("value", "current")
    both = b.withColumn("_b", F.lit(True)).join(c.withColumn("_c", F.lit(True)), [key, "metric"], "full")
    checked = both.where(F.assert_true(F.col("_b") & F.col("_c"), F.lit("baseline and current rows do not match")).isNull())
    sign = direction(F.col("metric"))
    delta = F.when(_finite(F.col("baseline")) & _finite(F.col("current")), F.col("current") - F.col("baseline")).otherwise(F.lit(float("nan")))
    return checked.where(sign.isNotNull()).select(key, "metric", "baseline", "current", delta.alias("delta"), F.when(sign > 0, "higher_is_better").otherwise("lower_is_better").alias("direction"), classify(F.col("current"), F.col("baseline"), sign).alias("classification"))


def relative_improvement(current: Column, baseline: Column, sign: Column) -> Column:
    return F.when(~_finite(current) | ~_finite(baseline) | (baseline == 0), F.lit(float("nan"))).otherwise((current - baseline) * sign / F.abs(baseline))


def summaries(d: DataFrame) -> DataFrame:
    """Finite median and mean of each metric on both sides; NaN where no value is finite."""
    finite = lambda c: F.when(_finite(F.col(c)), F.col(c))
    both = d.groupBy("metric").agg(*(F.coalesce(f(finite(c)), F.lit(float("nan"))).alias(f"{n}_{c}") for n, f in (("median", F.median), ("mean", F.avg)) for c in ("baseline", "current")))
    return both.select("metric", F.explode(F.array(*(F.struct(F.lit(n).alias("summary"), F.col(f"{n}_baseline").alias("baseline"), F.col(f"{n}_current").alias("current")) for n in ("median", "mean")))).alias("s")).select("metric", "s.*")


def quality_score(summary: DataFrame) -> DataFrame:
    """Mean relative improvement of the core metrics' medians: one row."""
    sign = direction(F.col("metric"))
    gain = relative_improvement(F.col("current"), F.col("baseline"), sign)
    return summary.where((F.col("summary") == "median") & F.col("metric").isin(*CORE)).select(gain.alias("g")).where(~F.isnan("g")).agg(F.avg("g").alias("score"))
