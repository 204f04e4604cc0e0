"""Raster algebra on cell tables (r, c, z): 0-based integer row and column, and a value.

Neighbourhoods are windows along one axis at a time, partitioned by the other axis, so a raster of H x W cells splits into
H or W independent parts. Rasters with several layers or frames pass their keys in ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crop(df: DataFrame, row0: int, col0: int, height: int, width: int) -> DataFrame:
    """The window's cells, re-based to its corner. The filters reach the scan."""
    inside = df.where((F.col("r") >= row0) & (F.col("r") < row0 + height) & (F.col("c") >= col0) & (F.col("c") < col0 + width))
    return inside.withColumns({"r": F.col("r") - row0, "c": F.col("c") - col0})


def overview(df: DataFrame, factor: int) -> DataFrame:
    """Every factor-th cell; values that are not finite or beyond 1e6 become NaN."""
    kept = df.where((F.col("r") % factor == 0) & (F.col("c") % factor == 0))
    z = F.col("z")
    return kept.select(F.expr(f"r div {factor}").alias("r"), F.expr(f"c div {factor}").alias("c"), F.when(z.isNull() | F.isnan(z) | (F.abs(z) > 1e6), F.lit(float("nan"))).otherwise(z).alias("z"))


def tile_of(height: int, width: int) -> list[Column]:
    """Tile row and column of a cell: partitioning keys of a render."""
    return [F.expr(f"r div {height}").alias("tr"), F.expr(f"c div {width}").alias("tc")]


def pool(df: DataFrame, height: int, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Next pyramid level: vmax and vmin over each parent's 3 x 3 cells (2 x 2 and one more on the far sides).

    Each cell is sent to its (at most four) parents and pre-aggregated there; no self-join.
    """
    parents = lambda x: F.expr(f"filter(array({x} div 2, if({x} % 2 = 0, {x} div 2 - 1, null)), p -> p is not null and p >= 0)")
    up = df.withColumn("pr", F.explode(parents("r"))).withColumn("pc", F.explode(parents("c"))).where((F.col("pr") < height // 2) & (F.col("pc") < width // 2))
    return up.groupBy(*by, F.col("pr").alias("r"), F.col("pc").alias("c")).agg(F.max("z").alias("vmax"), F.min("z").alias("vmin"))


def _along(axis: str, by: tuple[str, ...] = ()) -> Window:
    other = "r" if axis == "c" else "c"
    return Window.partitionBy(*by, other).orderBy(axis)


def quads(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(r, c, e11, e21, e12, e22): each cell with its right, lower and diagonal neighbours; cells without them go."""
    wide = df.withColumn("_right", F.lead("z").over(_along("c", by)))
    low = wide.withColumns({"e12": F.lead("z").over(_along("r", by)), "e22": F.lead("_right").over(_along("r", by))})
    return low.where(F.col("e22").isNotNull() & F.col("_right").isNotNull() & F.col("e12").isNotNull()).select(*by, "r", "c", F.col("z").alias("e11"), F.col("_right").alias("e21"), "e12", "e22")


def bilinear(x: Column, y: Column) -> Column:
    """Value at column x and row y inside the cell (c, r) of a quad; the cell is found by truncation."""
    fx, fy = x - F.col("c"), y - F.col("r")
    return (1 - fx) * (1 - fy) * F.col("e11") + fx * (1 - fy) * F.col("e21") + (1 - fx) * fy * F.col("e12") + fx * fy * F.col("e22")


def uniform_filter(df: DataFrame, columns: list[str], height: int, width: int, size: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over size x size cells of all ``columns``; the border is mirrored (half-sample). Two window passes."""
    pad = size // 2
    for axis, n in (("c", width), ("r", height)):
        mirrored = F.expr(f"filter(array({axis}, if({axis} < {pad}, -1 - {axis}, null), if({axis} >= {n - pad}, {2 * n - 1} - {axis}, null)), i -> i is not null)")
        spread = df.withColumn("_i", F.explode(mirrored)).drop(axis).withColumnRenamed("_i", axis)
        near = _along(axis, by).rowsBetween(-pad, pad)
        df = spread.select(*by, "r", "c", *(F.avg(x).over(near).alias(x) for x in columns)).where((F.col(axis) >= 0) & (F.col(axis) < n))
    return df


def ssim(df: DataFrame, x: str, y: str, height: int, width: int, size: int = 7, data_range: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(r, c, ssim): local structural similarity of two columns, with unbiased local covariances."""
    c1, c2, n = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2, size * size
    a, b = F.col(x), F.col(y)
    m = uniform_filter(df.select(*by, "r", "c", a.alias("_x"), b.alias("_y"), (a * a).alias("_xx"), (b * b).alias("_yy"), (a * b).alias("_xy")), ["_x", "_y", "_xx", "_yy", "_xy"], height, width, size, by)
    mx, my = F.col("_x"), F.col("_y")
    k = n / (n - 1)
    vx, vy, vxy = (F.col("_xx") - mx * mx) * k, (F.col("_yy") - my * my) * k, (F.col("_xy") - mx * my) * k
    return m.select(*by, "r", "c", ((2 * mx * my + c1) * (2 * vxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))).alias("ssim"))


def erode(df: DataFrame, mask: str, times: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Binary erosion by the four neighbours; beyond the raster nothing is set."""
    for _ in range(times):
        m = F.col(mask)
        sides = [f(mask, 1, False).over(_along(axis, by)) for axis in ("r", "c") for f in (F.lag, F.lead)]
        df = df.withColumn("_m", m & sides[0] & sides[1] & sides[2] & sides[3]).drop(mask).withColumnRenamed("_m", mask)
    return df


def _neighbours(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """3 x 3 neighbourhood a b c / d e f / g h i; what lies outside is extrapolated from the two nearest cells."""
    def beside(name: str, step, back, axis: str) -> Column:
        w = _along(axis, by)
        return F.coalesce(step(name).over(w), 2 * F.col(name) - back(name).over(w), F.col(name))

    wide = df.withColumns({"_l": beside("z", F.lag, F.lead, "c"), "_r": beside("z", F.lead, F.lag, "c")})
    names = {}
    for side, (up, mid, low) in {"_l": "adg", "z": "beh", "_r": "cfi"}.items():
        names |= {f"n_{up}": beside(side, F.lag, F.lead, "r"), f"n_{mid}": F.col(side), f"n_{low}": beside(side, F.lead, F.lag, "r")}
    return wide.withColumns(names)


def slope_and_shade(df: DataFrame, cell_m: float, azimuth: float = 315.0, altitude: float = 45.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(r, c, slope, shade): Horn's slope in degrees and hill shade from 1 to 255, edges included."""
    n = lambda x: F.col(f"n_{x}")
    dx = ((n("a") + 2 * n("d") + n("g")) - (n("c") + 2 * n("f") + n("i"))) / (8 * cell_m)
    dy = ((n("g") + 2 * n("h") + n("i")) - (n("a") + 2 * n("b") + n("c"))) / (8 * cell_m)
    square = dx * dx + dy * dy
    a, t = F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    light = (F.sin(t) - F.cos(t) * F.sqrt(square) * F.sin(F.atan2(dy, dx) - a)) / F.sqrt(1 + square)
    return _neighbours(df, by).select(*by, "r", "c", F.degrees(F.atan(F.sqrt(square))).alias("slope"), F.when(light <= 0, 1.0).otherwise(1 + 254 * light).alias("shade"))


def relief(df: DataFrame, spacing: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(r, c, steep): forward-difference gradients, scaled by the gradient at 95 % of their order (found by rank, not by
    collecting), at most 1."""
    g = df.select("r", "c", *[F.coalesce(F.lead("z").over(_along(axis, by)) - F.col("z"), F.lit(0.0)).alias(f"d{axis}") for axis in ("r", "c")])
    g = g.select("r", "c", (F.sqrt(F.col("dr") ** 2 + F.col("dc") ** 2) / spacing).alias("steep"))
    scale = g.agg(F.expr("percentile_disc(0.95) within group (order by steep)").alias("scale"))  # one row
    return g.crossJoin(F.broadcast(scale)).select("r", "c", F.least(F.lit(1.0), F.col("steep") / F.col("scale")).alias("steep"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of both rasters and their difference; cells of one only go."""
    return a.join(b.select("r", "c", F.col("z").alias("z2")), ["r", "c"]).select("r", "c", (F.col("z2") - F.col("z")).alias("d"))


def difference_summary(d: DataFrame) -> DataFrame:
    """Number of cells that differ, and min, median, mean and max of the non-zero |d|."""
    x = F.when(F.col("d") != 0, F.abs("d"))
    return d.agg(F.count("*").alias("n"), F.count(x).alias("n_diff"), F.min(x).alias("least"), F.percentile(x, F.lit(0.5)).alias("median"), F.avg(x).alias("mean"), F.max(x).alias("most"))


def ascii_patch(df: DataFrame, ramp: str = " .:-=+*#%@") -> DataFrame:
    """One line of text a row: each cell by its place between the patch's extremes."""
    ends = df.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    place = F.least(F.floor((F.col("z") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * len(ramp)), F.lit(len(ramp) - 1)).cast("int")
    sign = F.substring(F.lit(ramp), place + 1, F.lit(1))
    return df.crossJoin(F.broadcast(ends)).groupBy("r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", sign.alias("s")))), lambda x: x["s"]), "").alias("line"))


def overlap(a: tuple[float, float, float, float, int, int], b: tuple[float, float, float, float, int, int]) -> tuple[int, int, int, int, int, int] | None:
    """Index ranges of two rasters on one grid where they overlap: row and column of the corner in a and in b, height,
    width. A raster is (east, north, cell width, cell height, rows, columns); None where they are disjoint."""
    (ae, an, aw, ah, ar, ac), (be, bn, bw, bh, br, bc) = a, b
    e0, e1 = max(ae, be), min(ae + ac * aw, be + bc * bw)
    n0, n1 = max(an - ar * ah, bn - br * bh), min(an, bn)
    if e1 - e0 < 1e-6 or n1 - n0 < 1e-6:
        return None
    return round((an - n1) / ah), round((e0 - ae) / aw), round((bn - n1) / bh), round((e0 - be) / bw), round((n1 - n0) / ah), round((e1 - e0) / aw)
