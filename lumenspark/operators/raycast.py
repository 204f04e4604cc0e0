"""Ray casting and illumination as relational operators.

A ray is a series of steps from a pixel in a direction of the grid; stretches of it join the blocks of the quad table (each
cell with its neighbours) that they touch, so one equi-join on the block fetches all four corners of all their samples. The
horizon of a ray is an aggregate over its samples: the slope at the first one that reaches the threshold, else the largest.
Rays of one pixel and frame end up in one row by a second aggregate. Steps are generated per ray up to its own limit, never
by a cross join with a filter, and only where the block is at hand: samples are not shuffled.

``horizon_kernel`` is the other implementation of the same operator for large frames: tiles of pixels are marched in
lockstep by numpy over a terrain array that is broadcast behind a check of its size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.functions.geometry import Grid, Vector, body_to_stereo, encode_contact, encode_sun, stereo_to_body, up_and_depth
from lumenspark.operators.raster import bilinear
from lumenspark.session import ship_package

STEP = 0.70710698
HARD_CAP = 15000.0
TOP_M = 10000.0
SUN_HALF_ANGLE = 0.27
#: Offsets of the sun rays in half angles, and the weight that normalises the disk (fixed values).
RAY_OFFSETS = (-1.0, -5 / 7, -3 / 7, -1 / 7, 1 / 7, 3 / 7, 5 / 7, 1.0)
INV_MAX_PHOTONS = 0.14666102826595306
CELL_BYTES_LIMIT = 64 << 20
BLOCK = 6  # bits: blocks of 64 x 64 cells
CHUNK = 32  # steps


def chords() -> list[tuple[int, float, float]]:
    """(anchor, share of the way to the next anchor, half chord in degrees) of the 16 ticks over the disk.

    Half chords have single precision, as the weight that they are normalised by; a full disk comes to 1.00000001.
    """
    out = []
    for i in range(16):
        place = (i + 0.5) * 7 / 16
        out.append((int(place), place - int(place), float(np.float32(math.sqrt(64 - (7.5 - i) ** 2) / 8) * np.float32(SUN_HALF_ANGLE))))
    return out


def reach(threshold: Column, pixel_m: float, cap: float = HARD_CAP) -> Column:
    """Farthest useful distance in pixels: terrain of at most ``TOP_M`` cannot reach the slope beyond it."""
    return F.when(threshold > 0.005, F.least(F.lit(cap), TOP_M * 1.5 / pixel_m / threshold)).otherwise(cap)


def exit_distance(shape: tuple[int, int], dc: Column, dr: Column) -> Column:
    """Distance at which a ray from (qr, qc) has left a raster of so many rows and columns, and a pixel beyond it."""
    out = F.lit(math.inf)
    for size, at, toward in ((shape[0], F.col("qr"), dr), (shape[1], F.col("qc"), dc)):
        out = F.least(out, F.when(toward > 0, (size - 1 - at) / toward).when(toward < 0, (at + 1) / -toward).otherwise(math.inf))
    return out + 1.0


def next_layer_start(exit_distance: Column, from_m: float, to_m: float) -> Column:
    """First distance in the coarser layer's pixels, at least one."""
    return F.greatest(F.lit(1.0), exit_distance * from_m / to_m)


def blocks(quads: DataFrame) -> DataFrame:
    """(_br, _bc, _cells): squares of 2 ** ``BLOCK`` cells a side, each one array in which a cell's place is its row and column
    in the square; cells that are not there have no ``here``."""
    values = [n for n in quads.columns if n not in ("r", "c")]
    kinds = {f.name: f.dataType for f in quads.schema}
    cell = F.struct(_in_block().alias("i"), F.lit(True).alias("here"), *values)
    squares = quads.groupBy(F.shiftright("r", BLOCK).alias("_br"), F.shiftright("c", BLOCK).alias("_bc")).agg(F.collect_list(cell).alias("q"))
    every = F.transform(F.sequence(F.lit(0), F.lit((1 << 2 * BLOCK) - 1)), lambda i: F.struct(i.alias("i"), F.lit(None).cast("boolean").alias("here"), *(F.lit(None).cast(kinds[n]).alias(n) for n in values)))
    cells = squares.select("_br", "_bc", F.explode(F.concat("q", every)).alias("q")).select("_br", "_bc", "q.*")
    one = cells.groupBy("_br", "_bc", "i").agg(*(F.max(n).alias(n) for n in ("here", *values)))
    return one.groupBy("_br", "_bc").agg(F.sort_array(F.collect_list(F.struct("i", "here", *values))).alias("_cells"))


def _in_block() -> Column:
    low = F.lit((1 << BLOCK) - 1)
    return (F.shiftleft(F.col("r").bitwiseAND(low), BLOCK) + F.col("c").bitwiseAND(low)).cast("int")


def march(rays: DataFrame, quads: DataFrame, limit: Column, start: Column | float = 1.0, shape: tuple[int, int] | None = None) -> DataFrame:
    """Samples of rays (qr, qc, dc, dr, ...): columns of the ray, d, x, y and the quad's. ``limit`` bounds the distance.

    Rays meet the terrain block by block: each stretch of ``CHUNK`` steps goes to the blocks that it can touch, and becomes
    samples there. Neither side is broadcast, as the rows of a raster say little about the cells that they unfold to.
    In place of dc and dr, rays may have ``fan``, an array of structs with them: these rays go to their blocks together.
    With the raster's ``shape`` known, no steps are made beyond its edges; the samples are the same."""
    first = F.lit(float(start)) if not isinstance(start, Column) else start
    fan = "fan" in rays.columns
    if shape:
        left = F.array_max(F.transform("fan", lambda f: exit_distance(shape, f["dc"], f["dr"]))) if fan else exit_distance(shape, F.col("dc"), F.col("dr"))
        limit = F.least(limit, left)
    steps = F.floor((limit - first) / STEP).cast("int")
    distance = lambda k: first + F.col(k) * STEP
    own = [n for n in rays.columns if n != "fan"]

    def ends(at: str, toward: str) -> tuple[Column, Column]:
        if not fan:
            both = [F.col(at) + distance(k) * F.col(toward) for k in ("_from", "_to")]
            return F.least(*both), F.greatest(*both)
        both = F.concat(*(F.transform("fan", _step_of(F.col(at), distance(k), toward)) for k in ("_from", "_to")))
        return F.array_min(both), F.array_max(both)

    far = rays.withColumn("_from", F.explode(F.when(steps >= 0, F.sequence(F.lit(0), steps, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))))
    far = far.withColumn("_to", F.least(F.col("_from") + (CHUNK - 1), steps))
    (x0, x1), (y0, y1) = ends("qc", "dc"), ends("qr", "dr")
    far = far.withColumns({"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1}).where((F.col("_x1") > -1) & (F.col("_y1") > -1))
    for name, a in (("_br", "y"), ("_bc", "x")):
        far = far.withColumn(name, F.explode(F.sequence(*(F.shiftright(F.col(f"_{a}{i}").cast("long"), BLOCK) for i in (0, 1)))))
    met = far.drop("_x0", "_x1", "_y0", "_y1").join(blocks(quads).hint("merge"), ["_br", "_bc"])
    if fan:
        met = met.withColumn("_ray", F.explode("fan"))
        own += [f for f in rays.schema["fan"].dataType.elementType.fieldNames()]
        met = met.select("*", "_ray.*").drop("fan", "_ray")
    # A constant array, bits for block and place: code of more than 8,000 bytes is not compiled, but interpreted.
    met = met.withColumn("_i", F.explode(F.array(*(F.lit(i) for i in range(CHUNK))))).withColumn("_k", F.col("_from") + F.col("_i")).where("_k <= _to").withColumn("d", distance("_k"))
    met = met.withColumns({"x": F.col("qc") + F.col("d") * F.col("dc"), "y": F.col("qr") + F.col("d") * F.col("dr")}).where((F.col("x") > -1) & (F.col("y") > -1))
    # Truncation towards zero, so that the strip just outside the first row and column counts as cell 0.
    met = met.withColumns({"r": F.col("y").cast("long"), "c": F.col("x").cast("long")}).where((F.shiftright("r", BLOCK) == F.col("_br")) & (F.shiftright("c", BLOCK) == F.col("_bc")))
    cell = F.col("_cells")[_in_block()]
    return met.where(cell["here"]).select(*own, "d", "x", "y", "r", "c", *(cell[n].alias(n) for n in quads.columns if n not in ("r", "c")))


def _step_of(at: Column, distance: Column, toward: str):
    return lambda f: at + distance * f[toward]


def flat_slope(elev_m: Column, query_m: Column, distance_m: Column, radius_m: float) -> Column:
    """Slope over a sphere's drop: the brute-force form."""
    return (elev_m - query_m - distance_m * distance_m / (2 * radius_m)) / distance_m


def sphere_slope(x: Column, y: Column, elev_m: Column, query: Vector, up: Vector, grid: Grid, observer_m: float) -> Column:
    """Slope of a sample seen from a pixel, by its position on the sphere; the observer's height counts for the rise only."""
    d = stereo_to_body(x, y, elev_m, grid).minus(query)
    rise = d.dot(up)
    return (rise - observer_m / 1000) / F.sqrt(F.greatest(d.dot(d) - rise * rise, F.lit(1e-18)))


def with_sphere_slope(samples: DataFrame, query: Vector, up: Vector, grid: Grid, observer_m: float) -> DataFrame:
    """Samples with ``sphere_slope``, column by column: in one expression its code would be too large to be compiled."""
    placed = samples.withColumn("_e", bilinear(F.col("x"), F.col("y")))
    d = stereo_to_body(F.col("x"), F.col("y"), F.col("_e"), grid).minus(query)
    placed = placed.withColumns({"_dx": d.x, "_dy": d.y, "_dz": d.z})
    d = Vector(F.col("_dx"), F.col("_dy"), F.col("_dz"))
    placed = placed.withColumn("_rise", d.dot(up)).withColumn("_flat", d.dot(d) - F.col("_rise") * F.col("_rise"))
    return placed.withColumn("slope", (F.col("_rise") - observer_m / 1000) / F.sqrt(F.greatest(F.col("_flat"), F.lit(1e-18))))


def horizon(samples: DataFrame, keys: list[str], slope: str = "slope", threshold: str = "threshold") -> DataFrame:
    """Slope of each ray's horizon: at the first sample that reaches the threshold, else the largest. Samples that touch a
    cell without data (NaN) are skipped; Spark would take NaN for the largest of all numbers."""
    samples = samples.withColumn("_ok", ~F.isnan(slope)).withColumn(slope, F.when(F.col("_ok"), F.col(slope)))
    hit, d = F.col(slope) >= F.col(threshold), F.when(F.col("_ok"), F.col("d"))
    found = samples.groupBy(*keys).agg(F.coalesce(F.min_by(slope, F.when(hit, d)), F.max(slope)).alias(slope), F.max(hit).alias("hit"), F.max(d).alias("exit_d"))
    return found.where(F.col("exit_d").isNotNull())


def sun_fraction(sun_elevation: Column, horizons: Column) -> Column:
    """Visible share of the disk from eight horizon angles (an array): 16 chords between interpolated horizons."""
    total = F.lit(0.0)
    for anchor, share, half in chords():
        edge = horizons[anchor] + share * (horizons[anchor + 1] - horizons[anchor])
        total = total + F.greatest(F.lit(0.0), F.least(sun_elevation + half - edge, F.lit(2 * half)))
    return total * INV_MAX_PHOTONS


def ray_fans(df: DataFrame) -> DataFrame:
    """Two fans a row, with one threshold each: eight rays over the Sun's disk (0 to 7), one to Earth (8). ``df`` has
    sun_/earth_cos, _sin and _el.

    Rays of a body whose top is 10 degrees or more below the horizontal are not cast.
    """
    sun = F.array(*(F.struct(F.lit(i).alias("ray"), (F.col("sun_cos") * math.cos(a) - F.col("sun_sin") * math.sin(a)).alias("dc"), (F.col("sun_cos") * math.sin(a) + F.col("sun_sin") * math.cos(a)).alias("dr")) for i, a in enumerate(math.radians(o * SUN_HALF_ANGLE) for o in RAY_OFFSETS)))
    earth = F.array(F.struct(F.lit(8).alias("ray"), F.col("earth_cos").alias("dc"), F.col("earth_sin").alias("dr")))
    both = F.array(F.struct(F.lit(0).alias("i"), (F.col("sun_el") + SUN_HALF_ANGLE).alias("top")), F.struct(F.lit(1).alias("i"), F.col("earth_el").alias("top")))
    cast = df.withColumn("_body", F.explode(both)).where(F.col("_body.top") > -10)
    return cast.withColumns({"threshold": F.tan(F.radians("_body.top")), "fan": F.when(F.col("_body.i") == 0, sun).otherwise(earth)}).drop("_body")


def layered(rays: DataFrame, layers: list[tuple[DataFrame, Grid, float]], observer_m: float, keys: list[str], shape: tuple[int, int] | None = None) -> DataFrame:
    """(keys, slope): horizons of rays over one to three layers (quads, grid, farthest pixel), near to far. ``shape``: rows and
    columns of the nearest one, if they are known (see ``march``).

    Rays have qc, qr in the first layer's pixels, z, the query's position (px, py, pz) and up (ux, uy, uz), a direction (or
    a ``fan`` of them, see ``march``) and a threshold. A ray that reaches its threshold stops; others go on in the next layer from the distance at which they
    left the last one. The query is placed in a farther layer by its datum, not by its elevated position. Slopes of
    earlier layers lie under the threshold, so the largest is the horizon.
    """
    if not 1 <= len(layers) <= 3:
        raise ValueError("a stack has one to three layers")
    at, above = Vector(*(F.col(f"p{i}") for i in "xyz")), Vector(*(F.col(f"u{i}") for i in "xyz"))
    found, start, before = [], F.lit(1.0), None
    for cells, grid, farthest in layers:
        if before is not None:
            if "fan" in rays.columns:
                rays = rays.withColumn("_ray", F.explode("fan")).select("*", "_ray.*").drop("fan", "_ray")
            # Of a ray that had no sample the last distance stays.
            rays = rays.drop("exit_d").join(here.select(*keys, "hit", "exit_d").hint("merge"), keys, "left").where(~F.coalesce("hit", F.lit(False))).drop("hit")
            r = F.sqrt(at.dot(at))
            datum = Vector(*(c * (before.radius_km / r) for c in at))
            col, row = body_to_stereo(datum, grid)
            rays = rays.withColumns({"qc": col, "qr": row})
            start = next_layer_start(F.coalesce("exit_d", F.lit(1.0)), before.pixel_km * 1000, grid.pixel_km * 1000)
        samples = march(rays.withColumn("_start", start), cells, F.least(reach(F.col("threshold"), grid.pixel_km * 1000), F.lit(farthest)), F.col("_start"), shape if before is None else None)
        sloped = with_sphere_slope(samples, at, above, grid, observer_m)
        here = horizon(sloped.select(*keys, "d", "slope", "threshold"), keys)
        found.append(here.select(*keys, "slope"))
        before = grid
    if len(found) == 1:
        return found[0]
    every = found[0]
    for other in found[1:]:
        every = every.union(other)
    return every.groupBy(*keys).agg(F.max("slope").alias("slope"))


def illuminate(pixels: DataFrame, quads: DataFrame, grid: Grid, observer_m: float, max_pixels: float, keys: tuple[str, ...] = ("frame", "qr", "qc"), farther: tuple[tuple[DataFrame, Grid, float], ...] = (), whole: tuple[DataFrame, int, int] | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """Sun and contact bytes of pixels (frame, qr, qc, z, directions as in ``ray_fans``): keys, sun, dsn, horizon, over.

    ``farther``: more layers (quads, grid, farthest pixel) in which rays go on. ``whole``: the terrain's cells, rows and
    columns; if they are few enough to be broadcast, and there is one layer, rays are marched by ``horizon_kernel``. ``shape``:
    rows and columns of the terrain, where ``whole`` is not given.
    """
    qc, qr = F.col("qc").cast("double"), F.col("qr").cast("double")
    query = stereo_to_body(qc, qr, F.col("z"), grid)
    up, _ = up_and_depth(qc, qr, F.col("z"), grid)
    placed = pixels.withColumns({"px": query.x, "py": query.y, "pz": query.z, "ux": up.x, "uy": up.y, "uz": up.z})
    own = [f"k_{k}" for k in keys]  # the query's place in a farther layer overwrites qr and qc
    fans = ray_fans(placed.withColumns({f"k_{k}": F.col(k) for k in keys}))
    if whole and not farther and whole[1] * whole[2] * 8 <= CELL_BYTES_LIMIT:
        rays = fans.withColumn("_ray", F.explode("fan")).select("*", "_ray.*")
        found = horizon_kernel(rays.select(*own, "ray", "qr", "qc", "z", "dc", "dr", "threshold"), *whole, grid, observer_m, max_pixels, (*own, "ray"))
    else:
        found = layered(fans, [(quads, grid, max_pixels), *farther], observer_m, [*own, "ray"], shape or (whole and whole[1:]))
    found = found.withColumn("deg", F.degrees(F.atan("slope")))
    by_ray = found.groupBy(*(F.col(o).alias(k) for o, k in zip(own, keys, strict=True))).agg(*(F.coalesce(F.max(F.when(F.col("ray") == i, F.col("deg"))), F.lit(-90.0)).alias(f"h{i}") for i in range(9)))
    # Pixels whose rays were not cast come back here.
    out = pixels.join(by_ray.hint("merge"), list(keys), "left").withColumn("h", F.array(*(F.coalesce(F.col(f"h{i}"), F.lit(-90.0)) for i in range(8))))
    fraction = F.when(F.col("sun_el") + SUN_HALF_ANGLE > -10, sun_fraction(F.col("sun_el"), F.col("h"))).otherwise(0.0)
    over = F.when(F.col("earth_el") > -10, F.col("earth_el") - F.coalesce("h8", F.lit(-90.0))).otherwise(-90.0)
    return out.select(*keys, encode_sun(fraction).alias("sun"), encode_contact(over).alias("dsn"), F.coalesce("h8", F.lit(-90.0)).alias("horizon"), over.alias("over"))


def horizon_kernel(rays: DataFrame, cells: DataFrame, height: int, width: int, grid: Grid, observer_m: float, max_pixels: float, keys: tuple[str, ...]) -> DataFrame:
    """Same horizons as ``march`` + ``horizon`` (slope per ray), by arrays marched in lockstep.

    The terrain goes to every task as one array of doubles; beyond ``CELL_BYTES_LIMIT`` bytes this raises and the
    relational form is the way.
    """
    if height * width * 8 > CELL_BYTES_LIMIT:
        raise ValueError(f"{height} x {width} cells are too many to broadcast; use march() and horizon()")
    terrain = np.full((height, width), np.nan)
    for batch in cells.select("r", "c", "z").toArrow().to_batches():
        terrain[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    shared = ship_package(cells.sparkSession).sparkContext.broadcast(terrain)
    radius, s0, l0, pixel = grid.radius_km, grid.s0, grid.l0, grid.pixel_km

    def place(x, y, z):
        e, n = (x - s0) * pixel, (l0 - y) * pixel
        u2 = (e * e + n * n) / (4 * radius * radius)
        t = radius + z / 1000
        k = t / (radius * (1 + u2))
        return k * n, k * e, t * (u2 - 1) / (1 + u2)

    def run(batches):
        dem = shared.value
        h, w = dem.shape
        for batch in batches:
            col = {n: batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("qr", "qc", "z", "dc", "dr", "threshold")}
            n = batch.num_rows
            p = place(col["qc"].astype(float), col["qr"].astype(float), col["z"])
            length = np.sqrt(sum(i * i for i in p))
            best, live, d = np.full(n, -np.inf), np.arange(n), np.ones(n)
            threshold = col["threshold"]
            limit = np.minimum(np.where(threshold > 0.005, np.minimum(HARD_CAP, TOP_M * 1.5 / (pixel * 1000) / np.where(threshold > 0.005, threshold, 1)), HARD_CAP), max_pixels)
            k = 0
            while len(live):
                d = 1.0 + k * STEP
                k += 1
                live = live[d <= limit[live]]
                x, y = col["qc"][live] + d * col["dc"][live], col["qr"][live] + d * col["dr"][live]
                inside = (x > -1) & (y > -1) & (x < w) & (y < h)
                live, x, y = live[inside], x[inside], y[inside]
                ci, ri = np.trunc(x).astype(int), np.trunc(y).astype(int)
                whole = (ci < w - 1) & (ri < h - 1)  # the last row and column have no quad, but the ray goes on
                at, ci, ri = live[whole], ci[whole], ri[whole]
                fx, fy = x[whole] - ci, y[whole] - ri
                z = (1 - fx) * (1 - fy) * dem[ri, ci] + fx * (1 - fy) * dem[ri, ci + 1] + (1 - fx) * fy * dem[ri + 1, ci] + fx * fy * dem[ri + 1, ci + 1]
                q = place(x[whole], y[whole], z)
                v = [a - b[at] for a, b in zip(q, p, strict=True)]
                rise = sum(a * b[at] for a, b in zip(v, p, strict=True)) / length[at]
                slope = (rise - observer_m / 1000) / np.sqrt(np.maximum(sum(a * a for a in v) - rise * rise, 1e-18))
                best[at] = np.fmax(best[at], slope)
                done = np.zeros(n, bool)
                done[at] = slope >= threshold[at]
                live = live[~done[live]]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keys), pa.array(best)], names=[*keys, "slope"])

    kinds = {f.name: f.dataType.simpleString() for f in rays.schema}
    return rays.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", slope double")
