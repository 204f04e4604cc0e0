"""Command line: renders, light curves and azimuth series.

    python -m lumenspark.cli mapset --spec spec.toml --out maps [--dry-run]
    python -m lumenspark.cli light-curve --spec spec.toml --row 5 --col 7 --start T --stop T --step 15m --out curve
    python -m lumenspark.cli azel --lat -85 --lon 30 --start T --stop T --step 15m --out azel
"""

from __future__ import annotations

import argparse
import re
from collections.abc import Sequence
from datetime import datetime

from lumenspark.sources.tables import load_spec, spec_problems

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(text: str) -> int:
    """Seconds of HH:MM:SS or a number with s, m, h or d; periods are positive."""
    if m := re.fullmatch(r"(\d+):(\d\d):(\d\d)", text):
        out = int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3])
    elif m := re.fullmatch(r"(\d+)([smhd])", text):
        out = int(m[1]) * _UNITS[m[2]]
    else:
        raise argparse.ArgumentTypeError(f"{text!r} is no period")
    if not out:
        raise argparse.ArgumentTypeError("a period must be positive")
    return out


def moment(text: str) -> str:
    try:
        return datetime.fromisoformat(text.removesuffix("Z")).strftime("%Y-%m-%d %H:%M:%S")
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text!r} is no time") from None


class _Once(argparse.Action):
    """An option that may be given once."""

    def __call__(self, parser, namespace, value, option=None):
        seen = namespace.__dict__.setdefault("_seen", set())
        if self.dest in seen:
            parser.error(f"{option} was given twice")
        seen.add(self.dest)
        setattr(namespace, self.dest, value)


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="lumenspark", allow_abbrev=False)
    commands = top.add_subparsers(dest="command", required=True)
    mapset, curve, azel = (commands.add_parser(n, allow_abbrev=False) for n in ("mapset", "light-curve", "azel"))
    for p in (mapset, curve, azel):
        p.add_argument("--out", required=True, action=_Once)
        p.add_argument("--start", type=moment, action=_Once)
        p.add_argument("--stop", type=moment, action=_Once)
        p.add_argument("--step", type=seconds, action=_Once)
    for p in (mapset, curve):
        p.add_argument("--spec", required=True, action=_Once)
    mapset.add_argument("--dry-run", action="store_true")
    for p, pairs in ((curve, ("row", "col", "lat", "lon", "x", "y")), (azel, ("lat", "lon"))):
        for name in pairs:
            p.add_argument(f"--{name}", type=int if name in ("row", "col") else float, action=_Once)
    args = top.parse_args(argv)
    if args.command != "mapset":
        given = [pair for pair in (("row", "col"), ("lat", "lon"), ("x", "y")) if any(getattr(args, n, None) is not None for n in pair)]
        if len(given) != 1 or any(getattr(args, n) is None for n in given[0]):
            top.error("exactly one pair of coordinates is needed")
        args.pair = given[0]
    if (args.start is None) != (args.stop is None) or (args.start and args.stop < args.start):
        top.error("start and stop go together, start first")
    return args


def main(argv: Sequence[str] | None = None) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lumenspark import mapset
    from lumenspark.functions import geometry as G
    from lumenspark.operators.frames import time_range
    from lumenspark.sources import ephemeris, rasters, tables

    args = parse(argv)
    spec = {}
    if args.command != "azel":
        with open(args.spec, encoding="utf-8") as f:
            spec = load_spec(f.read())
        if problems := spec_problems(spec):
            raise SystemExit("\n".join(problems))
        if getattr(args, "dry_run", False):
            print(tables.render_spec(spec))
            return
    spark = SparkSession.builder.appName("lumenspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if spec.get("times") and not args.start:
        times = tables.time_list(spark.createDataFrame([(str(t),) for t in spec["times"]], "value string"))
    else:
        start, stop = args.start or moment(str(spec["start"])), args.stop or moment(str(spec["stop"]))
        times = time_range(spark, start, stop, args.step or int(float(spec.get("step_hours", 1)) * 3600))
    sky = ephemeris.approximate(times)
    if args.command == "azel":
        tables.write_csv(tables.azel_lines(mapset.azel_series(times, sky, args.lat, args.lon), "time"), args.out, crlf=True)
        return

    def terrain(layer: dict) -> mapset.Terrain:
        if layer.get("kind") == "site":
            raise SystemExit(f"{layer['path']}: site layers, whose grid is not centred on the pole, cannot be rendered")
        if layer["path"].endswith((".tif", ".tiff")):
            head = rasters.read_tiff_headers(spark, layer["path"]).first()
            return mapset.Terrain(rasters.read_tiff(spark, layer["path"]).drop("path"), G.Grid(head["s0"], head["l0"], head["cell_w"] / 1000), head["height"], head["width"])
        kind = layer.get("data_type", "int16")
        cells = rasters.read_grid(spark, layer["path"], layer["width"], kind, layer.get("elevation_scale_m", 0.5 if kind == "int16" else 1.0))
        return mapset.Terrain(cells, G.Grid((layer["width"] - 1) / 2, (layer["height"] - 1) / 2, layer["pixel_size_m"] / 1000), layer["height"], layer["width"])

    first, *farther = map(terrain, spec["layers"])
    height = float(spec.get("observer_height_m", 2.0))
    if args.command == "mapset":
        window = tuple(spec["layers"][0]["window"]) if spec["layers"][0].get("window") else None
        mapset.generate(first, sky, times, args.out, window=window, observer_m=height, cutoff=bool(spec["layers"][0].get("cutoff", False)), farther=tuple(farther))
        return
    if args.pair == ("row", "col"):
        row, col = args.row, args.col
    else:
        x, y = (F.lit(args.x / 1000), F.lit(args.y / 1000)) if args.pair == ("x", "y") else (None, None)
        c, r = (x / first.grid.pixel_km + first.grid.s0, first.grid.l0 - y / first.grid.pixel_km) if x is not None else G.latlon_to_pixel(F.lit(args.lat), F.lit(args.lon), first.grid)
        col, row = spark.range(1).select(G.nearest_pixel(c), G.nearest_pixel(r)).first()
    tables.write_csv(mapset.light_curve(first, sky, times, row, col, height), args.out)


if __name__ == "__main__":
    main()
