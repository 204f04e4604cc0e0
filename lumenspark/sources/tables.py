"""Text files as tables: time lists, azimuth and light-curve CSV, manifests, hashes, specifications."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Time spellings, tried in order.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")
METRIC_COUNTS = ("n_valid", "n_strict_valid", "agree_lit", "agree_dark", "missed", "over")
METRIC_VALUES = ("pixel_agree", "iou_shadow", "iou_lit", "missed_rate", "over_rate", "ber", "ssim_binary", "ssim_continuous", "mse", "rmse", "mae", "bias", "p99_abs_err")
METRICS_SCHEMA = "nac_id string, " + ", ".join([*(f"{c} int" for c in METRIC_COUNTS), *(f"{c} double" for c in METRIC_VALUES)])


def parse_time(text: Column) -> Column:
    """First spelling that fits, with or without a final Z; null if none does."""
    plain = F.regexp_replace(F.trim(text), "Z$", "")
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in TIME_FORMATS)).cast("timestamp_ntz")


def time_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct times of lines: what follows # and blank lines are left out. Reading any other line that is no time raises an
    error that names it."""
    text = F.trim(F.split_part(F.col(column), F.lit("#"), F.lit(1)))
    return lines.select(text.alias("t")).where(F.length("t") > 0).select(_time_or_error(F.col("t")).alias("ts")).distinct()


def _time_or_error(text: Column) -> Column:
    return F.coalesce(parse_time(text), F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp_ntz"))


def read_time_list(spark: SparkSession, path: str) -> DataFrame:
    return time_list(spark.read.text(path))


def read_csv_times(spark: SparkSession, path: str) -> DataFrame:
    """Times of a CSV file whose header may begin with '# ': of column time or start time, else of the first. Empty cells are
    left out; reading any other cell that is no time raises an error that names it."""
    df = spark.read.csv(path, header=True)
    clean = [c.lstrip("# ").strip().lower() for c in df.columns]
    at = next((i for i, c in enumerate(clean) if c in ("time", "start time")), 0)
    cell = F.col(f"`{df.columns[at]}`")
    return df.where(F.trim(cell) != "").select(_time_or_error(cell).alias("ts"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).csv(path, header=True)


def sections(lines: DataFrame, order: str, column: str = "value") -> DataFrame:
    """(section, key, value) of INI-like lines: a section's name carries forward to its lines."""
    from pyspark.sql import Window

    head = F.regexp_extract(F.col(column), r"^\[(.+)\]$", 1)
    named = lines.withColumn("section", F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(Window.orderBy(order)))
    pair = r"^\s*([^=\s]+)\s*=\s*(.+)$"
    return named.where(F.col(column).rlike(pair)).select("section", F.regexp_extract(column, pair, 1).alias("key"), F.regexp_extract(column, pair, 2).alias("value"))


def natural_origin(wkt: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the projection's origin, in either spelling."""
    find = lambda name: F.regexp_extract(wkt, rf'"{name}"\s*,\s*(-?[0-9.]+)', 1).try_cast("double")
    return F.coalesce(find("latitude_of_origin"), find("Latitude of natural origin")), F.coalesce(find("central_meridian"), find("Longitude of natural origin"))


def polar_wkt(lat0: float, lon0: float, radius_m: float = 1737400.0) -> str:
    """Text of a stereographic system on the sphere."""
    return f'PROJCS["Stereographic",GEOGCS["Moon",DATUM["D_Moon",SPHEROID["Moon",{radius_m:.1f},0]],PRIMEM["Reference_Meridian",0],UNIT["degree",0.0174532925199433]],PROJECTION["Stereographic"],PARAMETER["latitude_of_origin",{lat0}],PARAMETER["central_meridian",{lon0}],PARAMETER["scale_factor",1],PARAMETER["false_easting",0],PARAMETER["false_northing",0],UNIT["metre",1]]'


def identify(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, name): files whose size and SHA-256 are known. Only files of a known size are hashed."""
    sized = files.join(known.select("length").distinct(), "length", "left_semi").select("path", "length", F.sha2("content", 256).alias("sha256"))
    return sized.join(known, ["length", "sha256"]).select("path", "name")


def hash_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with the hash that is cached for the same path, length and modification time; null where it is stale."""
    return files.join(cache, ["path", "length", "modificationTime"], "left")


def load_spec(text: str) -> dict:
    """A render specification. Layers are of kind site, or farfield / polar; others raise."""
    spec = tomllib.loads(text)
    for layer in spec.get("layers", []):
        if layer.get("kind") not in ("site", "farfield", "polar"):
            raise ValueError(f"unknown layer kind {layer.get('kind')!r}")
    return spec


def spec_problems(spec: dict) -> list[str]:
    """What keeps a specification from being rendered; an empty list if nothing does."""
    out, layers = [], spec.get("layers", [])
    if not layers:
        out.append("no layer")
    if len(layers) > 3:
        out.append("more than three layers")
    if layers and len(layers) > 1 and layers[0].get("kind") != "site":
        out.append("the first of several layers must be a site")
    for i, layer in enumerate(layers[1:], 2):
        if layer.get("kind") == "site":
            out.append(f"layer {i} must be polar")
        if layer.get("window"):
            out.append(f"layer {i} cannot have a window")
    if len(layers) == 1 and layers[0].get("kind") == "site" and any(n % 16 for n in (layers[0].get("window") or [0, 0, 0, 0])[2:]):
        out.append("a site's window must be a multiple of 16")
    for k in ("step_hours", "azel_step_hours", "tile_height", "tile_width"):
        if k in spec and not spec[k] > 0:
            out.append(f"{k} must be positive")
    if spec.get("start") and spec.get("stop") and str(spec["stop"]) < str(spec["start"]):
        out.append("stop lies before start")
    return out


def render_spec(spec: dict, keys: tuple[str, ...] = ("name", "start", "stop", "step_hours", "azel_step_hours", "times", "observer_height_m", "tile_height", "tile_width", "workgroup_size", "dataset_description")) -> str:
    """Specification text in a fixed key order."""
    def value(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(value, v)) + "]"
        return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"' if not isinstance(v, (int, float)) else str(v)

    lines = [f"{k} = {value(spec[k])}" for k in keys if k in spec]
    for layer in spec.get("layers", []):
        lines += ["", "[[layers]]", *(f"{k} = {value(v)}" for k, v in layer.items())]
    return "\n".join(lines) + "\n"


def manifest(spark: SparkSession, entries: dict[str, dict[str, object]]) -> DataFrame:
    """(section, key, value) rows in order."""
    return spark.createDataFrame([(s, k, str(v)) for s, kv in entries.items() for k, v in kv.items()], "section string, key string, value string")


def write_csv(df: DataFrame, path: str, crlf: bool = False, mode: str = "errorifexists") -> None:
    """CSV with a header; quotes are doubled. Spark's committer makes the result appear at once or not at all."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"', lineSep="\r\n" if crlf else "\n")


def azel_lines(series: DataFrame, time: str = "ts") -> DataFrame:
    """The series with its time as ISO text with Z; milliseconds only where they are not zero."""
    t = F.col(time)
    text = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(t, "SSS") != "000", F.concat(F.lit("."), F.date_format(t, "SSS"))).otherwise(""), F.lit("Z"))
    return series.withColumn(time, text)


def csv_cell(c: Column) -> Column:
    """A cell as RFC 4180 has it."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def safe_name(c: Column) -> Column:
    """A name for files: without white space at its ends, and runs of other than letters, digits, dot, dash and underscore
    become one underscore."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"[^A-Za-z0-9._-]+", "_")


def human_bytes(n: Column) -> Column:
    """Size with one decimal (ties to even) in powers of 1024, up to GB: 1023 B, 1.0 KB, 12.3 MB."""
    n = n.cast("long")
    out = F.format_string("%d B", n)
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}", F.bround(n / 1024**i, 1))).otherwise(out)
    return out


def human_duration(seconds: Column) -> Column:
    """Whole seconds (ties to even) in the two largest units: 59s, 2m 05s, 3h 07m."""
    s = F.bround(seconds.cast("double"), 0).cast("long")
    minutes = F.format_string("%dm %02ds", F.floor(s / 60), s % 60)
    hours = F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, minutes).otherwise(hours)
