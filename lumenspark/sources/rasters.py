"""Raster files as cell tables: headerless grids, GeoTIFF and indexed PNG, read through Spark's own file access.

Files come in by ``binaryFile`` (so any store that Spark reads will do) and are decoded in Arrow batches on the executors.
Headerless grids that are too large for one record are read by rows with ``binaryRecords``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.session import ship_package

#: Tag numbers and sample types of the TIFF 6.0 and GeoTIFF formats (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT, PREDICTOR = 322, 323, 324, 325, 339, 317
PIXEL_SCALE, TIE_POINT, GEO_ASCII, NO_DATA = 33550, 33922, 34737, 42113
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def tiff_tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first directory's tags."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        code = _TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize(order + code) * n
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * i)[0]
        tags[tag] = raw[where : where + n].rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack_from(order + code * n, raw, where)
    return order, tags


def decode_tiff(raw: bytes) -> tuple[np.ndarray, dict]:
    """One-band raster and its geography: east, north (upper left corner), cell width, cell height, wkt, no data."""
    order, tags = tiff_tags(raw)
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    bits, form = tags[BITS][0], tags.get(SAMPLE_FORMAT, (1,))[0]
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
    packed = tags.get(COMPRESSION, (1,))[0]
    if packed not in (1, 8, 32946) or tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError(f"compression {packed} or several bands are not supported")
    tiled = TILE_OFFSETS in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (w, min(h, tags.get(ROWS_PER_STRIP, (h,))[0]))
    out = np.zeros((h, w), kind)
    across = -(-w // bw)
    for i, (at, n) in enumerate(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
        block = raw[at : at + n]
        block = zlib.decompress(block) if packed != 1 else block
        r, c = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, h - r)
        cells = np.frombuffer(block, kind, rows * bw).reshape(rows, bw)
        if tags.get(PREDICTOR, (1,))[0] == 2:
            cells = np.cumsum(cells, 1, dtype=kind)
        out[r : r + rows, c : c + bw] = cells[: h - r, : w - c]
    sx, sy, _ = tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0))
    px, py, _, e, n, _ = tags.get(TIE_POINT, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))[:6]
    return out.astype(kind.newbyteorder("=")), {"east": e - px * sx, "north": n + py * sy, "cell_w": sx, "cell_h": sy, "wkt": tags.get(GEO_ASCII, ""), "no_data": tags.get(NO_DATA)}


def encode_tiff(cells: np.ndarray, east: float = 0.0, north: float = 0.0, cell: float = 1.0, wkt: str = "") -> bytes:
    """Uncompressed one-strip GeoTIFF of a raster."""
    kind = cells.dtype.newbyteorder("<")
    body = cells.astype(kind).tobytes()
    text = wkt.encode("latin-1") + b"\0"
    extra = [(PIXEL_SCALE, 12, struct.pack("<3d", cell, cell, 0)), (TIE_POINT, 12, struct.pack("<6d", 0, 0, 0, east, north, 0)), (GEO_ASCII, 2, text)]
    form = {"u": 1, "i": 2, "f": 3}[kind.kind]
    short = lambda t, v: (t, 3, struct.pack("<HH", v, 0))
    long = lambda t, v: (t, 4, struct.pack("<I", v))
    entries = [long(WIDTH, cells.shape[1]), long(HEIGHT, cells.shape[0]), short(BITS, kind.itemsize * 8), short(COMPRESSION, 1), short(PHOTOMETRIC, 1), long(STRIP_OFFSETS, 8), short(SAMPLES, 1), long(ROWS_PER_STRIP, cells.shape[0]), long(STRIP_BYTES, len(body)), short(SAMPLE_FORMAT, form), *extra]
    at = 8 + len(body)
    directory, tail = struct.pack("<H", len(entries)), b""
    after = at + 2 + 12 * len(entries) + 4
    for tag, code, data in sorted(entries):
        n = len(data) // {2: 1, 3: 2, 4: 4, 12: 8}[code]
        n = 1 if code == 3 else n
        if len(data) > 4:
            directory += struct.pack("<HHII", tag, code, n, after + len(tail))
            tail += data + b"\0" * (len(data) % 2)
        else:
            directory += struct.pack("<HHI", tag, code, n) + data.ljust(4, b"\0")
    return b"II" + struct.pack("<HI", 42, at) + body + directory + struct.pack("<I", 0) + tail


def encode_png(values: np.ndarray, palette: np.ndarray | None = None, clear_from: int | None = None) -> bytes:
    """8-bit PNG of bytes: indexed with a 256 x 3 palette, else grey. Indices from ``clear_from`` on are transparent."""
    h, w = values.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.zeros((h, w + 1), np.uint8)
    lines[:, 1:] = values
    out = PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if palette is None else 3, 0, 0, 0))
    if palette is not None:
        out += chunk(b"PLTE", palette.astype(np.uint8).tobytes())
        if clear_from is not None:
            out += chunk(b"tRNS", bytes([255] * clear_from + [0] * (256 - clear_from)))
    return out + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    """Stored bytes of an 8-bit PNG: indices or grey values, of colour images the red channel."""
    if raw[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at < len(raw):
        n, kind = struct.unpack(">I", raw[at : at + 4])[0], raw[at + 4 : at + 8]
        part = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data += part
        at += 12 + n
    w, h, depth, colour, _, _, interlace = head
    if depth != 8 or interlace:
        raise ValueError("only 8-bit images without interlacing are supported")
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, w * step + 1)
    out, above = np.zeros((h, w * step), np.uint8), np.zeros(w * step, np.uint8)
    for r in range(h):
        kind, line = lines[r, 0], lines[r, 1:].astype(np.int32)
        if kind == 0:
            above = line.astype(np.uint8)
        elif kind == 2:
            above = ((line + above) & 255).astype(np.uint8)
        else:  # filters that look to the left go byte by byte
            now = np.zeros(w * step, np.int32)
            for c in range(w * step):
                a, b, d = (int(now[c - step]) if c >= step else 0), int(above[c]), (int(above[c - step]) if c >= step else 0)
                p = a + b - d
                guess = a if kind == 1 else (a + b) // 2 if kind == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                now[c] = (line[c] + guess) & 255
            above = now.astype(np.uint8)
        out[r] = above
    return out[:, ::step]


def _cells(path: str, cells: np.ndarray) -> pa.RecordBatch:
    r, c = np.indices(cells.shape)
    return pa.RecordBatch.from_arrays([pa.array([path] * cells.size), pa.array(r.ravel().astype(np.int64)), pa.array(c.ravel().astype(np.int64)), pa.array(cells.ravel().astype(np.float64))], names=["path", "r", "c", "z"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return ship_package(spark).read.format("binaryFile").load(path)


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """(path, r, c, z) of all GeoTIFF files at ``path``."""
    def run(batches):
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _cells(p, decode_tiff(raw)[0])

    return _files(spark, path).select("path", "content").mapInArrow(run, "path string, r long, c long, z double")


def read_tiff_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, east, north, cell_w, cell_h, s0, l0, wkt): no cells are decoded."""
    def run(batches):
        for batch in batches:
            rows = []
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, t = tiff_tags(raw)
                sx, sy, _ = t.get(PIXEL_SCALE, (1.0, 1.0, 0.0))
                e, n = t.get(TIE_POINT, (0.0,) * 6)[3:5]
                rows.append({"path": p, "height": t[HEIGHT][0], "width": t[WIDTH][0], "east": e, "north": n, "cell_w": sx, "cell_h": sy, "s0": -e / sx - 0.5, "l0": n / sy - 0.5, "wkt": t.get(GEO_ASCII, "")})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("height", pa.int64()), ("width", pa.int64()), *((k, pa.float64()) for k in ("east", "north", "cell_w", "cell_h", "s0", "l0")), ("wkt", pa.string())]))

    return _files(spark, path).select("path", "content").mapInArrow(run, "path string, height long, width long, east double, north double, cell_w double, cell_h double, s0 double, l0 double, wkt string")


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """(path, r, c, z): stored values of all PNG files at ``path``."""
    def run(batches):
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _cells(p, decode_png(raw))

    return _files(spark, path).select("path", "content").mapInArrow(run, "path string, r long, c long, z double")


def read_grid(spark: SparkSession, path: str, width: int, kind: str = "int16", scale: float = 0.5, byte_order: str = "little") -> DataFrame:
    """(r, c, z) of a headerless grid of little-endian int16 or float32 rows. Each record is one row, so files of any size
    are read in parallel; rows are numbered by their place in the file, without a second pass."""
    if byte_order != "little":
        raise ValueError("only little-endian grids are supported")
    size = np.dtype(f"<{ {'int16': 'i2', 'float32': 'f4'}[kind] }").itemsize
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    records = ship_package(spark).sparkContext.binaryRecords(path, width * size).zipWithIndex().map(lambda x: (x[1], bytes(x[0])))
    rows = spark.createDataFrame(records, StructType([StructField("r", LongType()), StructField("raw", BinaryType())]))

    def run(batches):
        for batch in batches:
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                z = np.frombuffer(raw, "<i2" if kind == "int16" else "<f4").astype(np.float64) * scale
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), r)), pa.array(np.arange(len(z))), pa.array(z)], names=["r", "c", "z"])

    return rows.mapInArrow(run, "r long, c long, z double")


def quantise(z):
    """Half-metre int16 steps of an elevation, ties to even."""
    return F.bround(F.least(F.greatest(z * 2, F.lit(-32768.0)), F.lit(32767.0)), 0).cast("short")


def raster_hash(cells: DataFrame, keys: list[str], kind: str = "u1") -> DataFrame:
    """SHA-256 of each raster's bytes, column by column. A raster is one group: its cells meet in one task."""
    import hashlib

    def run(table: pa.Table) -> pa.Table:
        r, c, z = (table[n].to_numpy() for n in ("r", "c", "z"))
        raw = z[np.lexsort((r, c))].astype(f"<{kind}").tobytes()
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "sha256": [hashlib.sha256(raw).hexdigest()]})

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    return cells.select(*keys, "r", "c", "z").groupBy(*keys).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sha256 string")


def write_png_frames(frames: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """(keys, png): one encoded image for each frame, to be written by any Spark sink."""
    def run(table: pa.Table) -> pa.Table:
        out = np.zeros((height, width), np.uint8)
        out[table["r"].to_numpy(), table["c"].to_numpy()] = table["v"].to_numpy()
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "png": pa.array([encode_png(out)], pa.binary())})

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return frames.select(*keys, "r", "c", "v").groupBy(*keys).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", png binary")
