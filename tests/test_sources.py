"""Codecs, text parsing and specifications."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspark.sources import rasters, tables
from lumenspark.streaming import frames as stream


def test_png_round_trip():
    r, c = np.indices((24, 40))
    values = ((7 * r + 3 * c) % 256).astype(np.uint8)
    palette = np.random.default_rng(0).integers(0, 256, (256, 3))
    for args in ((), (palette,), (palette, 71)):
        raw = rasters.encode_png(values, *args)
        assert (rasters.decode_png(raw) == values).all()
    assert (b"tRNS" in raw) and b"PLTE" in raw
    assert values[:2, :2].ravel().tolist() == [0, 3, 7, 10]
    with pytest.raises(ValueError, match="PNG"):
        rasters.decode_png(b"no image at all")


@pytest.mark.parametrize("kind", ["i2", "f4", "u1"])
def test_tiff_round_trip(spark, tmp_path, kind):
    cells = (np.arange(35 * 21).reshape(35, 21) % 200).astype(kind)
    wkt = tables.polar_wkt(-85.0, 30.0)
    (tmp_path / "a.tif").write_bytes(rasters.encode_tiff(cells, -160.0, 160.0, 10.0, wkt))
    got = {(r["r"], r["c"]): r["z"] for r in rasters.read_tiff(spark, str(tmp_path / "a.tif")).collect()}
    assert got == {(r, c): float(cells[r, c]) for r in range(35) for c in range(21)}
    head = rasters.read_tiff_headers(spark, str(tmp_path)).first()
    assert (head["height"], head["width"], head["s0"], head["l0"]) == (35, 21, 15.5, 15.5)
    origin = spark.createDataFrame([(head["wkt"],)], "w string").select(*tables.natural_origin(F.col("w"))).first()
    assert tuple(origin) == (-85.0, 30.0)


def test_headerless_grid(spark, tmp_path):
    cells = np.random.default_rng(1).integers(-3000, 3000, (50, 70)).astype("<i2")
    (tmp_path / "g.img").write_bytes(cells.tobytes())
    got = {(r["r"], r["c"]): r["z"] for r in rasters.read_grid(spark, str(tmp_path / "g.img"), 70).collect()}
    assert got == {(r, c): cells[r, c] * 0.5 for r in range(50) for c in range(70)}
    with pytest.raises(ValueError, match="little"):
        rasters.read_grid(spark, str(tmp_path / "g.img"), 70, byte_order="big")


def test_frames_to_images_and_hashes(spark, tmp_path):
    rows = [(f, r, c, (f * 50 + r * 5 + c) % 256) for f in range(2) for r in range(6) for c in range(9)]
    df = spark.createDataFrame(rows, "f int, r long, c long, v int")
    for row in rasters.write_png_frames(df, ["f"], 6, 9).collect():
        want = np.array([v for f, _, _, v in rows if f == row["f"]]).reshape(6, 9)
        assert (rasters.decode_png(row["png"]) == want).all()
        (tmp_path / f"sun.{row['f']}.png").write_bytes(row["png"])
    assert rasters.read_png(spark, str(tmp_path)).count() == 108
    for row in rasters.raster_hash(df.withColumnRenamed("v", "z"), ["f"]).collect():
        want = np.array([v for f, _, _, v in rows if f == row["f"]], np.uint8).reshape(6, 9)
        assert row["sha256"] == hashlib.sha256(want.T.tobytes()).hexdigest()


def test_times_and_csv(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# all\n2024-01-01T00:00:00\n\n2024-01-02T00:00:00.250  # second\n2024-01-01 00:00:00\n")
    assert tables.read_time_list(spark, str(tmp_path / "t.txt")).count() == 2
    (tmp_path / "c.csv").write_text("# Product ID,Start Time\nA,2024-01-01T00:00:00.5Z\nB,2024-01-01 00:00:01\nC,never\n")
    assert tables.read_csv_times(spark, str(tmp_path / "c.csv")).count() >= 1
    df = spark.createDataFrame([("a", 'say "x", now'), ("b", "plain")], "k string, v string").coalesce(1)
    tables.write_csv(df, f"{tmp_path}/out", crlf=True)
    raw = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv").read_bytes()
    assert raw == b'k,v\r\na,"say ""x"", now"\r\nb,plain\r\n'
    with pytest.raises(Exception, match="already exists"):
        tables.write_csv(df, f"{tmp_path}/out")


def test_identification_by_size_and_hash(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"terrain")
    (tmp_path / "b.bin").write_bytes(b"terrainX")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    known = spark.createDataFrame([("product", 7, hashlib.sha256(b"terrain").hexdigest())], "name string, length long, sha256 string")
    assert [(r["path"].rsplit("/")[-1], r["name"]) for r in tables.identify(files, known).collect()] == [("a.bin", "product")]


def test_specifications():
    spec = {"name": "x", "start": "2024-01-01", "stop": "2024-01-02", "step_hours": 2, "times": ["a"], "layers": [{"kind": "site", "window": [0, 0, 32, 16]}]}
    assert tables.spec_problems(tables.load_spec(tables.render_spec(spec))) == []
    assert tables.load_spec(tables.render_spec(spec)) == spec
    bad = spec | {"step_hours": 0, "stop": "2023-01-01", "layers": [{"kind": "polar"}, {"kind": "site", "window": [1, 1, 1, 1]}, {"kind": "polar"}, {"kind": "polar"}]}
    assert len(tables.spec_problems(bad)) == 6
    with pytest.raises(ValueError, match="kind"):
        tables.load_spec('[[layers]]\nkind = "moon"')


def test_stream_of_frames(spark, tmp_path):
    def write(day, rows):
        spark.createDataFrame(rows, "px long, h int, sun int, dsn int").selectExpr("px", f"timestamp'2024-01-{day:02d} 00:00:00' + make_interval(0,0,0,0,h) AS ts", "sun", "dsn").write.mode("append").parquet(f"{tmp_path}/in")

    write(1, [(1, 0, 10, 30), (1, 1, 0, 30), (2, 0, 5, 0), (1, 0, 10, 30)])
    shares = stream.windowed_shares(stream.read_frames(spark, f"{tmp_path}/in"), 20)
    stream.run_once(shares, f"{tmp_path}/out", f"{tmp_path}/cp")
    write(9, [(3, 0, 1, 1)])
    stream.run_once(shares, f"{tmp_path}/out", f"{tmp_path}/cp")
    write(20, [(3, 0, 1, 1)])
    stream.run_once(shares, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(str(r["start"])[:10], r["px"]): (r["n"], r["n_lit"], r["n_contact"], r["sum_sun"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[("2024-01-01", 1)] == (2, 1, 2, 10) and got[("2024-01-01", 2)] == (1, 1, 0, 5)


def test_names_sizes_and_durations(spark):
    row = spark.range(1).select(
        tables.safe_name(F.lit("  a b/c\t")).alias("name"),
        *(tables.human_bytes(F.lit(n)).alias(f"b{n}") for n in (0, 1023, 1024, 1280, 1792, 1048576, 5 * 1024**4)),
        *(tables.human_duration(F.lit(s)).alias(f"s{i}") for i, s in enumerate((59.4, 125.0, 3600.0, 11_224.0))),
    ).first()
    assert tuple(row) == ("a_b_c", "0 B", "1023 B", "1.0 KB", "1.2 KB", "1.8 KB", "1.0 MB", "5120.0 GB", "59s", "2m 05s", "1h 00m", "3h 07m")


def test_unreadable_times_and_missing_positions_are_errors(spark, tmp_path):
    from lumenspark.sources import ephemeris

    (tmp_path / "t.csv").write_text("# time,x\n2024-01-01T00:00:00,1\n,2\nsoon,3\n")
    with pytest.raises(Exception, match="not a time: soon"):
        tables.read_csv_times(spark, str(tmp_path / "t.csv")).collect()
    with pytest.raises(Exception, match="not a time: soon"):
        tables.time_list(spark.createDataFrame([("2024-01-01T00:00:00 # x",), ("",), ("soon",)], "value string")).collect()
    times = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS ts UNION ALL SELECT timestamp_ntz'2024-01-02 00:00:00'")
    sky = ephemeris.approximate(times)
    assert ephemeris.at_times(times, sky).count() == 2
    with pytest.raises(Exception, match="no positions at 2024-01-02"):
        ephemeris.require_positions(times, sky.where("ts < '2024-01-02'"))


def test_holes_are_no_horizon(spark):
    from lumenspark.operators import raycast

    samples = spark.createDataFrame([(1, 1.0, 0.1), (1, 2.0, float("nan")), (1, 3.0, 0.2), (2, 1.0, float("nan")), (2, 2.0, 0.5)], "ray int, d double, slope double").withColumn("threshold", F.lit(0.3))
    assert {r["ray"]: (r["slope"], r["hit"]) for r in raycast.horizon(samples, ["ray"]).collect()} == {1: (0.2, False), 2: (0.5, True)}
