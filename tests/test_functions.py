from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenspark.functions import single
from lumenspark.sources import masks


def test_fused_multiply_add_rounds_once():
    from fractions import Fraction

    bits = lambda x: int(np.float32(x).view(np.uint32))
    a = np.float32(1) + np.float32(2) ** np.float32(-12)
    assert bits(single.fma(a, a, -1.0)) == 0x3A000400
    assert bits(np.float32(1) / np.float32(3)) == 0x3EAAAAAB and bits(np.sqrt(np.float32(2))) == 0x3FB504F3
    rng = np.random.default_rng(1)
    x, y, z = (rng.normal(0, 10.0 ** rng.integers(-3, 4, 3000), 3000).astype(np.float32) for _ in range(3))
    got = single.fma(x, y, z)
    for i in range(3000):
        exact = Fraction(float(x[i])) * Fraction(float(y[i])) + Fraction(float(z[i]))
        near = [np.nextafter(got[i], np.float32(d)) for d in (-np.inf, np.inf)]
        assert all(abs(Fraction(float(got[i])) - exact) <= abs(Fraction(float(n)) - exact) for n in near)


def test_table_functions_are_close():
    a = np.linspace(-7, 7, 20001).astype(np.float32)
    c, s = single.cos_sin(a)
    assert np.abs(c - np.cos(a)).max() < 3e-6 and np.abs(s - np.sin(a)).max() < 3e-6
    rng = np.random.default_rng(0)
    y, x = rng.normal(size=(2, 20000)).astype(np.float32)
    assert np.abs(single.atan2(y, x) - np.arctan2(y, x)).max() < 1e-6
    assert single.atan2(-1.0, 0.0) == -np.float32(np.pi) / 2 and single.atan2(0.0, 0.0) == 0


def test_station_masks(spark, tmp_path):
    (tmp_path / "DSS-14_rcv.txt").write_text("\n".join(str(i / 36) for i in range(361)))
    m = masks.read_masks(spark, str(tmp_path))
    assert m.count() == 361
    df = spark.createDataFrame([("DSS-14", "rcv", 90.5, 2.6), ("DSS-14", "rcv", 90.5, 2.5), ("DSS-14", "rcv", 359.5, 9.99)], "station string, link string, az double, el double")
    assert [r["visible"] for r in masks.above_mask(df, m, F.col("az"), F.col("el")).orderBy("az", "el").collect()] == [False, True, True]
