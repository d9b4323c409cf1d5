"""Boundary cases of the column functions."""

import hashlib
import hmac
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetwatch.functions import crypto, geometry, scan, scoring, text

NAN, INF = float("nan"), float("inf")


def one(spark, schema, row, col):
    return spark.createDataFrame([row], schema).select(col.alias("v")).first().v


def beams(spark, ranges, col):
    return one(spark, "r array<double>", (ranges,), col)


def test_sanitize(spark):
    assert beams(spark, [NAN, INF, -INF, -1.0, 9.0, 2.0], scan.sanitize_ranges(F.col("r"))) == [3.5, 3.5, 3.5, 0.0, 3.5, 2.0]


@pytest.mark.parametrize("n", [360, 200, 100, 0])
def test_resample(spark, n):
    data = [i / 200 for i in range(n)]
    got = beams(spark, data, scan.resample_beams(F.col("r"), 180))
    want = data[:: max(1, n // 180)][:180]
    assert got == want + [3.5] * (180 - len(want))


def test_bins(spark):
    data = [float(i) / 10 for i in range(25)]
    got = beams(spark, data, scan.bin_min(F.col("r"), 20))
    assert got == [data[i] for i in range(0, 25, 2)] + [3.5] * 7
    data = [float(i) / 20 for i in range(50)]
    assert beams(spark, data, scan.sector_min(F.col("r"), 24)) == [data[2 * i] for i in range(24)]
    assert beams(spark, [1.0], scan.sector_min(F.col("r"), 24)) == [3.5] * 24


def test_gate_and_nearest(spark):
    g = beams(spark, [1.0] * 51, scan.gate_scan(F.col("r"), 50, 50))
    assert (len(g.ranges), g.oversize, g.usable) == (50, True, True)
    assert not beams(spark, [1.0] * 50, scan.gate_scan(F.col("r"))).usable
    assert beams(spark, [NAN, INF, 0.01, 0.34], scan.nearest_obstacle(F.col("r"))) == 0.34
    assert beams(spark, [NAN], scan.nearest_obstacle(F.col("r"))) is None


@pytest.mark.parametrize("a,b", [([1.0, 2.0, NAN], [1.5, INF, 3.0]), ([NAN] * 3, [1.0] * 3), ([1.0] * 360, [1.1] * 300), ([], [1.0])])
def test_frame_diff(spark, a, b):
    n = min(len(a), len(b))
    x, y = np.array(a[:n]), np.array(b[:n])
    ok = np.isfinite(x) & np.isfinite(y)
    want = float(np.abs(x[ok] - y[ok]).mean()) if ok.any() else 0.0
    got = one(spark, "a array<double>, b array<double>", (a, b), scan.frame_diff(F.col("a"), F.col("b")))
    assert got == pytest.approx(want, abs=1e-12)


def test_scan_quality_cases(spark):
    rng = np.random.default_rng(0)
    far = (3.5 + rng.normal(0, 0.05, 360)).tolist()
    real = list(far)
    real[100:120] = (0.5 + rng.normal(0, 0.02, 20)).tolist()
    cases = [([3.5] * 360, None, "low_std"), ([1.0] * 360, None, "low_std"), (far, far, "frame_repeat"), (far, None, "mostly_max"),
             (real, None, None), ([3.5] * 50, None, None)]
    for r, prev, want in cases:
        assert one(spark, "r array<double>, p array<double>", (r, prev), scan.scan_quality(F.col("r"), F.col("p"))) == want


def test_bearing_keeps_pi(spark):
    def wrap(a):
        return one(spark, "a double", (a,), geometry.wrap_angle(F.col("a")))

    assert wrap(math.pi) == math.pi and wrap(-math.pi) == -math.pi
    assert wrap(math.pi + 0.1) == pytest.approx(-math.pi + 0.1)
    assert wrap(-7 * math.pi - 0.1) == pytest.approx(math.pi - 0.1)


@pytest.mark.parametrize("x,y,ok", [(1.5, -1, True), (0, 0, True), (2.5, 2.5, True), (-2.5, -2.5, True), (100, 100, False), (0, -10, False),
                                    (3, 0, False), (2.5, 0, True), (2.50001, 0, False)])
def test_bounds(spark, x, y, ok):
    assert one(spark, "x double, y double", (float(x), float(y)), geometry.in_bounds(F.col("x"), F.col("y"))) is ok


@pytest.mark.parametrize("x,cell", [(-2.6, 0), (-2.5, 0), (2.5, 11), (2.49, 11)])
def test_grid(spark, x, cell):
    assert one(spark, "x double", (x,), geometry.grid_cell(F.col("x"))) == cell


def test_sector_wraps_around(spark):
    r = [5.0] * 360
    r[359] = 1.0
    got = beams(spark, r, geometry.sector_clearance(F.col("r"), F.lit(0.0), F.lit(math.radians(1)), 0, 30))
    assert got == 1.0
    assert beams(spark, r, geometry.sector_clearance(F.col("r"), F.lit(0.0), F.lit(math.radians(1)), 30, 0)) == 5.0


def test_action_scaling(spark):
    def scaled(a):
        return one(spark, "a array<double>", (a,), geometry.scale_action(F.col("a"), F.lit(0.22), F.lit(1.5)))

    assert scaled([-3.0, 2.0]).asDict() == {"lin": 0.0, "ang": 1.5}
    assert scaled([NAN, 0.0]) is None


def test_spl(spark):
    def spl(e, o, p):
        return one(spark, "e string, o double, p double", (e, o, p), scoring.spl(F.col("e"), F.col("o"), F.col("p")))

    assert (spl("all_done", 5.0, 4.0), spl("all_done", 5.0, 10.0), spl("collision", 5.0, 5.0)) == (1.0, 0.5, 0.0)


def test_goto_parsing(spark):
    def goto(p):
        return one(spark, "p string", (p,), text.parse_goto(F.col("p")))

    g = goto('{"name": "a\\u001b[31mb\\nc ' + "x" * 60 + '", "x": 1.5, "y": "2"}')
    assert g.name == "a[31mbc " + "x" * 30 and (g.x, g.y, g.error) == (1.5, 2.0, None)
    assert goto('{"x": "here", "y": 1}').error == "format"
    assert goto("{").error == "format"
    assert goto('{"x": 1, "y": 1}').name == "unnamed"


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 80])
def test_hmac(spark, key):
    body = "héllo – 機器人"
    got = one(spark, "b string", (body,), crypto.hmac_sha256(F.col("b"), key))
    assert got == hmac.new(key, body.encode(), hashlib.sha256).hexdigest()


def test_fingerprint(spark):
    def fp(s):
        return one(spark, "s string", (s,), crypto.fingerprint(F.col("s")))

    assert fp("a") == fp("a") and fp("a") != fp("b") and len(fp("a")) == 16
