"""Lidar arrays: cleaning, resampling, binning, quality and frame difference.

All are native array expressions. ``bind`` evaluates a value once and hands it
to a lambda; without it an outer expression inside a lambda is evaluated again
for every beam.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

MAX_RANGE = 3.5


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), 0)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def sanitize_ranges(ranges: Column, top: float = MAX_RANGE) -> Column:
    """Non-finite beams become ``top``; the rest is clipped to [0, top]."""
    return F.transform(
        ranges,
        lambda x: F.when(finite(x), F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(top))).otherwise(F.lit(top)),
    )


def _pad(beams: Column, n: int, top: float) -> Column:
    return bind(beams, lambda b: F.concat(b, F.array_repeat(F.lit(top), F.lit(n) - F.size(b))))


def resample_beams(ranges: Column, n: int, top: float = MAX_RANGE) -> Column:
    """Every k-th beam with k = max(1, len // n), cut to n, padded with ``top``."""
    doubles = F.transform(ranges, lambda x: x.cast("double"))
    stride = F.greatest(F.lit(1), F.floor(F.size(ranges) / n).cast("int"))
    taken = bind(F.struct(doubles.alias("r"), stride.alias("k")), lambda s: F.filter(s["r"], lambda x, i: i % s["k"] == 0))
    return _pad(F.slice(taken, 1, n), n, top)


def _bins(ranges: Column, n: int, width: Callable[[Column], Column], top: float) -> Column:
    doubles = F.transform(ranges, lambda x: x.cast("double"))

    def fill(s: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.coalesce(
                F.when((s["w"] > 0) & (i * s["w"] < F.size(s["r"])), F.array_min(F.slice(s["r"], i * s["w"] + 1, s["w"]))),
                F.lit(top),
            ),
        )

    return bind(F.struct(doubles.alias("r"), width(F.size(ranges)).cast("int").alias("w")), fill)


def bin_min(ranges: Column, n: int = 20, top: float = MAX_RANGE) -> Column:
    """Minimum of each of n bins of ceil(len / n) beams."""
    return _bins(ranges, n, lambda size: F.ceil(size / n), top)


def sector_min(ranges: Column, n: int = 24, top: float = MAX_RANGE) -> Column:
    """Minimum of each of n sectors of len // n beams; the tail is left out."""
    return _bins(ranges, n, lambda size: F.floor(size / n), top)


def gate_scan(ranges: Column, max_points: int = 4096, min_points: int = 50) -> Column:
    """struct(ranges, oversize, usable): truncated frame and its two flags."""
    return bind(
        ranges,
        lambda r: F.struct(
            F.slice(r, 1, max_points).alias("ranges"),
            (F.size(r) > max_points).alias("oversize"),
            (F.size(r) > min_points).alias("usable"),
        ),
    )


def nearest_obstacle(ranges: Column, floor: float = 0.01) -> Column:
    return F.array_min(F.filter(ranges, lambda x: finite(x) & (x > floor))).cast("double")


def danger(nearest: Column, limit: float = 0.35) -> Column:
    return F.coalesce(nearest < limit, F.lit(False))


def _moments(values: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).alias("n"))
    return F.aggregate(
        values,
        start,
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"), (a["n"] + 1).alias("n")),
        lambda a: F.struct(
            (a["s"] / a["n"]).alias("mean"),
            F.sqrt(F.greatest(F.lit(0.0), a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"]))).alias("std"),
        ),
    )


def frame_std(ranges: Column, top: float = MAX_RANGE) -> Column:
    """Population standard deviation with non-finite beams at ``top``."""
    return _moments(F.transform(ranges, lambda x: F.when(finite(x), x.cast("double")).otherwise(F.lit(top))))["std"]


def share_near_max(ranges: Column, top: float = MAX_RANGE) -> Column:
    near = F.filter(ranges, lambda x: ~finite(x) | (x > 0.9 * top))
    return F.size(near) / F.size(ranges)


def scan_quality(ranges: Column, previous: Column, top: float = MAX_RANGE, min_points: int = 50) -> Column:
    """``low_std`` / ``frame_repeat`` / ``mostly_max`` / null, first match wins."""
    return F.when(
        F.size(ranges) > min_points,
        F.when(frame_std(ranges, top) < 0.01, F.lit("low_std"))
        .when(previous.isNotNull() & (ranges == previous), F.lit("frame_repeat"))
        .when(share_near_max(ranges, top) > 0.95, F.lit("mostly_max")),
    )


def frame_diff(previous: Column, current: Column) -> Column:
    """Mean |difference| over pairs finite on both sides; 0.0 where there is none."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    pairs = F.zip_with(
        previous, current, lambda a, b: F.when(finite(a) & finite(b), F.abs(a.cast("double") - b.cast("double")))
    )
    return F.aggregate(
        pairs,
        start,
        lambda a, d: F.when(d.isNull(), a).otherwise(F.struct((a["s"] + d).alias("s"), (a["n"] + 1).alias("n"))),
        lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(F.lit(0.0)),
    )


def obs_bins(ranges: Column, distance: Column, bearing: Column, prev_lin: Column, prev_ang: Column,
             max_lin: float = 0.22, max_ang: float = 1.5, top: float = MAX_RANGE) -> Column:
    """25 numbers: 20 scaled bins, capped distance, bearing and last velocities."""
    bins = F.transform(bin_min(sanitize_ranges(ranges, top), 20, top), lambda x: x / top)
    return F.concat(
        bins,
        F.array(F.least(distance / 4.0, F.lit(1.0)), F.cos(bearing), F.sin(bearing), prev_lin / max_lin, prev_ang / max_ang),
    )


def obs_frame(ranges: Column, distance: Column, bearing: Column, prev_a0: Column, prev_a1: Column, step: Column,
              beams: int = 180, max_steps: int = 500, top: float = MAX_RANGE) -> Column:
    """186 numbers: resampled scaled beams, goal, previous action, time share."""
    lidar = F.transform(resample_beams(sanitize_ranges(ranges, top), beams, top), lambda x: x / top)
    return F.concat(
        lidar,
        F.array(
            F.least(distance / 4.5, F.lit(1.0)), F.cos(bearing), F.sin(bearing),
            prev_a0.cast("double"), prev_a1.cast("double"), (step / max_steps).cast("double"),
        ),
    )
