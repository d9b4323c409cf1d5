"""Planar geometry, goal bearings, sector clearance and command rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .scan import bind, finite


def planar_accel(ax: Column, ay: Column) -> Column:
    return F.hypot(ax, ay)


def yaw_from_quat(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))


def wrap_angle(a: Column) -> Column:
    """To [-pi, pi]; exactly +-pi stays as it is."""
    turns = F.ceil((F.abs(a) - F.lit(math.pi)) / (2 * math.pi))
    return F.when(a > math.pi, a - 2 * math.pi * turns).when(a < -math.pi, a + 2 * math.pi * turns).otherwise(a)


def goal_distance(x: Column, y: Column, gx: Column, gy: Column) -> Column:
    return F.hypot(gx - x, gy - y)


def goal_bearing(x: Column, y: Column, yaw: Column, gx: Column, gy: Column) -> Column:
    return bind(F.atan2(gy - y, gx - x) - yaw, wrap_angle)


def in_bounds(x: Column, y: Column, r: float = 2.5) -> Column:
    return x.between(-r, r) & y.between(-r, r)


def grid_cell(v: Column, n: int = 12, low: float = -2.5, high: float = 2.5) -> Column:
    """Grid index, truncated toward zero and clamped."""
    return F.least(F.greatest(((v - low) / (high - low) * n).cast("int"), F.lit(0)), F.lit(n - 1))


def forward_beam(angle_min: Column, increment: Column, n: Column) -> Column:
    """Index of the beam straight ahead; halves round to even."""
    return F.greatest(F.lit(0), F.least(n - 1, F.bround(-angle_min / increment).cast("int")))


def sector_clearance(ranges: Column, angle_min: Column, increment: Column, ccw_deg: float, cw_deg: float) -> Column:
    """Minimum over the circular slice from cw to ccw around the forward beam."""

    def sector(s: Column) -> Column:
        return F.array_min(
            F.transform(
                F.sequence(-s["cw"], s["ccw"]),
                lambda k: F.element_at(s["r"], (F.pmod(s["f"] + k, F.size(s["r"])) + 1).cast("int")),
            )
        ).cast("double")

    packed = F.struct(
        ranges.alias("r"),
        forward_beam(angle_min, increment, F.size(ranges)).alias("f"),
        F.bround(F.lit(math.radians(ccw_deg)) / increment).cast("int").alias("ccw"),
        F.bround(F.lit(math.radians(cw_deg)) / increment).cast("int").alias("cw"),
    )
    return F.when(F.size(ranges) > 0, bind(packed, sector)).otherwise(F.lit(9.9))


def expected_command(bearing: Column, front: Column, left: Column, right: Column, max_lin: float = 0.12,
                     max_ang: float = 0.8, gain: float = 1.2, align_deg: float = 25.0, stop: float = 0.19,
                     slow: float = 0.35) -> Column:
    """struct(v, w) the patrol rule asks for: rotate, blocked, slow zone or cruise."""

    def clip(w: Column) -> Column:
        return F.least(F.greatest(w, F.lit(-max_ang)), F.lit(max_ang))

    turn = clip(bearing * gain)
    side = F.when(left > right, F.lit(1.0)).otherwise(F.lit(-1.0))
    ratio = (front - stop) / (slow - stop)
    rotate, blocked, near = F.abs(bearing) > math.radians(align_deg), front <= stop, front < slow
    v = F.when(rotate | blocked, 0.0).when(near, ratio * max_lin).otherwise(max_lin)
    w = F.when(rotate, turn).when(blocked, side * max_ang).when(near, clip(turn + side * (0.4 * max_ang) * (1 - ratio))).otherwise(turn)
    return F.struct(v.alias("v"), w.alias("w"))


def scale_action(action: Column, max_lin: Column, max_ang: Column) -> Column:
    """struct(lin, ang) for a two-number action; null where a number is not finite."""

    def unit(i: int) -> Column:
        return F.least(F.greatest(F.get(action, F.lit(i)).cast("double"), F.lit(-1.0)), F.lit(1.0))

    return F.when(
        F.forall(action, finite),
        F.struct(((unit(0) + 1.0) / 2.0 * max_lin).alias("lin"), (unit(1) * max_ang).alias("ang")),
    )
