"""Episode flags, path-weighted success and the three logged reward rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def spl(event: Column, optimal: Column, path: Column) -> Column:
    return F.when(event == "all_done", optimal / F.greatest(optimal, path, F.lit(1e-6))).otherwise(F.lit(0.0))


def final_event(event: Column, step: Column, max_steps: int = 500) -> Column:
    """A step-limit end is a timeout when nothing else happened."""
    return F.when((event == "running") & (step >= max_steps), F.lit("timeout")).otherwise(event)


def episode_flags(event: Column) -> Column:
    return F.struct(
        (event == "collision").alias("collision"),
        (event == "all_done").alias("success"),
        (event == "timeout").alias("timeout"),
    )


def reward_shaped(event: Column, prev_dist: Column, dist: Column, action_change2: Column, gamma: float = 0.99,
                  smooth: float = 0.05, time: float = 0.005) -> Column:
    """Potential shaping with action smoothing (rule v2)."""
    return (
        F.when(event == "collision", F.lit(-100.0))
        .when(event.isin("waypoint", "all_done"), F.lit(100.0))
        .when(event == "scan_timeout", F.lit(0.0))
        .otherwise(gamma * (-dist) + prev_dist - smooth * action_change2 - time)
    )


def reward_progress(event: Column, lin: Column, ang: Column, nearest: Column, prev_dist: Column, dist: Column) -> Column:
    """Progress with obstacle penalty (rule v1); stops and timeouts count as -100."""
    return (
        F.when(event.isin("collision", "scan_timeout", "security_stop"), F.lit(-100.0))
        .when(event.isin("waypoint", "all_done"), F.lit(100.0))
        .otherwise(
            lin - F.abs(ang) / 2.0 - F.greatest(F.lit(0.0), 1.35 - nearest) / 2.0 + 10.0 * (prev_dist - dist)
        )
    )


def visit_bonus(prior_visits: Column) -> Column:
    return 2.0 / (1.0 + 0.3 * prior_visits)


def reward_explore(nearest: Column, ang: Column, prior_visits: Column, hit: float = 0.18, near: float = 0.30,
                   far: float = 0.80, best: float = 0.50) -> Column:
    """Distance zones plus exploration (rule v0)."""
    t = (nearest - near) / (far - near)
    peak = (best - near) / (far - near)
    hill = 2.0 * F.greatest(F.lit(0.0), 1.0 - ((t - peak) / max(1.0 - peak, peak)) * ((t - peak) / max(1.0 - peak, peak)))
    zone = F.when(nearest < near, -3.0 * (1.0 - (nearest - hit) / (near - hit))).when(nearest < far, hill).otherwise(F.lit(0.0))
    return F.when(nearest <= hit, F.lit(-50.0)).otherwise(1.0 - 0.5 * F.abs(ang) / 1.5 + zone + visit_bonus(prior_visits))
