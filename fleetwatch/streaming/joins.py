"""Stateless, aggregate and join twins on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import graph as G, integrity as S
from .machines import Cooldown
from .stateful import run_stream


def verify(df: DataFrame, key: bytes, expected: Column, watermark: str = "12 seconds", keys=("receiver", "nonce"),
           max_age: Column | float = S.MAX_AGE_S, skew: float = S.CLOCK_SKEW_S) -> DataFrame:
    """Accepted messages, first copy within the watermark.

    Native and cheap, but the watermark moves between triggers only: a nonce may
    be held longer than its time to live, never shorter. ``first_copies`` after
    ``inspect`` gives the exact rule.
    """
    seen = S.inspect(df, key, expected, max_age, skew).where(F.col("reject_reason").isNull())
    return seen.withWatermark("recv_ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def first_copies(seen: DataFrame, keys=("receiver", "nonce"), ttl: float = S.REPLAY_TTL_S, watermark: str = "12 seconds") -> DataFrame:
    """C6 exactly, one state per nonce that lives for ``ttl``: (*keys, t, seq)."""
    ok = seen.where(F.col("reject_reason").isNull())
    return run_stream(ok, keys, "recv_ts", Cooldown(ttl), watermark, idle_s=ttl)


def refused(df: DataFrame, key: bytes, expected: Column, **limits) -> DataFrame:
    return S.inspect(df, key, expected, **limits).where(F.col("reject_reason").isNotNull())


def impostors(accepted: DataFrame, own: DataFrame, watermark: str = "12 seconds") -> DataFrame:
    """Accepted messages without a nonce of ours within the watermark.

    Both sides are bounded in time: (nonce, recv_ts) and (nonce, sent_ts).
    """
    left = accepted.withWatermark("recv_ts", watermark).alias("m")
    right = own.select(F.col("nonce").alias("own_nonce"), "sent_ts").withWatermark("sent_ts", watermark).alias("o")
    near = (F.col("m.nonce") == F.col("o.own_nonce")) & (
        F.col("o.sent_ts").between(F.col("m.recv_ts") - F.expr(f"interval {watermark}"), F.col("m.recv_ts") + F.expr(f"interval {watermark}"))
    )
    return left.join(right, near, "left_outer").where(F.col("own_nonce").isNull()).drop("own_nonce", "sent_ts")


def publisher_multiplicity(publishers: DataFrame, watermark: str = "5 seconds", topics=G.WATCHED_TOPICS) -> DataFrame:
    """D6 per tick once the watermark has passed it."""
    return G.publisher_multiplicity(publishers.withWatermark("tick_ts", watermark), topics)


def snapshot_totals(snapshots: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """F8: live nodes per poll; snapshots list each node once."""
    timed = snapshots.withWatermark("poll_ts", watermark)
    return timed.groupBy("robot_id", "poll_seq", "poll_ts").agg(F.count(F.lit(1)).alias("live_nodes"))


def detector_hits(at_ticks: DataFrame, detectors=("d1", "d2", "d3", "d4", "d5", "d6"), every: str = "5 seconds",
                  watermark: str = "5 seconds") -> DataFrame:
    """F2 per interval; running totals belong to the reader of the table."""
    sums = [F.count(F.when(F.col(d), 1)).alias(d) for d in detectors]
    per = at_ticks.withWatermark("tick_ts", watermark).groupBy("robot_id", F.window("tick_ts", every).alias("_w")).agg(*sums)
    return per.select("robot_id", F.col("_w.start").alias("window_start"), *detectors)


def episode_rollup(steps: DataFrame, watermark: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """F5 for steps with ``step_ts``; an episode lies within one interval."""
    timed = steps.withWatermark("step_ts", watermark)
    return timed.groupBy("run_id", "episode", F.window("step_ts", every)).agg(
        F.sum("reward").alias("reward"), F.count(F.lit(1)).alias("steps"), F.max_by("event", "step").alias("event")
    ).drop("window")


def outcomes(episodes: DataFrame) -> DataFrame:
    """F10, in complete or update mode."""
    return episodes.groupBy("run_id", "event").agg(F.count(F.lit(1)).alias("episodes"))
