"""As-of: the value every stream holds at each tick, in one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .timeline import Timeline

DAY = 86_400_000_000


def make_ticks(df: DataFrame, key: str, ts: str, every_s: float) -> DataFrame:
    """Regular ticks per key from its first to its last row.

    The grid is the multiples of ``every_s`` since the epoch. Days are exploded
    before ticks, so no array outgrows one day.
    """
    step = int(every_s * 1_000_000)
    span = max(step, DAY // step * step)
    us = F.unix_micros(ts)
    ends = df.groupBy(key).agg(
        (F.floor(F.min(us) / step) * step).alias("_a"), (F.ceil(F.max(us) / step) * step).alias("_b")
    )
    days = ends.select(key, "_b", F.explode(F.sequence("_a", "_b", F.lit(span))).alias("_d"))
    return days.select(
        key,
        F.explode(F.sequence("_d", F.least(F.col("_b"), F.col("_d") + span - step), F.lit(step))).alias("_t"),
    ).select(key, F.timestamp_micros("_t").alias("tick_ts"))


def hold(ticks: DataFrame, streams: list[tuple[DataFrame, str, list[str]]], key: str, timeline: Timeline | None = None) -> DataFrame:
    """For each tick the latest values at or before it.

    ``streams`` holds ``(rows, time column, value columns)``; value columns must
    differ between streams. At equal time the message counts before the tick.
    Rows of one stream with the same time must be told apart by the caller
    (``_tie``), else the winner is arbitrary.
    """
    names = [c for _, _, cols in streams for c in cols]
    tick_cols = [c for c in ticks.columns if c not in (key, "tick_ts")]
    line = ticks.select(key, F.col("tick_ts").alias("_at"), F.lit(1).alias("_tick"), F.lit(0).cast("long").alias("_tie"), *tick_cols)
    for rows, ts, cols in streams:
        tie = F.col("_tie").cast("long") if "_tie" in rows.columns else F.lit(0).cast("long")
        line = line.unionByName(
            rows.select(key, F.col(ts).alias("_at"), F.lit(0).alias("_tick"), tie.alias("_tie"), *cols),
            allowMissingColumns=True,
        )
    tl = timeline.ordered_by("_at", "_tick", "_tie") if timeline else Timeline.of(line, key, ("_at", "_tick", "_tie"))
    held = tl.running(line, {f"_h_{c}": ("last", F.col(c)) for c in names})
    return held.where("_tick = 1").select(
        key, F.col("_at").alias("tick_ts"), *tick_cols, *[F.col(f"_h_{c}").alias(c) for c in names]
    )
