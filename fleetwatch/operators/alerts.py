"""Alert thinning, bursts, notification and the batch side of the alert machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import burst_text
from ..plans.asof import hold
from ..plans.replay import replay, thin
from ..plans.timeline import Timeline
from ..session import checkpointed
from .machines import MissionMode, PatrolPause, StuckWatch, TrainingGuard

ORDER = ("recv_ts", "seq")


def cooldown(df: DataFrame, keys=("robot_id",), seconds: float = 10.0, strict: bool = False, order=ORDER,
             mark: str | None = None) -> DataFrame:
    """Rows at least (``strict``: more than) ``seconds`` after the last kept one."""
    return thin(df, Timeline.of(df, keys, order), seconds, strict, mark)


def merge_alerts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def burst_summary(alerts: DataFrame, starts: DataFrame | None = None, window_s: int = 30, cap: int = 256, shown: int = 10) -> DataFrame:
    """(robot_id, window_start, total, listed, overflow, names, summary) per tumbling window.

    Windows count from ``starts`` (robot_id, started), or from the epoch. Up to
    ``cap`` alerts are listed and the rest is counted as overflow, so no list
    outgrows ``shown`` names. Rows are (robot_id, recv_ts, seq, node, is_exit).
    """
    us = F.unix_micros("recv_ts")
    origin = F.lit(0).cast("long")
    rows = alerts
    if starts is not None:
        # a robot without a start counts from its first alert
        first = alerts.groupBy("robot_id").agg(F.min(us).alias("_f"))
        begun = starts.groupBy("robot_id").agg(F.min(F.unix_micros("started")).alias("_o"))
        begun = first.join(begun, "robot_id", "left").select("robot_id", F.coalesce("_o", "_f").alias("_o"))
        rows = alerts.join(begun, "robot_id")
        origin = F.col("_o")
    width = int(window_s * 1_000_000)
    rows = rows.withColumn("_w", F.floor((us - origin) / width) * width + origin)
    rows = rows.withColumn("node", F.when(F.col("is_exit"), F.concat(F.lit("(exit) "), "node")).otherwise(F.col("node")))
    # Exit alerts are always listed; of the join alerts only the first ``cap``
    # are. Ranks up to ``shown`` are enough to find the names, counts the rest.
    ahead = W.partitionBy("robot_id", "_w").orderBy(*ORDER)
    first = rows.withColumn("_r", F.row_number().over(ahead)).where(F.col("_r") <= shown)
    names = first.groupBy("robot_id", "_w").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "node"))), lambda n: n["node"]).alias("names")
    )
    total = F.count(F.lit(1))
    joins = F.count(F.when(~F.col("is_exit"), 1))
    sizes = rows.groupBy("robot_id", "_w").agg(
        total.alias("total"), F.greatest(joins - cap, F.lit(0)).alias("overflow")
    )
    out = sizes.join(names, ["robot_id", "_w"]).withColumn("listed", F.col("total") - F.col("overflow"))
    return out.select(
        "robot_id", F.timestamp_micros("_w").alias("window_start"), "total", "listed", "overflow", "names",
        burst_text(F.col("total"), F.col("names"), F.col("listed"), F.col("overflow"), window_s, shown).alias("summary"),
    )


def notify(alerts: DataFrame, window_s: int = 30, limit_s: float = 15.0, cap: int = 256, shown: int = 10, starts: DataFrame | None = None) -> DataFrame:
    """Leading edge at once, the rest in bursts: (robot_id, sent_ts, kind, total, rate_limited).

    Bursts count from ``starts`` (robot_id, started), or from the epoch. A summary is sent at the end of its window. ``rate_limited`` marks what the
    push limit would swallow.
    """
    tl = Timeline.of(alerts, "robot_id", ORDER)
    edge = checkpointed(thin(alerts, tl, window_s, mark="_edge"))
    now = edge.where("_edge").select("robot_id", F.col("recv_ts").alias("sent_ts"), F.lit("immediate").alias("kind"),
                                     F.lit(1).cast("long").alias("total"), "seq")
    late = burst_summary(edge.where("not _edge"), starts, window_s, cap, shown).select(
        "robot_id", F.timestamp_micros(F.unix_micros("window_start") + window_s * 1_000_000).alias("sent_ts"),
        F.lit("summary").alias("kind"), "total", F.lit(-1).cast("long").alias("seq"),
    )
    sent = now.unionByName(late)
    kept = thin(sent, tl.ordered_by("sent_ts", "seq"), limit_s, mark="_kept")
    return kept.select("robot_id", "sent_ts", "kind", "total", (~F.col("_kept")).alias("rate_limited"))


def _machine(df: DataFrame, machine, key="robot_id", order=ORDER) -> DataFrame:
    return replay(df, Timeline.of(df, key, order), machine)


def patrol_pause(alerts: DataFrame, **limits) -> DataFrame:
    """One row per alert: pause, counted or quiet, with the pause it belongs to."""
    return _machine(alerts, PatrolPause(**limits))


def pause_intervals(actions: DataFrame, pause_s: float = 30) -> DataFrame:
    """(robot_id, pause_start, pause_end, alerts_during, escalated) from ``patrol_pause``."""
    return (
        actions.where("pause_start is not null")
        .groupBy("robot_id", "pause_start")
        .agg(F.count(F.when(F.col("action") == "counted", 1)).alias("alerts_during"), F.bool_or("escalated").alias("escalated"))
        .withColumn("pause_end", F.col("pause_start") + int(pause_s * 1_000_000))
    )


def mission_mode(rows: DataFrame, **limits) -> DataFrame:
    return _machine(rows, MissionMode(**limits))


def training_guard(rows: DataFrame, **limits) -> DataFrame:
    return _machine(rows, TrainingGuard(**limits))


def stuck_events(odom: DataFrame, gotos: DataFrame | None = None, pauses: DataFrame | None = None, **limits) -> DataFrame:
    """(robot_id, t, stuck_no, turn) from (robot_id, recv_ts, seq, x, y, arrived).

    ``gotos`` (robot_id, recv_ts, seq) are accepted targets: the count starts over. ``pauses`` (robot_id, pause_start,
    pause_end in microseconds, as from ``pause_intervals``) hold the patrol; where they overlap the latest end counts.
    Rows without a position are passed over.
    """
    if gotos is None and pauses is None:
        return _machine(odom, StuckWatch(**limits))
    line = patrol_line(odom, gotos, pauses)
    return _machine(line, StuckWatch(events=True, **limits), order=("recv_ts", "rank", "seq"))


def patrol_line(odom: DataFrame, gotos: DataFrame | None = None, pauses: DataFrame | None = None) -> DataFrame:
    """Positions, targets, pauses and resumes in one order: (robot_id, recv_ts, rank, seq, x, y, arrived, kind).

    At equal time a resume comes before a pause, both before targets, these before positions. A resume is left out if
    another pause still lasts: the running latest end of the pauses before decides.
    """
    line = odom.select("robot_id", "recv_ts", F.lit(3).alias("rank"), "seq", "x", "y", "arrived", F.lit("odom").alias("kind"))
    none = [F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(False).alias("arrived")]
    if gotos is not None:
        line = line.unionByName(gotos.select("robot_id", "recv_ts", F.lit(2).alias("rank"), "seq", *none, F.lit("goto").alias("kind")))
    if pauses is not None:
        # united intervals: one begins where no pause before lasts to its start
        tl = Timeline.of(pauses, "robot_id", ("pause_start", "pause_end"))
        seen = tl.running(pauses.select("robot_id", "pause_start", "pause_end"), {"_until": ("max", F.col("pause_end"))}, before=True)
        first = F.col("_until").isNull() | (F.col("pause_start") > F.col("_until"))
        starts = seen.where(first).select("robot_id", F.col("pause_start").alias("_at"), F.lit(1).alias("rank"), F.lit("pause").alias("kind"))
        following = tl.following(tl.running(seen.withColumn("_first", first), {"_end": ("max", F.col("pause_end"))}), {"_next": "_first"})
        ends = following.where(F.coalesce("_next", F.lit(True))).select("robot_id", F.col("_end").alias("_at"), F.lit(0).alias("rank"), F.lit("resume").alias("kind"))
        both = starts.unionByName(ends)
        line = line.unionByName(both.select("robot_id", F.timestamp_micros("_at").alias("recv_ts"), "rank", F.lit(0).cast("long").alias("seq"), *none, "kind"))
    return line


def security_status(alerts: DataFrame, ticks: DataFrame, timeout_s: float = 30.0, calm: str = "OK") -> DataFrame:
    """Alert text held at ticks, cleared when older than ``timeout_s``.

    Alert rows are (robot_id, recv_ts, seq, status).
    """
    mine = alerts.select("robot_id", "recv_ts", F.col("seq").alias("_tie"),
                         F.struct(F.col("recv_ts").alias("at"), "status").alias("_alert"))
    held = hold(ticks, [(mine, "recv_ts", ["_alert"])], "robot_id")
    age = (F.unix_micros("tick_ts") - F.unix_micros("_alert.at")) / 1e6
    status = F.when(age <= timeout_s, F.col("_alert.status")).otherwise(F.lit(calm))
    return held.withColumn("status", status).drop("_alert")
