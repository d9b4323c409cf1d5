"""Behavioural detectors, voting and the alert pipeline over ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.crypto import hmac_sha256
from ..functions.scan import frame_diff, frame_std, gate_scan, share_near_max
from ..functions.text import detector_text
from ..plans.asof import hold
from ..plans.replay import thin
from ..plans.timeline import Timeline
from ..session import checkpointed
from .integrity import sign

# The live limits of the six detectors.
LIN_MAX, ANG_MAX = 0.23, 3.00
DIRECTION_SHARE, DIRECTION_DEAD = 0.15, 0.01
REPEAT_DIFF, STILL_DIFF = 0.005, 0.002
MOVING, FROZEN = 0.05, 0.005
HISTORY, BEAT_TIMEOUT_S, COOLDOWN_S, VOTES = 20, 10.0, 10.0, 2

ORDER = ("recv_ts", "seq")


def physics(cmd: DataFrame, tl: Timeline | None = None, lin_max: float = LIN_MAX, ang_max: float = ANG_MAX) -> DataFrame:
    """D1 per command: a limit broken within the last 5 commands."""
    tl = tl or Timeline.of(cmd, "robot_id", ORDER)

    def build(w):
        last5 = w.rowsBetween(-4, 0)
        return {"max_lin": F.max(F.abs("v_lin")).over(last5), "max_ang": F.max(F.abs("v_ang")).over(last5)}

    return tl.frame(cmd, 4, build).withColumn("d1", F.coalesce(F.col("max_lin") > lin_max, F.lit(False)) | F.coalesce(F.col("max_ang") > ang_max, F.lit(False)))


def direction_conflict(cmd: DataFrame, tl: Timeline | None = None, share: float = DIRECTION_SHARE) -> DataFrame:
    """D2 per command: forward and backward both >= share of the last 20, 10 rows at least."""
    tl = tl or Timeline.of(cmd, "robot_id", ORDER)

    def build(w):
        last = w.rowsBetween(1 - HISTORY, 0)
        return {
            "n20": F.count(F.lit(1)).over(last),
            "fwd": F.count(F.when(F.col("v_lin") > DIRECTION_DEAD, 1)).over(last),
            "bwd": F.count(F.when(F.col("v_lin") < -DIRECTION_DEAD, 1)).over(last),
        }

    judged = tl.frame(cmd, HISTORY - 1, build)
    both = (F.col("fwd") / F.col("n20") >= share) & (F.col("bwd") / F.col("n20") >= share)
    return judged.withColumn("d2", (F.col("n20") >= 10) & both)


def scan_motion(scan: DataFrame, tl: Timeline | None = None, repeat: float = REPEAT_DIFF, min_points: int = 50) -> DataFrame:
    """Per usable frame: ``diff`` to the frame before, ``diff4``/``diff2`` maxima, frame count, D3."""
    tl = tl or Timeline.of(scan, "robot_id", ORDER)
    usable = (
        scan.withColumn("_g", gate_scan(F.col("ranges"), min_points=min_points))
        .where("_g.usable")
        .withColumns({"ranges": F.col("_g.ranges"), "oversize": F.col("_g.oversize")})
        .drop("_g")
    )
    pairs = tl.previous(usable, {"_prev": "ranges"})
    diffs = pairs.withColumn("diff", F.when(F.col("_prev").isNotNull(), frame_diff(F.col("_prev"), F.col("ranges"))))
    diffs = diffs.drop("_prev", "ranges")

    def build(w):
        return {
            "diff4": F.max("diff").over(w.rowsBetween(-3, 0)),
            "diff2": F.max("diff").over(w.rowsBetween(-1, 0)),
            "frames": F.count(F.lit(1)).over(w.rowsBetween(1 - HISTORY, 0)),
        }

    return tl.frame(diffs, HISTORY - 1, build).withColumn("d3", (F.col("frames") >= 5) & (F.col("diff4") < repeat))


def odom_speed(odom: DataFrame, tl: Timeline | None = None) -> DataFrame:
    tl = tl or Timeline.of(odom, "robot_id", ORDER)

    def build(w):
        last = w.rowsBetween(-9, 0)
        return {"speed10": F.avg(F.abs("v_lin")).over(last), "odoms": F.count(F.lit(1)).over(last)}

    return tl.frame(odom, 9, build)


def cmd_mean(cmd: DataFrame, tl: Timeline | None = None) -> DataFrame:
    tl = tl or Timeline.of(cmd, "robot_id", ORDER)

    def build(w):
        last = w.rowsBetween(-4, 0)
        return {"cmd5": F.avg("v_lin").over(last), "cmds": F.count(F.lit(1)).over(last)}

    return tl.frame(cmd, 4, build)


def motion_conflict(moving: float = MOVING, frozen: float = FROZEN, still: float = STILL_DIFF) -> Column:
    """D6 from held metrics: odometry moves while the scan stands, or commands without motion."""
    enough = (F.col("odoms") >= 10) & (F.col("frames") >= 5)
    a = (F.col("speed10") > moving) & (F.coalesce("diff2", F.lit(0.0)) < still)
    b = (F.col("cmds") >= 5) & (F.col("cmd5") > moving) & (F.col("speed10") < frozen)
    return F.coalesce(enough & (a | b), F.lit(False))


def motion_consistency(ticks: DataFrame, cmd: DataFrame, odom: DataFrame, scan: DataFrame, tl: Timeline | None = None,
                       min_points: int = 50, **limits) -> DataFrame:
    """D6 at ticks: three windowed streams held side by side."""
    held = hold(
        ticks,
        [
            (cmd_mean(cmd, tl).withColumnRenamed("seq", "_tie"), "recv_ts", ["cmd5", "cmds"]),
            (odom_speed(odom, tl).withColumnRenamed("seq", "_tie"), "recv_ts", ["speed10", "odoms"]),
            (scan_motion(scan, tl, min_points=min_points).withColumnRenamed("seq", "_tie"), "recv_ts", ["diff2", "frames"]),
        ],
        "robot_id",
        tl,
    )
    return held.withColumn("d6", motion_conflict(**limits))


def heartbeat_gap(ticks: DataFrame, beats: DataFrame, timeout: float = BEAT_TIMEOUT_S, tl: Timeline | None = None) -> DataFrame:
    """D5 at ticks plus the outage number; silent before the first beat."""
    mine = beats.select("robot_id", "recv_ts", F.col("seq").alias("_tie"), F.col("recv_ts").alias("last_beat"))
    held = hold(ticks, [(mine, "recv_ts", ["last_beat"])], "robot_id", tl)
    gap = (F.unix_micros("tick_ts") - F.unix_micros("last_beat")) / 1e6
    return held.withColumn("gap_s", gap).withColumn("d5", F.coalesce(F.col("gap_s") > timeout, F.lit(False)))


def latched(at_ticks: DataFrame, tl: Timeline | None = None) -> DataFrame:
    """Adds ``d5_new``: the first firing tick of each outage (same last beat)."""
    tl = tl.ordered_by("tick_ts") if tl else Timeline.of(at_ticks, "robot_id", "tick_ts")
    seen = tl.previous(at_ticks, {"_d5": "d5", "_beat": "last_beat"})
    again = F.coalesce(F.col("_d5") & (F.col("_beat") == F.col("last_beat")), F.lit(False))
    return seen.withColumn("d5_new", F.col("d5") & ~again).drop("_d5", "_beat")


def beat_cadence(beats: DataFrame, period: float = 2.0, tl: Timeline | None = None, ticks: DataFrame | None = None) -> DataFrame:
    """Beats that the next one, or with ``ticks`` the robot's last tick (``open``), follows by more than two periods."""
    tl = tl or Timeline.of(beats, "robot_id", ORDER)
    seen = _with_end(tl.following(beats, {"until": "recv_ts"}), ticks, "until")
    gap = (F.unix_micros("until") - F.unix_micros("recv_ts")) / 1e6
    late = seen.withColumn("gap_s", gap).where(F.col("gap_s") > 2 * period)
    return late.withColumn("missed", (F.floor(F.col("gap_s") / period) - 1).cast("long"))


def _with_end(rows: DataFrame, ticks: DataFrame | None, column: str) -> DataFrame:
    """``column`` filled with the robot's last tick where it is null, and ``open`` there."""
    if ticks is None:
        return rows.withColumn("open", F.lit(False))
    last = ticks.groupBy("robot_id").agg(F.max("tick_ts").alias("_end"))
    ended = rows.join(last, "robot_id", "left").withColumn("open", F.col(column).isNull())
    return ended.withColumn(column, F.coalesce(column, "_end")).drop("_end")


def silent_scans(scan: DataFrame, limit_s: float = 1.0, tl: Timeline | None = None, ticks: DataFrame | None = None) -> DataFrame:
    """Intervals without a scan for more than ``limit_s``: (robot_id, since, until, gap_s, open).

    With ``ticks`` (robot_id, tick_ts) the silence after a robot's last scan
    counts up to its last tick, as ``open``.
    """
    tl = tl or Timeline.of(scan, "robot_id", ORDER)
    seen = _with_end(tl.following(scan.select("robot_id", *ORDER), {"until": "recv_ts"}), ticks, "until")
    gap = (F.unix_micros("until") - F.unix_micros("recv_ts")) / 1e6
    return seen.select("robot_id", F.col("recv_ts").alias("since"), "until", gap.alias("gap_s"), "open").where(F.col("gap_s") > limit_s)


def vote(at_ticks: DataFrame, detectors=("d1", "d2", "d3", "d4", "d5", "d6"), strong=("d4", "d5"), need: int = VOTES) -> DataFrame:
    """Adds ``votes`` (names), ``verdict``: vote, strong, warning or null."""
    names = F.filter(
        F.array(*[F.when(F.col(d), F.lit(d.upper())) for d in detectors]), lambda n: n.isNotNull()
    )
    alone = F.arrays_overlap("votes", F.array(*[F.lit(s.upper()) for s in strong]))
    verdict = (
        F.when(F.size("votes") >= need, "vote").when(alone, "strong-D4").when(F.size("votes") == 1, "warning")
    )
    return at_ticks.withColumn("votes", names).withColumn("verdict", verdict)


def detector_hits(at_ticks: DataFrame, detectors=("d1", "d2", "d3", "d4", "d5", "d6"), every: str = "5 seconds",
                  tl: Timeline | None = None) -> DataFrame:
    """Per reporting interval: hits and the running total of every detector."""
    sums = [F.count(F.when(F.col(d), 1)).alias(d) for d in detectors]
    per = at_ticks.groupBy("robot_id", F.window("tick_ts", every).alias("_w")).agg(*sums)
    per = per.select("robot_id", F.col("_w.start").alias("window_start"), *detectors)
    tl = tl.ordered_by("window_start") if tl else Timeline.of(per, "robot_id", "window_start")
    return tl.running(per, {f"{d}_total": ("sum", F.col(d)) for d in detectors})


def detections(ticks: DataFrame, cmd: DataFrame, odom: DataFrame, scan: DataFrame, beats: DataFrame,
               publisher_alarms: DataFrame, lin_max: float = LIN_MAX, ang_max: float = ANG_MAX, share: float = DIRECTION_SHARE,
               repeat: float = REPEAT_DIFF, still: float = STILL_DIFF, moving: float = MOVING, frozen: float = FROZEN,
               beat_timeout: float = BEAT_TIMEOUT_S, min_points: int = 50, tl: Timeline | None = None, measures: bool = False) -> DataFrame:
    """All six detectors at every tick; with ``measures`` also what they saw, for :func:`details`.

    Frame metrics are computed per message and carried to ticks by one as-of
    pass; that equals evaluating the buffers at the tick. Robot sizes are
    measured once for every step.
    """
    if tl is None:
        size = [d.select("robot_id", "recv_ts") for d in (cmd, odom, scan)]
        tl = Timeline.of(size[0].unionByName(size[1]).unionByName(size[2]), "robot_id", "recv_ts").ordered_by(*ORDER)
    commands = direction_conflict(cmd_mean(physics(cmd, tl, lin_max, ang_max), tl), tl, share)
    held = hold(
        ticks,
        [
            (commands.withColumnRenamed("seq", "_tie"), "recv_ts", ["d1", "d2", "cmd5", "cmds", *(["max_lin", "max_ang", "fwd", "bwd", "n20"] if measures else [])]),
            (odom_speed(odom, tl).withColumnRenamed("seq", "_tie"), "recv_ts", ["speed10", "odoms"]),
            (scan_motion(scan, tl, repeat, min_points).withColumnRenamed("seq", "_tie"), "recv_ts", ["d3", "diff2", "frames", *(["diff4"] if measures else [])]),
            (beats.select("robot_id", "recv_ts", F.col("seq").alias("_tie"), F.col("recv_ts").alias("last_beat")), "recv_ts", ["last_beat"]),
        ],
        "robot_id",
        tl,
    )
    gap = (F.unix_micros("tick_ts") - F.unix_micros("last_beat")) / 1e6
    no = F.lit(False)
    judged = (
        held.join(publisher_alarms, ["robot_id", "tick_ts"], "left")
        .withColumn("d1", F.coalesce("d1", no))
        .withColumn("d2", F.coalesce("d2", no))
        .withColumn("d3", F.coalesce("d3", no))
        .withColumn("d4", F.col("d4_info").isNotNull())
        .withColumn("d5", F.coalesce(gap > beat_timeout, no))
        .withColumn("d6", motion_conflict(moving, frozen, still))
    )
    return latched(judged, tl)


def details(beat_ts: str = "last_beat") -> Column:
    """One text per voting detector with what it saw, in whole thousandths (micro for scan differences); needs ``measures``."""
    def whole(c: str, scale: int) -> Column:
        return F.coalesce(F.floor(F.col(c) * scale + 1e-6).cast("string"), F.lit("-"))

    gap = F.floor((F.unix_micros("tick_ts") - F.unix_micros(beat_ts)) / 1000).cast("string")
    seen = {
        "D1": F.concat(F.lit("lin="), whole("max_lin", 1000), F.lit(" ang="), whole("max_ang", 1000)),
        "D2": F.concat(F.lit("fwd="), F.col("fwd").cast("string"), F.lit(" bwd="), F.col("bwd").cast("string"), F.lit(" of "), F.col("n20").cast("string")),
        "D3": F.concat(F.lit("diff="), whole("diff4", 1_000_000)),
        "D4": F.col("d4_info"),
        "D5": F.concat(F.lit("silent ms="), gap),
        "D6": F.concat(F.lit("speed="), whole("speed10", 1000), F.lit(" command="), whole("cmd5", 1000), F.lit(" still="), whole("diff2", 1_000_000)),
    }
    texts = F.create_map(*[x for k, v in seen.items() for x in (F.lit(k), F.concat(F.lit(f"{k}["), F.coalesce(v, F.lit("")), F.lit("]")))])
    return F.transform("votes", lambda v: F.element_at(texts, v))


def signed_alerts(at_ticks: DataFrame, key: bytes, cooldown: float = COOLDOWN_S, tl: Timeline | None = None, channel: str = "alerts") -> DataFrame:
    """(robot_id, tick_ts, votes, verdict, payload, raw): emitted alerts, signed, from ``detections`` with ``measures``.

    The nonce is a keyed hash of robot, tick and verdict: a repeated task or a
    replayed trigger signs the same message again, which receivers refuse as a copy.
    """
    seen = ids(at_ticks, cooldown, tl, {"details": details()}).where("emitted")
    text = seen.withColumn("payload", detector_text(F.col("votes"), F.col("details"), F.col("verdict")))
    second = F.floor(F.unix_micros("tick_ts") / 1_000_000)
    nonce = F.substring(hmac_sha256(F.concat_ws("|", "robot_id", F.unix_micros("tick_ts").cast("string"), "verdict"), key), 1, 16)
    return sign(text, key, F.col("payload"), F.lit(channel), second, nonce).select("robot_id", "tick_ts", "votes", "verdict", "payload", "raw")


def ids(at_ticks: DataFrame, cooldown: float = COOLDOWN_S, tl: Timeline | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Latch, vote and cooldown: alert ticks with ``emitted`` true or swallowed, and the columns ``more``.

    The few alert ticks are written once; the cooldown reads them twice.
    """
    voting = vote(at_ticks.withColumn("d5", F.col("d5_new")))
    alerts = voting.where(F.col("verdict").isin("vote", "strong-D4")).withColumn("seq", F.lit(0).cast("long"))
    alerts = checkpointed(alerts.select("robot_id", "tick_ts", "seq", "votes", "verdict", *[c.alias(n) for n, c in (more or {}).items()]))
    tl = tl.ordered_by("tick_ts", "seq") if tl else Timeline.of(alerts, "robot_id", ("tick_ts", "seq"))
    return thin(alerts, tl, cooldown, mark="emitted").drop("seq")


def seen_frames_skipped(scan: DataFrame, tl: Timeline | None = None) -> DataFrame:
    """Frames whose device stamp differs from the frame before."""
    tl = tl or Timeline.of(scan, "robot_id", ORDER)
    return tl.previous(scan, {"_p": "stamp_s"}).where(~F.col("stamp_s").eqNullSafe(F.col("_p"))).drop("_p")


def frame_repeat(scan: DataFrame, tl: Timeline | None = None, min_points: int = 50) -> DataFrame:
    """``repeated``: the frame equals the last accepted one.

    Frames of low spread or mostly at the maximum are never stored; a repeat
    equals what is stored, so the last of the remaining frames is the accepted
    one. Small frames and null ones pass unjudged.
    """
    tl = tl or Timeline.of(scan, "robot_id", ORDER)
    judged = scan.withColumn("_low", (F.size("ranges") > min_points) & (frame_std(F.col("ranges")) < 0.01))
    judged = judged.withColumn("_far", (F.size("ranges") > min_points) & (share_near_max(F.col("ranges")) > 0.95))
    stored = F.when(~F.col("_low") & ~F.col("_far"), F.col("ranges"))
    seen = tl.running(judged, {"_prev": ("last", stored)}, before=True)
    same = F.coalesce(F.col("ranges") == F.col("_prev"), F.lit(False))
    return seen.withColumn("repeated", F.coalesce(same & ~F.col("_low") & (F.size("ranges") > min_points), F.lit(False))).drop("_low", "_far", "_prev")
