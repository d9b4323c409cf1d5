"""A stream in several micro-batches gives what the batch gives."""

import random
import tempfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fleetwatch.catalog import detector_queries as Q, inputs as I, message_queries as M
from fleetwatch.operators import alerts as A, detectors as D, episodes as E, graph as G, integrity as S
from fleetwatch.operators.machines import MissionMode, PatrolPause, StuckWatch, TrainingGuard, VisitProgress
from fleetwatch.streaming import joins as J, machines as SM
from fleetwatch.streaming.stateful import run_stream

SF = "/root/testdata/sf0.001"
HOUR = 3600


def feed(spark, df, by, parts=3):
    """The rows as a file stream, cut in time order."""
    path = tempfile.mkdtemp(prefix="/tmp/run-")
    us = F.unix_micros(by)
    lo, hi = df.agg(F.min(us), F.max(us)).first()
    width = (hi - lo) // parts + 1
    for i in range(parts):
        df.where((us >= lo + i * width) & (us < lo + (i + 1) * width)).coalesce(1).write.parquet(f"{path}/in/part={i}")
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in"),
        path,
    )


def drain(spark, stream, path, mode="append"):
    name = "out_" + path.rsplit("-", 1)[1].replace("_", "x")
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def lines(df, *cols):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark):
    return I.events(spark, SF).cache()


MACHINES = {
    "pause": (PatrolPause(12 * HOUR, 96 * HOUR, 2, 72 * HOUR), lambda e: e.where("event_type = 'error'"), ("t", "action", "escalated")),
    "mission": (
        MissionMode(8 * HOUR, 240 * HOUR),
        lambda e: e.withColumn("kind", F.when(F.col("event_type") == "error", "alert").when(F.col("event_type") == "view", "tick").otherwise("sensor")).withColumn("danger", F.col("k") < 35),
        ("t", "mode", "cause", "escalated"),
    ),
    "guard": (
        TrainingGuard(60 * HOUR, 3, 60 * HOUR),
        lambda e: e.withColumn("kind", F.when(F.col("event_type") == "signup", "reset").otherwise("alert")),
        ("t", "action"),
    ),
    "stuck": (
        StuckWatch(60, 8 * HOUR, 5 * HOUR),
        lambda e: e.select("robot_id", "recv_ts", "seq", F.col("value").alias("x"), F.col("k").cast("double").alias("y"), (F.col("event_type") == "signup").alias("arrived")),
        ("t", "stuck_no", "turn"),
    ),
}


@pytest.mark.parametrize("name", list(MACHINES))
def test_machines(spark, events, name):
    machine, prepare, cols = MACHINES[name]
    rows = prepare(events)
    stream, path = feed(spark, rows, "recv_ts")
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", machine, "1 hour"), path)
    assert lines(got, "robot_id", *cols) == lines(A._machine(rows, machine), "robot_id", *cols)


def test_command_windows(spark, events):
    stream, path = feed(spark, events, "recv_ts")
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.LastRows(), "1 hour"), path)
    want = D.cmd_mean(D.odom_speed(D.direction_conflict(D.physics(events))))
    cols = ("seq", "max_lin", "max_ang", "d1", "d2", "cmd5", "speed10")
    assert lines(got, *cols) == lines(want, *cols)


def test_scan_motion(spark):
    scans = I.repeated_scans(spark, SF)
    stream, path = feed(spark, scans, "recv_ts")
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.ScanMotion(), "1 hour"), path)
    cols = ("seq", "diff", "diff4", "diff2", "frames", "d3")
    assert lines(got, *cols) == lines(D.scan_motion(scans), *cols)


@pytest.mark.parametrize("strict", [False, True])
def test_cooldown(spark, events, strict):
    stream, path = feed(spark, events, "recv_ts")
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.Cooldown(20 * HOUR, strict), "1 hour", idle_s=20 * HOUR), path)
    assert lines(got, "seq") == lines(A.cooldown(events, seconds=20 * HOUR, strict=strict), "seq")


def test_all_detectors(spark, events):
    ticks = I.ticks(spark, SF)
    alarm = G.publisher_alarm(Q.tick_publishers(spark, SF), I.topic_allow(spark, SF), I.EVENT_TOPICS)
    limits = dict(lin_max=0.9, ang_max=4.5, share=0.45, beat_timeout=172800)
    beats, scans = Q.beats(spark, SF), Q.timed_scans(spark, SF)
    det = D.detections(ticks, events, events, scans, beats, alarm, **limits)
    want = D.vote(det.withColumn("all5", F.col("d5")).withColumn("d5", F.col("d5_new")))
    want = want.withColumn("t", F.unix_micros("tick_ts")).withColumn("d5", F.col("all5")).withColumn("votes", F.array_join("votes", ","))
    sent = D.ids(det, 86400).where("emitted").select("robot_id", F.unix_micros("tick_ts").alias("t"))

    def kind(df, name, ts="recv_ts", **cols):
        empty = {"a": "double", "b": "double", "ranges": "array<double>", "info": "string"}
        filled = [cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items()]
        seq = F.col("seq") if "seq" in df.columns else F.lit(0).cast("long")
        return df.select("robot_id", F.col(ts).alias("recv_ts"), F.lit(int(name == "tick")).alias("late"), seq.alias("seq"), F.lit(name).alias("kind"), *filled)

    rows = kind(events, "cmd", a=F.col("v_lin"), b=F.col("v_ang"))
    for part in (
        kind(events, "odom", a=F.col("v_lin")), kind(scans, "scan", ranges=F.col("ranges")), kind(beats, "beat"),
        kind(alarm, "alarm", "tick_ts", info=F.col("d4_info")), kind(ticks, "tick", "tick_ts"),
    ):
        rows = rows.unionByName(part)
    stream, path = feed(spark, rows, "recv_ts")
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.Detectors(cooldown=86400, **limits), "1 hour", order=("late", "seq")), path).cache()
    cols = ("robot_id", "t", "d1", "d2", "d3", "d4", "d5", "d6", "votes", "verdict")
    assert lines(got, *cols) == lines(want, *cols)
    assert lines(got.where("emitted"), "robot_id", "t") == lines(sent, "robot_id", "t")


def test_node_monitor(spark):
    snaps = I.snapshots(spark, SF)
    listed = I.whitelist(spark, SF).select(F.concat(F.lit("/ns/"), "name").alias("node"), F.lit(True).alias("listed"))
    rows = snaps.join(listed, "node", "left").select("robot_id", "poll_ts", "node", F.coalesce("listed", F.lit(False)).alias("listed"))
    closing = snaps.select("robot_id").distinct().select("robot_id", F.timestamp_seconds(F.lit(1800000000)).alias("poll_ts"), F.lit("/ns/u0").alias("node"), F.lit(True).alias("listed"))
    stream, path = feed(spark, rows, "poll_ts")
    end = f"{path}/in/part=9"
    closing.coalesce(1).write.parquet(end)
    got = drain(spark, run_stream(stream, "robot_id", "poll_ts", SM.NodeMonitor(100 * HOUR), "1 hour", order=("node",)), path)
    want = G.node_monitor(snaps, I.whitelist(spark, SF), 100 * HOUR).withColumn("t", F.unix_micros("poll_ts"))
    cols = ("robot_id", "t", "node", "alert", "live_nodes")
    assert lines(got, *cols) == lines(want, *cols)


def test_notify(spark):
    rows = M.node_alerts(spark, SF)
    closing = rows.select("robot_id").distinct().select("robot_id", F.timestamp_seconds(F.lit(1800000000)).alias("recv_ts"), F.lit(10**9).alias("seq"), F.lit("/end").alias("node"), F.lit(False).alias("is_exit"))
    stream, path = feed(spark, rows, "recv_ts")
    closing.select(*rows.columns).coalesce(1).write.parquet(f"{path}/in/part=9")
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.Notify(2 * HOUR, HOUR), "1 hour"), path)
    want = A.notify(rows, 2 * HOUR, HOUR).withColumn("t", F.unix_micros("sent_ts"))
    cols = ("robot_id", "t", "kind", "total", "rate_limited")
    assert lines(got.where("t < 1800000000000000"), *cols) == lines(want, *cols)


def test_verified_messages(spark):
    rows = M.envelopes(spark, SF).cache()
    want = S.verify(rows, I.KEY, F.col("topic")).where("reject_reason is null").cache()
    stream, path = feed(spark, rows, "recv_ts")
    got = drain(spark, J.first_copies(S.inspect(stream, I.KEY, F.col("topic"))), path)
    assert lines(got, "seq") == lines(want, "seq")
    stream, path = feed(spark, rows, "recv_ts", parts=2)
    cheap = drain(spark, J.verify(stream, I.KEY, F.col("topic")), path)
    missed = want.join(cheap, "seq", "left_anti")
    assert cheap.join(want, "seq", "left_anti").isEmpty()
    assert missed.join(cheap, ["receiver", "nonce"], "left_anti").isEmpty()  # only copies, held longer


def test_refusal_reports(spark):
    rows = S.verify(M.envelopes(spark, SF), I.KEY, F.col("topic")).where("reject_reason is not null").select("receiver", "recv_ts", "seq", "reject_reason").cache()
    stream, path = feed(spark, rows, "recv_ts")
    got = drain(spark, run_stream(stream, "receiver", "recv_ts", SM.Reports(10 * HOUR), "1 hour"), path)
    want = S.rejections(rows, 10 * HOUR).withColumn("t", F.unix_micros("report_ts"))
    assert lines(got, "receiver", "t", "refused") == lines(want, "receiver", "t", "refused")


def test_gaps_and_skips(spark, events):
    stamped = events.withColumn("stamp_s", F.floor(F.col("k") / 50).cast("double"))
    stream, path = feed(spark, stamped, "recv_ts")
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.skip_seen(), "1 hour"), path)
    want = D.seen_frames_skipped(stamped).withColumn("t", F.unix_micros("recv_ts"))
    assert lines(got, "robot_id", "t", "stamp_s") == lines(want, "robot_id", "t", "stamp_s")
    stream, path = feed(spark, events, "recv_ts")
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.silence(10 * HOUR), "1 hour"), path)
    want = D.silent_scans(events, 10 * HOUR).select("robot_id", F.unix_micros("since").alias("since"), F.unix_micros("until").alias("until"))
    assert lines(got, "robot_id", "since", "until") == lines(want, "robot_id", "since", "until")


def test_silence_is_reported_by_timer(spark):
    rows = spark.createDataFrame([("a", 1000, 0), ("b", 1000, 1), ("b", 1100, 2), ("b", 1101, 3), ("c", 1290, 4)], "robot_id string, s long, seq long")
    rows = rows.select("robot_id", F.timestamp_seconds("s").alias("recv_ts"), "seq")
    stream, path = feed(spark, rows, "recv_ts", parts=3)
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.Silence(), "1 second", idle_s=10), path)
    assert ("a", 1000000000) in lines(got, "robot_id", "since")


def test_curriculum_and_visits(spark):
    ep = I.episodes(spark, SF).withColumn("recv_ts", F.timestamp_micros("day")).withColumn("seq", F.col("episode"))
    stream, path = feed(spark, ep.select("run_id", "recv_ts", "seq", "success"), "recv_ts")
    got = drain(spark, run_stream(stream, "run_id", "recv_ts", SM.Curriculum(promote=0.4), "400 days"), path)
    want = E.curriculum(ep, promote=0.4, order=("day", "episode"))
    assert lines(got, "run_id", "seq", "stage", "promoted") == lines(want, "run_id", "seq", "stage", "promoted")


def test_tick_aggregates(spark):
    pubs = I.publishers(spark, SF).cache()
    stream, path = feed(spark, pubs, "tick_ts")
    end = pubs.limit(1).withColumn("tick_ts", F.timestamp_seconds(F.lit(1800000000)))
    end.coalesce(1).write.parquet(f"{path}/in/part=9")
    got = drain(spark, J.publisher_multiplicity(stream, "1 day", I.EVENT_TOPICS), path)
    want = G.publisher_multiplicity(pubs, I.EVENT_TOPICS)
    cols = ("robot_id", "tick_ts", "topic", "publishers")
    assert lines(got, *cols) == lines(want, *cols)


def test_frame_repeat_and_status(spark, events):
    scans = Q.shaped(spark, SF)
    stream, path = feed(spark, scans, "recv_ts")
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.FrameRepeat(), "1 hour"), path)
    assert lines(got, "seq", "repeated") == lines(D.frame_repeat(scans), "seq", "repeated")

    alerts = events.where("event_type = 'error'").withColumn("status", F.col("props"))
    ticks = I.ticks(spark, SF)
    want = A.security_status(alerts, ticks, 86400).select("robot_id", F.unix_micros("tick_ts").alias("t"), "status")
    rows = alerts.select("robot_id", "recv_ts", F.lit(0).alias("late"), "seq", F.lit("alert").alias("kind"), "status").unionByName(
        ticks.select("robot_id", F.col("tick_ts").alias("recv_ts"), F.lit(1).alias("late"), F.lit(0).cast("long").alias("seq"), F.lit("tick").alias("kind"), F.lit(None).cast("string").alias("status"))
    )
    stream, path = feed(spark, rows, "recv_ts")
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.SecurityStatus(86400), "1 hour", order=("late", "seq")), path)
    assert lines(got, "robot_id", "t", "status") == lines(want, "robot_id", "t", "status")


def test_impostors(spark):
    base = spark.range(40).select(F.lit("a").alias("receiver"), F.timestamp_seconds(1000 + F.col("id") * 5).alias("recv_ts"), F.col("id").cast("string").alias("nonce"))
    own = base.where("nonce % 3 != 0").select("nonce", F.col("recv_ts").alias("sent_ts"))
    left, path = feed(spark, base, "recv_ts")
    right, _ = feed(spark, own, "sent_ts")
    got = drain(spark, J.impostors(left, right), path)
    seen = {int(r.nonce) for r in got.collect()}
    assert seen <= set(range(0, 40, 3)) and {0, 3, 6} <= seen  # the newest still wait for the watermark


def test_sinks(spark, events):
    from fleetwatch.sources.sinks import stream_batches, stream_table

    rows = events.select("robot_id", "recv_ts", "seq")
    stream, path = feed(spark, rows, "recv_ts")
    stream_table(stream, f"{path}/out", f"{path}/c1").awaitTermination(120)
    stream_batches(stream, f"{path}/out2", f"{path}/c2").awaitTermination(120)
    assert spark.read.parquet(f"{path}/out").count() == rows.count()
    assert spark.read.parquet(f"{path}/out2").count() == rows.count()


def test_bad_numbers_on_a_stream_equal_the_batch(spark):
    nan, inf = float("nan"), float("inf")
    speeds = [0.1, nan, None, 0.2, inf, -inf, 0.0, None, None, None, None, None, 0.1, -0.1, 0.3, nan, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, -0.2, -0.2, -0.2]
    rows = [(r, 1000 + 10 * i, i, speeds[(i + s) % len(speeds)], speeds[(i * s) % len(speeds)]) for s, r in enumerate("abc", 1) for i in range(60)]
    cmd = spark.createDataFrame(rows, "robot_id string, s long, seq long, v_lin double, v_ang double").select("robot_id", F.timestamp_seconds("s").alias("recv_ts"), "seq", "v_lin", "v_ang")
    stream, path = feed(spark, cmd, "recv_ts", parts=4)
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.LastRows(), "1 hour"), path)
    want = D.direction_conflict(D.physics(cmd))
    assert want.where("d1").count() and want.where("NOT d1").count()
    assert lines(got, "robot_id", "seq", "d1", "d2") == lines(want, "robot_id", "seq", "d1", "d2")
    rows = [(t, "odom", v, None, None, None) for t, v in enumerate([nan, None] * 6)] + [(100, "cmd", None, nan, None, None), (200, "tick", None, None, None, None)]
    out, _ = SM.Detectors().run([(t * 1_000_000, *r) for t, *r in rows], SM.Detectors().initial())
    assert out[0][1] is True and out[0][2] is False


def test_open_silence_and_missing_beats(spark):
    rows = [("stops", 1000 + i, i) for i in range(10)] + [("goes on", 1000 + i, 100 + i) for i in range(60)]
    scan = spark.createDataFrame(rows, "robot_id string, s long, seq long").select("robot_id", F.timestamp_seconds("s").alias("recv_ts"), "seq")
    ticks = spark.createDataFrame([(r, 1059) for r in ("stops", "goes on")], "robot_id string, s long").select("robot_id", F.timestamp_seconds("s").alias("tick_ts"))
    assert [(r.robot_id, r.gap_s, r.open) for r in D.silent_scans(scan, 1.0, ticks=ticks).collect()] == [("stops", 50.0, True)]
    assert [(r.robot_id, r.missed, r.open) for r in D.beat_cadence(scan, 2.0, ticks=ticks).collect()] == [("stops", 24, True)]
    assert D.silent_scans(scan, 1.0).count() == 0


def test_rows_without_scan_position_or_kind_equal_the_batch(spark, events):
    """Nulls are passed over in both engines; NaN is no position."""
    odd = F.col("seq") % 7
    gone = lambda c, kind: F.when(odd == 3, F.lit(None)).otherwise(c).cast(kind)
    scans = I.repeated_scans(spark, SF)
    scans = scans.unionByName(scans.where("seq % 5 = 0").withColumn("ranges", F.lit(None).cast("array<double>")).withColumn("seq", F.col("seq") + 100_000))
    stream, path = feed(spark, scans, "recv_ts", parts=2)
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.ScanMotion(), "1 hour"), path)
    cols = ("seq", "diff", "diff4", "diff2", "frames", "d3")
    assert lines(got, *cols) == lines(D.scan_motion(scans), *cols)
    stream, path = feed(spark, scans, "recv_ts", parts=2)
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", SM.FrameRepeat(), "1 hour"), path)
    assert lines(got, "seq", "repeated") == lines(D.frame_repeat(scans), "seq", "repeated")

    walked = events.select("robot_id", "recv_ts", "seq", gone(F.col("value"), "double").alias("x"), F.when(odd == 5, float("nan")).otherwise(F.col("k")).cast("double").alias("y"), (odd == 1).alias("arrived"))
    for machine in (StuckWatch(60, 8 * HOUR, 5 * HOUR),):
        stream, path = feed(spark, walked, "recv_ts", parts=2)
        got = drain(spark, run_stream(stream, "robot_id", "recv_ts", machine, "1 hour"), path)
        assert lines(got, "robot_id", "t", "stuck_no", "turn") == lines(A._machine(walked, machine), "robot_id", "t", "stuck_no", "turn")
        whole = walked.where("x IS NOT NULL AND NOT isnan(y)")
        assert lines(A._machine(whole, machine), "robot_id", "t", "stuck_no") == lines(got, "robot_id", "t", "stuck_no")

    routed = walked.withColumns({"route_x": F.when(odd != 2, F.array(F.lit(50.0), F.lit(20.0))), "route_y": F.array(F.lit(50.0), F.lit(80.0)), "goto_x": F.lit(None).cast("double"), "goto_y": F.lit(None).cast("double")})
    stream, path = feed(spark, routed, "recv_ts", parts=2)
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", VisitProgress(30.0), "1 hour"), path)
    assert lines(got, "robot_id", "t", "target", "reached") == lines(A._machine(routed, VisitProgress(30.0)), "robot_id", "t", "target", "reached")

    kinds = events.withColumn("kind", F.when(odd == 3, F.lit(None)).when(odd == 1, "reset").otherwise("alert"))
    stream, path = feed(spark, kinds, "recv_ts", parts=2)
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", TrainingGuard(60 * HOUR, 3, 60 * HOUR), "1 hour"), path)
    assert lines(got, "robot_id", "t", "action") == lines(A._machine(kinds.where("kind IS NOT NULL"), TrainingGuard(60 * HOUR, 3, 60 * HOUR)), "robot_id", "t", "action")


def test_stuck_count_and_anchor_start_over_on_goto_and_resume(spark, events):
    rows = [(0, "odom", 0.0), (2, "odom", 0.0), (4, "odom", 0.0), (7, "odom", 0.0), (11, "odom", 0.0), (12, "goto", None), (16, "odom", 0.0), (18, "pause", None), (19, "odom", 9.0), (30, "resume", None), (32, "odom", 9.0), (34, "odom", 9.0)]
    made, _ = StuckWatch(events=True).run([(t * 1_000_000, x, 0.0 if x is not None else None, False, k) for t, k, x in rows], StuckWatch(events=True).initial())
    # stuck at 4 and 11; the target at 12 starts the count over, the resume at 30 the wait: 34 is the first beyond
    assert [(t // 1_000_000, n) for t, n, _ in made] == [(4, 1), (11, 2), (34, 1)]

    odom = events.select("robot_id", "recv_ts", "seq", F.col("value").alias("x"), F.col("k").cast("double").alias("y"), (F.col("event_type") == "signup").alias("arrived"))
    gotos = events.where("event_type = 'click'")
    alerts = A.patrol_pause(events.where("event_type = 'error'"), pause_s=30 * HOUR, window_s=96 * HOUR, quiet_s=72 * HOUR)
    pauses = A.pause_intervals(alerts, 30 * HOUR)
    limits = dict(dist=60, time_s=8 * HOUR, backup_s=5 * HOUR)
    line = A.patrol_line(odom, gotos, pauses)
    want = A.stuck_events(odom, gotos, pauses, **limits)
    assert 0 < want.count() != A.stuck_events(odom, **limits).count()
    stream, path = feed(spark, line, "recv_ts")
    got = drain(spark, run_stream(stream, "robot_id", "recv_ts", StuckWatch(events=True, **limits), "1 hour", order=("rank", "seq")), path)
    assert lines(got, "robot_id", "t", "stuck_no", "turn") == lines(want, "robot_id", "t", "stuck_no", "turn")


def test_overlapping_pauses_resume_once(spark):
    pauses = spark.createDataFrame([("a", 0, 30), ("a", 10, 20), ("a", 25, 40), ("a", 50, 60), ("b", 5, 6)], "robot_id string, pause_start long, pause_end long")
    odom = spark.createDataFrame([], "robot_id string, recv_ts timestamp, seq long, x double, y double, arrived boolean")
    got = sorted((r.robot_id, r.t, r.kind) for r in A.patrol_line(odom, None, pauses).withColumn("t", F.unix_micros("recv_ts")).collect())
    assert got == [("a", 0, "pause"), ("a", 40, "resume"), ("a", 50, "pause"), ("a", 60, "resume"), ("b", 5, "pause"), ("b", 6, "resume")]


def test_notify_windows_from_the_first_alert(spark):
    rnd = random.Random(5)
    times = sorted(rnd.sample(range(1_000_007, 1_000_400), 60))
    rows = [("r", datetime.fromtimestamp(t, timezone.utc), i, f"n{i}", i % 7 == 0) for i, t in enumerate(times)]
    alerts = spark.createDataFrame(rows, "robot_id string, recv_ts timestamp, seq long, node string, is_exit boolean")
    starts = spark.createDataFrame([rows[0][:2]], "robot_id string, started timestamp")
    want = sorted((int(r.t), r.kind, r.total, r.rate_limited) for r in A.notify(alerts, starts=starts).selectExpr("unix_micros(sent_ts) t", "kind", "total", "rate_limited").collect())
    machine = SM.Notify(from_first=True)
    got, state = [], machine.initial()
    for at in range(0, len(rows), 13):  # the state goes through several triggers
        sent, state = machine.run([(t * 1_000_000, n, x) for t, (_, _, _, n, x) in list(zip(times, rows))[at : at + 13]], state)
        got += sent
    got += machine.expire(state)
    assert sorted((r[0], r[1], r[2], r[6]) for r in got) == want and len(want) > 10
