"""Streams with shuffled triggers give what the batch gives; rows behind the watermark come out as late."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetwatch.catalog import detector_queries as Q, inputs as I, message_queries as M
from fleetwatch.operators import alerts as A, detectors as D, episodes as E, graph as G, integrity as S
from fleetwatch.streaming import joins as J, machines as SM, ordered as O
from test_streaming import HOUR, MACHINES, SF, drain, lines

END = 1_800_000_000
SLACK = 60 * HOUR


def shuffled(spark, df, by="recv_ts", parts=3, slack=SLACK, key="robot_id"):
    """The rows as a file stream of few triggers: every row up to ``slack`` seconds late, no trigger sorted, one far row at the end."""
    path = tempfile.mkdtemp(prefix="/tmp/run-")
    late = F.unix_micros(by) + F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]), F.lit(int(slack * 1e6)))
    rows = df.withColumn("_at", late).cache()
    lo, hi = rows.agg(F.min("_at"), F.max("_at")).first()
    width = (hi - lo) // parts + 1
    for i in range(parts):
        part = rows.where((F.col("_at") >= lo + i * width) & (F.col("_at") < lo + (i + 1) * width))
        part.drop("_at").repartition(1).orderBy(F.xxhash64(by)).write.parquet(f"{path}/in/part={i}")
    far = df.limit(1).withColumn(by, F.timestamp_seconds(F.lit(END))).withColumn(key, F.lit("zz").cast(df.schema[key].dataType) if df.schema[key].dataType.simpleString() == "string" else F.lit(-1).cast(df.schema[key].dataType))
    far.select(*df.columns).coalesce(1).write.parquet(f"{path}/in/part=9")
    rows.unpersist()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in"), path


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Each partition of a stateful operator starts a worker in every trigger."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def events(spark):
    return I.events(spark, SF).cache()


def ordered(spark, rows, machine, by="recv_ts", key="robot_id", **more):
    stream, path = shuffled(spark, rows, by, key=key)
    got = drain(spark, O.run_ordered(stream, key, by, machine, f"{SLACK + 1} seconds", idle_s=None, **more), path).cache()
    assert got.where("late").isEmpty()
    return O.on_time(got)


@pytest.mark.parametrize("name", list(MACHINES))
def test_machines(spark, events, name):
    machine, prepare, cols = MACHINES[name]
    rows = prepare(events)
    assert lines(ordered(spark, rows, machine), "robot_id", *cols) == lines(A._machine(rows, machine), "robot_id", *cols)


def test_windows(spark, events):
    got = ordered(spark, events, SM.LastRows())
    want = D.cmd_mean(D.odom_speed(D.direction_conflict(D.physics(events))))
    cols = ("seq", "max_lin", "max_ang", "d1", "d2", "cmd5", "speed10")
    assert lines(got, *cols) == lines(want, *cols)
    scans = I.repeated_scans(spark, SF)
    cols = ("seq", "diff", "diff4", "diff2", "frames", "d3")
    assert lines(ordered(spark, scans, SM.ScanMotion()), *cols) == lines(D.scan_motion(scans), *cols)
    shaped = Q.shaped(spark, SF)
    assert lines(ordered(spark, shaped, SM.FrameRepeat()), "seq", "repeated") == lines(D.frame_repeat(shaped), "seq", "repeated")


def test_cooldown_and_gaps(spark, events):
    assert lines(ordered(spark, events, SM.Cooldown(20 * HOUR)), "seq") == lines(A.cooldown(events, seconds=20 * HOUR), "seq")
    got = ordered(spark, events, SM.silence(10 * HOUR))
    want = D.silent_scans(events, 10 * HOUR).select("robot_id", F.unix_micros("since").alias("since"), F.unix_micros("until").alias("until"))
    assert lines(got, "robot_id", "since", "until") == lines(want, "robot_id", "since", "until")


def test_node_monitor_and_notify(spark):
    snaps = I.snapshots(spark, SF)
    listed = I.whitelist(spark, SF).select(F.concat(F.lit("/ns/"), "name").alias("node"), F.lit(True).alias("listed"))
    rows = snaps.join(listed, "node", "left").select("robot_id", "poll_ts", "node", F.coalesce("listed", F.lit(False)).alias("listed"))
    closing = snaps.select("robot_id").distinct().select("robot_id", F.timestamp_seconds(F.lit(END - 10**7)).alias("poll_ts"), F.lit("/ns/u0").alias("node"), F.lit(True).alias("listed"))
    got = ordered(spark, rows.unionByName(closing), SM.NodeMonitor(100 * HOUR), "poll_ts", order=("node",))
    want = G.node_monitor(snaps, I.whitelist(spark, SF), 100 * HOUR).withColumn("t", F.unix_micros("poll_ts"))
    cols = ("robot_id", "t", "node", "alert", "live_nodes")
    assert lines(got, *cols) == lines(want, *cols)

    alerts = M.node_alerts(spark, SF)
    closing = alerts.select("robot_id").distinct().select("robot_id", F.timestamp_seconds(F.lit(END - 10**7)).alias("recv_ts"), F.lit(10**9).alias("seq"), F.lit("/end").alias("node"), F.lit(False).alias("is_exit"))
    got = ordered(spark, alerts.unionByName(closing, allowMissingColumns=True), SM.Notify(2 * HOUR, HOUR))
    want = A.notify(alerts, 2 * HOUR, HOUR).withColumn("t", F.unix_micros("sent_ts"))
    cols = ("robot_id", "t", "kind", "total", "rate_limited")
    assert lines(got.where(f"t < {(END - 10**7) * 10**6}"), *cols) == lines(want, *cols)


def test_all_detectors(spark, events):
    limits = dict(lin_max=0.9, ang_max=4.5, share=0.45, beat_timeout=172800)
    rows, want, sent = detector_rows(spark, events, limits)
    got = ordered(spark, rows, SM.Detectors(cooldown=86400, **limits), order=("late_", "seq")).cache()
    cols = ("robot_id", "t", "d1", "d2", "d3", "d4", "d5", "d6", "votes", "verdict")
    assert lines(got, *cols) == lines(want, *cols)
    assert lines(got.where("emitted"), "robot_id", "t") == lines(sent, "robot_id", "t")


def detector_rows(spark, events, limits):
    ticks, alarm = I.ticks(spark, SF), G.publisher_alarm(Q.tick_publishers(spark, SF), I.topic_allow(spark, SF), I.EVENT_TOPICS)
    beats, scans = Q.beats(spark, SF), Q.timed_scans(spark, SF)
    det = D.detections(ticks, events, events, scans, beats, alarm, **limits)
    want = D.vote(det.withColumn("all5", F.col("d5")).withColumn("d5", F.col("d5_new")))
    want = want.withColumn("t", F.unix_micros("tick_ts")).withColumn("d5", F.col("all5")).withColumn("votes", F.array_join("votes", ","))
    sent = D.ids(det, 86400).where("emitted").select("robot_id", F.unix_micros("tick_ts").alias("t"))

    def kind(df, name, ts="recv_ts", **cols):
        empty = {"a": "double", "b": "double", "ranges": "array<double>", "info": "string"}
        filled = [cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items()]
        seq = F.col("seq") if "seq" in df.columns else F.lit(0).cast("long")
        return df.select("robot_id", F.col(ts).alias("recv_ts"), F.lit(int(name == "tick")).alias("late_"), seq.alias("seq"), F.lit(name).alias("kind"), *filled)

    rows = kind(events, "cmd", a=F.col("v_lin"), b=F.col("v_ang"))
    for part in (
        kind(events, "odom", a=F.col("v_lin")), kind(scans, "scan", ranges=F.col("ranges")), kind(beats, "beat"),
        kind(alarm, "alarm", "tick_ts", info=F.col("d4_info")), kind(ticks, "tick", "tick_ts"),
    ):
        rows = rows.unionByName(part)
    return rows, want, sent


def test_late_rows_come_out_and_change_nothing(spark):
    rows = [[("a", 1000, 1, 0.0), ("a", 1010, 3, float("nan"))], [("a", 1007, 2, None), ("a", 1020, 4, 0.1)], [("a", 990, 9, float("nan")), ("a", 1030, 5, 0.2), ("zz", END, 0, 0.0)]]
    path = tempfile.mkdtemp(prefix="/tmp/run-")
    for i, part in enumerate(rows):
        df = spark.createDataFrame(part, "robot_id string, s long, seq long, v_lin double").select("robot_id", F.timestamp_seconds("s").alias("recv_ts"), "seq", "v_lin", F.lit(0.0).alias("v_ang"))
        df.coalesce(1).write.parquet(f"{path}/in/part={i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    got = drain(spark, O.run_ordered(stream, "robot_id", "recv_ts", SM.LastRows(), "5 seconds"), path).collect()
    fresh, late = [r for r in got if not r.late], [r for r in got if r.late]
    assert [(r.seq, r.d1) for r in sorted(fresh, key=lambda r: r.t)] == [(1, False), (2, False), (3, True), (4, True), (5, True)]
    assert [json.loads(r.late_row) for r in late] == [{"t": 990_000_000, "seq": 9, "v_lin": None, "v_ang": 0.0}]


def test_silent_keys_are_dropped(spark):
    rows = spark.createDataFrame([("a", 1000, 1), ("a", 1004, 2), ("a", 1200, 3), ("b", 1003, 4), ("zz", 5000, 0)], "robot_id string, s long, seq long")
    rows = rows.select("robot_id", F.timestamp_seconds("s").alias("recv_ts"), "seq")
    path = tempfile.mkdtemp(prefix="/tmp/run-")
    rows.coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    got = drain(spark, O.run_ordered(stream, "robot_id", "recv_ts", SM.Cooldown(10_000), "1 second", idle_s=60), path)
    assert lines(got, "robot_id", "seq") == [("a", 1), ("a", 3), ("b", 4)]  # row 3 comes after the silence: the cooldown is forgotten
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    silent = drain(spark, O.run_ordered(stream, "robot_id", "recv_ts", SM.Silence(), "1 second", idle_s=60), tempfile.mkdtemp(prefix="/tmp/run-"))
    assert lines(silent, "robot_id", "since") == [("a", 1_004_000_000), ("a", 1_200_000_000), ("b", 1_003_000_000)]


def test_copies_keep_payload_and_expire_exactly(spark):
    base = spark.createDataFrame([(f"m{i}", 1000.0 + 7 * i, d) for i in range(12) for d in (0.0, 11.9, 12.0, 12.1, 24.0)], "m string, s double, d double")
    base = base.withColumn("recv_ts", F.timestamp_micros(((F.col("s") + F.col("d")) * 1e6).cast("long"))).withColumn("nonce", F.substring(F.sha2("m", 256), 1, 16))
    base = base.withColumn("seq", F.xxhash64("m", "d")).withColumn("topic", F.lit("/alerts")).withColumn("receiver", F.when(F.col("m") < "m4", "patrol").otherwise("mission"))
    base = base.withColumn("payload", F.concat(F.col("m"), F.lit(' "ü" \n'))).withColumn("note", F.array(F.lit(1.5), F.col("d")))
    signed = S.sign(base, I.KEY, F.col("payload"), F.lit("alerts"), F.col("s"), F.col("nonce")).select("receiver", "topic", "recv_ts", "seq", "raw", "d", "note")
    want = S.verify(signed, I.KEY, F.lit("alerts"), max_age=60).where("reject_reason is null or reject_reason = 'replay'")
    far = signed.limit(1).withColumn("recv_ts", F.timestamp_seconds(F.lit(END)))
    path = tempfile.mkdtemp(prefix="/tmp/run-")
    for i in range(3):
        signed.where(F.pmod(F.floor((F.unix_micros("recv_ts") / 1e6 + F.pmod(F.xxhash64("seq"), F.lit(20))) / 40), F.lit(3)) == i).coalesce(1).write.parquet(f"{path}/in/part={i}")
    far.coalesce(1).write.parquet(f"{path}/in/part=9")
    stream = spark.readStream.schema(signed.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    got = drain(spark, O.verify_ordered(stream, I.KEY, F.lit("alerts"), "200 seconds", max_age=60), path).cache()
    assert got.columns == want.columns
    assert got.where("payload is null or note is null").isEmpty()
    accepted = {r.d: r["count"] for r in got.where("reject_reason is null").groupBy("d").count().collect()}
    assert accepted == {0.0: 12, 12.0: 12, 24.0: 12}
    assert lines(got.withColumn("recv_ts", F.unix_micros("recv_ts")), *want.columns) == lines(want.withColumn("recv_ts", F.unix_micros("recv_ts")), *want.columns)


def test_episodes_last_as_long_as_they_do(spark):
    rows = [("r", e, s, 1000 + 5000 * e + 1800 * s, 0.25 * s, "all_done" if s == 9 and e != 2 else "running") for e in range(4) for s in range(10)]
    steps = spark.createDataFrame(rows, "run_id string, episode long, step int, s long, reward double, event string").withColumn("step_ts", F.timestamp_seconds("s")).drop("s")
    stream, path = shuffled(spark, steps, "step_ts", slack=600, key="run_id")
    got = drain(spark, O.episode_rollup(stream, F.col("event") == "all_done", "11 minutes", idle_s=40_000), path).cache()
    assert got.where("late").isEmpty()
    cols = ("run_id", "episode", "reward", "steps", "event")
    assert lines(got, *cols) == lines(E.episode_rollup(steps), *cols)

    after = steps.where("episode = 1 AND step = 9").withColumn("step_ts", F.col("step_ts") + F.expr("interval 2 hours")).withColumn("step", F.lit(10))
    path = tempfile.mkdtemp(prefix="/tmp/run-")
    for i, part in enumerate((steps.where("episode <= 1"), steps.where("episode = 3"), after)):
        part.coalesce(1).write.parquet(f"{path}/in/part={i}")
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    got = drain(spark, O.episode_rollup(stream, F.col("event") == "all_done", "2 hours", idle_s=400_000), path)
    assert [(r.episode, json.loads(r.late_row)["step"]) for r in got.where("late").collect()] == [(1, 10)]
    assert lines(got.where("NOT late"), "episode", "steps") == [(0, 10), (1, 10)]  # episode 3 waits: its last row isn't passed


def test_hits_and_totals(spark):
    hits = I.ticks(spark, SF).select("robot_id", "tick_ts", *[(F.pmod(F.xxhash64("robot_id", "tick_ts", F.lit(i)), F.lit(3)) == 0).alias(f"d{i}") for i in range(1, 7)])
    stream, path = shuffled(spark, hits, "tick_ts")
    got = drain(spark, O.detector_hits(stream, every="12 hours", watermark=f"{SLACK + 1} seconds", idle_s=10**7), path)
    want = D.detector_hits(hits, every="12 hours")
    assert lines(got.where(f"window_start < timestamp_seconds({END - 10**6})"), *want.columns) == lines(want, *want.columns)


def test_unlisted_publishers(spark):
    pubs, allow = Q.tick_publishers(spark, SF), I.topic_allow(spark, SF)
    flood = pubs.limit(2).withColumn("node_name", F.explode(F.array(*[F.lit(f"x{i % 7}") for i in range(25)])))
    pubs = pubs.unionByName(flood)
    for shown in (1, 10):
        stream, path = shuffled(spark, pubs, "tick_ts")
        got = drain(spark, O.unauthorised_publishers(stream, allow, I.EVENT_TOPICS, f"{SLACK + 1} seconds", shown), path)
        want = G.unauthorised_publishers(pubs, allow, I.EVENT_TOPICS, shown)
        cols = ("robot_id", "tick_ts", "topic", "nodes", "more")
        assert lines(got.where("robot_id <> 'zz'"), *cols) == lines(want, *cols)
        assert want.where("more > 0").count() > 0
    whole = G.unauthorised_publishers(pubs, allow, I.EVENT_TOPICS)
    assert lines(G.unauthorised_publishers(pubs, allow, I.EVENT_TOPICS, 10**6).drop("more"), *whole.columns) == lines(whole, *whole.columns)
