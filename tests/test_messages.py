"""Signed messages, artifacts and publisher rules on hand-made rows."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from fleetwatch.operators import alerts as A, artifacts as R, graph as G, integrity as S
from fleetwatch.sources import readers, sinks

KEY = b"secret"
NOW = 1_700_000_000


def raw(payload="hello", channel="alerts", ts=NOW, nonce="n1", key=KEY):
    body = json.dumps({"channel": channel, "nonce": nonce, "payload": payload, "ts": ts}, sort_keys=True, ensure_ascii=False)
    return json.dumps({"body": body, "sig": hmac.new(key, body.encode(), hashlib.sha256).hexdigest()})


def judge(spark, rows, key=KEY):
    """(raw, channel expected, receiver, second received) -> reasons in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, raw string, want string, receiver string, at double")
    df = df.withColumn("recv_ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    out = S.verify(df, key, F.col("want")).orderBy("seq").collect()
    return [r.reject_reason for r in out], [r.payload for r in out]


def at(r, want="alerts", receiver="a", second=NOW):
    return (r, want, receiver, float(second))


def test_round_trip(spark):
    assert judge(spark, [at(raw("hello – 機器"))]) == ([None], ["hello – 機器"])


def test_own_signature_is_accepted(spark):
    df = spark.createDataFrame([("x / y", "alerts", float(NOW), "n")], "p string, c string, t double, n string")
    signed = S.sign(df, KEY, F.col("p"), F.col("c"), F.col("t"), F.col("n")).first().raw
    assert judge(spark, [at(signed)]) == ([None], ["x / y"])


def test_rejections_in_order(spark):
    tampered = raw("legit msg").replace("legit msg", "EVIL")
    rows = [at("not signed"), at(tampered), at(raw(), "heartbeat"), at(raw(ts=0)), at(raw())]
    assert judge(spark, rows)[0] == ["format", "signature", "channel", "stale", None]
    assert judge(spark, [at(raw(key=b"z" * 80))])[0] == ["signature"]


@pytest.mark.parametrize("garbage", ["", "{}", "{not json}", "[]", '{"only_payload":"x"}', '{"payload":"x"}', "\x00\x01\x02"])
def test_garbage(spark, garbage):
    assert judge(spark, [at(garbage)])[0] == ["format"]


def test_strict_types(spark):
    rows = [at(raw(payload=5)), at(raw(ts=True)), at(raw(ts="1")), at(raw(nonce=None))]
    assert judge(spark, rows)[0] == ["types"] * 4


def test_freshness_includes_both_ends(spark):
    rows = [at(raw(ts=NOW + d, nonce=str(d))) for d in (-10, 2, -10.001, 2.001)]
    assert judge(spark, rows)[0] == [None, None, "stale", "stale"]


def test_replay_per_receiver_and_ttl(spark):
    r = raw()
    rows = [at(r), at(r, second=NOW + 1), at(r, receiver="b"), at(raw(ts=NOW + 12), second=NOW + 12)]
    assert judge(spark, rows)[0] == [None, "replay", None, None]


def test_artifacts_from_files(spark, tmp_path):
    for name in ("ok", "spoiled", "bare", "other"):
        (tmp_path / name).write_bytes(name.encode() * 10)
    listing = spark.read.format("binaryFile").load(str(tmp_path / "*")).select("path", "content")
    for r in R.sign_artifacts(listing, KEY).collect():
        name = r.path.rsplit("/", 1)[1]
        if not name.startswith("bare"):
            (tmp_path / name).write_text(r.sidecar)
    (tmp_path / "spoiled").write_bytes(b"spoiled" * 10 + b"x")
    wrong = hmac.new(b"k2", b"other" * 10, hashlib.sha256).hexdigest()
    (tmp_path / "other.sha256.hmac").write_text(wrong)
    got = R.verify_artifacts(readers.read_artifacts(spark, str(tmp_path / "*")), KEY)
    verdict = {r.path.rsplit("/", 1)[1]: r.verdict for r in got.collect()}
    assert verdict == {"ok": "ok", "spoiled": "tampered", "bare": "unsigned", "other": "tampered"}
    strict = got.select("verdict", R.load_policy(F.col("verdict"), True).alias("s"), R.load_policy(F.col("verdict"), False).alias("l"))
    assert {(r.verdict, r.s, r.l) for r in strict.collect()} == {("ok", "load", "load"), ("tampered", "refuse", "refuse"), ("unsigned", "refuse", "warn")}


def publishers(spark, rows):
    df = spark.createDataFrame(rows, "topic string, node_name string")
    return df.select(F.lit("r").alias("robot_id"), F.timestamp_seconds(F.lit(0)).alias("tick_ts"), "*")


@pytest.mark.parametrize("rows,fires", [
    ([("/scan", "ros_gz_bridge")] * 2, True),
    ([("/cmd_vel", "patrol_node"), ("/cmd_vel", "dds_security_monitor")], False),
    ([("/cmd_vel", "patrol_node")] * 2, True),
    ([("/cmd_vel", "evil")], True),
    ([("/cmd_vel", "_NODE_NAME_UNKNOWN_")] * 3, False),
])
def test_publisher_alarm(spark, rows, fires):
    got = G.publisher_alarm(publishers(spark, rows), readers.defaults(spark, "topic_allow"))
    assert (not got.isEmpty()) is fires


def polls(spark, rows):
    df = spark.createDataFrame(rows, "poll_seq long, s long, node string")
    return df.select(F.lit("r").alias("robot_id"), "poll_seq", F.timestamp_seconds("s").alias("poll_ts"), "node")


def test_first_poll_and_names(spark):
    s = polls(spark, [(0, 0, "/patrol_node"), (0, 0, "/evil"), (1, 5, "/patrol_node"), (1, 5, "/evil"), (1, 5, "/x/rviz2"), (1, 5, "/late")])
    got = G.node_monitor(s, readers.defaults(spark, "whitelist")).orderBy("poll_seq").collect()
    assert [(r.poll_seq, r.node, r.live_nodes) for r in got] == [(0, "/evil", 2), (1, "/late", 4)]


@pytest.mark.parametrize("exits,want", [(False, [0, 700]), (True, [0, 300, 700])])
def test_realert(spark, exits, want):
    rows = [(i, t, "/patrol_node") for i, t in enumerate((0, 5, 100, 300, 400, 700))]
    # Unknown at 5 (poll 1 of the baseline is 0 with the trusted node only).
    s = polls(spark, [(i - 2, t - 1000, "/patrol_node") for i, t in enumerate((0, 500))] + rows + [(0, 0, "/evil"), (3, 300, "/evil"), (5, 700, "/evil")])
    got = G.node_monitor(s, readers.defaults(spark, "whitelist"), exit_alerts=exits).where("alert = 'joined'")
    assert sorted(int(r.poll_ts.timestamp()) for r in got.collect()) == want


def test_burst_summary_counts(spark):
    df = spark.range(300).select(F.lit("r").alias("robot_id"), F.timestamp_micros(F.col("id") * 90_000).alias("recv_ts"), F.col("id").alias("seq"),
                                 F.concat(F.lit("/n"), F.col("id").cast("string")).alias("node"), F.lit(False).alias("is_exit"))
    sent = A.notify(df).orderBy("sent_ts").collect()
    assert [(r.kind, r.total) for r in sent] == [("immediate", 1), ("summary", 299)]
    rest = df.where("seq > 0")
    b = A.burst_summary(rest).first()
    assert (b.total, b.listed, b.overflow, len(b.names)) == (299, 256, 43, 10)
    assert "246 more" in b.summary


def test_sources_and_sinks(spark, tmp_path):
    assert readers.reference_table(spark, "whitelist", str(tmp_path / "none")).count() == 44
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "w.csv").write_text("name\nmine\n")
    assert [r.name for r in readers.reference_table(spark, "whitelist", str(tmp_path / "w")).collect()] == ["mine"]
    ep = tmp_path / "ep"
    ep.mkdir()
    (ep / "m.csv").write_text("#{\"t_start\": 1}\nrun_id,episode,seed,reward,steps,spl,success,collision,timeout,wp_done,clearance\na,1,7,2.5,10,0.5,1,0,0,3,0.4\n")
    got = readers.read_episodes(spark, str(ep))
    assert got.first().reward == 2.5
    sinks.write_eval(got, str(tmp_path / "out"))
    head = next((tmp_path / "out" / "run_id=a").glob("*.csv")).read_text().splitlines()[0]
    assert head == "episode,seed,reward,steps,spl,success,collision,timeout,wp_done,clearance"
    assert len(readers.defaults(spark, "obstacles").collect()) == 9 and readers.defaults(spark, "waypoints").count() == 5


def test_files_above_the_limit_are_told_and_the_rest_is_judged(spark, tmp_path):
    for name, data in (("small", b"x" * 10), ("bare", b"y"), ("large", b"z" * 5000)):
        (tmp_path / name).write_bytes(data)
        if name != "bare":
            (tmp_path / f"{name}{R.SIDECAR}").write_text(hmac.new(KEY, data, hashlib.sha256).hexdigest())
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = {r.path.rsplit("/", 1)[1]: r.verdict for r in readers.check_artifacts(spark, str(tmp_path), KEY).collect()}
        assert got == {"small": "ok", "bare": "unsigned", "large": "too_large"}
        got = {r.path.rsplit("/", 1)[1]: r.verdict for r in R.verify_artifacts(readers.read_artifacts(spark, str(tmp_path)), KEY).collect()}
        assert got == {"small": "ok", "bare": "unsigned", "large": "too_large"}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_alerts_of_a_robot_without_a_start_are_counted(spark):
    rows = [("a", 100, 1, "n1", False), ("b", 205, 2, "n2", False), ("b", 220, 3, "n3", False), ("b", 240, 4, "n4", False)]
    alerts = spark.createDataFrame(rows, "robot_id string, s long, seq long, node string, is_exit boolean").select("robot_id", F.timestamp_seconds("s").alias("recv_ts"), "seq", "node", "is_exit")
    starts = spark.createDataFrame([("a", 95)], "robot_id string, s long").select("robot_id", F.timestamp_seconds("s").alias("started"))
    got = sorted((r.robot_id, r.window_start, r.total) for r in A.burst_summary(alerts, starts).select("robot_id", F.unix_seconds("window_start").alias("window_start"), "total").collect())
    assert got == [("a", 95, 1), ("b", 205, 2), ("b", 235, 1)]


def test_signed_alerts_are_accepted_and_stable(spark):
    from fleetwatch.catalog import detector_queries as Q, inputs as I

    sent = Q.signed_alerts(spark, "/root/testdata/sf0.001").cache()
    assert sent.count() > 20 and sent.where("raw IS NULL OR payload NOT LIKE '[behaviour alert]%  - D_[%'").isEmpty()
    again = {r.raw for r in Q.signed_alerts(spark, "/root/testdata/sf0.001").collect()}
    assert again == {r.raw for r in sent.collect()}
    got = sent.select(F.lit("patrol").alias("receiver"), F.col("tick_ts").alias("recv_ts"), F.xxhash64("raw").alias("seq"), "raw")
    assert S.verify(got, I.KEY, F.lit("alerts")).where("reject_reason IS NOT NULL").isEmpty()
    twice = got.unionByName(got.withColumn("seq", F.col("seq") + 1))
    assert S.verify(twice, I.KEY, F.lit("alerts")).where("reject_reason = 'replay'").count() == sent.count()
