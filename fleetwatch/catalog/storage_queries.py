"""Readers and sinks in use: telemetry is written as a log would hold it, then read through its declared schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..operators import episodes as E, graph as G, integrity as S, report as P
from ..session import shared_folder
from ..sources import readers as R, sinks as K
from . import inputs as I
from .column_queries import hmac_sql
from .detector_queries import _SIGNED, signed_alerts
from .message_queries import _VERIFIED, envelopes
from .registry import query, r6, with_ctes


def stored(df: DataFrame, name: str, fmt: str = "parquet") -> str:
    """Writes a table into the shared folder; its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.format(fmt).save(path)
    return path


@query("read_scans", "A1", "B6", sql=with_ctes(I.SC) + """
SELECT robot_id, count(*) AS frames, round(min(list_min(list_transform(ranges, lambda r: r::FLOAT::DOUBLE))), 5) AS nearest, max(us) AS latest FROM sc GROUP BY robot_id""")
def _(spark, sf):
    path = stored(I.scans(spark, sf).select("robot_id", "recv_ts", "seq", F.lit(0.0).alias("stamp_s"), F.lit(0.0).alias("angle_min"), F.lit(6.28).alias("angle_max"), F.col("ranges").cast("array<float>").alias("ranges")), "scans")
    scans = R.read_scans(spark, path)
    return scans.groupBy("robot_id").agg(F.count("*").alias("frames"), F.round(F.min(F.array_min("ranges").cast("double")), 5).alias("nearest"), F.unix_micros(F.max("recv_ts")).alias("latest"))


@query("read_motion", "A2", "A3", "A4", sql=with_ctes(I.EV) + """
SELECT robot_id, count(*) AS messages, round(max(abs(v_lin)), 6) AS fastest, round(max(sqrt(v_lin * v_lin + v_ang * v_ang)), 6) AS hardest, round(min(value), 6) AS least_x, arg_max(event_type, seq) AS publisher
FROM ev GROUP BY robot_id""")
def _(spark, sf):
    ev = I.events(spark, sf)
    zero = {c: F.lit(0.0).alias(c) for c in ("qx", "qy", "qz", "qw")}
    odom = R.read_odom(spark, stored(ev.select("robot_id", "recv_ts", "seq", F.col("value").alias("x"), F.col("k").cast("double").alias("y"), *zero.values(), "v_lin", "v_ang"), "odom", "orc"), fmt="orc")
    cmd = R.read_cmds(spark, stored(ev.select("robot_id", "recv_ts", "seq", F.col("event_type").alias("publisher"), "v_lin", "v_ang"), "commands"))
    imu = R.read_imu(spark, stored(ev.select("robot_id", "recv_ts", "seq", F.col("v_lin").alias("ax"), F.col("v_ang").alias("ay")), "inertia", "json"), fmt="json")
    out = odom.groupBy("robot_id").agg(F.count("*").alias("messages"), r6(F.min("x")).alias("least_x"))
    out = out.join(cmd.groupBy("robot_id").agg(r6(F.max(F.abs("v_lin"))).alias("fastest"), F.max_by("publisher", "seq").alias("publisher")), "robot_id")
    return out.join(imu.groupBy("robot_id").agg(r6(F.max(F.hypot("ax", "ay"))).alias("hardest")), "robot_id")


@query("read_messages", "A5", "C3", "F9", sql=with_ctes(_VERIFIED) + "SELECT receiver, coalesce(reason, 'ok') AS verdict, count(*) AS messages FROM verified GROUP BY ALL")
def _(spark, sf):
    raw = R.read_envelopes(spark, stored(envelopes(spark, sf).select("robot_id", "recv_ts", "seq", "receiver", "topic", "raw"), "messages"))
    verdict = S.verify(raw, I.KEY, F.col("topic")).select("receiver", F.coalesce("reject_reason", F.lit("ok")).alias("verdict"))
    return verdict.groupBy("receiver", "verdict").agg(F.count("*").alias("messages"))


@query("read_snapshots", "A6", "A7", "A8", "D2", "D6", sql=with_ctes(I.EV, I.SN, I.PB, I.WL) + """
SELECT 'nodes' AS kind, robot_id, count(DISTINCT node) AS n, count(*) AS rows FROM sn WHERE substr(node, 5) NOT IN (SELECT name FROM wl) GROUP BY robot_id
UNION ALL SELECT 'publishers', robot_id, count(DISTINCT node_name), count(*) FROM pb GROUP BY robot_id""")
def _(spark, sf):
    nodes = I.snapshots(spark, sf).select("robot_id", "poll_seq", "poll_ts", F.lit("/ns/").alias("namespace"), F.substring("node", 5, 99).alias("name"))
    snaps = R.read_node_snapshots(spark, stored(nodes, "snapshots"))
    listed = R.reference_table(spark, "whitelist", stored(I.whitelist(spark, sf), "whitelist", "json"), "json")
    unknown = G.not_whitelisted(snaps, listed).groupBy("robot_id").agg(F.count_distinct("node").alias("n"), F.count("*").alias("rows"))
    pubs = R.read_publisher_snapshots(spark, stored(I.publishers(spark, sf).withColumn("node_namespace", F.lit("/")), "publishers"))
    live = pubs.groupBy("robot_id").agg(F.count_distinct("node_name").alias("n"), F.count("*").alias("rows"))
    return unknown.select(F.lit("nodes").alias("kind"), "*").unionByName(live.select(F.lit("publishers").alias("kind"), "*"))


@query("alert_log", "A11", "G15", sql=_SIGNED + f"""
SELECT robot_id, t, '{{"body":' || to_json(body)::VARCHAR || ',"sig":"' || {hmac_sql('body', I.KEY)} || '"}}' AS text FROM signed""")
def _(spark, sf):
    path = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    K.write_alerts(signed_alerts(spark, sf).select("robot_id", F.col("tick_ts").alias("recv_ts"), F.lit(0).cast("long").alias("seq"), F.lit("detectors").alias("source"), F.col("raw").alias("text")), path)
    return R.read(spark, path, schemas.ALERT).select("robot_id", F.unix_micros("recv_ts").alias("t"), "text")


@query("health_log", "A11", "F7", sql=with_ctes(I.EV, I.tk()) + """
SELECT t.robot_id, count(*) AS reports, count(a.props) AS with_alert FROM tk t ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'error') a ON t.robot_id = a.robot_id AND t.t >= a.us GROUP BY ALL""")
def _(spark, sf):
    ev = I.events(spark, sf)
    part = {n: ev.where(F.col("event_type") == t).select("robot_id", "recv_ts", "seq", F.col("props").alias(n)) for n, t in (("sensor", "click"), ("mission", "signup"), ("security", "error"))}
    path = f"{shared_folder(spark)}/health-{uuid.uuid4().hex}"
    K.write_health(P.health_report(I.ticks(spark, sf), part["sensor"], part["mission"], part["security"]).select("robot_id", "tick_ts", "report"), path)
    log = R.read(spark, path, schemas.HEALTH)
    return log.groupBy("robot_id").agg(F.count("*").alias("reports"), F.count(F.when(~F.col("report").endswith("security: OK"), 1)).alias("with_alert"))


@query("evaluation", "F5", "F3", "F10", "A9", "A11", sql=with_ctes(I.ST) + """,
roll AS (
  SELECT episode, sum(round(reward * 100)::BIGINT) AS reward, count(*) AS steps, arg_max(event, step) AS event, min(round(nearest * 1000)::BIGINT) AS near FROM st GROUP BY episode),
ep2 AS (
  SELECT 'r' || (episode % 3) AS run_id, *, (event = 'all_done')::INT AS success, (event = 'collision')::INT AS collision, (event = 'running')::INT AS timeout FROM roll)
SELECT run_id, count(*) AS episodes, round(avg(success), 6) AS success_rate, round(avg(collision), 6) AS collision_rate, round(avg(timeout), 6) AS timeout_rate,
       round(avg(steps), 6) AS mean_steps, round(avg(near), 4) AS mean_clearance, round(avg(reward), 4) AS mean_reward, round(stddev_pop(reward), 3) AS std_reward FROM ep2 GROUP BY run_id""")
def _(spark, sf):
    """Steps rolled up to episodes, written as evaluation files, read back and reported. Rewards and clearances are whole hundredths and thousandths."""
    steps = I.steps(spark, sf).withColumns({"reward": F.round(F.col("reward") * 100), "near": F.round(F.col("nearest") * 1000)})
    rolled = steps.groupBy("run_id", "episode").agg(F.sum("reward").alias("reward"), F.count("*").cast("int").alias("steps"), F.max_by("event", "step").alias("event"), F.min("near").alias("clearance"))
    flag = lambda e: (F.col("event") == e).cast("int")
    episodes = rolled.withColumn("run_id", F.concat(F.lit("r"), (F.col("episode") % 3).cast("string"))).select(
        "run_id", "episode", F.lit(7).cast("long").alias("seed"), "reward", "steps", F.lit(1.0).alias("spl"), flag("all_done").alias("success"), flag("collision").alias("collision"), flag("running").alias("timeout"), F.lit(0).alias("wp_done"), "clearance")
    path = f"{shared_folder(spark)}/evaluation-{uuid.uuid4().hex}"
    K.write_eval(episodes, path)
    report = E.eval_report(R.read_episodes(spark, path))
    names = ("success_rate", "collision_rate", "timeout_rate", "mean_steps")
    return report.select("run_id", "episodes", *[r6(c).alias(c) for c in names], r6("mean_clearance", 4).alias("mean_clearance"), r6("mean_reward", 4).alias("mean_reward"), r6("std_reward", 3).alias("std_reward"))
