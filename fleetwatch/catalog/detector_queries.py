"""Windowed detectors, voting, cooldowns and the whole alert pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scan import frame_diff
from ..operators import alerts as A, detectors as D, graph as G
from ..plans.asof import hold
from ..plans.replay import thin
from ..plans.timeline import Timeline
from . import inputs as I
from .column_queries import DIRTY, _SHAPED, _dirty, hmac_sql, shaped
from .registry import query, r6, with_ctes

HOUR = 3600


def greedy(name: str, src: str, seconds: float, keys: str = "robot_id", strict: bool = False, us: str = "us", seq: str = "seq") -> str:
    """CTE with the rows greedy thinning keeps: keys, us, seq."""
    op, gap = (">" if strict else ">="), int(seconds * 1_000_000)
    return f"""{name} AS (
  SELECT {keys}, k.us AS us, k.seq AS seq FROM (
    SELECT {keys}, unnest(list_reduce(list([{{'us': {us}, 'seq': {seq}}}] ORDER BY {us}, {seq}),
           lambda a, b: CASE WHEN b[1].us - a[-1].us {op} {gap} THEN list_concat(a, b) ELSE a END)) AS k
    FROM {src} GROUP BY {keys}))"""


W20 = "(PARTITION BY robot_id ORDER BY us, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
W10 = "(PARTITION BY robot_id ORDER BY us, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
W5 = "(PARTITION BY robot_id ORDER BY us, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
PHYS = f"""phys AS (
  SELECT *, max(abs(v_lin)) OVER {W5} AS max_lin, max(abs(v_ang)) OVER {W5} AS max_ang FROM ev),
fired AS (SELECT *, max_lin > 0.23 OR max_ang > 3.0 AS d1 FROM phys)"""


@query("physics_detector", "E1", "A3", sql=with_ctes(I.EV, PHYS) + "SELECT seq, round(max_lin, 6) AS max_lin, round(max_ang, 6) AS max_ang, d1 FROM fired")
def _(spark, sf):
    return D.physics(I.events(spark, sf)).select("seq", r6("max_lin").alias("max_lin"), r6("max_ang").alias("max_ang"), "d1")


@query("physics_alerts", "E1", "G1",
       sql=with_ctes(I.EV, PHYS, greedy("kept", "(SELECT * FROM fired WHERE d1)", HOUR)) + "SELECT robot_id, us, seq FROM kept")
def _(spark, sf):
    cmd = I.events(spark, sf).select("robot_id", "recv_ts", "seq", "us", "v_lin", "v_ang")
    tl = Timeline.of(cmd, "robot_id", ("recv_ts", "seq"))
    fired = D.physics(cmd, tl).where("d1").select("robot_id", "recv_ts", "seq", "us")
    return thin(fired, tl, HOUR).select("robot_id", "us", "seq")


@query("direction_conflict", "E2", sql=with_ctes(I.EV) + f"""
SELECT seq, n20, fwd, bwd, n20 >= 10 AND fwd / n20 >= 0.15 AND bwd / n20 >= 0.15 AS d2 FROM (
  SELECT seq, count(*) OVER {W20} AS n20, count(CASE WHEN v_lin > 0.01 THEN 1 END) OVER {W20} AS fwd,
         count(CASE WHEN v_lin < -0.01 THEN 1 END) OVER {W20} AS bwd FROM ev)""")
def _(spark, sf):
    return D.direction_conflict(I.events(spark, sf)).select("seq", "n20", "fwd", "bwd", "d2")


_DIFF = "coalesce(list_avg(list_filter(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: abs(a[i] - b[i])), lambda d: isfinite(d))), 0)"


@query("frame_diff", "E3", sql=with_ctes(DIRTY) + f"""
SELECT seq, round({_DIFF}, 6) AS diff FROM (
  SELECT seq, cut AS b, lag(cut) OVER (PARTITION BY robot_id ORDER BY seq) AS a
  FROM (SELECT *, list_concat(ranges, ranges[1:(seq % 14)]) AS cut FROM dirty)) WHERE a IS NOT NULL""")
def _(spark, sf):
    # frames of 64 to 77 beams: the first ones once more at the end
    s = _dirty(spark, sf).withColumn("ranges", F.concat("ranges", F.slice("ranges", F.lit(1), (F.col("seq") % 14).cast("int"))))
    p = Timeline.of(s, "robot_id", ("recv_ts", "seq")).previous(s, {"before": "ranges"}).where("before is not null")
    return p.select("seq", r6(frame_diff(F.col("before"), F.col("ranges"))).alias("diff"))


def _motion_sql(src: str) -> str:
    w = "PARTITION BY robot_id ORDER BY us, seq ROWS BETWEEN"
    return f"""diffs AS (
  SELECT robot_id, us, seq, CASE WHEN a IS NOT NULL THEN list_avg(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) END AS diff
  FROM (SELECT robot_id, us, seq, ranges AS b, lag(ranges) OVER (PARTITION BY robot_id ORDER BY us, seq) AS a FROM {src})),
motion AS (
  SELECT *, max(diff) OVER ({w} 3 PRECEDING AND CURRENT ROW) AS diff4, max(diff) OVER ({w} 1 PRECEDING AND CURRENT ROW) AS diff2,
         count(*) OVER ({w} 19 PRECEDING AND CURRENT ROW) AS frames FROM diffs)"""


@query("scan_repeat", "E3", "A1", sql=with_ctes(I.RS, _motion_sql("rs")) + """
SELECT seq, round(diff4, 6) AS diff4, round(diff2, 6) AS diff2, frames, frames >= 5 AND diff4 < 0.005 AS d3 FROM motion""")
def _(spark, sf):
    m = D.scan_motion(I.repeated_scans(spark, sf))
    return m.select("seq", r6("diff4").alias("diff4"), r6("diff2").alias("diff2"), "frames", "d3")


@query("frame_repeat", "E6", sql=with_ctes(_SHAPED) + """,
acc AS (SELECT *, CASE WHEN NOT low_std AND NOT mostly_max THEN ranges END AS stored FROM judged)
SELECT seq, coalesce(ranges = last_value(stored IGNORE NULLS) OVER (PARTITION BY robot_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND NOT low_std AS repeated FROM acc""")
def _(spark, sf):
    return D.frame_repeat(shaped(spark, sf)).select("seq", "repeated")


@query("odom_and_command_means", "E4", sql=with_ctes(I.EV) + f"""
SELECT seq, round(avg(abs(v_lin)) OVER {W10}, 8) AS speed10, count(*) OVER {W10} AS odoms,
       round(avg(v_lin) OVER {W5}, 8) AS cmd5, count(*) OVER {W5} AS cmds FROM ev""")
def _(spark, sf):
    ev = I.events(spark, sf)
    tl = Timeline.of(ev, "robot_id", ("recv_ts", "seq"))
    return D.cmd_mean(D.odom_speed(ev, tl), tl).select("seq", r6("speed10", 8).alias("speed10"), "odoms", r6("cmd5", 8).alias("cmd5"), "cmds")


_BEATS = """beats AS (SELECT robot_id, us, seq FROM ev WHERE event_type = 'view'),
gaps AS (
  SELECT t.robot_id, t.t, b.us AS last_beat, coalesce((t.t - b.us) / 1e6 > 172800, false) AS d5
  FROM tk t ASOF LEFT JOIN beats b ON t.robot_id = b.robot_id AND t.t >= b.us),
latch AS (
  SELECT *, d5 AND NOT coalesce(lag(d5) OVER w AND lag(last_beat) OVER w = last_beat, false) AS d5_new FROM gaps
  WINDOW w AS (PARTITION BY robot_id ORDER BY t))"""


def beats(spark, sf):
    return I.events(spark, sf).where("event_type = 'view'").select("robot_id", "recv_ts", "seq")


@query("heartbeat_gap", "E5", "G4", sql=with_ctes(I.EV, I.tk(), _BEATS) + "SELECT robot_id, t, last_beat, d5, d5_new FROM latch")
def _(spark, sf):
    g = D.latched(D.heartbeat_gap(I.ticks(spark, sf), beats(spark, sf), 172800))
    return g.select("robot_id", F.unix_micros("tick_ts").alias("t"), F.unix_micros("last_beat").alias("last_beat"), "d5", "d5_new")


@query("asof_latest", "D9", sql=with_ctes(I.EV, I.tk()) + """
SELECT t.robot_id, t.t, c.value AS click_value, p.k AS purchase_k
FROM tk t ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'click') c ON t.robot_id = c.robot_id AND t.t >= c.us
ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'purchase') p ON t.robot_id = p.robot_id AND t.t >= p.us""")
def _(spark, sf):
    ev = I.events(spark, sf).withColumn("_tie", F.col("seq"))
    held = hold(
        I.ticks(spark, sf),
        [
            (ev.where("event_type = 'click'").withColumnRenamed("value", "click_value"), "recv_ts", ["click_value"]),
            (ev.where("event_type = 'purchase'").withColumnRenamed("k", "purchase_k"), "recv_ts", ["purchase_k"]),
        ],
        "robot_id",
    )
    return held.select("robot_id", F.unix_micros("tick_ts").alias("t"), "click_value", "purchase_k")


def timed_scans(spark, sf):
    """Repeated scans spread over the time of the events."""
    return I.repeated_scans(spark, sf).withColumn("recv_ts", F.timestamp_seconds(F.lit(1704067200) + F.col("seq") * 5184))


TS = I.RS + """,
ts AS (SELECT robot_id, seq, (1704067200 + seq * 5184) * 1000000 AS us, ranges FROM rs)"""
_CMD = f"""cmdm AS (
  SELECT robot_id, us, seq, coalesce(max(abs(v_lin)) OVER {W5} > 0.9 OR max(abs(v_ang)) OVER {W5} > 4.5, false) AS d1,
         count(*) OVER {W20} >= 10 AND count(CASE WHEN v_lin > 0.01 THEN 1 END) OVER {W20} / count(*) OVER {W20} >= 0.45
           AND count(CASE WHEN v_lin < -0.01 THEN 1 END) OVER {W20} / count(*) OVER {W20} >= 0.45 AS d2,
         avg(v_lin) OVER {W5} AS cmd5, count(*) OVER {W5} AS cmds FROM ev),
odm AS (SELECT robot_id, us, seq, avg(abs(v_lin)) OVER {W10} AS speed10, count(*) OVER {W10} AS odoms FROM ev)"""
_D6 = """coalesce(o.odoms >= 10 AND s.frames >= 5 AND ((o.speed10 > 0.05 AND coalesce(s.diff2, 0) < 0.002)
           OR (c.cmds >= 5 AND c.cmd5 > 0.05 AND o.speed10 < 0.005)), false)"""
_ASOF = """FROM tk t ASOF LEFT JOIN cmdm c ON t.robot_id = c.robot_id AND t.t >= c.us
ASOF LEFT JOIN odm o ON t.robot_id = o.robot_id AND t.t >= o.us
ASOF LEFT JOIN motion s ON t.robot_id = s.robot_id AND t.t >= s.us"""


@query("motion_consistency", "D10", "E4", sql=with_ctes(I.EV, I.tk(), TS, _motion_sql("ts"), _CMD) + f"""
SELECT t.robot_id, t.t, round(o.speed10, 8) AS speed10, round(s.diff2, 6) AS diff2, {_D6} AS d6 {_ASOF}""")
def _(spark, sf):
    ev = I.events(spark, sf)
    m = D.motion_consistency(I.ticks(spark, sf), ev, ev, timed_scans(spark, sf), robots(spark, sf))
    return m.select("robot_id", F.unix_micros("tick_ts").alias("t"), r6("speed10", 8).alias("speed10"), r6("diff2").alias("diff2"), "d6")


_PUBS = """pubs AS (
  SELECT robot_id, (us + 21599999999) // 21600000000 * 21600000000 AS t, '/' || event_type AS topic, 'u' || (seq % 40) AS node_name
  FROM ev),
bad AS (
  SELECT robot_id, t, topic, string_agg(node_name, ',' ORDER BY node_name) AS nodes FROM pubs p
  WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.topic = p.topic AND al.node_name = p.node_name) GROUP BY ALL),
many AS (SELECT robot_id, t, topic, count(*) AS n FROM pubs GROUP BY ALL HAVING count(*) >= 2),
alarm AS (
  SELECT robot_id, t, coalesce(b.info, m.info) AS d4_info
  FROM (SELECT robot_id, t, arg_min(topic || ' unlisted: ' || nodes, topic) AS info FROM bad GROUP BY ALL) b
  FULL JOIN (SELECT robot_id, t, arg_min(topic || ' publishers: ' || n, topic) AS info FROM many GROUP BY ALL) m USING (robot_id, t))"""


def tick_publishers(spark, sf):
    """The events seen as publishers at the next six-hour tick."""
    step = 6 * HOUR
    return I.events(spark, sf).select(
        "robot_id",
        F.timestamp_seconds(F.ceil(F.col("us") / 1_000_000 / step) * step).alias("tick_ts"),
        F.concat(F.lit("/"), F.col("event_type")).alias("topic"),
        F.concat(F.lit("u"), (F.col("seq") % 40).cast("string")).alias("node_name"),
    )


def robots(spark, sf):
    """Robot sizes, measured once over everything a robot sends."""
    rows = I.events(spark, sf).select("robot_id", "recv_ts").unionByName(timed_scans(spark, sf).select("robot_id", "recv_ts"))
    return Timeline.of(rows, "robot_id", "recv_ts").ordered_by("recv_ts", "seq")


def all_detections(spark, sf, tl, measures=False):
    ev = I.events(spark, sf)
    alarm = G.publisher_alarm(tick_publishers(spark, sf), I.topic_allow(spark, sf), I.EVENT_TOPICS)
    return D.detections(
        I.ticks(spark, sf), ev, ev, timed_scans(spark, sf), beats(spark, sf), alarm, lin_max=0.9, ang_max=4.5, share=0.45, beat_timeout=172800, tl=tl, measures=measures
    )


_DET = f"""det AS (
  SELECT t.robot_id, t.t, coalesce(c.d1, false) AS d1, coalesce(c.d2, false) AS d2, coalesce(s.frames >= 5 AND s.diff4 < 0.005, false) AS d3,
         p.d4_info IS NOT NULL AS d4, l.d5, l.d5_new, {_D6} AS d6
  {_ASOF}
  LEFT JOIN latch l ON t.robot_id = l.robot_id AND t.t = l.t LEFT JOIN alarm p ON t.robot_id = p.robot_id AND t.t = p.t),
voted AS (
  SELECT *, list_filter([CASE WHEN d1 THEN 'D1' END, CASE WHEN d2 THEN 'D2' END, CASE WHEN d3 THEN 'D3' END, CASE WHEN d4 THEN 'D4' END,
         CASE WHEN d5_new THEN 'D5' END, CASE WHEN d6 THEN 'D6' END], lambda v: v IS NOT NULL) AS votes FROM det),
verdicts AS (
  SELECT *, CASE WHEN len(votes) >= 2 THEN 'vote' WHEN d4 OR d5_new THEN 'strong-D4' WHEN len(votes) = 1 THEN 'warning' END AS verdict FROM voted)"""
_ALL = with_ctes(I.EV, I.tk(), TS, _motion_sql("ts"), _CMD, _BEATS, I.AL, _PUBS, _DET)


@query("vote", "F1", "G15", sql=_ALL + "SELECT robot_id, t, d1, d2, d3, d4, d5, d6, array_to_string(votes, ',') AS votes, verdict FROM verdicts")
def _(spark, sf):
    d = all_detections(spark, sf, robots(spark, sf))
    v = D.vote(d.withColumn("d5_all", F.col("d5")).withColumn("d5", F.col("d5_new")))
    return v.select(
        "robot_id", F.unix_micros("tick_ts").alias("t"), "d1", "d2", "d3", "d4", F.col("d5_all").alias("d5"), "d6",
        F.array_join("votes", ",").alias("votes"), "verdict",
    )


@query("ids", "G15", "G1", "G4", "F1", sql=_ALL.rstrip() + ",\n" + greedy("kept", "(SELECT *, 0 AS seq FROM verdicts WHERE verdict IN ('vote', 'strong-D4'))", 86400, us="t") + """
SELECT v.robot_id, v.t, array_to_string(votes, ',') AS votes, verdict, k.us IS NOT NULL AS emitted
FROM verdicts v LEFT JOIN kept k ON v.robot_id = k.robot_id AND v.t = k.us WHERE verdict IN ('vote', 'strong-D4')""")
def _(spark, sf):
    tl = robots(spark, sf)
    out = D.ids(all_detections(spark, sf, tl), 86400, tl)
    return out.select("robot_id", F.unix_micros("tick_ts").alias("t"), F.array_join("votes", ",").alias("votes"), "verdict", "emitted")


# What each voting detector saw, the alert's text and the signed message of every emitted alert.
_SIGNED = _ALL.rstrip() + ",\n" + greedy("kept", "(SELECT *, 0 AS seq FROM verdicts WHERE verdict IN ('vote', 'strong-D4'))", 86400, us="t") + f""",
cmdx AS (
  SELECT robot_id, us, max(abs(v_lin)) OVER {W5} AS max_lin, max(abs(v_ang)) OVER {W5} AS max_ang, avg(v_lin) OVER {W5} AS cmd5, avg(abs(v_lin)) OVER {W10} AS speed10,
         count(CASE WHEN v_lin > 0.01 THEN 1 END) OVER {W20} AS fwd, count(CASE WHEN v_lin < -0.01 THEN 1 END) OVER {W20} AS bwd, count(*) OVER {W20} AS n20 FROM ev),
sent AS (SELECT v.* FROM verdicts v JOIN kept k ON v.robot_id = k.robot_id AND v.t = k.us WHERE verdict IN ('vote', 'strong-D4')),
saw AS (
  SELECT s.robot_id, s.t, s.votes, s.verdict, MAP {{
    'D1': 'lin=' || coalesce(floor(c.max_lin * 1000 + 1e-6)::BIGINT::VARCHAR, '-') || ' ang=' || coalesce(floor(c.max_ang * 1000 + 1e-6)::BIGINT::VARCHAR, '-'),
    'D2': 'fwd=' || c.fwd || ' bwd=' || c.bwd || ' of ' || c.n20, 'D3': 'diff=' || coalesce(floor(m.diff4 * 1000000 + 1e-6)::BIGINT::VARCHAR, '-'),
    'D4': p.d4_info, 'D5': 'silent ms=' || ((s.t - l.last_beat) // 1000),
    'D6': 'speed=' || coalesce(floor(c.speed10 * 1000 + 1e-6)::BIGINT::VARCHAR, '-') || ' command=' || coalesce(floor(c.cmd5 * 1000 + 1e-6)::BIGINT::VARCHAR, '-')
          || ' still=' || coalesce(floor(m.diff2 * 1000000 + 1e-6)::BIGINT::VARCHAR, '-')}} AS seen
  FROM sent s ASOF LEFT JOIN cmdx c ON s.robot_id = c.robot_id AND s.t >= c.us ASOF LEFT JOIN motion m ON s.robot_id = m.robot_id AND s.t >= m.us
  LEFT JOIN latch l ON s.robot_id = l.robot_id AND s.t = l.t LEFT JOIN alarm p ON s.robot_id = p.robot_id AND s.t = p.t),
texts AS (
  SELECT robot_id, t, verdict, '[behaviour alert] (' || CASE WHEN verdict = 'vote' THEN 'vote=' || len(votes) || '/6 >= 2' ELSE 'strong signal' END || '):' || chr(10)
         || array_to_string(list_transform(votes, lambda v: '  - ' || v || '[' || coalesce(seen[v], '') || ']'), chr(10)) AS payload FROM saw),
signed AS (
  SELECT *, '{{"channel":"alerts","nonce":"' || substr({hmac_sql("robot_id || '|' || t || '|' || verdict", I.KEY)}, 1, 16) || '","payload":' || to_json(payload)::VARCHAR || ',"ts":' || (t // 1000000) || '}}' AS body FROM texts)
"""


def signed_alerts(spark, sf):
    tl = robots(spark, sf)
    return D.signed_alerts(all_detections(spark, sf, tl, True), I.KEY, 86400, tl)


@query("signed_alerts", "G15", "C2", "B19", sql=_SIGNED + f"""
SELECT robot_id, t, verdict, payload, '{{"body":' || to_json(body)::VARCHAR || ',"sig":"' || {hmac_sql('body', I.KEY)} || '"}}' AS raw FROM signed""")
def _(spark, sf):
    return signed_alerts(spark, sf).select("robot_id", F.unix_micros("tick_ts").alias("t"), "verdict", "payload", "raw")


@query("detector_hits", "F2", sql=with_ctes(I.EV, PHYS) + """
SELECT robot_id, day, d1, d2, sum(d1) OVER w::BIGINT AS d1_total, sum(d2) OVER w::BIGINT AS d2_total FROM (
  SELECT robot_id, us // 86400000000 AS day, count(*) FILTER (d1) AS d1, count(*) FILTER (v_lin < 0) AS d2 FROM fired GROUP BY ALL)
WINDOW w AS (PARTITION BY robot_id ORDER BY day)""".replace("sum(d1) OVER w::BIGINT", "(sum(d1) OVER w)::BIGINT").replace("sum(d2) OVER w::BIGINT", "(sum(d2) OVER w)::BIGINT"))
def _(spark, sf):
    at = D.physics(I.events(spark, sf)).withColumn("d2", F.col("v_lin") < 0).withColumnRenamed("recv_ts", "tick_ts")
    hits = D.detector_hits(at, ("d1", "d2"), "1 day")
    return hits.select("robot_id", F.floor(F.unix_micros("window_start") / 86_400_000_000).alias("day"), "d1", "d2", "d1_total", "d2_total")


@query("cooldown", "G1", sql=with_ctes(I.EV, greedy("a", "ev", 10 * HOUR), greedy("b", "ev", 50 * HOUR, "robot_id, event_type", strict=True)) + """
SELECT 'plain' AS rule, seq FROM a UNION ALL SELECT 'strict', seq FROM b""")
def _(spark, sf):
    ev = I.events(spark, sf).select("robot_id", "event_type", "recv_ts", "seq")
    plain = A.cooldown(ev, seconds=10 * HOUR).select(F.lit("plain").alias("rule"), "seq")
    strict = A.cooldown(ev, ("robot_id", "event_type"), 50 * HOUR, strict=True).select(F.lit("strict").alias("rule"), "seq")
    return plain.unionByName(strict)


@query("seen_frames_skipped", "D12", sql=with_ctes(I.EV) + """
SELECT seq FROM (SELECT seq, k, lag(k) OVER (PARTITION BY robot_id ORDER BY us, seq) AS p FROM (SELECT * REPLACE (k // 50 AS k) FROM ev))
WHERE k IS DISTINCT FROM p""")
def _(spark, sf):
    ev = I.events(spark, sf).withColumn("stamp_s", F.floor(F.col("k") / 50).cast("double"))
    return D.seen_frames_skipped(ev).select("seq")


@query("silent_scans", "G13", sql=with_ctes(I.EV) + """
SELECT robot_id, us AS since, coalesce(next, last) AS until, round((coalesce(next, last) - us) / 1e6, 6) AS gap_s, next IS NULL AS open
FROM (SELECT robot_id, us, lead(us) OVER (PARTITION BY robot_id ORDER BY us, seq) AS next, (SELECT max(us) FROM ev) + 86400000000 AS last FROM ev)
WHERE (coalesce(next, last) - us) / 1e6 > 36000""")
def _(spark, sf):
    ev = I.events(spark, sf)
    g = D.silent_scans(ev, 10 * HOUR, ticks=watch_end(ev))
    return g.select("robot_id", F.unix_micros("since").alias("since"), F.unix_micros("until").alias("until"), r6("gap_s").alias("gap_s"), "open")


def watch_end(ev):
    """Every robot is watched until a day after the last event of all."""
    end = ev.agg((F.max("us") + 86_400_000_000).alias("us"))
    return ev.select("robot_id").distinct().withColumn("tick_ts", F.timestamp_micros(end.scalar()))


@query("beat_cadence", "G14", sql=with_ctes(I.EV) + """
SELECT seq, round(g, 6) AS gap_s, floor(g / 18000)::BIGINT - 1 AS missed, open
FROM (SELECT seq, (coalesce(next, last) - us) / 1e6 AS g, next IS NULL AS open
      FROM (SELECT seq, us, lead(us) OVER (PARTITION BY robot_id ORDER BY us, seq) AS next, (SELECT max(us) FROM ev) + 86400000000 AS last
            FROM ev WHERE event_type = 'view')) WHERE g > 36000""")
def _(spark, sf):
    late = D.beat_cadence(beats(spark, sf), 5 * HOUR, ticks=watch_end(I.events(spark, sf)))
    return late.select("seq", r6("gap_s").alias("gap_s"), "missed", "open")
