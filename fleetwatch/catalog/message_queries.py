"""Signed messages, artifacts, node graphs, alerts and the alert machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.crypto import hmac_sha256
from ..functions.scan import bind
from ..operators import alerts as A, artifacts as R, graph as G, integrity as S, report as P
from ..session import checkpointed
from . import inputs as I
from .column_queries import hmac_sql
from .detector_queries import HOUR, _SIGNED, greedy, signed_alerts
from .registry import query, r6, with_ctes

# -- messages ------------------------------------------------------------------


def envelopes(spark, sf):
    """Events as signed messages, some of them spoiled.

    Payload = props, channel = event type, sent at the event, received up to 14 s
    later; the nonce repeats where type, number and user do. Every seventh
    signature is spoiled, every eleventh text is cut, every thirteenth payload
    is a number. The messages are written once, as a bus would have logged them.
    """
    ev = I.events(spark, sf).repartition("seq")
    nonce = F.substring(F.sha2(F.concat_ws("|", "event_type", F.col("k").cast("string"), F.col("user_id").cast("string")), 256), 1, 16)
    sent = F.floor(F.col("us") / 1_000_000)
    body = F.when(
        F.col("seq") % 13 == 0, F.to_json(F.struct(F.col("event_type").alias("channel"), nonce.alias("nonce"), F.col("k").alias("payload"), sent.alias("ts")))
    ).otherwise(F.to_json(F.struct(F.col("event_type").alias("channel"), nonce.alias("nonce"), F.col("props").alias("payload"), sent.alias("ts"))))
    seq = F.col("seq")

    def seal(b):
        spoil = lambda sig: F.when(seq % 7 == 0, F.reverse(sig)).otherwise(sig)
        return F.to_json(F.struct(b.alias("body"), bind(hmac_sha256(b, I.KEY), spoil).alias("sig")))

    raw = bind(bind(body, seal), lambda r: F.when(seq % 11 == 0, F.substr(r, F.lit(2))).otherwise(r))
    late = (F.col("seq") % 15) * 1_000_000
    return checkpointed(ev.select(
        "robot_id", F.timestamp_micros(F.col("us") + late).alias("recv_ts"), "seq",
        F.concat(F.lit("rx"), (F.col("seq") % 3).cast("string")).alias("receiver"),
        F.when(F.col("seq") % 17 == 0, F.lit("view")).otherwise(F.col("event_type")).alias("topic"),
        raw.alias("raw"),
    ))


# What the checks must find, from how the messages were made.
_ENV = I.EV + """,
made AS (
  SELECT robot_id, us + seq % 15 * 1000000 AS us, seq, 'rx' || (seq % 3) AS receiver,
         substr(sha256(event_type || '|' || k || '|' || user_id), 1, 16) AS nonce, props AS payload,
         CASE WHEN seq % 11 = 0 THEN 'format' WHEN seq % 7 = 0 THEN 'signature' WHEN seq % 13 = 0 THEN 'types'
              WHEN seq % 17 = 0 AND event_type <> 'view' THEN 'channel'
              WHEN (us + seq % 15 * 1000000) / 1e6 - us // 1000000 > 10 THEN 'stale' END AS first_reason FROM ev)"""
_VERIFIED = _ENV + ",\n" + greedy("firsts", "(SELECT * FROM made WHERE first_reason IS NULL)", 12, "receiver, nonce") + """,
verified AS (
  SELECT m.*, coalesce(first_reason, CASE WHEN f.seq IS NULL THEN 'replay' END) AS reason
  FROM made m LEFT JOIN firsts f ON m.seq = f.seq)"""


def verified(spark, sf, ttl=12.0):
    return S.verify(envelopes(spark, sf), I.KEY, F.col("topic"), ttl=ttl)


@query("sign", "C2", sql=f"""
SELECT doc_id, '{{"body":' || to_json(b)::VARCHAR || ',"sig":"' || {hmac_sql('b', I.KEY)} || '"}}' AS raw FROM (
  SELECT doc_id, '{{"channel":"alerts","nonce":"' || substr(sha256(doc_id::VARCHAR), 1, 16) || '","payload":' || to_json(concat_ws(' é ', lang, source, text))::VARCHAR || ',"ts":' || doc_id || '}}' AS b FROM documents)""")
def _(spark, sf):
    d = I.text_table(spark, sf)
    payload = F.concat_ws(" é ", "lang", "source", "text")
    nonce = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16)
    return S.sign(d, I.KEY, payload, F.lit("alerts"), F.col("doc_id"), nonce).select("doc_id", "raw")


@query("verify", "C3", "C4", "C5", "C6", "A5",
       sql=with_ctes(_VERIFIED) + "SELECT seq, receiver, CASE WHEN first_reason IS NULL THEN payload END AS payload, reason AS reject_reason FROM verified")
def _(spark, sf):
    v = verified(spark, sf)
    payload = F.when(F.col("reject_reason").isNull() | (F.col("reject_reason") == "replay"), F.col("payload"))
    return v.select("seq", "receiver", payload.alias("payload"), "reject_reason")


@query("channel_bound", "C4", sql=with_ctes(_ENV) + "SELECT topic_ok, count(*) AS messages FROM (SELECT first_reason IS DISTINCT FROM 'channel' AS topic_ok FROM made) GROUP BY ALL")
def _(spark, sf):
    seen = S.inspect(envelopes(spark, sf), I.KEY, F.col("topic"))
    ok = ~F.col("reject_reason").eqNullSafe(F.lit("channel"))
    return seen.groupBy(ok.alias("topic_ok")).agg(F.count(F.lit(1)).alias("messages"))


@query("freshness", "C5", sql=with_ctes(I.EV) + """
SELECT seq, us // 1000000 BETWEEN (us + seq % 15 * 1000000) / 1e6 - 5 AND (us + seq % 15 * 1000000) / 1e6 + 2 AS fresh FROM ev""")
def _(spark, sf):
    now = (F.col("us") + F.col("seq") % 15 * 1_000_000) / 1e6
    sent = F.floor(F.col("us") / 1_000_000)
    return I.events(spark, sf).select("seq", S.is_fresh(sent, now, 5.0).alias("fresh"))


@query("drop_replays", "C6", sql=with_ctes(I.EV, greedy("firsts", "(SELECT *, event_type || k AS nonce FROM ev)", 12 * HOUR, "event_type, nonce")) + "SELECT seq FROM firsts")
def _(spark, sf):
    ev = I.events(spark, sf).withColumn("nonce", F.concat("event_type", F.col("k").cast("string")))
    return S.drop_replays(ev.select("event_type", "nonce", "recv_ts", "seq"), ("event_type", "nonce"), 12 * HOUR).select("seq")


@query("impostor_messages", "D8", sql=with_ctes(_VERIFIED) + """
SELECT v.seq FROM verified v WHERE reason IS NULL AND NOT EXISTS (
  SELECT 1 FROM made m JOIN supplier s ON m.robot_id = 'r' || s.s_suppkey WHERE m.nonce = v.nonce)""")
def _(spark, sf):
    """Own messages are those of robots that have a supplier's number."""
    ours = I.table(spark, sf, "supplier").select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("robot_id"))
    ev = I.events(spark, sf).join(ours, "robot_id", "left_semi")
    own = ev.select(F.substring(F.sha2(F.concat_ws("|", "event_type", F.col("k").cast("string"), F.col("user_id").cast("string")), 256), 1, 16).alias("nonce"))
    return S.impostor_messages(verified(spark, sf), own).select("seq")


@query("rejections", "F9", sql=with_ctes(_VERIFIED, "bad AS (SELECT * FROM verified WHERE reason IS NOT NULL)", greedy("reports", "bad", 10 * HOUR, "receiver")) + """
SELECT r.receiver, r.us AS report_us, count(*) AS refused FROM (
  SELECT receiver, us, seq, coalesce(lag(us) OVER w, -1) AS pus, coalesce(lag(seq) OVER w, -1) AS pseq FROM reports WINDOW w AS (PARTITION BY receiver ORDER BY us, seq)) r
JOIN bad b ON b.receiver = r.receiver AND (b.us, b.seq) <= (r.us, r.seq) AND (b.us, b.seq) > (r.pus, r.pseq) GROUP BY r.receiver, r.us, r.seq""")
def _(spark, sf):
    out = S.rejections(verified(spark, sf), 10 * HOUR)
    return out.select("receiver", F.unix_micros("report_ts").alias("report_us"), "refused")


# -- artifacts -------------------------------------------------------------------


def files(spark, sf):
    """Documents as files; sidecars missing for ids 0 mod 5 and spoiled for 1 mod 5."""
    d = I.text_table(spark, sf)
    content = F.encode("text", "UTF-8")
    sig = hmac_sha256(content, I.KEY, binary=True)
    side = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, F.reverse(sig)).otherwise(sig)
    return d.select(F.col("doc_id").cast("string").alias("path"), content.alias("content"), side.alias("sidecar"))


@query("sign_artifacts", "C7", sql=f"SELECT doc_id || '.sha256.hmac' AS path, {hmac_sql('text', I.KEY)} AS sidecar FROM documents")
def _(spark, sf):
    return R.sign_artifacts(files(spark, sf), I.KEY)


_VERDICT = "CASE doc_id % 5 WHEN 0 THEN 'unsigned' WHEN 1 THEN 'tampered' ELSE 'ok' END"


@query("verify_artifacts", "C7", "C8", "A10", sql=f"""
SELECT doc_id::VARCHAR AS path, v AS verdict, CASE v WHEN 'ok' THEN 'load' ELSE 'refuse' END AS strict,
       CASE v WHEN 'ok' THEN 'load' WHEN 'unsigned' THEN 'warn' ELSE 'refuse' END AS lenient FROM (SELECT doc_id, {_VERDICT} AS v FROM documents)""")
def _(spark, sf):
    v = R.verify_artifacts(files(spark, sf), I.KEY)
    return v.select("path", "verdict", R.load_policy(F.col("verdict"), True).alias("strict"), R.load_policy(F.col("verdict"), False).alias("lenient"))


@query("key_fingerprints", "C9", sql="""
SELECT o_custkey, count(*) AS nodes, min(f) = max(f) AS same_key, min(f) AS low
FROM (SELECT o_custkey, substr(sha256(o_orderpriority || (o_custkey % 2)), 1, 16) AS f FROM orders) GROUP BY o_custkey""")
def _(spark, sf):
    o = I.table(spark, sf, "orders")
    n = R.key_fingerprints(o, F.concat("o_orderpriority", (F.col("o_custkey") % 2).cast("string")))
    agree = R.fingerprint_agreement(n, "o_custkey")
    return agree.join(n.groupBy("o_custkey").agg(F.min("fingerprint").alias("low")), "o_custkey")


# -- node graph ------------------------------------------------------------------

_POLLS = """polls AS (
  SELECT robot_id, poll_seq, lag(poll_seq) OVER w AS prev_seq, lead(poll_seq) OVER w AS next_seq, row_number() OVER w AS poll_no
  FROM (SELECT DISTINCT robot_id, poll_seq FROM sn) WINDOW w AS (PARTITION BY robot_id ORDER BY poll_seq)),
diff AS (
  SELECT s.robot_id, s.poll_seq, s.node, 'joined' AS change FROM sn s JOIN polls p USING (robot_id, poll_seq)
  WHERE p.prev_seq IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sn b WHERE b.robot_id = s.robot_id AND b.node = s.node AND b.poll_seq = p.prev_seq)
  UNION ALL
  SELECT s.robot_id, p.next_seq, s.node, 'exited' FROM sn s JOIN polls p USING (robot_id, poll_seq)
  WHERE p.next_seq IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sn b WHERE b.robot_id = s.robot_id AND b.node = s.node AND b.poll_seq = p.next_seq))"""


@query("graph_diff", "D1", "A6", sql=with_ctes(I.EV, I.SN, _POLLS) + "SELECT * FROM diff")
def _(spark, sf):
    return G.graph_diff(I.snapshots(spark, sf)).select("robot_id", "poll_seq", "node", "change")


@query("not_whitelisted", "D2", "A8", sql=with_ctes(I.EV, I.SN, I.WL) + "SELECT robot_id, poll_seq, node FROM sn WHERE regexp_extract(node, '[^/]*$') NOT IN (SELECT name FROM wl)")
def _(spark, sf):
    return G.not_whitelisted(I.snapshots(spark, sf), I.whitelist(spark, sf)).select("robot_id", "poll_seq", "node")


@query("baseline_split", "D3", sql=with_ctes(I.EV, I.SN, I.WL) + """
SELECT robot_id, node, regexp_extract(node, '[^/]*$') IN (SELECT name FROM wl) AS trusted
FROM sn WHERE (robot_id, poll_seq) IN (SELECT (robot_id, min(poll_seq)) FROM sn GROUP BY robot_id)""")
def _(spark, sf):
    return G.baseline_split(I.snapshots(spark, sf), I.whitelist(spark, sf)).select("robot_id", "node", "trusted")


@query("grace_absorb", "D4", sql=with_ctes(I.EV, I.SN, I.WL, _POLLS) + """
SELECT robot_id, poll_seq, node, regexp_extract(node, '[^/]*$') IN (SELECT name FROM wl)
       AND (poll_seq - (SELECT min(poll_seq) FROM sn b WHERE b.robot_id = d.robot_id)) * 3600 < 259200 AS absorbed
FROM diff d WHERE change = 'joined'""")
def _(spark, sf):
    s = I.snapshots(spark, sf)
    joins = G.graph_diff(s).where("change = 'joined'")
    return G.grace_absorb(joins, s, I.whitelist(spark, sf), 72 * HOUR).select("robot_id", "poll_seq", "node", "absorbed")


@query("snapshot_totals", "F8", sql=with_ctes(I.EV, I.SN) + "SELECT robot_id, poll_seq, count(DISTINCT node) AS live_nodes FROM sn GROUP BY ALL")
def _(spark, sf):
    return G.snapshot_totals(I.snapshots(spark, sf))


_NODE_EVENTS = """wnode AS (SELECT DISTINCT node FROM sn WHERE regexp_extract(node, '[^/]*$') NOT IN (SELECT name FROM wl)),
nev AS (
  SELECT s.robot_id, s.poll_seq, s.node, 'joined' AS change FROM sn s JOIN polls p USING (robot_id, poll_seq) JOIN wnode USING (node) WHERE poll_no <= 2
  UNION ALL
  SELECT d.* FROM diff d JOIN polls p USING (robot_id, poll_seq) JOIN wnode USING (node) WHERE poll_no > 2),
joins AS (SELECT *, poll_seq * 3600000000 AS us FROM nev WHERE change = 'joined'),
exits AS (SELECT *, poll_seq * 3600000000 AS us FROM nev WHERE change = 'exited')"""


@query("alert_once", "G2", sql=with_ctes(I.EV, I.SN, I.WL, _POLLS, _NODE_EVENTS, """lives AS (
  SELECT j.*, (SELECT count(*) FROM exits e WHERE e.robot_id = j.robot_id AND e.node = j.node AND e.us < j.us) AS life FROM joins j)""",
  greedy("a", "joins", 100 * HOUR, "robot_id, node", seq="poll_seq"), greedy("b", "lives", 100 * HOUR, "robot_id, node, life", seq="poll_seq")) + """
SELECT 'ttl' AS rule, robot_id, node, us FROM a UNION ALL SELECT 'exits', robot_id, node, us FROM b""")
def _(spark, sf):
    s = I.snapshots(spark, sf)
    tl = G.node_histories(s)
    e = G.node_events(s, I.whitelist(spark, sf), tl)
    joins, exits = e.where("change = 'joined'"), e.where("change = 'exited'")
    cols = ["robot_id", "node", F.unix_micros("poll_ts").alias("us")]
    ttl = G.alert_once(joins, 100 * HOUR, None, tl).select(F.lit("ttl").alias("rule"), *cols)
    return ttl.unionByName(G.alert_once(joins, 100 * HOUR, exits, tl).select(F.lit("exits").alias("rule"), *cols))


@query("node_monitor", "G3", "F8", sql=with_ctes(I.EV, I.SN, I.WL, _POLLS, _NODE_EVENTS, greedy("a", "joins", 100 * HOUR, "robot_id, node", seq="poll_seq")) + """
SELECT a.robot_id, a.seq AS poll_seq, a.node, 'joined' AS alert, (SELECT count(*) FROM sn WHERE sn.robot_id = a.robot_id AND sn.poll_seq = a.seq) AS live_nodes FROM a""")
def _(spark, sf):
    return G.node_monitor(I.snapshots(spark, sf), I.whitelist(spark, sf), 100 * HOUR).select("robot_id", "poll_seq", "node", "alert", "live_nodes")


@query("unauthorised_publishers", "D5", "A7", sql=with_ctes(I.EV, I.PB, I.AL) + """
SELECT robot_id, tick_s, arg_min(topic, topic) AS topic, arg_min(nodes, topic) AS nodes FROM (
  SELECT robot_id, tick_s, topic, string_agg(node_name, ',' ORDER BY node_name) AS nodes FROM pb
  WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.topic = pb.topic AND al.node_name = pb.node_name) GROUP BY ALL) GROUP BY robot_id, tick_s""")
def _(spark, sf):
    u = G.unauthorised_publishers(I.publishers(spark, sf), I.topic_allow(spark, sf), I.EVENT_TOPICS)
    return u.select("robot_id", F.unix_seconds("tick_ts").alias("tick_s"), "topic", F.array_join("nodes", ",").alias("nodes"))


@query("publisher_multiplicity", "D6", sql=with_ctes(I.EV, I.PB) + "SELECT robot_id, tick_s, topic, count(*) AS publishers FROM pb GROUP BY ALL HAVING count(*) >= 2")
def _(spark, sf):
    m = G.publisher_multiplicity(I.publishers(spark, sf), I.EVENT_TOPICS)
    return m.select("robot_id", F.unix_seconds("tick_ts").alias("tick_s"), "topic", "publishers")


@query("merge_alerts", "D11", sql=with_ctes(I.EV) + """
SELECT robot_id, seq, value, NULL::INT AS k FROM ev WHERE event_type = 'error' UNION ALL SELECT robot_id, seq, NULL, k FROM ev WHERE event_type = 'click'""")
def _(spark, sf):
    ev = I.events(spark, sf)
    return A.merge_alerts(ev.where("event_type = 'error'").select("robot_id", "seq", "value"), ev.where("event_type = 'click'").select("robot_id", "seq", "k"))


# -- bursts and notification -------------------------------------------------------


def node_alerts(spark, sf):
    """Events as node alerts: robot = event type, node = user, exits where k is 0 mod 10."""
    return I.events(spark, sf).select(
        F.col("event_type").alias("robot_id"), "recv_ts", "seq", F.concat(F.lit("/u"), F.col("user_id").cast("string")).alias("node"), (F.col("k") % 10 == 0).alias("is_exit")
    )


_NA = "na AS (SELECT event_type AS robot_id, us, seq, '/u' || user_id AS node, k % 10 = 0 AS is_exit FROM ev)"


@query("burst_summary", "F6", sql=with_ctes(I.EV, _NA) + """
SELECT robot_id, ws AS window_us, total, total - overflow AS listed, overflow, names FROM (
  SELECT robot_id, ws, count(*) AS total, greatest(count(*) FILTER (NOT is_exit) - 40, 0) AS overflow,
         array_to_string(list(CASE WHEN is_exit THEN '(exit) ' || node ELSE node END ORDER BY us, seq)[1:10], ',') AS names
  FROM (SELECT n.*, o + (us - o) // 86400000000 * 86400000000 AS ws FROM na n JOIN (SELECT robot_id, min(us) AS o FROM na GROUP BY ALL) USING (robot_id)) GROUP BY ALL)""")
def _(spark, sf):
    a = node_alerts(spark, sf)
    b = A.burst_summary(a, a.select("robot_id", F.col("recv_ts").alias("started")), 86400, 40)
    return b.select("robot_id", F.unix_micros("window_start").alias("window_us"), "total", "listed", "overflow", F.array_join("names", ",").alias("names"))


@query("notify", "G9", sql=with_ctes(I.EV, _NA, greedy("edges", "na", 2 * HOUR), """sent AS (
  SELECT robot_id, us, 'immediate' AS kind, 1 AS total, seq FROM edges
  UNION ALL
  SELECT robot_id, (us // 7200000000 + 1) * 7200000000, 'summary', count(*), -1 FROM na WHERE seq NOT IN (SELECT seq FROM edges) GROUP BY robot_id, us // 7200000000)""",
  greedy("kept", "sent", HOUR)) + """
SELECT s.robot_id, s.us, s.kind, s.total, k.seq IS NULL AS rate_limited FROM sent s LEFT JOIN kept k ON s.robot_id = k.robot_id AND s.us = k.us AND s.seq = k.seq""")
def _(spark, sf):
    n = A.notify(node_alerts(spark, sf), 2 * HOUR, HOUR)
    return n.select("robot_id", F.unix_micros("sent_ts").alias("us"), "kind", "total", "rate_limited")


# -- machines ------------------------------------------------------------------------


def _numbered(src: str) -> str:
    return f"src AS (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY us, seq) AS rn FROM {src})"


#: Pauses of 12 hours, a quiet time of 72 after two within 96.
_PAUSES = f""",
m AS (
  SELECT robot_id, rn, us, 'pause' AS action, us AS pause, us AS hist, NULL::BIGINT AS quiet, false AS escalated FROM src WHERE rn = 1
  UNION ALL
  SELECT robot_id, rn, us, action, CASE WHEN action = 'pause' THEN us ELSE pause END,
         CASE WHEN action = 'pause' THEN us WHEN action = 'quiet' THEN hist ELSE h END,
         CASE WHEN action = 'quiet' THEN quiet WHEN action = 'pause' AND us - h < {96 * HOUR}000000 THEN us + {72 * HOUR}000000 END,
         coalesce(action = 'pause' AND us - h < {96 * HOUR}000000, false)
  FROM (
    SELECT s.robot_id, s.rn, s.us, m.pause, m.hist, m.quiet, CASE WHEN m.quiet IS NULL THEN m.hist END AS h,
           CASE WHEN m.quiet IS NOT NULL AND s.us < m.quiet THEN 'quiet' WHEN s.us < m.pause + {12 * HOUR}000000 THEN 'counted' ELSE 'pause' END AS action
    FROM m JOIN src s ON s.robot_id = m.robot_id AND s.rn = m.rn + 1))
"""


@query("patrol_pause", "G5", sql="WITH RECURSIVE " + I.EV + ",\n" + _numbered("(SELECT * FROM ev WHERE event_type = 'error')") + _PAUSES + "SELECT robot_id, us, action, escalated FROM m")
def _(spark, sf):
    a = I.events(spark, sf).where("event_type = 'error'")
    p = A.patrol_pause(a, pause_s=12 * HOUR, window_s=96 * HOUR, quiet_s=72 * HOUR)
    return p.select("robot_id", F.col("t").alias("us"), "action", "escalated")


@query("alert_to_pause", "G15", "C3", "G5", sql=_SIGNED.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + _numbered("(SELECT robot_id, t + 1000000 AS us, 0 AS seq FROM signed)") + _PAUSES + "SELECT robot_id, us, action, escalated FROM m")
def _(spark, sf):
    """Alerts signed by the detector node, delivered a second later and twice, verified by the patrol, which pauses."""
    sent = signed_alerts(spark, sf).select("robot_id", "tick_ts", "raw")
    copies = sent.withColumn("after", F.explode(F.array(F.lit(1), F.lit(2))))
    arrived = copies.select("robot_id", (F.col("tick_ts") + F.make_dt_interval(secs=F.col("after"))).alias("recv_ts"), F.col("after").cast("long").alias("seq"), F.col("robot_id").alias("receiver"), "raw")
    accepted = S.verify(arrived, I.KEY, F.lit("alerts")).where("reject_reason IS NULL")
    p = A.patrol_pause(accepted, pause_s=12 * HOUR, window_s=96 * HOUR, quiet_s=72 * HOUR)
    return p.select("robot_id", F.col("t").alias("us"), "action", "escalated")


@query("mission_mode", "G6", sql="WITH RECURSIVE " + I.EV + ",\n" + _numbered("(SELECT *, CASE event_type WHEN 'error' THEN 'alert' WHEN 'view' THEN 'tick' ELSE 'sensor' END AS kind, k < 35 AS danger FROM ev)") + f""",
m AS (
  SELECT robot_id, 0::BIGINT AS rn, 0::BIGINT AS us, 'PATROL' AS mode, NULL::BIGINT AS since, []::BIGINT[] AS stops, false AS escalated, false AS emitted, '' AS cause FROM src WHERE rn = 1
  UNION ALL
  SELECT robot_id, rn, us,
         CASE WHEN on_sensor THEN CASE WHEN danger THEN 'AVOID_OBSTACLE' ELSE 'PATROL' END WHEN on_alert THEN 'EMERGENCY_STOP' WHEN on_tick THEN 'PATROL' ELSE mode END,
         CASE WHEN on_alert THEN us WHEN on_tick THEN NULL ELSE since END,
         CASE WHEN on_alert THEN new_stops ELSE stops END, on_alert AND len(new_stops) >= 3, on_sensor OR on_alert OR on_tick, kind
  FROM (
    SELECT s.robot_id, s.rn, s.us, s.kind, s.danger, m.mode, m.since, m.stops,
           s.kind = 'sensor' AND m.mode <> 'EMERGENCY_STOP' AS on_sensor, s.kind = 'alert' AND m.mode <> 'EMERGENCY_STOP' AS on_alert,
           coalesce(s.kind = 'tick' AND m.mode = 'EMERGENCY_STOP' AND s.us - m.since >= {8 * HOUR}000000, false) AS on_tick,
           list_append(list_filter(m.stops, lambda x: s.us - x < {240 * HOUR}000000), s.us) AS new_stops
    FROM m JOIN src s ON s.robot_id = m.robot_id AND s.rn = m.rn + 1))
SELECT robot_id, us, mode, cause, escalated FROM m WHERE emitted""")
def _(spark, sf):
    ev = I.events(spark, sf)
    kind = F.when(F.col("event_type") == "error", "alert").when(F.col("event_type") == "view", "tick").otherwise("sensor")
    rows = ev.withColumn("kind", kind).withColumn("danger", F.col("k") < 35)
    m = A.mission_mode(rows, recovery_s=8 * HOUR, window_s=240 * HOUR)
    return m.select("robot_id", F.col("t").alias("us"), "mode", "cause", "escalated")


@query("training_guard", "G8", sql="WITH RECURSIVE " + I.EV + ",\n" + _numbered("(SELECT *, CASE WHEN event_type = 'signup' THEN 'reset' ELSE 'alert' END AS kind FROM ev)") + f""",
m AS (
  SELECT robot_id, 0::BIGINT AS rn, 0::BIGINT AS us, false AS stopped, []::BIGINT[] AS hist, NULL::BIGINT AS quiet, '' AS action FROM src WHERE rn = 1
  UNION ALL
  SELECT robot_id, rn, us, CASE action WHEN 'reset' THEN false WHEN 'stop' THEN true ELSE stopped END,
         CASE WHEN action IN ('reset', 'quiet') THEN hist ELSE nh END,
         CASE WHEN action IN ('reset', 'quiet') THEN quiet WHEN action = 'escalate' THEN us + {60 * HOUR}000000 END, action
  FROM (
    SELECT *, CASE WHEN kind = 'reset' THEN 'reset' WHEN us < quiet THEN 'quiet' WHEN len(nh) >= 10 THEN 'escalate' WHEN stopped THEN 'held' ELSE 'stop' END AS action FROM (
      SELECT s.robot_id, s.rn, s.us, s.kind, m.stopped, m.hist, m.quiet, list_append(list_filter(m.hist, lambda x: s.us - x < {60 * HOUR}000000), s.us) AS nh
      FROM m JOIN src s ON s.robot_id = m.robot_id AND s.rn = m.rn + 1)))
SELECT robot_id, us, action FROM m WHERE rn > 0 AND action <> 'reset'""")
def _(spark, sf):
    rows = I.events(spark, sf).withColumn("kind", F.when(F.col("event_type") == "signup", "reset").otherwise("alert"))
    g = A.training_guard(rows, window_s=60 * HOUR, quiet_s=60 * HOUR)
    return g.select("robot_id", F.col("t").alias("us"), "action")


@query("stuck_events", "G10", "G13", sql="WITH RECURSIVE " + I.EV + ",\n" + _numbered("(SELECT *, value AS x, k::DOUBLE AS y, event_type = 'signup' AS arrived FROM ev)") + f""",
m AS (
  SELECT robot_id, rn, us, x AS ax, y AS ay, us AS since, 0::BIGINT AS n, NULL::BIGINT AS until, false AS hit FROM src WHERE rn = 1
  UNION ALL
  SELECT robot_id, rn, us,
         CASE WHEN busy THEN ax WHEN moved OR (arrived AND NOT stuck) THEN x ELSE bx END, CASE WHEN busy THEN ay WHEN moved OR (arrived AND NOT stuck) THEN y ELSE by_ END,
         CASE WHEN busy THEN since WHEN moved OR (arrived AND NOT stuck) THEN us ELSE bs END,
         CASE WHEN busy THEN n WHEN stuck THEN n + 1 WHEN arrived THEN 0 ELSE n END,
         CASE WHEN busy THEN until WHEN stuck THEN us + {5 * HOUR}000000 END, stuck
  FROM (
    SELECT *, NOT busy AND sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_)) > 60 AS moved,
           NOT busy AND NOT sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_)) > 60 AND us - bs > {8 * HOUR}000000 AS stuck FROM (
      SELECT s.robot_id, s.rn, s.us, s.x, s.y, s.arrived, m.ax, m.ay, m.since, m.n, m.until, coalesce(s.us < m.until, false) AS busy,
             CASE WHEN m.until IS NOT NULL THEN s.x ELSE m.ax END AS bx, CASE WHEN m.until IS NOT NULL THEN s.y ELSE m.ay END AS by_,
             CASE WHEN m.until IS NOT NULL THEN s.us ELSE m.since END AS bs
      FROM m JOIN src s ON s.robot_id = m.robot_id AND s.rn = m.rn + 1)))
SELECT robot_id, us, n AS stuck_no, round(CASE WHEN n % 2 = 1 THEN 1 ELSE -1 END * least(0.8, 0.3::DOUBLE * n), 6) AS turn FROM m WHERE hit""")
def _(spark, sf):
    rows = I.events(spark, sf).select("robot_id", "recv_ts", "seq", F.col("value").alias("x"), F.col("k").cast("double").alias("y"), (F.col("event_type") == "signup").alias("arrived"))
    s = A.stuck_events(rows, dist=60, time_s=8 * HOUR, backup_s=5 * HOUR)
    return s.select("robot_id", F.col("t").alias("us"), "stuck_no", r6("turn").alias("turn"))


@query("security_status", "G7", sql=with_ctes(I.EV, I.tk()) + """
SELECT t.robot_id, t.t, CASE WHEN (t.t - a.us) / 1e6 <= 86400 THEN 'ALERT: ' || a.props ELSE 'OK' END AS status
FROM tk t ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'error') a ON t.robot_id = a.robot_id AND t.t >= a.us""")
def _(spark, sf):
    from ..functions.text import security_text

    alerts = I.events(spark, sf).where("event_type = 'error'").withColumn("status", security_text(F.col("props")))
    return A.security_status(alerts, I.ticks(spark, sf), 86400).select("robot_id", F.unix_micros("tick_ts").alias("t"), "status")


@query("health_report", "F7", "B19", "A11", sql=with_ctes(I.EV, I.tk()) + """
SELECT t.robot_id, t.t, '== health ==' || chr(10) || 'sensor: ' || coalesce(s.props, 'waiting') || chr(10) || 'mission: ' || coalesce(m.props, 'waiting') || chr(10) || 'security: ' || coalesce(a.props, 'OK') AS report
FROM tk t ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'click') s ON t.robot_id = s.robot_id AND t.t >= s.us
ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'signup') m ON t.robot_id = m.robot_id AND t.t >= m.us
ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'error') a ON t.robot_id = a.robot_id AND t.t >= a.us""")
def _(spark, sf):
    ev = I.events(spark, sf)
    part = {n: ev.where(F.col("event_type") == t).select("robot_id", "recv_ts", "seq", F.col("props").alias(n)) for n, t in (("sensor", "click"), ("mission", "signup"), ("security", "error"))}
    h = P.health_report(I.ticks(spark, sf), part["sensor"], part["mission"], part["security"])
    return h.select("robot_id", F.unix_micros("tick_ts").alias("t"), "report")


@query("late_joiner_view", "A12", sql=with_ctes(I.EV) + """
SELECT seq FROM (SELECT seq, us, row_number() OVER (PARTITION BY event_type, robot_id, us >= 1705276800000000 ORDER BY us DESC, seq DESC) AS r FROM ev)
WHERE us >= 1705276800000000 OR r <= 3""")
def _(spark, sf):
    start = F.timestamp_seconds(F.lit(1705276800))
    return P.late_joiner_view(I.events(spark, sf), start, True, 3, ("event_type", "robot_id")).select("seq")
