"""Array, geometry, text and scoring functions over the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry, scan, scoring, text
from ..functions.crypto import hmac_sha256
from ..operators.report import audit_commands
from . import inputs as I
from .registry import checksum, checksum_sql, query, r6, with_ctes

TOP = scan.MAX_RANGE


def _dirty(spark, sf):
    """Scans with NaN and infinite beams put in at every eleventh and thirteenth place."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return I.scans(spark, sf).withColumn(
        "ranges",
        F.transform("ranges", lambda x, i: F.when((F.col("seq") + i) % 11 == 0, nan).when((F.col("seq") + i) % 13 == 0, inf).otherwise(x)),
    )


DIRTY = I.SC + """,
dirty AS (
  SELECT robot_id, seq, list_transform(ranges, lambda x, i: CASE WHEN (seq + i - 1) % 11 = 0 THEN 'nan'::DOUBLE
         WHEN (seq + i - 1) % 13 = 0 THEN 'inf'::DOUBLE ELSE x END) AS ranges FROM sc)"""
CLEAN = DIRTY + """,
clean AS (
  SELECT robot_id, seq, list_transform(ranges, lambda x: CASE WHEN isfinite(x) THEN least(greatest(x, 0.0), 3.5) ELSE 3.5 END) AS r
  FROM dirty)"""


@query("sanitize_ranges", "B1", sql=with_ctes(CLEAN) + f"SELECT seq, {checksum_sql('r')} AS chk, round(list_max(r), 6) AS hi FROM clean")
def _(spark, sf):
    s = _dirty(spark, sf).withColumn("r", scan.sanitize_ranges(F.col("ranges")))
    return s.select("seq", checksum(F.col("r")).alias("chk"), r6(F.array_max("r")).alias("hi"))


def _resample_sql(n: int) -> str:
    taken = f"list_filter(r, lambda x, i: (i - 1) % greatest(1, len(r) // {n}) = 0)[1:{n}]"
    return f"list_concat({taken}, list_transform(range({n} - len({taken})), lambda z: 3.5::DOUBLE))"


@query("resample_beams", "B2",
       sql=with_ctes(CLEAN) + f"SELECT seq, {checksum_sql(_resample_sql(20))} AS down, {checksum_sql(_resample_sql(90))} AS padded FROM clean")
def _(spark, sf):
    s = _dirty(spark, sf).withColumn("r", scan.sanitize_ranges(F.col("ranges")))
    return s.select("seq", checksum(scan.resample_beams(F.col("r"), 20)).alias("down"), checksum(scan.resample_beams(F.col("r"), 90)).alias("padded"))


def _bins_sql(n: int, width: str) -> str:
    return f"list_transform(range({n}), lambda i: coalesce(list_min(r[i * {width} + 1:(i + 1) * {width}]), 3.5))"


@query("bin_min", "B3", sql=with_ctes(CLEAN) + f"SELECT seq, {checksum_sql(_bins_sql(20, '4'))} AS chk FROM clean")
def _(spark, sf):
    s = _dirty(spark, sf).withColumn("r", scan.sanitize_ranges(F.col("ranges")))
    return s.select("seq", checksum(scan.bin_min(F.col("r"), 20)).alias("chk"))


@query("sector_min", "B4", sql=with_ctes(CLEAN) + f"SELECT seq, {checksum_sql(_bins_sql(24, '2'))} AS chk FROM clean")
def _(spark, sf):
    s = _dirty(spark, sf).withColumn("r", scan.sanitize_ranges(F.col("ranges")))
    return s.select("seq", checksum(scan.sector_min(F.col("r"), 24)).alias("chk"))


@query("gate_scan", "B5", sql=with_ctes(I.SC) + f"""
SELECT seq, len(ranges[1:60]) AS kept, len(ranges) > 60 AS oversize, len(ranges) > 50 AS usable, {checksum_sql('ranges[1:60]')} AS chk FROM sc""")
def _(spark, sf):
    g = I.scans(spark, sf).withColumn("g", scan.gate_scan(F.col("ranges"), 60, 50))
    return g.select("seq", F.size("g.ranges").cast("long").alias("kept"), "g.oversize", "g.usable", checksum(F.col("g.ranges")).alias("chk"))


@query("nearest_obstacle", "B6", sql=with_ctes(DIRTY) + """
SELECT seq, round(n, 6) AS nearest, coalesce(n < 0.35, false) AS danger
FROM (SELECT seq, list_min(list_filter(ranges, lambda x: isfinite(x) AND x > 0.01)) AS n FROM dirty)""")
def _(spark, sf):
    s = _dirty(spark, sf).withColumn("n", scan.nearest_obstacle(F.col("ranges")))
    return s.select("seq", r6("n").alias("nearest"), scan.danger(F.col("n")).alias("danger"))


@query("planar_accel", "B7", "A4", sql=with_ctes(I.EV) + "SELECT seq, round(sqrt(v_lin * v_lin + v_ang * v_ang), 6) AS accel FROM ev")
def _(spark, sf):
    return I.events(spark, sf).select("seq", r6(geometry.planar_accel(F.col("v_lin"), F.col("v_ang"))).alias("accel"))


@query("yaw_from_quaternion", "B8", "A2", sql=with_ctes(I.EV) + """
SELECT seq, round(atan2(2.0 * (k / 100.0::DOUBLE * v_ang + v_lin * value / 100), 1.0 - 2.0 * (value / 100 * value / 100 + v_ang * v_ang)), 6) AS yaw FROM ev""")
def _(spark, sf):
    yaw = geometry.yaw_from_quat(F.col("v_lin"), F.col("value") / 100, F.col("v_ang"), F.col("k") / 100)
    return I.events(spark, sf).select("seq", r6(yaw).alias("yaw"))


_WRAP = "CASE WHEN a > pi() THEN a - 2 * pi() * ceil((a - pi()) / (2 * pi())) WHEN a < -pi() THEN a + 2 * pi() * ceil((-a - pi()) / (2 * pi())) ELSE a END"


@query("goal_offset", "B9", sql=with_ctes(I.PT) + f"""
SELECT c_custkey, round(sqrt((1.5 - x) * (1.5 - x) + (0.25 - y) * (0.25 - y)), 6) AS dist, round({_WRAP}, 6) AS bearing
FROM (SELECT *, atan2(0.25 - y, 1.5 - x) - (c_custkey % 13 - 6) AS a FROM pt)""")
def _(spark, sf):
    gx, gy = F.lit(1.5), F.lit(0.25)
    x, y, yaw = F.col("x"), F.col("y"), (F.col("c_custkey") % 13 - 6).cast("double")
    return I.points(spark, sf).select(
        "c_custkey", r6(geometry.goal_distance(x, y, gx, gy)).alias("dist"), r6(geometry.goal_bearing(x, y, yaw, gx, gy)).alias("bearing")
    )


@query("sector_clearance", "B10", sql=with_ctes(I.SC) + """
SELECT seq, round(list_min(list_transform(range(-5, 6), lambda k: ranges[(32 + k + 64) % 64 + 1])), 6) AS front,
       round(list_min(list_transform(range(0, 12), lambda k: ranges[(32 + k) % 64 + 1])), 6) AS left_side FROM sc""")
def _(spark, sf):
    inc = F.lit(2 * math.pi / 64)
    a0 = F.lit(-math.pi)
    r = F.col("ranges")
    return I.scans(spark, sf).select(
        "seq", r6(geometry.sector_clearance(r, a0, inc, 30, 30)).alias("front"), r6(geometry.sector_clearance(r, a0, inc, 60, 0)).alias("left_side")
    )


@query("audit_commands", "B11", "D9", sql=with_ctes(I.EV) + """,
obs AS (
  SELECT robot_id, us, seq, least(greatest(v_ang * 1.2, -0.8), 0.8) AS turn, CASE WHEN k > 99 - k THEN 1.0 ELSE -1.0 END AS side,
         (value / 100 - 0.19) / (0.35 - 0.19) AS ratio, abs(v_ang) > radians(25) AS rotate, value / 100 AS front FROM ev WHERE event_type = 'error'),
want AS (
  SELECT robot_id, us, seq,
    CASE WHEN rotate OR front <= 0.19 THEN 0.0 WHEN front < 0.35 THEN ratio * 0.12 ELSE 0.12 END AS v,
    CASE WHEN rotate THEN turn WHEN front <= 0.19 THEN side * 0.8
         WHEN front < 0.35 THEN least(greatest(turn + side * 0.32 * (1 - ratio), -0.8), 0.8) ELSE turn END AS w FROM obs)
SELECT w.robot_id, w.us, round(c.v_lin - w.v, 6) AS v_off, round(c.v_ang - w.w, 6) AS w_off
FROM want w ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type <> 'error') c ON w.robot_id = c.robot_id AND w.us >= c.us""")
def _(spark, sf):
    ev = I.events(spark, sf)
    front = F.col("value") / 100
    obs = ev.where("event_type = 'error'").select(
        "robot_id", F.col("recv_ts").alias("tick_ts"), geometry.expected_command(F.col("v_ang"), front, F.col("k"), 99 - F.col("k")).alias("want")
    )
    out = audit_commands(obs, ev.where("event_type != 'error'"))
    return out.select("robot_id", F.unix_micros("tick_ts").alias("us"), r6("v_off").alias("v_off"), r6("w_off").alias("w_off"))


@query("scale_action", "B12", sql=with_ctes(I.ST) + """
SELECT episode, step, round((least(greatest(a0, -1.0), 1.0) + 1.0) / 2.0 * 0.22, 6) AS lin, round(least(greatest(a1, -1.0), 1.0) * 1.5, 6) AS ang FROM st""")
def _(spark, sf):
    s = I.steps(spark, sf).withColumn("c", geometry.scale_action(F.col("action"), F.lit(0.22), F.lit(1.5)))
    return s.select("episode", "step", r6("c.lin").alias("lin"), r6("c.ang").alias("ang"))


@query("obs_bins", "B13", sql=with_ctes(CLEAN) + f"""
SELECT seq, {checksum_sql(f"list_concat(list_transform({_bins_sql(20, '4')}, lambda q: q / 3.5), [least(seq / 100.0::DOUBLE / 4.0, 1.0), cos(seq::DOUBLE), sin(seq::DOUBLE), (seq % 22) / 100.0::DOUBLE / 0.22, (seq % 3 - 1) / 1.5::DOUBLE])")} AS chk
FROM clean""")
def _(spark, sf):
    q = F.col("seq")
    obs = scan.obs_bins(F.col("ranges"), q / 100, q.cast("double"), (q % 22) / 100, (q % 3 - 1).cast("double"))
    return _dirty(spark, sf).select("seq", checksum(obs).alias("chk"))


@query("obs_frame", "B14", sql=with_ctes(CLEAN) + f"""
SELECT seq, 186::BIGINT AS size, {checksum_sql(f"list_concat(list_transform({_resample_sql(180)}, lambda q: q / 3.5), [least(seq / 100.0::DOUBLE / 4.5, 1.0), cos(seq::DOUBLE), sin(seq::DOUBLE), (seq % 5) / 5.0::DOUBLE, (seq % 3 - 1)::DOUBLE, (seq % 500) / 500.0::DOUBLE])")} AS chk
FROM clean""")
def _(spark, sf):
    q = F.col("seq")
    obs = scan.obs_frame(F.col("ranges"), q / 100, q.cast("double"), (q % 5) / 5, q % 3 - 1, q % 500)
    s = _dirty(spark, sf).select("seq", obs.alias("o"))
    return s.select("seq", F.size("o").cast("long").alias("size"), checksum(F.col("o")).alias("chk"))


# Squeezed scans: some frames nearly constant, some mostly at the maximum.
_SHAPED = I.RS + """,
shaped AS (
  SELECT robot_id, seq, us, CASE WHEN seq % 18 < 6 THEN list_transform(ranges, lambda x: 1.0 + x / 1000)
         WHEN seq % 18 < 9 THEN list_transform(ranges, lambda x: 3.4 + x / 20) ELSE ranges END AS ranges FROM rs),
judged AS (
  SELECT *, sqrt(greatest(0, list_avg(list_transform(ranges, lambda x: x * x)) - list_avg(ranges) * list_avg(ranges))) < 0.01 AS low_std,
         len(list_filter(ranges, lambda x: x > 3.15)) / len(ranges)::DOUBLE > 0.95 AS mostly_max FROM shaped)"""


def shaped(spark, sf):
    block = F.col("seq") % 18
    return I.repeated_scans(spark, sf).withColumn(
        "ranges",
        F.when(block < 6, F.transform("ranges", lambda x: 1.0 + x / 1000))
        .when(block < 9, F.transform("ranges", lambda x: 3.4 + x / 20))
        .otherwise(F.col("ranges")),
    )


@query("scan_quality", "B15", sql=with_ctes(_SHAPED) + """
SELECT seq, CASE WHEN low_std THEN 'low_std' WHEN ranges = lag(ranges) OVER (PARTITION BY robot_id ORDER BY seq) THEN 'frame_repeat'
       WHEN mostly_max THEN 'mostly_max' END AS problem FROM judged""")
def _(spark, sf):
    from ..plans.timeline import Timeline

    s = shaped(spark, sf)
    prev = Timeline.of(s, "robot_id", ("recv_ts", "seq")).previous(s, {"prev": "ranges"})
    return prev.select("seq", scan.scan_quality(F.col("ranges"), F.col("prev")).alias("problem"))


_PRINTABLE = r"""regexp_replace(left(h, 40), '[\p{C}\p{Zl}\p{Zp}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', '', 'g')"""


@query("parse_goto", "B16", "B17", sql=f"""
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unnamed' ELSE coalesce(nullif({_PRINTABLE}, ''), 'unnamed') END AS name,
       round(px, 6) AS x, round(py, 6) AS y, CASE WHEN px IS NULL OR py IS NULL THEN 'format' END AS error,
       coalesce(px BETWEEN -2.5 AND 2.5 AND py BETWEEN -2.5 AND 2.5, false) AS inside
FROM (SELECT page_id, html AS h, CASE WHEN page_id % 7 = 0 THEN NULL ELSE (page_id % 31) / 5.0::DOUBLE - 3 END AS px,
             (page_id % 17) / 3.0::DOUBLE - 2.5 AS py FROM pages)""")
def _(spark, sf):
    p = I.table(spark, sf, "pages")
    x = F.when(F.col("page_id") % 7 == 0, F.lit("here")).otherwise(((F.col("page_id") % 31) / 5 - 3).cast("string"))
    payload = F.to_json(
        F.struct(
            F.when(F.col("page_id") % 5 != 0, F.col("html")).alias("name"), x.alias("x"), ((F.col("page_id") % 17) / 3 - 2.5).alias("y")
        )
    )
    g = p.select("page_id", text.parse_goto(payload).alias("g"))
    inside = F.coalesce(geometry.in_bounds(F.col("g.x"), F.col("g.y")), F.lit(False))
    return g.select("page_id", "g.name", r6("g.x").alias("x"), r6("g.y").alias("y"), "g.error", inside.alias("inside"))


@query("short_name", "B18", sql="SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages")
def _(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", text.short_name(F.col("url")).alias("name"))


@query("alert_text", "B19", sql="""
SELECT p_partkey, '[node alert] unknown node joined' || chr(10) || '> node: ' || p_name || chr(10) || '> live nodes: ' || p_size AS joined,
       '[node offline] node left the graph' || chr(10) || '> node: ' || p_brand AS gone,
       CASE WHEN p_size < 10 THEN 'DANGER' ELSE 'CLEAR' END || ' | nearest ' || printf('%.2f', p_size / 4.0::DOUBLE) || ' m | accel ' || printf('%.2f', p_size / 8.0::DOUBLE) AS sensor,
       '[behaviour alert] (vote=2/6 >= 2):' || chr(10) || '  - ' || p_name || chr(10) || '  - ' || p_type AS detectors
FROM part""")
def _(spark, sf):
    p = I.table(spark, sf, "part")
    size = F.col("p_size")
    return p.select(
        "p_partkey",
        text.join_text(F.col("p_name"), size).alias("joined"),
        text.exit_text(F.col("p_brand")).alias("gone"),
        text.sensor_text(size / 4, size / 8, size < 10).alias("sensor"),
        text.detector_text(F.array(F.lit("D1"), F.lit("D2")), F.array("p_name", "p_type"), F.lit("vote")).alias("detectors"),
    )


@query("alert_preview", "B19", sql="""
SELECT doc_id, 'ALERT: ' || left(replace(replace(text, chr(10), ' '), chr(13), ''), 100) AS status,
       left(replace(replace(text, chr(10), ' '), chr(13), ''), 60) AS shown FROM documents""")
def _(spark, sf):
    return I.text_table(spark, sf).select("doc_id", text.security_text(F.col("text")).alias("status"), text.preview(F.col("text"), 60).alias("shown"))


@query("reward_shaped", "B20", sql=with_ctes(I.ST) + """
SELECT episode, step, round(CASE WHEN event = 'collision' THEN -100 WHEN event = 'all_done' THEN 100
       ELSE 0.99 * (-nearest) + abs(x) - 0.05 * (a0 * a0 + a1 * a1) - 0.005 END, 6) AS reward FROM st""")
def _(spark, sf):
    a2 = F.col("action")[0] * F.col("action")[0] + F.col("action")[1] * F.col("action")[1]
    r = scoring.reward_shaped(F.col("event"), F.abs("x"), F.col("nearest"), a2)
    return I.steps(spark, sf).select("episode", "step", r6(r).alias("reward"))


@query("reward_progress", "B21", sql=with_ctes(I.ST) + """
SELECT episode, step, round(CASE WHEN event = 'collision' THEN -100 WHEN event = 'all_done' THEN 100
       ELSE a0 - abs(a1) / 2 - greatest(0, 1.35 - nearest) / 2 + 10 * (abs(x) - abs(y)) END, 6) AS reward FROM st""")
def _(spark, sf):
    r = scoring.reward_progress(F.col("event"), F.col("action")[0], F.col("action")[1], F.col("nearest"), F.abs("x"), F.abs("y"))
    return I.steps(spark, sf).select("episode", "step", r6(r).alias("reward"))


@query("reward_explore", "B22", "E14", "B25", sql=with_ctes(I.ST) + """,
cells AS (SELECT *, least(greatest(trunc((x + 2.5) / 5.0 * 12)::INT, 0), 11) AS gx12, least(greatest(trunc((y + 2.5) / 5.0 * 12)::INT, 0), 11) AS gy12 FROM st),
seen AS (SELECT *, row_number() OVER (PARTITION BY run_id, gx12, gy12 ORDER BY episode, step) - 1 AS n FROM cells)
SELECT episode, step, gx12 AS gx, gy12 AS gy, n AS prior_visits, round(CASE WHEN nearest <= 0.18 THEN -50 ELSE 1 - 0.5 * abs(a1) / 1.5
  + CASE WHEN nearest < 0.30 THEN -3.0 * (1 - (nearest - 0.18) / 0.12)
         WHEN nearest < 0.80 THEN 2.0 * greatest(0, 1 - (((nearest - 0.30) / 0.50 - 0.4) / 0.6) * (((nearest - 0.30) / 0.50 - 0.4) / 0.6)) ELSE 0 END
  + 2.0 / (1 + 0.3 * n) END, 6) AS reward FROM seen""")
def _(spark, sf):
    from ..operators.episodes import visit_bonus_input

    s = visit_bonus_input(I.steps(spark, sf).drop("gx", "gy"))
    r = scoring.reward_explore(F.col("nearest"), F.col("action")[1], F.col("prior_visits"))
    return s.select("episode", "step", "gx", "gy", "prior_visits", r6(r).alias("reward"))


@query("spl_and_flags", "B23", "B24", sql=with_ctes(I.ST) + """,
e AS (SELECT episode, step, CASE WHEN event = 'running' AND step >= 5 THEN 'timeout' ELSE event END AS event, abs(x) AS o, abs(y) AS p FROM st)
SELECT episode, step, event, round(CASE WHEN event = 'all_done' THEN o / greatest(o, p, 1e-6) ELSE 0 END, 6) AS spl,
       event = 'collision' AS collision, event = 'all_done' AS success, event = 'timeout' AS timeout FROM e""")
def _(spark, sf):
    s = I.steps(spark, sf).withColumn("event", scoring.final_event(F.col("event"), F.col("step"), 5)).withColumn("f", scoring.episode_flags(F.col("event")))
    return s.select("episode", "step", "event", r6(scoring.spl(F.col("event"), F.abs("x"), F.abs("y"))).alias("spl"), "f.collision", "f.success", "f.timeout")


@query("progress_columns", "B26", sql="""
SELECT o_orderkey, round(r, 6) AS rate, round(steps / 500.0::DOUBLE, 6) AS share,
       CASE WHEN r > 0 THEN printf('%d:%02d:%02d', floor(e / 3600)::BIGINT, floor(e % 3600 / 60)::BIGINT, floor(e)::BIGINT % 60) ELSE '0:00:00' END AS eta
FROM (SELECT *, CASE WHEN r > 0 THEN (500 - steps) / r ELSE 0 END AS e
      FROM (SELECT o_orderkey, o_custkey % 500 AS steps, CASE WHEN o_totalprice > 0 THEN (o_custkey % 500) / o_totalprice ELSE 0 END AS r FROM orders))""")
def _(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", text.progress(F.col("o_custkey") % 500, F.col("o_totalprice"), F.lit(500)).alias("p"))
    return o.select("o_orderkey", r6("p.rate").alias("rate"), r6("p.share").alias("share"), "p.eta")


@query("trend_arrow", "B27", sql="""
SELECT seq, CASE WHEN d > 1e-6 THEN 'up' WHEN d < -1e-6 THEN 'down' ELSE 'flat' END AS arrow
FROM (SELECT event_id AS seq, value - lag(value, 1, value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)""")
def _(spark, sf):
    from ..plans.timeline import Timeline

    ev = I.events(spark, sf)
    prev = Timeline.of(ev, "robot_id", ("recv_ts", "seq")).previous(ev, {"before": "value"})
    return prev.select("seq", text.trend(F.col("value"), F.coalesce("before", "value")).arrow.alias("arrow"))


def hmac_sql(text_expr: str, key: bytes) -> str:
    from ..functions.crypto import pads

    i, o = (p.hex() for p in pads(key))
    return f"sha256(unhex('{o}') || unhex(sha256(unhex('{i}') || encode({text_expr}))))"


@query("hmac_sha256", "C1", sql=f"SELECT doc_id, {hmac_sql('text', I.KEY)} AS sig FROM documents")
def _(spark, sf):
    return I.text_table(spark, sf).select("doc_id", hmac_sha256(F.col("text"), I.KEY).alias("sig"))
