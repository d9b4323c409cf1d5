"""Episode scores, step windows, curricula, intervals and sampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import episodes as E, sampling as H
from . import inputs as I
from .registry import checksum, checksum_sql, off_tie, off_tie_sql, query, r6, with_ctes

ORDER = ("day", "episode")
W100 = "(PARTITION BY run_id ORDER BY day, episode ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"


def u_sql(*parts: str) -> str:
    """SQL twin of ``unit_hash``."""
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(sha256({text}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def draw_sql(*parts: str) -> str:
    """SQL twin of ``hashed_draws``: draw b is the b % 5-th piece of hash b // 5."""
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in (*parts, "b // 5"))
    return f"(('0x' || substr(sha256({text}), 1 + 12 * (b % 5), 12))::BIGINT / 281474976710656.0::DOUBLE)"


# -- steps -------------------------------------------------------------------------


@query("frame_stack", "E7", sql=with_ctes(I.ST) + f"""
SELECT episode, step, {checksum_sql("list_concat(list_concat(f3, f2), list_concat(f1, f0))")} AS chk FROM (
  SELECT episode, step, [a0, a1] AS f0, coalesce(lag([a0, a1], 1) OVER w, first([a0, a1]) OVER w) AS f1,
         coalesce(lag([a0, a1], 2) OVER w, first([a0, a1]) OVER w) AS f2, coalesce(lag([a0, a1], 3) OVER w, first([a0, a1]) OVER w) AS f3
  FROM st WINDOW w AS (PARTITION BY episode ORDER BY step))""")
def _(spark, sf):
    s = I.steps(spark, sf).select("run_id", "episode", "step", F.col("action").alias("frame"))
    return E.frame_stack(s).select("episode", "step", checksum(F.col("stacked")).alias("chk"))


@query("path_length", "E8", sql=with_ctes(I.ST) + """
SELECT episode, step, round(sum(h) OVER (PARTITION BY episode ORDER BY step), 8) AS path_length FROM (
  SELECT episode, step, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS h FROM st WINDOW w AS (PARTITION BY episode ORDER BY step))""")
def _(spark, sf):
    return E.path_length(I.steps(spark, sf)).select("episode", "step", r6("path_length", 8).alias("path_length"))


@query("optimal_length", "E9", sql=with_ctes(I.PT, I.WP) + """,
line AS (SELECT c_custkey AS id, -1 AS seq, x, y FROM pt UNION ALL SELECT c_custkey, seq, wp.x, wp.y FROM pt JOIN wp ON wp.route_id = (c_custkey % 5)::VARCHAR)
SELECT id, round(sum(sqrt((x - px) ** 2 + (y - py) ** 2)), 6) AS optimal FROM (
  SELECT id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM line WINDOW w AS (PARTITION BY id ORDER BY seq)) GROUP BY id""")
def _(spark, sf):
    p = I.points(spark, sf)
    starts = p.select(F.col("c_custkey").alias("route_id"), "x", "y")
    wp = I.waypoints(spark, sf).select(F.col("route_id").alias("_r"), (F.col("seq") + 1).alias("seq"), "x", "y")
    routes = p.select(F.col("c_custkey").alias("route_id"), (F.col("c_custkey") % 5).cast("string").alias("_r")).join(wp, "_r")
    return E.optimal_length(starts, routes).select(F.col("route_id").alias("id"), r6("optimal").alias("optimal"))


@query("running_min_clearance", "E10", sql=with_ctes(I.ST) + "SELECT episode, step, round(min(nearest) OVER (PARTITION BY episode ORDER BY step), 6) AS min_clearance FROM st")
def _(spark, sf):
    return E.running_min_clearance(I.steps(spark, sf)).select("episode", "step", r6("min_clearance").alias("min_clearance"))


_SMOOTH = "(PARTITION BY episode ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query("smooth_actions", "E16", sql=with_ctes(I.ST) + f"""
SELECT episode, step, CASE WHEN count(*) OVER {_SMOOTH} = 3 AND min(raw_action) OVER {_SMOOTH} > 0 AND min(raw_action) OVER {_SMOOTH} <> max(raw_action) OVER {_SMOOTH}
       THEN 0 ELSE raw_action END AS action FROM st""")
def _(spark, sf):
    return E.smooth_actions(I.steps(spark, sf)).select("episode", "step", "action")


@query("turning_stuck", "G11", sql="WITH RECURSIVE " + I.ST + """,
m AS (
  SELECT episode, 0 AS step, 0 AS n, 0 AS back, []::INT[] AS recent, 0 AS action, false AS reversed FROM st WHERE step = 1
  UNION ALL
  SELECT episode, step, CASE WHEN rev THEN n WHEN nn >= 3 THEN 0 ELSE nn END, CASE WHEN rev THEN back - 1 WHEN nn >= 3 THEN 2 ELSE 0 END,
         CASE WHEN rev THEN recent WHEN nn >= 3 THEN [] ELSE nr END, CASE WHEN rev THEN 0 ELSE act END, rev
  FROM (SELECT *, CASE WHEN act = 0 THEN 0 ELSE n + 1 END AS nn FROM (
    SELECT *, CASE WHEN len(nr) = 3 AND list_min(nr) > 0 AND list_min(nr) <> list_max(nr) THEN 0 ELSE raw_action END AS act FROM (
      SELECT s.episode, s.step, s.raw_action, m.n, m.back, m.recent, m.back > 0 AS rev, list_append(m.recent, s.raw_action)[-3:] AS nr
      FROM m JOIN st s ON s.episode = m.episode AND s.step = m.step + 1))))
SELECT episode, step, action, reversed FROM m WHERE step > 0""")
def _(spark, sf):
    t = E.turning_stuck(I.steps(spark, sf), limit=3, back=2)
    return t.select("episode", F.col("t").cast("int").alias("step"), "action", "reversed")


@query("visit_progress", "E19", sql="WITH RECURSIVE " + I.ST + ",\n" + I.WP + """,
rt AS (SELECT route_id, list({'x': x, 'y': y} ORDER BY seq) AS r FROM wp GROUP BY route_id),
src AS (SELECT st.*, rt.r, CASE WHEN reward > 0.095 THEN {'x': gx, 'y': gy} END AS g FROM st JOIN rt ON rt.route_id = (episode % 5)::VARCHAR),
m AS (
  SELECT episode, 0 AS step, 0 AS i, NULL::STRUCT(x DOUBLE, y DOUBLE) AS goto_, 0 AS target, 0.0::DOUBLE AS dist, false AS reached FROM src WHERE step = 1
  UNION ALL
  SELECT episode, step, CASE WHEN d < 1.0 THEN CASE WHEN g2 IS NOT NULL OR i + 1 >= len(r) THEN 0 ELSE i + 1 END ELSE i END,
         CASE WHEN d >= 1.0 THEN g2 END, CASE WHEN g2 IS NOT NULL THEN -1 ELSE i END, d, d < 1.0
  FROM (SELECT *, sqrt((tgt.x - x) * (tgt.x - x) + (tgt.y - y) * (tgt.y - y)) AS d FROM (
    SELECT *, coalesce(g2, r[i + 1]) AS tgt FROM (
      SELECT s.episode, s.step, s.x, s.y, s.r, m.i, coalesce(s.g, m.goto_) AS g2 FROM m JOIN src s ON s.episode = m.episode AND s.step = m.step + 1))))
SELECT episode, step, target, round(dist, 8) AS dist, reached FROM m WHERE step > 0""")
def _(spark, sf):
    s = I.steps(spark, sf).withColumn("route_id", (F.col("episode") % 5).cast("string"))
    pts = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    routes = I.waypoints(spark, sf).groupBy("route_id").agg(
        F.transform(pts, lambda w: w["x"]).alias("route_x"), F.transform(pts, lambda w: w["y"]).alias("route_y")
    )
    go = F.col("reward") > 0.095
    rows = s.join(routes, "route_id").withColumn("goto_x", F.when(go, F.col("gx"))).withColumn("goto_y", F.when(go, F.col("gy")))
    v = E.visit_progress(rows, reach=1.0)
    return v.select("episode", F.col("t").cast("int").alias("step"), "target", r6("dist", 8).alias("dist"), "reached")


@query("delta_prev", "E17", sql=with_ctes(I.ST) + """
SELECT episode, step, round((a0 - pa0) ** 2 + (a1 - pa1) ** 2, 6) AS action_change2, round(sqrt((gx - px) ** 2 + (gy - py) ** 2) - sqrt((gx - x) ** 2 + (gy - y) ** 2), 8) AS progress
FROM (SELECT *, coalesce(lag(a0) OVER w, 0) AS pa0, coalesce(lag(a1) OVER w, 0) AS pa1, coalesce(lag(x) OVER w, x) AS px, coalesce(lag(y) OVER w, y) AS py
      FROM st WINDOW w AS (PARTITION BY episode ORDER BY step))""")
def _(spark, sf):
    return E.delta_prev(I.steps(spark, sf)).select("episode", "step", r6("action_change2").alias("action_change2"), r6("progress", 8).alias("progress"))


@query("transitions", "E18", sql=with_ctes(I.ST) + """
SELECT episode, step, round(reward, 6) AS reward, round(coalesce(lead(x) OVER w, y), 8) AS next_x, event = 'collision' AS done
FROM st WINDOW w AS (PARTITION BY episode ORDER BY step)""")
def _(spark, sf):
    s = I.steps(spark, sf).withColumn("obs", F.array("x")).withColumn("next_obs", F.array("y")).withColumn("terminated", F.col("event") == "collision")
    return E.transitions(s).select("episode", "step", r6("reward").alias("reward"), r6(F.col("next_obs")[0], 8).alias("next_x"), "done")


@query("episode_rollup", "F5", sql=with_ctes(I.ST) + """
SELECT episode, round(sum(reward), 6) AS reward, count(*) AS steps, arg_max(event, step) AS event, round(arg_max(x, step), 6) AS x FROM st GROUP BY episode""")
def _(spark, sf):
    r = E.episode_rollup(I.steps(spark, sf), ("event", "x"))
    return r.select("episode", r6("reward").alias("reward"), "steps", "event", r6("x").alias("x"))


# -- episodes ------------------------------------------------------------------------

_CLEAR = """fin AS (
  SELECT run_id, day, episode, avg(clearance) OVER (PARTITION BY run_id ORDER BY day, episode ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS c FROM ep WHERE isfinite(clearance))"""


@query("rolling_scores", "E11", "A9", sql=with_ctes(I.EP, _CLEAR) + f"""
SELECT ep.episode, {off_tie_sql(f"avg(reward) OVER {W100}", 2)} AS mean_reward, round(stddev_pop(reward) OVER {W100}, 3) AS std_reward,
       round(avg(steps) OVER {W100}, 6) AS mean_steps, {off_tie_sql(f"avg(spl) OVER {W100}", 6)} AS mean_spl, round(avg(success) OVER {W100}, 6) AS mean_success,
       round(avg(wp_done) OVER {W100}, 6) AS mean_wp_done, round(avg((wp_done >= 1)::INT) OVER {W100}, 6) AS partial_rate,
       {off_tie_sql("last_value(c IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ep.day, ep.episode ROWS UNBOUNDED PRECEDING)", 6)} AS mean_clearance
FROM (SELECT ep.*, fin.c FROM ep LEFT JOIN fin USING (run_id, day, episode)) ep""")
def _(spark, sf):
    s = E.rolling_scores(I.episodes(spark, sf), order=ORDER)
    return s.select(
        "episode", off_tie("mean_reward", 2).alias("mean_reward"), r6("std_reward", 3).alias("std_reward"),
        *[r6(c).alias(c) for c in ("mean_steps", "mean_success", "mean_wp_done", "partial_rate")],
        *[off_tie(c, 6).alias(c) for c in ("mean_spl", "mean_clearance")],
    )


@query("best_so_far", "E12", sql=with_ctes(I.EP) + """,
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY day, episode) AS rn FROM ep),
b AS (SELECT *, CASE WHEN rn > 50 THEN reward END AS v FROM n)
SELECT episode, round(max(v) OVER w, 6) AS best_before, coalesce(v > coalesce(max(v) OVER w, -1e300), false) AS is_new_best
FROM b WINDOW w AS (PARTITION BY run_id ORDER BY day, episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    n = E.numbered(I.episodes(spark, sf), "run_id", ORDER)
    return E.best_so_far(n, "reward", F.col("_i") >= 50, ORDER).select("episode", r6("best_before").alias("best_before"), "is_new_best")


@query("half_trend", "E13", sql=with_ctes(I.EP) + f"""
SELECT episode, CASE WHEN len(v) >= 20 THEN {off_tie_sql("list_avg(v[-(len(v) // 2):])", 2)} END AS recent, CASE WHEN len(v) >= 20 THEN {off_tie_sql("list_avg(v[1:len(v) // 2])", 2)} END AS before
FROM (SELECT episode, list(reward) OVER {W100} AS v FROM ep)""")
def _(spark, sf):
    return E.half_trend(I.episodes(spark, sf), order=ORDER).select("episode", off_tie("recent", 2).alias("recent"), off_tie("before", 2).alias("before"))


@query("moving_average", "E15", sql=with_ctes(I.EP) + """
SELECT run_id, episode, round(ma + 0.0012371513::DOUBLE, 2) AS ma_50, tail <= 200 AS in_tail FROM (
  SELECT *, avg(reward) OVER (PARTITION BY run_id ORDER BY day, episode ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS ma,
         row_number() OVER (PARTITION BY run_id ORDER BY day, episode) AS rn, row_number() OVER (PARTITION BY run_id ORDER BY day DESC, episode DESC) AS tail FROM ep)
WHERE rn >= 50""")
def _(spark, sf):
    e = I.episodes(spark, sf).select("run_id", "day", "episode", "reward")
    ma = E.moving_average(e, "reward", 50, order=ORDER)
    tail = E.newest(e, 200, order=ORDER).select("episode", F.lit(True).alias("in_tail"))
    return ma.join(tail, "episode", "left").select("run_id", "episode", off_tie("ma_50", 2).alias("ma_50"), F.coalesce("in_tail", F.lit(False)).alias("in_tail"))


@query("eval_report", "F3", sql=with_ctes(I.EP) + """
SELECT run_id, count(*) AS episodes, round(avg(spl), 6) AS mean_spl, round(avg(success), 6) AS success_rate, round(avg(collision), 6) AS collision_rate,
       round(avg(timeout), 6) AS timeout_rate, round(avg(steps), 6) AS mean_steps, round(avg(wp_done), 6) AS mean_waypoints,
       round(avg(clearance) FILTER (isfinite(clearance)), 6) AS mean_clearance, round(avg(reward) + 0.0012371513::DOUBLE, 2) AS mean_reward, round(stddev_pop(reward), 3) AS std_reward FROM ep GROUP BY run_id""")
def _(spark, sf):
    r = E.eval_report(I.episodes(spark, sf))
    names = ("mean_spl", "success_rate", "collision_rate", "timeout_rate", "mean_steps", "mean_waypoints", "mean_clearance")
    return r.select("run_id", "episodes", *[r6(c).alias(c) for c in names], off_tie("mean_reward", 2).alias("mean_reward"), r6("std_reward", 3).alias("std_reward"))


DRAWS = 100


@query("bootstrap_interval", "F4", sql=with_ctes(I.EP) + f""",
base AS (SELECT run_id, spl AS v, row_number() OVER (PARTITION BY run_id ORDER BY day, episode) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM ep),
picks AS (SELECT run_id, b, least(floor({draw_sql('7', 'run_id', 'i')} * n), n - 1)::BIGINT AS i FROM base, range({DRAWS}) r(b)),
means AS (SELECT p.run_id, b, avg(v) AS m FROM picks p JOIN base USING (run_id, i) GROUP BY ALL)
SELECT run_id, n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi
FROM (SELECT run_id, count(*) AS n, avg(v) AS mean FROM base GROUP BY ALL) JOIN (SELECT run_id, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY ALL) USING (run_id)""")
def _(spark, sf):
    b = E.bootstrap_ci(I.episodes(spark, sf), "spl", DRAWS, seed=7, order=ORDER)
    return b.select("run_id", "n", *[r6(c).alias(c) for c in ("mean", "lo", "hi")])


def _poisson_sql() -> str:
    total, p, out = 0.0, 0.36787944117144233, []
    for k in range(1, 13):
        total += p
        out.append((total, k))
        p /= k
    cases = " ".join(f"WHEN u >= {t!r}::DOUBLE THEN {k}" for t, k in reversed(out))
    return f"CASE {cases} ELSE 0 END"


@query("bootstrap_interval_poisson", "F4", sql=with_ctes(I.EP) + f""",
w AS (SELECT run_id, b, v, {_poisson_sql()} AS w FROM (SELECT run_id, b, spl AS v, {draw_sql('7', 'run_id', 'day', 'episode')} AS u FROM ep, range({DRAWS}) r(b))),
means AS (SELECT run_id, b, sum(w * v) / sum(w) AS m FROM w GROUP BY ALL HAVING sum(w) > 0)
SELECT run_id, n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi
FROM (SELECT run_id, count(*) AS n, avg(spl) AS mean FROM ep GROUP BY ALL) JOIN (SELECT run_id, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY ALL) USING (run_id)""")
def _(spark, sf):
    b = E.bootstrap_ci_poisson(I.episodes(spark, sf), "spl", DRAWS, seed=7, order=ORDER)
    return b.select("run_id", "n", *[r6(c).alias(c) for c in ("mean", "lo", "hi")])


@query("bootstrap_interval_split", "F4")
def _(spark, sf):
    b = E.bootstrap_ci_split(I.episodes(spark, sf), "spl", 1000, seed=7, order=ORDER)
    return b.select("run_id", "n", *[r6(c).alias(c) for c in ("mean", "lo", "hi")])


@query("outcomes", "F10", sql=with_ctes(I.EP) + "SELECT run_id, event, count(*) AS episodes FROM ep GROUP BY ALL")
def _(spark, sf):
    return E.outcomes(I.episodes(spark, sf))


@query("curriculum", "G12", sql="WITH RECURSIVE " + I.EP + """,
n AS (SELECT run_id, episode, success, row_number() OVER (PARTITION BY run_id ORDER BY day, episode) AS rn FROM ep),
m AS (
  SELECT run_id, -1::BIGINT AS episode, 0::BIGINT AS rn, 1 AS stage, []::INT[] AS win, 1 AS now, false AS promoted FROM n WHERE rn = 1
  UNION ALL
  SELECT run_id, episode, rn, stage + up::INT, CASE WHEN up THEN [] ELSE w END, stage, up FROM (
    SELECT *, len(w) >= 30 AND list_avg(w) >= 0.4 AND stage < 5 AS up FROM (
      SELECT n.run_id, n.episode, n.rn, m.stage, list_append(m.win, n.success)[-50:] AS w FROM m JOIN n ON n.run_id = m.run_id AND n.rn = m.rn + 1)))
SELECT run_id, episode, now AS stage, promoted FROM m WHERE rn > 0""")
def _(spark, sf):
    return E.curriculum(I.episodes(spark, sf), promote=0.4, order=ORDER).select("run_id", "episode", "stage", "promoted")


@query("metrics_table", "A13", sql=with_ctes(I.EP) + """
SELECT run_id, episode, 'reward' AS metric, reward AS value FROM ep UNION ALL SELECT run_id, episode, 'steps', steps FROM ep UNION ALL SELECT run_id, episode, 'spl', spl FROM ep""")
def _(spark, sf):
    return E.metrics_table(I.episodes(spark, sf), ["run_id", "episode"], ["reward", "steps", "spl"])


@query("route_legs", "D13", sql=with_ctes(I.WP) + """,
v AS (SELECT (o_custkey % 5)::VARCHAR AS route_id, o_orderkey AS visit FROM orders), c AS (SELECT route_id, count(*) AS n FROM wp GROUP BY ALL)
SELECT v.route_id, visit, a.name, b.name AS next_name, a.x, b.y AS next_y FROM v JOIN c USING (route_id)
JOIN wp a ON a.route_id = v.route_id AND a.seq = visit % n JOIN wp b ON b.route_id = v.route_id AND b.seq = (visit + 1) % n""")
def _(spark, sf):
    v = I.table(spark, sf, "orders").select((F.col("o_custkey") % 5).cast("string").alias("route_id"), F.col("o_orderkey").alias("visit"))
    return E.route_legs(v, I.waypoints(spark, sf)).select("route_id", "visit", "name", "next_name", "x", "next_y")


# -- sampling --------------------------------------------------------------------------

_OB = "ob AS (SELECT (n_nationkey % 5 - 2) * 0.9::DOUBLE AS ox, (n_nationkey // 5 - 2) * 0.9::DOUBLE AS oy FROM nation)"


def obstacles(spark, sf):
    n = I.table(spark, sf, "nation")
    return n.select(((F.col("n_nationkey") % 5 - 2) * 0.9).alias("ox"), ((F.floor(F.col("n_nationkey") / 5) - 2) * 0.9).alias("oy"))


@query("safe_positions", "D7", sql=with_ctes(I.PT, _OB) + """
SELECT c_custkey FROM pt WHERE abs(x) <= 1.8 AND abs(y) <= 1.8 AND NOT EXISTS (SELECT 1 FROM ob WHERE sqrt((x - ox) ** 2 + (y - oy) ** 2) < 0.5)""")
def _(spark, sf):
    return H.safe_positions(I.points(spark, sf), obstacles(spark, sf)).select("c_custkey")


def seeds(spark, sf):
    return I.table(spark, sf, "customer").select(F.col("c_custkey").alias("seed"))


def _b(u: str, lo: float, hi: float) -> str:
    return f"{lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * {u}"


@query("episode_params", "H2", sql=f"""
SELECT c_custkey AS seed, round({_b(u_sql('c_custkey', "'noise'"), 0, 0.02)}, 6) AS noise, round({_b(u_sql('c_custkey', "'dropout'"), 0, 0.05)}, 6) AS dropout,
       round({_b(u_sql('c_custkey', "'max_lin'"), 0.18, 0.22)}, 6) AS max_lin, round({_b(u_sql('c_custkey', "'max_ang'"), 1.2, 1.8)}, 6) AS max_ang,
       round(CASE WHEN {u_sql('c_custkey', "'bias?'")} < 0.05 THEN {_b(u_sql('c_custkey', "'bias'"), 0.03, 0.08)} ELSE 0 END, 6) AS bias,
       {u_sql('c_custkey', "'burst?'")} < 0.05 AS burst, {u_sql('c_custkey', "'jam?'")} < 0.05 AS jam FROM customer""")
def _(spark, sf):
    p = H.episode_params(seeds(spark, sf))
    return p.select("seed", *[r6(c).alias(c) for c in ("noise", "dropout", "max_lin", "max_ang", "bias")], "burst", "jam")


def _beam_sql() -> str:
    def u(name: str) -> str:
        return u_sql("seed", "step", f"'{name}'", "i - 1")

    normal = f"sqrt(-2.0 * ln(1.0 - {u('n1')})) * cos(2 * pi() * {u('n2')})"
    y = f"CASE WHEN {u('drop')} < 0.05 THEN 1.0 ELSE x + 0.02 * {normal} END + 0.03"
    burst = f"CASE WHEN step % 10 = 0 THEN {_b(u('burst'), -0.1, 0.1)} ELSE 0 END"
    return f"least(greatest({y} + {burst}, 0.0), 1.0)"


@query("perturb_scans", "H1", sql=with_ctes(I.SC) + f"""
SELECT step, {checksum_sql(f"list_transform(f, lambda x, i: {_beam_sql()})")} AS chk FROM (SELECT 9 AS seed, seq AS step, list_transform(ranges, lambda r: r / 3.5) AS f FROM sc)""")
def _(spark, sf):
    s = I.scans(spark, sf).select(F.col("seq").alias("step"), F.transform("ranges", lambda r: r / 3.5).alias("frame"), F.lit(9).alias("seed"))
    params = {"noise": F.lit(0.02), "dropout": F.lit(0.05), "bias": F.lit(0.03), "burst": F.lit(True)}
    return H.perturb_scans(s.withColumns(params)).select("step", checksum(F.col("frame")).alias("chk"))


@query("sample_starts", "H3", sql=with_ctes(_OB) + f""",
cand AS (SELECT c_custkey AS seed, n, {_b(u_sql('c_custkey', "'x'", 'n'), -1.8, 1.8)} AS x, {_b(u_sql('c_custkey', "'y'", 'n'), -1.8, 1.8)} AS y FROM customer, range(60) t(n)),
ok AS (SELECT seed, n, x, y FROM cand WHERE NOT EXISTS (SELECT 1 FROM ob WHERE sqrt((x - ox) ** 2 + (y - oy) ** 2) < 0.5))
SELECT c.c_custkey AS seed, round(coalesce(f.x, 0.5), 6) AS x, round(coalesce(f.y, 0.5), 6) AS y, round({_b(u_sql('c.c_custkey', "'yaw'"), -math.pi, math.pi)}, 6) AS yaw
FROM customer c LEFT JOIN (SELECT seed, arg_min(x, n) AS x, arg_min(y, n) AS y FROM ok GROUP BY seed) f ON f.seed = c.c_custkey""")
def _(spark, sf):
    s = H.sample_starts(seeds(spark, sf), obstacles(spark, sf), tries=60)
    return s.select("seed", *[r6(c).alias(c) for c in ("x", "y", "yaw")])


@query("sample_routes", "H4", sql=with_ctes(I.WP) + f"""
SELECT seed, seq::INT AS seq, name, x, y FROM (
  SELECT c_custkey AS seed, wp.name, wp.x, wp.y, row_number() OVER (PARTITION BY c_custkey ORDER BY {u_sql('c_custkey', "'wp'", 'wp.seq')}) AS seq,
         floor({u_sql('c_custkey', "'count'")} * 5) + 1 AS n
  FROM customer JOIN wp ON wp.route_id = (c_custkey % 5)::VARCHAR) WHERE seq <= n""")
def _(spark, sf):
    s = seeds(spark, sf).withColumn("route_id", (F.col("seed") % 5).cast("string")).withColumn("max_wp", F.lit(5))
    return H.sample_routes(s, I.waypoints(spark, sf))


@query("minibatch", "H5", sql=with_ctes(I.ST) + f"SELECT episode, step FROM st ORDER BY {u_sql('3', 'episode', 'step')}, episode, step LIMIT 256")
def _(spark, sf):
    return H.minibatch(I.steps(spark, sf), 256, 3, ["episode", "step"]).select("episode", "step")


@query("keep_latest", "H6", sql=with_ctes(I.EV) + """
SELECT robot_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY us DESC, seq DESC) AS r FROM ev) WHERE r <= 20""")
def _(spark, sf):
    return H.keep_latest(I.events(spark, sf), 20, "robot_id", ("recv_ts", "seq")).select("robot_id", "seq")


@query("keep_latest_overall", "H6", sql="SELECT event_id AS seq FROM events ORDER BY ts DESC, event_id DESC LIMIT 3000")
def _(spark, sf):
    return H.keep_latest(I.events(spark, sf), 3000, None, ("recv_ts", "seq")).select("seq")
