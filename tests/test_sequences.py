"""Sequence rules: detectors, votes, machines, episodes."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetwatch.operators import alerts as A, detectors as D, episodes as E
from fleetwatch.operators.machines import SEC, MissionMode, PatrolPause, TrainingGuard, TurningStuck
from fleetwatch.plans.replay import _plain
from fleetwatch.plans.timeline import Timeline


def cmds(spark, values):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(values)], "seq long, v_lin double, v_ang double")
    return df.select(F.lit("r").alias("robot_id"), F.timestamp_seconds("seq").alias("recv_ts"), "*")


def flags(df, col):
    return [r[col] for r in df.orderBy("seq").collect()]


def test_physics(spark):
    assert flags(D.physics(cmds(spark, [(0.23, 0)])), "d1") == [False]
    assert flags(D.physics(cmds(spark, [(0.2301, 0)])), "d1") == [True]
    assert flags(D.physics(cmds(spark, [(0, 3.0), (0, 3.01)])), "d1") == [False, True]
    assert flags(D.physics(cmds(spark, [(9, 0)] + [(0, 0)] * 5)), "d1") == [True] * 5 + [False]


@pytest.mark.parametrize("fwd,bwd,fires", [(7, 2, False), (8, 2, True), (17, 3, True), (18, 2, False)])
def test_direction(spark, fwd, bwd, fires):
    assert flags(D.direction_conflict(cmds(spark, [(0.1, 0)] * fwd + [(-0.1, 0)] * bwd)), "d2")[-1] is fires


def frames(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "seq long, ranges array<double>")
    return df.select(F.lit("r").alias("robot_id"), F.timestamp_seconds("seq").alias("recv_ts"), "*")


def test_scan_repeat(spark):
    same = [[1.0] * 360] * 5
    assert flags(D.scan_motion(frames(spark, same)), "d3") == [False] * 4 + [True]
    assert not flags(D.scan_motion(frames(spark, same[:4] + [[1.1] * 300])), "d3")[-1]


def ticks(spark, seconds):
    return spark.createDataFrame([(s,) for s in seconds], "s double").select(
        F.lit("r").alias("robot_id"), F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("tick_ts")
    )


def test_motion_consistency(spark):
    still = frames(spark, [[1.0] * 360] * 5)
    go, stop = cmds(spark, [(0.06, 0)] * 10), cmds(spark, [(0.0, 0)] * 10)
    at = ticks(spark, [100.0])

    def fires(cmd, odom):
        return D.motion_consistency(at, cmd, odom, still).first().d6

    assert fires(stop, go) and fires(cmds(spark, [(0.1, 0)] * 5), stop)
    assert not fires(stop, cmds(spark, [(0.06, 0)] * 9))


def test_heartbeat_latch(spark):
    beats = spark.createDataFrame([(0.0, 0), (12.0, 1)], "s double, seq long").select(
        F.lit("r").alias("robot_id"), F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("recv_ts"), "seq"
    )
    grid = ticks(spark, [i / 2 for i in range(-4, 47)])
    got = D.latched(D.heartbeat_gap(grid, beats)).where("d5_new").collect()
    assert sorted(r.tick_ts.timestamp() for r in got) == [10.5, 22.5]
    none = D.latched(D.heartbeat_gap(grid, beats.limit(0)))
    assert none.where("d5").isEmpty()


@pytest.mark.parametrize("on,verdict", [("d1", "warning"), ("d1 d3", "vote"), ("d4", "strong-D4"), ("d5 d1", "vote"), ("", None)])
def test_votes(spark, on, verdict):
    row = spark.range(1).select(*[F.lit(d in on.split()).alias(d) for d in ("d1", "d2", "d3", "d4", "d5", "d6")])
    assert D.vote(row).first().verdict == verdict


def test_pause_sequence():
    rows, _ = PatrolPause().run([(s * SEC,) for s in (0, 10, 31, 62, 152, 200)], PatrolPause().initial())
    assert [(r[0] // SEC, r[1], r[3]) for r in rows] == [
        (0, "pause", False), (10, "counted", False), (31, "pause", True), (62, "quiet", False), (152, "pause", False), (200, "pause", True)
    ]


def test_mission_sequence():
    m = MissionMode()
    rows = [(0, "sensor", False), (1, "sensor", True), (5, "alert", None), (10, "sensor", True), (34, "tick", None), (35, "tick", None)]
    out, _ = m.run([(t * SEC, k, d) for t, k, d in rows], m.initial())
    assert [(r[0] // SEC, r[1]) for r in out] == [(0, "PATROL"), (1, "AVOID_OBSTACLE"), (5, "EMERGENCY_STOP"), (35, "PATROL")]
    stops = [(s, k, None) for n in range(4) for s, k in ((n * 30, "alert"), (n * 30 + 30, "tick"))]
    silent, _ = m.run(sorted((t * SEC, k, d) for t, k, d in stops), m.initial())
    assert not any(r[3] for r in silent)
    quick = MissionMode(recovery_s=5)
    loud, _ = quick.run([(t * SEC, k, None) for t, k in ((0, "alert"), (5, "tick"), (6, "alert"), (11, "tick"), (12, "alert"))], quick.initial())
    assert [r[3] for r in loud if r[1] == "EMERGENCY_STOP"] == [False, False, True]


def test_guard_sequence():
    g = TrainingGuard()
    rows = [x for s in range(12) for x in ((s * SEC, "reset"), (s * SEC, "alert"))]
    out, _ = g.run(rows, g.initial())
    assert [a for _, a in out] == ["stop"] * 9 + ["escalate", "quiet", "quiet"]


def test_turning_sequence():
    t = TurningStuck(limit=4, back=2)
    out, _ = t.run([(i, 1) for i in range(8)], t.initial())
    assert [(a, r) for _, a, r in out] == [(1, False)] * 4 + [(0, True)] * 2 + [(1, False)] * 2


@pytest.mark.parametrize("acts,last", [((1, 3, 1), 0), ((1, 1, 1), 1), ((1, 0, 3), 3)])
def test_smoothing(spark, acts, last):
    df = spark.createDataFrame([("a", 1, i, a) for i, a in enumerate(acts)], "run_id string, episode long, step int, raw_action int")
    assert [r.action for r in E.smooth_actions(df).orderBy("step").collect()][-1] == last


def episodes(spark, values, col="reward"):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], f"run_id string, episode long, {col} double")


def test_half_trend(spark):
    assert E.half_trend(episodes(spark, range(19))).where("recent is not null").isEmpty()
    last = E.half_trend(episodes(spark, range(21))).orderBy(F.desc("episode")).first()
    assert (last.recent, last.before) == (15.5, 4.5)


def test_bootstrap_edges(spark):
    def interval(values):
        return [(r.lo, r.hi) for r in E.bootstrap_ci(episodes(spark, values), "reward", 50).collect()]

    assert interval([2.0] * 9) == [(2.0, 2.0)] and interval([7.0]) == [(7.0, 7.0)] and interval([]) == []
    import numpy as np

    data = np.random.default_rng(1).normal(5, 2, 400)
    for f in (E.bootstrap_ci, E.bootstrap_ci_poisson):
        r = f(episodes(spark, data), "reward", 400).first()
        se = 1.96 * data.std() / 20
        assert abs(r.lo - (data.mean() - se)) < 0.06 and abs(r.hi - (data.mean() + se)) < 0.06


def test_curriculum_promotes_after_thirty(spark):
    df = episodes(spark, [1] * 65, "success")
    got = E.curriculum(df).orderBy("episode").collect()
    assert [r.episode for r in got if r.promoted] == [29, 59]
    assert [got[i].stage for i in (29, 30, 59, 60)] == [1, 2, 2, 3]


def test_results_do_not_depend_on_partitioning(spark):
    rows = spark.range(500).select(F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("robot_id"),
                                   F.timestamp_seconds(F.col("id") * 7 % 499).alias("recv_ts"), F.col("id").alias("seq"))
    a = A.cooldown(rows.repartition(1)).select("seq").collect()
    b = A.cooldown(rows.repartition(13, "seq")).select("seq").collect()
    assert sorted(a) == sorted(b)


def test_split_bootstrap_draws_exactly_and_reproducibly(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.lognormal(1, 0.7, 1500)
    df = spark.createDataFrame([(r, i, float(v)) for r in ("a", "b") for i, v in enumerate(data if r == "a" else data[:37])], "run_id string, episode long, reward double")
    for block in (64, 4096):
        got = {r.run_id: r for r in E.bootstrap_ci_split(df, "reward", 2000, block=block).collect()}
        for run, values in (("a", data), ("b", data[:37])):
            want = np.percentile(values[np.random.default_rng(9).integers(0, len(values), (20_000, len(values)))].mean(1), [2.5, 97.5])
            wide = want[1] - want[0]
            assert got[run].n == len(values) and abs(got[run].mean - values.mean()) < 1e-9
            assert abs(got[run].lo - want[0]) < 0.08 * wide and abs(got[run].hi - want[1]) < 0.08 * wide
    a, b = ([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in E.bootstrap_ci_split(x, "reward", 50, seed=3, block=64).orderBy("run_id").collect()] for x in (df.repartition(1), df.repartition(11, "reward")))
    assert a == b
    # n draws exactly: resampled means of ones are one, and nulls count neither way
    ones = df.withColumn("reward", F.when(F.col("episode") % 3 == 0, F.lit(None)).otherwise(F.lit(1.0)))
    assert {(r.lo, r.hi) for r in E.bootstrap_ci_split(ones, "reward", 50, block=64).collect()} == {(1.0, 1.0)}
    assert E.bootstrap_ci_split(df.limit(0), "reward", 50).count() == 0
    assert [(r.lo, r.hi) for r in E.bootstrap_ci_split(episodes(spark, [7.0]), "reward", 50).collect()] == [(7.0, 7.0)]


def test_first_rows_of_a_whole_table(spark):
    import random

    from fleetwatch.plans.orderstat import first_rows

    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, 1.5, 1.5, 2.0, rnd.random() * 1e6]), rnd.choice([7, None, rnd.randrange(-10**15, 10**15)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, y long").repartition(7).cache()
    low = lambda v: (v is not None, v)
    order = sorted(rows, key=lambda r: (low(r[1]), low(r[2]), low(r[0])))
    for n in (0, 1, 50, 700, 1800, 2999, 3000, 4000):
        for small in (5, 200, 10_000):
            got = first_rows(df, n, [F.col("x"), F.col("y"), F.col("id")], small)
            assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in order[:n]), (n, small)
    assert first_rows(df.limit(0), 5, [F.col("x")]).count() == 0


def test_rolling_scores_of_cut_runs_read_the_rows_twice(spark, tmp_path):
    rnd = random.Random(4)
    rows = []
    for run in ("a", "b", None):
        for i in range(300):
            clear = None if i % 7 == 0 else float("inf") if i < 5 or 90 < i < 230 else rnd.random()
            rows.append((run, i, None if i % 11 == 0 else rnd.gauss(50, 9), i % 5, rnd.random(), i % 2, i % 3, 0, None if i % 13 == 0 else i % 4, clear))
    spark.createDataFrame(rows, "run_id string, episode long, reward double, steps int, spl double, success int, collision int, timeout int, wp_done int, clearance double").write.parquet(f"{tmp_path}/episodes")
    episodes, n = spark.read.parquet(f"{tmp_path}/episodes"), 8
    spark.conf.set("spark.fleetwatch.rowsPerTask", "30")
    try:
        scores = E.rolling_scores(episodes, n)
    finally:
        spark.conf.unset("spark.fleetwatch.rowsPerTask")
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("] parquet") <= 2
    mean = lambda x: sum(x) / len(x) if x else None
    for got in (scores, E.rolling_scores(episodes, n)):
        for r in got.collect():
            mine = [x for x in rows if x[0] == r.run_id and x[1] <= r.episode]
            last = mine[-n:]
            for c, name in enumerate(("reward", "steps", "spl", "success", "collision", "timeout", "wp_done"), 2):
                assert r[f"mean_{name}"] == pytest.approx(mean([x[c] for x in last if x[c] is not None]), abs=1e-9)
            reward = [x[2] for x in last if x[2] is not None]
            assert r.std_reward == (pytest.approx(mean([(x - mean(reward)) ** 2 for x in reward]) ** 0.5, abs=1e-9) if reward else None)
            assert r.partial_rate == pytest.approx(mean([float((x[8] or 0) >= 1) for x in last]))
            assert r.mean_clearance == pytest.approx(mean([x[9] for x in mine if x[9] is not None and math.isfinite(x[9])][-n:]), abs=1e-9)


def drawn(seed, *parts, draws):
    """(b, u) of a row, one by one."""
    for b in range(draws):
        digest = hashlib.sha256("|".join(map(str, (seed, *parts, b // 5))).encode()).hexdigest()
        yield b, int(digest[12 * (b % 5) : 12 * (b % 5) + 12], 16) / (1 << 48)


def scored_runs(spark):
    rnd = random.Random(6)
    rows = [(run, i, None if i % 9 == 2 else rnd.random()) for run, n in (("a", 150), ("b", 3), ("c", 1), (None, 5)) for i in range(n)] + [("empty", 0, None)]
    return rows, spark.createDataFrame(rows, "run_id string, episode long, spl double")


def interval(means):
    return pytest.approx([float(np.percentile(means, q)) for q in (2.5, 97.5)], abs=1e-12)


def test_bootstrap_draws_go_to_blocks_without_a_row_each(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_BITS", 4)
    monkeypatch.setattr(E, "PACKED", 7)
    rows, df = scored_runs(spark)
    got = E.bootstrap_ci(df, "spl", 23, seed=7)
    assert "sha2(" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {r.run_id: r for r in got.collect()}
    assert set(found) == {"a", "b", "c", "empty"} and found["empty"].lo is None
    for run in "abc":
        v, picks = [x[2] for x in rows if x[0] == run], [[] for _ in range(23)]
        for i in range(len(v)):
            for b, u in drawn(7, run, i, draws=23):
                picks[b].append(v[min(math.floor(u * len(v)), len(v) - 1)])
        real = [[x for x in p if x is not None] for p in picks]
        assert [found[run].lo, found[run].hi] == interval([sum(x) / len(x) for x in real if x])
        assert found[run].n == len(v)


def test_poisson_bootstrap_adds_up_in_the_tasks(spark):
    rows, df = scored_runs(spark)
    got = E.bootstrap_ci_poisson(df, "spl", 23, seed=7)
    assert "sha2(" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {r.run_id: r for r in got.collect()}
    assert set(found) == {"a", "b", "c", "empty"} and found["empty"].lo is None
    least = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    for run in "ab":
        total, size = [0.0] * 23, [0] * 23
        for _, i, v in (x for x in rows if x[0] == run):
            for b, u in drawn(7, run, i, draws=23):
                w = int((least <= u).sum())
                total[b], size[b] = total[b] + w * (v or 0.0), size[b] + w
        assert [found[run].lo, found[run].hi] == interval([t / k for t, k in zip(total, size) if k])


def test_small_keys_are_measured_without_their_order(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("k"), F.raise_error(F.lit("the order is read")).cast("long").alias("step"))
    assert Timeline.of(df, "k", "step").hot is None
    assert Timeline.of(df.limit(0), "k", "step").hot is None


def test_walks_take_columns_in_bulk():
    lists = pa.array([[1.0, None], None, [], [2.5]]).slice(1)
    assert _plain(lists) == [None, [], [2.5]]
    assert _plain(pa.array([1, None, 3])) == [1, None, 3] and _plain(pa.array([1.5, 2.0])) == [1.5, 2.0]
    assert _plain(pa.array(["a", None])) == ["a", None] and _plain(pa.array([True, None])) == [True, None]
