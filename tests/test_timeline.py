"""Cut keys must give what the plain window gives."""

import random

import pytest
from pyspark.sql import functions as F

from fleetwatch.operators.machines import MissionMode, PatrolPause, TrainingGuard
from fleetwatch.plans import replay as R
from fleetwatch.plans.asof import hold, make_ticks
from fleetwatch.plans.replay import thin
from fleetwatch.plans.timeline import Timeline


def stream(spark, n=600, seed=1):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 1, 2, 3, 5, 9, 40, 200])
        key = "big" if rnd.random() < 0.6 else f"r{rnd.randrange(5)}"
        rows.append((key, t, i, rnd.choice([None, rnd.random()])))
    return spark.createDataFrame(rows, "robot_id string, s long, n long, v double").select(
        "robot_id", F.timestamp_seconds("s").alias("recv_ts"), "n", "v"
    )


def lines(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows(spark):
    return stream(spark).cache()


def both(rows, limit=40):
    plain = Timeline.of(rows, "robot_id", ("recv_ts", "n"))
    cut = Timeline.of(rows, "robot_id", ("recv_ts", "n"), limit=limit)
    assert plain.hot is None and cut.hot is not None
    return plain, cut


@pytest.mark.parametrize("n,ahead", [(1, False), (4, False), (19, False), (60, False), (3, True)])
def test_frames_survive_cutting(rows, n, ahead):
    plain, cut = both(rows, limit=10)

    def build(w):
        return {"m": F.max("v").over(w.rowsBetween(-n, 0)), "c": F.count("n").over(w.rowsBetween(-n, 0)), "l": F.lag("n", n).over(w)}

    assert lines(plain.frame(rows, n, build, ahead)) == lines(cut.frame(rows, n, build, ahead))


@pytest.mark.parametrize("before", [False, True])
def test_running_values_survive_cutting(rows, before):
    plain, cut = both(rows)
    aggs = {
        "s": ("sum", F.col("n")),
        "c": ("count", F.col("v")),
        "hi": ("max", F.col("v")),
        "lo": ("min", F.col("v")),
        "last": ("last", F.col("v")),
        "first": ("first", F.col("v")),
    }
    assert lines(plain.running(rows, aggs, before)) == lines(cut.running(rows, aggs, before))


def brute_thin(rows, seconds, strict):
    last, kept = {}, []
    for r in sorted(rows.collect(), key=lambda r: (r.robot_id, r.recv_ts, r.n)):
        prev = last.get(r.robot_id)
        d = None if prev is None else (r.recv_ts - prev).total_seconds()
        if d is None or (d > seconds if strict else d >= seconds):
            last[r.robot_id] = r.recv_ts
            kept.append(tuple(r))
    return sorted(kept, key=repr)


@pytest.mark.parametrize("seconds,strict", [(10, False), (10, True), (40, False), (5, False)])
def test_thinning_is_greedy_for_plain_and_cut_keys(rows, seconds, strict):
    plain, cut = both(rows)
    want = brute_thin(rows, seconds, strict)
    assert lines(thin(rows, plain, seconds, strict)) == want
    assert lines(thin(rows, cut, seconds, strict)) == want
    marked = thin(rows, plain, seconds, strict, mark="kept")
    assert marked.count() == rows.count()
    assert lines(marked.where("kept").drop("kept")) == want


def test_thinning_documented_case(spark):
    rows = spark.createDataFrame([("r", s, i) for i, s in enumerate([0.0, 4.0, 9.99, 10.0, 15.0, 20.0])], "robot_id string, s double, n long")
    rows = rows.select("robot_id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("recv_ts"), "n", "s")
    tl = Timeline.of(rows, "robot_id", ("recv_ts", "n"))
    assert sorted(r.s for r in thin(rows, tl, 10).collect()) == [0, 10, 20]
    assert sorted(r.s for r in thin(rows, tl, 10, strict=True).collect()) == [0, 15]


def test_hold_is_inclusive_and_keeps_last_value(rows):
    ticks = make_ticks(rows, "robot_id", "recv_ts", 30)
    got = hold(ticks, [(rows.withColumn("_tie", F.col("n")), "recv_ts", ["v"])], "robot_id")
    data = sorted(rows.collect(), key=lambda r: (r.recv_ts, r.n))
    for t in got.collect():
        seen = [r.v for r in data if r.robot_id == t.robot_id and r.recv_ts <= t.tick_ts and r.v is not None]
        assert t.v == (seen[-1] if seen else None)


def test_no_slice_is_deep_however_rows_crowd(spark):
    rnd = random.Random(4)
    at = [rnd.randrange(10_000) for _ in range(300)] + [5_000 + rnd.randrange(100) for _ in range(2_000)] + [7_000] * 700
    rows = spark.createDataFrame([("big", s, i) for i, s in enumerate(at)] + [("small", i, i) for i in range(30)], "robot_id string, s long, n long")
    rows = rows.select("robot_id", F.timestamp_seconds("s").alias("recv_ts"), "n").cache()
    limit = 100
    tl = Timeline.of(rows, "robot_id", ("recv_ts", "n"), limit)
    depth = {(r.robot_id, r._slice): r["count"] for r in tl.cut(rows).groupBy("robot_id", "_slice").count().collect()}
    assert len(depth) > 30 and max(depth.values()) <= 2 * limit
    ends = tl.cut(rows).groupBy("robot_id", "_slice").agg(F.min(F.struct("recv_ts", "n")).alias("a"), F.max(F.struct("recv_ts", "n")).alias("b")).orderBy("robot_id", "_slice").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]) if x.robot_id == y.robot_id)  # slices follow the order
    plain = Timeline.of(rows, "robot_id", ("recv_ts", "n"), 10**6)
    aggs = {"c": ("count", F.col("n")), "l": ("last", F.col("n"))}
    assert lines(plain.running(rows, aggs)) == lines(tl.running(rows, aggs))
    build = lambda w: {"p": F.lag("n", 3).over(w)}
    assert lines(plain.frame(rows, 3, build)) == lines(tl.frame(rows, 3, build))
    for seconds in (1, 5, 4_000):
        assert lines(thin(rows, tl, seconds)) == lines(thin(rows, plain, seconds)) == brute_thin(rows, seconds, False)


MACHINES = {
    "pause": (lambda: PatrolPause(30, 90, 2, 120), lambda r: r),
    "mission": (lambda: MissionMode(30, 60), lambda r: r.withColumn("kind", F.element_at(F.array(F.lit("tick"), F.lit("alert"), F.lit("sensor"), F.lit("tick")), (F.col("n") % 4 + 1).cast("int"))).withColumn("danger", F.col("v") > 0.5)),
    "guard": (lambda: TrainingGuard(60, 3, 60), lambda r: r.withColumn("kind", F.when(F.col("n") % 5 == 0, "reset").when(F.col("n") % 7 == 0, F.lit(None)).otherwise("alert"))),
}


@pytest.mark.parametrize("name", list(MACHINES))
def test_machines_that_forget_need_no_rounds(spark, rows, name, monkeypatch):
    make, prepare = MACHINES[name]
    machine, data = make(), prepare(rows)
    plain, cut = both(data)
    want = lines(R.replay(data, plain, machine))
    monkeypatch.setattr(R, "STRETCH", 1_000)
    monkeypatch.setattr(R, "entries", lambda *a: pytest.fail("rounds"))
    assert lines(R.replay(data, cut, machine)) == want
    monkeypatch.undo()
    monkeypatch.setattr(R, "STRETCH", 0)  # every stretch is too long: by rounds
    assert lines(R.replay(data, cut, machine)) == want


def test_thinning_walks_once(spark, rows):
    plain, cut = both(rows)
    plan = thin(rows, plain, 10, mark="kept")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan and "Join" not in plan
    monkey = R.STRETCH
    try:
        R.STRETCH = 0
        assert lines(thin(rows, cut, 10)) == brute_thin(rows, 10, False)
        marked = thin(rows, cut, 10, mark="kept", eligible=F.col("v") > 0.3)
    finally:
        R.STRETCH = monkey
    want = {r.n for r in rows.where("v > 0.3").collect()} & {t[2] for t in brute_thin(rows.where("v > 0.3"), 10, False)}
    assert {r.n for r in marked.where("kept").collect()} == want and marked.count() == rows.count()


def test_rows_without_time_are_passed_over(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 10, 2), ("a", 12, 3), (None, 5, 4)], "robot_id string, s long, n long").select("robot_id", F.timestamp_seconds("s").alias("recv_ts"), "n")
    tl = Timeline.of(rows, "robot_id", ("recv_ts", "n"))
    assert sorted((r.n, r.kept) for r in thin(rows, tl, 5, mark="kept").collect()) == [(1, False), (2, True), (3, False), (4, True)]
    assert thin(rows.limit(0), tl, 5).count() == 0
