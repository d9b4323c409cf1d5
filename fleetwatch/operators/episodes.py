"""Episode and step analytics: scores, trends, rewards inputs, intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.crypto import draw_text, hashed_draws
from ..functions.geometry import goal_distance, grid_cell
from ..functions.scan import finite
from ..plans.replay import replay
from ..plans.timeline import Timeline
from ..session import checkpointed, ship
from .machines import TurningStuck, VisitProgress

STEP_KEY = ("run_id", "episode")


def _steps(df: DataFrame) -> Timeline:
    return Timeline.of(df, STEP_KEY, "step")


def frame_stack(frames: DataFrame, k: int = 4, col: str = "frame") -> DataFrame:
    """``stacked``: the last k frames, oldest first; the first frame fills the start."""
    tl = _steps(frames)
    lagged = tl.frame(frames, k - 1, lambda w: {f"_f{i}": F.lag(col, i).over(w) for i in range(1, k)})
    # Before the k-th frame the oldest one present is the episode's first.
    parts: list[Column] = []
    for i in range(k - 1, -1, -1):
        nearest = [F.col(col) if j == 0 else F.col(f"_f{j}") for j in range(i, -1, -1)]
        parts.append(F.coalesce(*nearest))
    return lagged.withColumn("stacked", F.concat(*parts)).drop(*[f"_f{i}" for i in range(1, k)])


def path_length(steps: DataFrame) -> DataFrame:
    tl = _steps(steps)
    moves = tl.previous(steps, {"_x": "x", "_y": "y"})
    hop = F.coalesce(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")), F.lit(0.0))
    return tl.running(moves.withColumn("_hop", hop), {"path_length": ("sum", F.col("_hop"))}).drop("_x", "_y", "_hop")


def optimal_length(starts: DataFrame, waypoints: DataFrame) -> DataFrame:
    """(route_id, optimal): start, then the waypoints in order. Starts are (route_id, x, y)."""
    line = starts.select("route_id", F.lit(0).alias("seq"), "x", "y").unionByName(waypoints.select("route_id", "seq", "x", "y"))
    tl = Timeline.of(line, "route_id", "seq")
    legs = tl.previous(line, {"_x": "x", "_y": "y"})
    return legs.groupBy("route_id").agg(F.sum(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))).alias("optimal"))


def running_min_clearance(steps: DataFrame, nearest: str = "nearest") -> DataFrame:
    return _steps(steps).running(steps, {"min_clearance": ("min", F.col(nearest))})


#: What ``rolling_scores`` averages over the last n rows.
SCORES = ("reward", "steps", "spl", "success", "collision", "timeout", "wp_done")


def rolling_scores(episodes: DataFrame, n: int = 100, order=("episode",)) -> DataFrame:
    """Means over the last n episodes of each run; clearance over its last n finite values.

    Rows are shuffled and sorted once and walked batch by batch; a walk holds the last n rows and the last n finite
    clearances. Slices of cut runs begin with those of the slices before, from one narrow walk over the same rows.
    """
    tl = Timeline.of(episodes, "run_id", order)
    if tl.hot is None:
        return _rolled(episodes, tl.key, order, n, episodes.columns)
    body = tl.cut(episodes)
    slot = [*tl.key, "_slice"]
    narrow = body.where("_hot").select(*slot, *order, *SCORES, "clearance")
    begun = _slice_starts(checkpointed(_rolled(narrow, slot, order, n, None)), tl.key, n, len(SCORES) + 1)
    every = body.drop("_hot").withColumn("_at", F.lit(1)).unionByName(begun.withColumn("_at", F.lit(0)), allowMissingColumns=True)
    return _rolled(every, slot, ("_at", *order), n, episodes.columns)


def _slice_starts(ends: DataFrame, key, n: int, wide: int) -> DataFrame:
    """(key, _slice, _rows, _fins) of what each slice's own end is: the last rows and finite values before each slice."""
    along = W.partitionBy(*key).orderBy("_slice")

    def last(c: str, count: int, first: int, end: int) -> Column:
        whole = F.flatten(F.collect_list(c).over(along.rowsBetween(first, end)))
        return F.slice(whole, F.greatest(F.lit(1), F.size(whole) - count + 1), F.lit(count))

    slot = [*key, "_slice"]
    some = ends.where(F.size("_fins") > 0).select(*slot, last("_fins", n, 1 - n, 0).alias("_upto"))
    before = F.last("_upto", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    return ends.join(some, slot, "left").select(*slot, last("_rows", (n - 1) * wide, 1 - n, -1).alias("_rows"), before.alias("_fins"))


def _rolled(df: DataFrame, group, order, n: int, given: list[str] | None) -> DataFrame:
    """The means of sorted groups beside the ``given`` columns; without these one row per group with its last rows and finite values.

    A row with ``_at`` = 0 opens a group with what came before it.
    """
    group, order, seeded = list(group), list(order), "_at" in df.columns
    wide = len(SCORES) + 1
    names = [*[f"mean_{c}" for c in SCORES], "partial_rate", "std_reward", "mean_clearance"]
    out = [*[f"mean_{c}" for c in SCORES], "std_reward", "partial_rate", "mean_clearance"]
    if given is None:
        schema = T.StructType([*[df.schema[c] for c in group], T.StructField("_rows", T.ArrayType(T.DoubleType())), T.StructField("_fins", T.ArrayType(T.DoubleType()))])
    else:
        schema = T.StructType([*[df.schema[c] for c in given], *[T.StructField(c, T.DoubleType()) for c in out]])
    arrow = to_arrow_schema(schema)
    views = np.lib.stride_tricks.sliding_window_view

    def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        c = batch.column(name).cast(pa.float64())
        return pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False), pc.is_valid(c).to_numpy(zero_copy_only=False)

    def valued(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Values and validity: the scores, whether a waypoint was done (always known) and the clearance."""
        found = [column(batch, c) for c in SCORES]
        done, known = found[SCORES.index("wp_done")]
        some = known & ((done >= 1) | np.isnan(done))
        every = [*found, (some.astype(float), np.ones(len(some), bool)), column(batch, "clearance")]
        return np.array([v for v, _ in every]), np.array([k for _, k in every])

    def start(rows=None, fins=None):
        """Values and validity of the n - 1 rows before, oldest first, and the finite values before."""
        v, ok = np.zeros((wide, n - 1)), np.zeros((wide, n - 1), bool)
        if rows:
            had = np.array(rows, object).reshape(-1, wide).T
            ok[:, n - 1 - had.shape[1] :] = had != None  # noqa: E711
            v[:, n - 1 - had.shape[1] :] = np.where(had == None, 0.0, had).astype(float)  # noqa: E711
        return v, ok, np.array(fins or [], float)

    def means(v, ok, fins, x, known, made):
        """Writes the means of rows x into ``made`` (values, validity)."""
        count = np.cumsum(np.pad(ok, ((0, 0), (1, 0))), axis=1)
        count = count[:, n:] - count[:, :-n]
        some = np.maximum(count, 1)
        mean = views(v, n, axis=1).sum(axis=2) / some
        made[0][:wide], made[1][:wide] = mean, count > 0
        off = np.where(views(ok[0], n), views(v[0], n) - mean[0][:, None], 0.0)
        made[0][wide], made[1][wide] = np.sqrt((off * off).sum(axis=1) / some[0]), count[0] > 0
        real = known & np.isfinite(x)
        every = np.concatenate([np.zeros(n - len(fins)), fins, x[real]])
        held = np.minimum(len(fins) + np.arange(int(real.sum()) + 1), n)
        at = np.cumsum(real)
        made[0][wide + 1], made[1][wide + 1] = (views(every, n).sum(axis=1) / np.maximum(held, 1))[at], held[at] > 0
        return every[len(every) - held[-1] :]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, (v, ok, fins) = None, start()

        def end(v, ok, fins) -> pa.RecordBatch:
            flat = [a if b else None for a, b in zip(v[:, ok[-1]].T.ravel().tolist(), ok[:, ok[-1]].T.ravel().tolist())]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*key, flat, fins.tolist()), arrow)], schema=arrow)

        for batch in batches:
            many = batch.num_rows
            if not many:
                continue
            new = np.zeros(many, bool)
            new[0] = True
            for g in group:
                codes = pc.dictionary_encode(batch.column(g), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            begin = np.flatnonzero(new)
            x, known = valued(batch)
            opens = batch.column("_at").to_numpy(zero_copy_only=False) == 0 if seeded else np.zeros(many, bool)
            made = np.zeros((wide + 2, many)), np.zeros((wide + 2, many), bool)
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), many]):
                here = tuple(batch.column(g)[a].as_py() for g in group)
                if here != key:
                    if given is None and key is not None:
                        yield end(v, ok, fins)
                    key, (v, ok, fins) = here, start()
                if opens[a]:
                    v, ok, fins = start(batch.column("_rows")[a].as_py(), batch.column("_fins")[a].as_py())
                    a += 1
                if a == b:
                    continue
                v, ok = np.hstack([v, x[:wide, a:b]]), np.hstack([ok, known[:wide, a:b]])
                if given is not None:
                    fins = means(v, ok, fins, x[wide, a:b], known[wide, a:b], (made[0][:, a:b], made[1][:, a:b]))
                else:
                    last = x[wide, a:b][known[wide, a:b] & np.isfinite(x[wide, a:b])]
                    fins = np.concatenate([fins, last[max(0, len(last) - n) :]])
                    fins = fins[max(0, len(fins) - n) :]
                v, ok = v[:, v.shape[1] - n + 1 :], ok[:, ok.shape[1] - n + 1 :]
            if given is not None:
                new_columns = {c: pa.array(a, mask=~k) for c, a, k in zip(names, *made)}
                done = pa.RecordBatch.from_arrays([*[batch.column(c) for c in given], *[new_columns[c] for c in out]], schema=arrow)
                yield done.filter(pa.array(~opens)) if seeded else done
        if given is None and key is not None:
            yield end(v, ok, fins)

    ship(df.sparkSession)
    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(walk, schema)


def best_so_far(scores: DataFrame, metric: str, eligible: Column, order=("episode",)) -> DataFrame:
    """Adds ``best_before`` and ``is_new_best`` over eligible rows (strictly better)."""
    tl = Timeline.of(scores, "run_id", order)
    value = F.when(eligible, F.col(metric))
    seen = tl.running(scores, {"best_before": ("max", value)}, before=True)
    new = eligible & (F.col("best_before").isNull() | (F.col(metric) > F.col("best_before")))
    return seen.withColumn("is_new_best", F.coalesce(new, F.lit(False)))


def half_trend(episodes: DataFrame, col: str = "reward", n: int = 100, order=("episode",), least: int = 20) -> DataFrame:
    """Mean of the newest and of the oldest half of the last n rows; null under ``least``."""
    tl = Timeline.of(episodes, "run_id", order)
    seen = tl.frame(episodes, n - 1, lambda w: {"_v": F.collect_list(F.col(col).cast("double")).over(w.rowsBetween(1 - n, 0))})
    half = F.floor(F.size("_v") / 2).cast("int")

    def mean(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / half

    ready = F.size("_v") >= least
    return (
        seen.withColumn("recent", F.when(ready, mean(F.slice("_v", F.size("_v") - half + 1, half))))
        .withColumn("before", F.when(ready, mean(F.slice("_v", F.lit(1), half))))
        .drop("_v")
    )


def visit_bonus_input(steps: DataFrame, order=("episode", "step")) -> DataFrame:
    """``prior_visits`` of the grid cell by the whole run before each step."""
    cells = steps.withColumn("gx", grid_cell(F.col("x"))).withColumn("gy", grid_cell(F.col("y")))
    tl = Timeline.of(cells, ("run_id", "gx", "gy"), order)
    seen = tl.running(cells.withColumn("_one", F.lit(1)), {"prior_visits": ("count", F.col("_one"))}, before=True)
    return seen.drop("_one")


def moving_average(df: DataFrame, col: str, n: int, key="run_id", order=("episode",)) -> DataFrame:
    """Only full windows of n rows."""
    tl = Timeline.of(df, key, order)

    def build(w):
        last = w.rowsBetween(1 - n, 0)
        return {f"ma_{n}": F.avg(col).over(last), "_k": F.count(F.lit(1)).over(last)}

    return tl.frame(df, n - 1, build).where(F.col("_k") == n).drop("_k")


def newest(df: DataFrame, n: int, key=("run_id",), order=("episode",)) -> DataFrame:
    """The last n rows per key; Spark keeps n per task before it shuffles."""
    w = W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def smooth_actions(actions: DataFrame, n: int = 3, forward: int = 0) -> DataFrame:
    """``action``: forward where the last n raw actions all turn and differ."""
    tl = _steps(actions)
    turning = F.when(F.col("raw_action") != forward, 1)

    def build(w):
        last = w.rowsBetween(1 - n, 0)
        return {"_k": F.count(turning).over(last), "_lo": F.min("raw_action").over(last), "_hi": F.max("raw_action").over(last)}

    seen = tl.frame(actions, n - 1, build)
    mixed = (F.col("_k") == n) & (F.col("_lo") != F.col("_hi"))
    return seen.withColumn("action", F.when(mixed, F.lit(forward)).otherwise(F.col("raw_action"))).drop("_k", "_lo", "_hi")


def turning_stuck(actions: DataFrame, **limits) -> DataFrame:
    return replay(actions, _steps(actions), TurningStuck(**limits))


def visit_progress(steps: DataFrame, key=STEP_KEY, order=("step",), **limits) -> DataFrame:
    return replay(steps, Timeline.of(steps, key, order), VisitProgress(**limits))


def delta_prev(steps: DataFrame) -> DataFrame:
    """``action_change2``, ``dist``, ``prev_dist`` and ``progress`` of each step.

    ``prev_dist`` is the last position's distance to the target in force now
    (``gx``, ``gy``), so a switch of target makes no jump. Before the first step
    the action is zero and the position its own.
    """
    tl = _steps(steps)
    seen = tl.previous(steps, {"_a": "action", "_x": "x", "_y": "y"})
    change = F.aggregate(
        F.zip_with(F.coalesce("_a", F.transform("action", lambda x: x * 0)), F.col("action"), lambda p, a: (a - p) * (a - p)),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    before = goal_distance(F.coalesce("_x", "x"), F.coalesce("_y", "y"), F.col("gx"), F.col("gy"))
    return (
        seen.withColumn("action_change2", change)
        .withColumn("dist", goal_distance(F.col("x"), F.col("y"), F.col("gx"), F.col("gy")))
        .withColumn("prev_dist", before)
        .withColumn("progress", F.col("prev_dist") - F.col("dist"))
        .drop("_a", "_x", "_y")
    )


def transitions(steps: DataFrame, obs: str = "obs", final: str | None = "next_obs") -> DataFrame:
    """(run_id, episode, step, obs, action, reward, next_obs, done); done means terminated."""
    tl = _steps(steps)
    seen = tl.following(steps, {"_next": obs})
    nxt = F.coalesce("_next", final) if final else F.col("_next")
    return seen.select(*STEP_KEY, "step", F.col(obs).alias("obs"), "action", "reward", nxt.alias("next_obs"),
                       F.col("terminated").alias("done"))


def episode_rollup(steps: DataFrame, last=("event",)) -> DataFrame:
    return steps.groupBy(*STEP_KEY).agg(
        F.sum("reward").alias("reward"), F.count(F.lit(1)).alias("steps"), *[F.max_by(c, "step").alias(c) for c in last]
    )


def eval_report(episodes: DataFrame) -> DataFrame:
    real = F.when(finite(F.col("clearance")), F.col("clearance"))
    return episodes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg("spl").alias("mean_spl"),
        F.avg("success").alias("success_rate"),
        F.avg("collision").alias("collision_rate"),
        F.avg("timeout").alias("timeout_rate"),
        F.avg("steps").alias("mean_steps"),
        F.avg("wp_done").alias("mean_waypoints"),
        F.avg(real).alias("mean_clearance"),
        F.avg("reward").alias("mean_reward"),
        F.stddev_pop("reward").alias("std_reward"),
    )


def outcomes(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("run_id", "event").agg(F.count(F.lit(1)).alias("episodes"))


def numbered(df: DataFrame, key="run_id", order=("episode",), tl: Timeline | None = None) -> DataFrame:
    """Adds ``_i`` = 0.. per key, also for keys cut over tasks."""
    one = df.withColumn("_one", F.lit(1))
    tl = tl or Timeline.of(df, key, order)
    return tl.running(one, {"_i": ("count", F.col("_one"))}, before=True).drop("_one")


#: Draws that a task holds at once, binary digits of the rows in one block of values, and draws in one shuffled row.
HELD, BLOCK_BITS, PACKED = 1_000_000, 16, 2_048


def _codes(column: pa.Array) -> np.ndarray:
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Few short rows turn into much work: deal them out first."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _by_resample(sums: DataFrame, key: str, *columns: str) -> DataFrame:
    """Arrays over the resamples as rows (key, _b, columns)."""
    each = F.posexplode(F.arrays_zip(*columns)).alias("_b", "_x")
    return sums.select(key, each).select(key, "_b", *[F.col("_x").getField(c).alias(c) for c in columns])


def bootstrap_ci(df: DataFrame, col: str, draws: int = 1000, low: float = 2.5, high: float = 97.5, seed: int = 0,
                 key="run_id", order=("episode",)) -> DataFrame:
    """Percentile interval of resampled means: (run_id, n, mean, lo, hi).

    Draw i of resample b takes value floor(u * n) with u hashed from the seed,
    the run, i and b: any partitioning gives the same interval. Tasks draw for
    their rows in numpy and send the draws, four bytes each, to the block of
    values they fall into; a block adds up its values as the draws come by and
    returns one sum per resample.
    """
    base = numbered(df.select(key, *order, col), key, order).select(key, "_i", F.col(col).cast("double").alias("_v"))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(col).cast("double")).alias("mean"))
    slots = base.join(sizes.select(key, "n"), key).select(key, "n", "_i", "_v", draw_text(F.lit(seed), F.col(key), F.col("_i")).alias("_text"))
    bits = min(BLOCK_BITS, ((1 << 31) // draws).bit_length() - 1)
    kind = df.schema[key]
    dealt = T.StructType([kind, *[T.StructField(n, t) for n, t in (("_block", T.LongType()), ("_kind", T.IntegerType()), ("_at", T.IntegerType()), ("_v", T.DoubleType()), ("_picks", T.BinaryType()))]])
    summed = T.StructType([kind, T.StructField("_s", T.ArrayType(T.DoubleType())), T.StructField("_c", T.ArrayType(T.LongType()))])
    to_blocks, to_sums = to_arrow_schema(dealt), to_arrow_schema(summed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, HELD // draws)):
                batch = whole.slice(at, max(1, HELD // draws))
                run, n, i = _codes(batch.column(key)).astype(np.int64), *(batch.column(c).to_numpy() for c in ("n", "_i"))
                rows = len(n)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(i >> bits), pa.array(np.zeros(rows, np.int32)), pa.array((i & ((1 << bits) - 1)).astype(np.int32)), batch.column("_v"), pa.nulls(rows, pa.binary())], schema=to_blocks)
                index = np.minimum(np.floor(hashed_draws(batch.column("_text").to_pylist(), draws) * n[:, None]).astype(np.int64), n[:, None] - 1)
                block = index >> bits
                many = int(block.max()) + 1
                group = (run[:, None] * many + block).ravel()
                if (int(run.max()) + 1) * many < 1 << 16:
                    group = group.astype(np.uint16)  # sorted by counting
                along = np.argsort(group, kind="stable")
                group = group[along]
                picks = ((np.arange(draws, dtype=np.int64) << bits) + (index & ((1 << bits) - 1))).ravel()[along].astype(np.int32)
                begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                size = np.diff(np.append(begin, len(group)))
                parts = -(-size // PACKED)
                begin = np.repeat(begin, parts) + PACKED * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((4 * np.append(begin, len(group))).astype(np.int32).tobytes()), pa.py_buffer(picks.tobytes())])
                first = along[begin]
                count = len(begin)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(first // draws)), pa.array(block.ravel()[first]), pa.array(np.ones(count, np.int32)), pa.nulls(count, pa.int32()), pa.nulls(count, pa.float64()), packed], schema=to_blocks)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, value, known, total, count = None, None, None, None, None
        done: list[tuple] = []

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), to_sums)], schema=to_sums)

        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            run, block, which = _codes(batch.column(key)), batch.column("_block").to_numpy(), batch.column("_kind").to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (block[1:] != block[:-1])]))
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), rows]):
                here = (batch.column(key)[a].as_py(), int(block[a]))
                if here != held:
                    if held is not None:
                        done.append((held[0], total, count))
                    held, value, known, total, count = here, np.zeros(1 << bits), np.zeros(1 << bits, bool), np.zeros(draws), np.zeros(draws, np.int64)
                middle = a + int(np.searchsorted(which[a:b], 1))
                if middle > a:
                    v = batch.column("_v").slice(a, middle - a)
                    at = batch.column("_at").slice(a, middle - a).to_numpy(zero_copy_only=False).astype(np.int64)
                    value[at], known[at] = pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False), pc.is_valid(v).to_numpy(zero_copy_only=False)
                for data in batch.column("_picks").slice(middle, b - middle).to_pylist():
                    picks = np.frombuffer(data, np.int32)
                    sample, at = picks >> bits, picks & ((1 << bits) - 1)
                    total += np.bincount(sample, value[at], draws)
                    count += np.bincount(sample, known[at], draws).astype(np.int64)
            if len(done) >= 100:
                yield pack()
                done = []
        if held is not None:
            done.append((held[0], total, count))
        if done:
            yield pack()

    ship(df.sparkSession)
    blocks = _spread(slots, key, "_i").mapInArrow(deal, dealt)
    walked = blocks.repartition(key, "_block").sortWithinPartitions(key, "_block", "_kind").mapInArrow(add, summed)
    sums = _by_resample(walked, key, "_s", "_c").groupBy(key, "_b").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    means = sums.select(key, "_b", (F.col("_s") / F.when(F.col("_c") > 0, F.col("_c"))).alias("_m"))
    return sizes.join(_interval(means, key, low, high), key).select(key, "n", "mean", "lo", "hi")


def _interval(means: DataFrame, key: str, low: float, high: float) -> DataFrame:
    return means.groupBy(key).agg(
        F.percentile("_m", F.lit(low / 100)).alias("lo"), F.percentile("_m", F.lit(high / 100)).alias("hi")
    )


def bootstrap_ci_poisson(df: DataFrame, col: str, draws: int = 1000, low: float = 2.5, high: float = 97.5, seed: int = 0,
                         key="run_id", order=("episode",)) -> DataFrame:
    """The same interval with Poisson(1) weights: no join, one combined aggregate.

    Each row weighs itself for every resample, so a task adds up its rows in
    numpy and only ``draws`` partial sums per run and batch leave it. The
    resample size varies around n.
    """
    rows = df.select(key, draw_text(F.lit(seed), F.col(key), *[F.col(c) for c in order]).alias("_text"), F.col(col).cast("double").alias("_v"))
    total, p, least = 0.0, 0.36787944117144233, []
    for k in range(1, 13):
        total += p
        least.append(total)
        p /= k
    arrays = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_s", "_w")]
    schema = T.StructType([df.schema[key], T.StructField("_known", T.LongType()), *arrays])
    arrow = to_arrow_schema(schema)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, HELD // draws)):
                batch = whole.slice(at, max(1, HELD // draws))
                run = _codes(batch.column(key))
                along = np.argsort(run, kind="stable")
                run = run[along]
                begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                weight = np.searchsorted(least, hashed_draws(batch.column("_text").to_pylist(), draws), "right").astype(np.float64)[along]
                known = pc.is_valid(batch.column("_v")).to_numpy(zero_copy_only=False)[along]
                value = pc.fill_null(batch.column("_v"), 0.0).to_numpy(zero_copy_only=False)[along]
                sums = np.add.reduceat(weight * value[:, None], begin, axis=0), np.add.reduceat(weight, begin, axis=0)
                ends = np.arange(len(begin) + 1, dtype=np.int32) * draws
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel())) for x in sums]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(along[begin])), pa.array(np.add.reduceat(known.astype(np.int64), begin)), *lists], schema=arrow)

    ship(df.sparkSession)
    weighed = _spread(rows, key, "_text").mapInArrow(weigh, schema)
    # a run without a value has no sum
    some = F.when(F.col("_known") > 0, F.col("_s")).otherwise(F.transform("_s", lambda x: F.lit(None).cast("double")))
    sums = _by_resample(weighed.withColumn("_s", some), key, "_s", "_w").groupBy(key, "_b").agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_n"))
    means = sums.where("_n > 0").select(key, "_b", (F.col("_s") / F.col("_n")).alias("_m"))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(col).cast("double")).alias("mean"))
    return sizes.join(_interval(means, key, low, high), key).select(key, "n", "mean", "lo", "hi")


#: Rows of a run that one task draws from.
BLOCK = 4_096


def bootstrap_ci_split(df: DataFrame, col: str, draws: int = 1000, low: float = 2.5, high: float = 97.5, seed: int = 0,
                       key="run_id", order=("episode",), block: int = BLOCK) -> DataFrame:
    """The same interval with n draws exactly, and no row of another block in sight: (run_id, n, mean, lo, hi).

    A run's rows are dealt into 2^k blocks by hash. The n draws of each resample are split down the tree of blocks: a
    node gives its left half a binomial number of its draws, by the halves' row counts. A block draws its share from its
    own rows, in numpy, and returns one sum per resample. All numbers come from the seed, the run, the node and the
    order columns, so any partitioning gives the same interval.
    """
    base = df.select(F.col(key).alias("_run"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(col).cast("double").alias("_v"))
    at = [f"_o{i}" for i in range(len(order))]
    sizes = base.groupBy("_run").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    deep = F.greatest(F.ceil(F.log2(F.col("n") / block)), F.lit(0)).cast("int")
    dealt = base.join(sizes.select("_run", "n"), "_run").withColumn("_deep", deep)
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("_run", *at), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_deep")))).drop("n")
    leaves = dealt.groupBy("_run", "_deep", "_block").agg(F.count(F.lit(1)).alias("_n"))
    up = lambda levels: leaves.select("*", F.explode(levels).alias("_level")).withColumn("_node", F.call_function("shiftright", F.col("_block"), F.col("_deep") - F.col("_level")))
    nodes = up(F.sequence(F.lit(0), F.col("_deep"))).groupBy("_run", "_level", "_node").agg(F.sum("_n").alias("size"))
    left = nodes.where("_level > 0 AND _node % 2 = 0").select("_run", (F.col("_level") - 1).alias("_level"), F.call_function("shiftright", F.col("_node"), F.lit(1)).alias("_node"), F.col("size").alias("left"))
    halves = nodes.join(left, ["_run", "_level", "_node"], "left").na.fill(0, ["left"])
    steps = up(F.filter(F.sequence(F.lit(0), F.col("_deep")), lambda i: i < F.col("_deep"))).drop("_n").join(halves, ["_run", "_level", "_node"])
    path = steps.groupBy("_run", "_block").agg(F.array_sort(F.collect_list(F.struct("_level", "_node", "size", "left"))).alias("path"))
    path = leaves.select("_run", "_deep", "_block").join(path, ["_run", "_block"], "left").join(sizes.select("_run", "n"), "_run")
    path = path.select(F.col("_run").alias("run"), F.col("_block").alias("block"), F.col("_deep").alias("deep"), "path", "n")

    def draw(rows: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"_run": [], "_b": [], "_s": [], "_c": []})
        way = way.iloc[0]
        run, deep, number = way["run"], int(way["deep"]), int(way["block"])

        def numbers(*at: int) -> np.random.Generator:
            text = "|".join(map(str, (seed, run, *at)))
            return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.sha256(text.encode()).digest()[:16], "little")))

        share = np.full(draws, int(way["n"]), np.int64)
        for step in way["path"] if way["path"] is not None else []:
            node, size, first = int(step["_node"]), int(step["size"]), int(step["left"])
            to_left = numbers(int(step["_level"]), node).binomial(share, first / size)
            right = (number >> (deep - int(step["_level"]) - 1)) & 1
            share = share - to_left if right else to_left
        value = rows.sort_values(at, kind="stable")["_v"].to_numpy(np.float64)
        null = rows.sort_values(at, kind="stable")["_null"].to_numpy(bool)
        rng = numbers(-1, number)
        total, count = np.zeros(draws), np.zeros(draws, np.int64)
        many = max(1, 2_000_000 // max(len(value), 1))
        for b in range(0, draws, many):
            part = share[b : b + many]
            pick, which = rng.integers(0, len(value), int(part.sum())), np.repeat(np.arange(len(part)), part)
            real = ~null[pick]
            total[b : b + many] = np.bincount(which[real], value[pick[real]], len(part))
            count[b : b + many] = np.bincount(which[real], minlength=len(part))
        return pd.DataFrame({"_run": run, "_b": np.arange(draws), "_s": total, "_c": count})

    ship(df.sparkSession)
    kind = base.schema["_run"].dataType.simpleString()
    body = dealt.withColumn("_null", F.col("_v").isNull()).groupBy("_run", "_block")
    sums = body.cogroup(path.groupBy("run", "block")).applyInPandas(draw, f"_run {kind}, _b long, _s double, _c long")
    means = sums.groupBy("_run", "_b").agg((F.sum("_s") / F.when(F.sum("_c") > 0, F.sum("_c"))).alias("_m"))
    return sizes.join(_interval(means, "_run", low, high), "_run").select(F.col("_run").alias(key), "n", "mean", "lo", "hi")


def curriculum(episodes: DataFrame, stages: int = 5, window: int = 50, least: int = 30, promote: float = 0.7,
               order=("episode",)) -> DataFrame:
    """Adds ``stage`` (before the episode) and ``promoted``.

    A run is promoted at the first row whose last ``window`` episodes of the
    stage, ``least`` at the minimum, succeed at ``promote``. There are few
    stages, so each is one window pass over the rows after the last promotion;
    positions with successes are written once, and so are the promotions (one
    row per run), or every pass would repeat those before it.
    """
    tl = Timeline.of(episodes, "run_id", order)
    rows = numbered(episodes, "run_id", order, tl)
    flags = checkpointed(rows.select("run_id", *order, "_i", F.col("success").cast("double").alias("_s")))
    starts = flags.select("run_id").distinct().withColumn("_from", F.lit(0).cast("long"))
    gates = []
    for stage in range(1, stages):
        mine = flags.join(starts, "run_id").where(F.col("_i") >= F.col("_from"))

        def build(w):
            return {"_m": F.avg("_s").over(w.rowsBetween(1 - window, 0))}

        seen = tl.frame(mine, window - 1, build)
        ready = (F.col("_i") - F.col("_from") + 1 >= least) & (F.col("_m") >= promote)
        gate = checkpointed(seen.where(ready).groupBy("run_id").agg(F.min("_i").alias("_at")))
        gates.append(gate.select("run_id", F.col("_at").alias(f"_g{stage}")))
        starts = gate.select("run_id", (F.col("_at") + 1).alias("_from"))
    out = rows
    for gate in gates:
        out = out.join(gate, "run_id", "left")
    names = [c for c in out.columns if c.startswith("_g")]
    stage = F.lit(1)
    for g in names:
        stage = stage + F.when(F.col("_i") > F.col(g), 1).otherwise(0)
    promoted = F.lit(False)
    for g in names:
        promoted = promoted | F.coalesce(F.col("_i") == F.col(g), F.lit(False))
    return out.withColumn("stage", stage).withColumn("promoted", promoted).drop("_i", *names)


def metrics_table(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value")


def route_legs(visits: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Visits (route_id, visit) with the waypoint at ``visit mod n`` and the one after it."""
    sizes = waypoints.groupBy("route_id").agg(F.count(F.lit(1)).alias("_n"))
    here = waypoints.select("route_id", F.col("seq").alias("_a"), "name", "x", "y")
    then = waypoints.select("route_id", F.col("seq").alias("_b"), F.col("name").alias("next_name"), F.col("x").alias("next_x"), F.col("y").alias("next_y"))
    at = visits.join(sizes, "route_id").withColumn("_a", F.pmod("visit", "_n").cast("int")).withColumn("_b", F.pmod(F.col("visit") + 1, F.col("_n")).cast("int"))
    return at.join(here, ["route_id", "_a"]).join(then, ["route_id", "_b"]).drop("_a", "_b", "_n")
