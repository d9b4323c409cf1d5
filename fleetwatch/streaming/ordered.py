"""Streams whose rows come in any order: rows wait in state until the watermark has passed them, then count in time order.

What a batch plan gives over sorted rows comes out of a stream this way too, however triggers cut and shuffle the rows.
Rows that come after the watermark has passed their time are returned as ``late`` and change nothing. The state of a key
that stays silent is dropped.

These operators need Spark's RocksDB state store (``spark.sql.streaming.stateStore.providerClass``); ``local_session``
sets it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators import graph as G, integrity as S
from ..session import ship
from .stateful import NAN, _tuples

DAY_S = 86_400.0
#: Rows written as JSON keep microseconds.
AS_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _ready(spark: SparkSession) -> None:
    found = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    if not found.endswith("RocksDBStateStoreProvider"):
        raise RuntimeError("set spark.sql.streaming.stateStore.providerClass to the RocksDB provider")
    ship(spark)


def _plain(value):
    """A value that JSON can hold; NaN stays NaN."""
    if isinstance(value, np.ndarray):
        return [_plain(v) for v in value.tolist()]
    return value.item() if isinstance(value, np.generic) else value


def _no_nan(value):
    if isinstance(value, list):
        return [_no_nan(v) for v in value]
    return None if isinstance(value, float) and math.isnan(value) else value


class Reordered(StatefulProcessor):
    """Holds each key's rows until the watermark has passed them and feeds them in order of time and ``order``.

    Rows are tuples of ``names``, the time in microseconds first. A subclass says what it does with them: ``begin``
    opens its state, ``feed`` takes rows in order, ``expire`` gives what a silence of ``idle`` microseconds ends, and
    ``forget`` drops its state. Silence counts between rows, so it ends the same state wherever triggers fall.
    """

    def __init__(self, names: Sequence[str], n_order: int, idle: int | None, columns: Sequence[str], whole: Sequence[str]):
        self.names, self.n_order, self.idle, self.columns, self.whole = list(names), n_order, idle, list(columns), list(whole)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row string")
        self.clock = handle.getValueState("clock", "timer long, last long")
        self.begin(handle)

    def close(self) -> None:
        pass

    # -- what a subclass fills in

    def begin(self, handle) -> None: ...

    def feed(self, rows: list[tuple]) -> list[tuple]: ...

    def expire(self) -> list[tuple]:
        return []

    def forget(self) -> None: ...

    # -- the buffer

    def _pack(self, key: tuple, made: list[tuple], late: list[tuple]) -> pd.DataFrame:
        width = len(self.columns) - len(key) - 2
        rows = [(*key, *r, False, None) for r in made]
        rows += [(*key, *[None] * width, True, json.dumps(dict(zip(self.names, map(_no_nan, r))))) for r in late]
        out = pd.DataFrame(rows, columns=self.columns)
        for c in self.whole:
            out[c] = out[c].astype("Int64")
        return out

    def _arm(self, now_ms: int, at_us: int, last: int | None, held: tuple | None) -> None:
        at = max(-(-at_us // 1000), now_ms + 1)
        if held is None or held[0] != at:
            if held is not None and held[0] is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(at)
        self.clock.update((at, last))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        fresh, late = [], []
        for pdf in rows:
            for r in _tuples(pdf, self.names):
                r = tuple(map(_plain, r))
                (late if 0 < now * 1000 >= r[0] else fresh).append(r)
        if fresh:
            self.waiting.appendList([(json.dumps(r),) for r in fresh])
            held = self.clock.get()
            first = min(r[0] for r in fresh)
            self._arm(now, first if held is None or held[0] is None else min(first, held[0] * 1000), held[1] if held else None, held)
        if late:
            yield self._pack(key, [], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self.clock.get()
        last = held[1] if held else None
        waiting = [json.loads(r[0]) for r in self.waiting.get()]
        due = [tuple(r) for r in waiting if r[0] <= now * 1000]
        rest = [r for r in waiting if r[0] > now * 1000]
        low = lambda v: (v is not None, v)
        due.sort(key=lambda r: tuple(map(low, r[: self.n_order + 1])))
        made, run = [], []
        for r in due:
            if last is not None and self.idle is not None and r[0] - last >= self.idle:
                made += self.feed(run) if run else []
                made += self.expire()
                self.forget()
                run = []
            run.append(r)
            last = r[0]
        made += self.feed(run) if run else []
        if due:
            if rest:
                self.waiting.put([(json.dumps(r),) for r in rest])
            else:
                self.waiting.clear()
        gone = None if held is None else (None, last)  # the timer that fired is no more
        if rest:
            self._arm(now, min(r[0] for r in rest), last, gone)
        elif self.idle is not None and last is not None and last + self.idle <= now * 1000:
            made += self.expire()
            self.forget()
            self.clock.clear()
        elif self.idle is not None and last is not None:
            self._arm(now, last + self.idle, last, gone)
        else:
            self.clock.update((None, last))
        if made:
            yield self._pack(key, made, [])


class _Machine(Reordered):
    """Feeds a machine of ``operators.machines`` or ``streaming.machines``; its state is one JSON value."""

    def __init__(self, machine, *args):
        super().__init__(*args)
        self.machine = machine

    def begin(self, handle) -> None:
        self.held = handle.getValueState("held", "state string")

    def feed(self, rows):
        state = json.loads(self.held.get()[0]) if self.held.exists() else self.machine.initial()
        made, state = self.machine.run([(r[0], *r[1 + self.n_order :]) for r in rows], state)
        self.held.update((json.dumps(state),))
        return made

    def expire(self):
        last = getattr(self.machine, "expire", None)
        return list(last(json.loads(self.held.get()[0]))) if last and self.held.exists() else []

    def forget(self) -> None:
        self.held.clear()


def _flagged(src: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A flag beside each column of floating numbers: pandas can't tell null from NaN."""
    floats = [c for c in dict.fromkeys(cols) if isinstance(src.schema[c].dataType, T.FractionalType) and not isinstance(src.schema[c].dataType, T.DecimalType)]
    return src.withColumns({NAN + c: F.coalesce(F.isnan(c), F.lit(False)) for c in floats})


def _run(src: DataFrame, key: list[str], own: list[T.StructField], make, idle_s: float | None) -> DataFrame:
    """Applies the processor that ``make(idle, columns, whole numbers)`` gives to a source without event-time column."""
    _ready(src.sparkSession)
    fields = [*[T.StructField(k, src.schema[k].dataType) for k in key], *own, T.StructField("late", T.BooleanType()), T.StructField("late_row", T.StringType())]
    whole = [f.name for f in own if isinstance(f.dataType, T.IntegralType)]
    idle = None if idle_s is None else int(idle_s * 1e6)
    return src.groupBy(*key).transformWithStateInPandas(make(idle, [f.name for f in fields], whole), T.StructType(fields), "append", "EventTime")


def run_ordered(df: DataFrame, key, ts: str, machine, watermark: str = "12 seconds", order: Sequence[str] = ("seq",), idle_s: float | None = DAY_S) -> DataFrame:
    """A machine over a stream whose rows come in any order.

    Returns the key, the machine's columns, ``late`` and ``late_row``. A row counts once the watermark has passed it,
    after all rows of its key that are earlier in (``ts``, ``order``); rows after the watermark come out with ``late``
    true, the machine's columns null and what they held in ``late_row`` (JSON; NaN is null there). After ``idle_s``
    seconds without a row (``None``: never) the machine may emit what it holds and starts anew.
    """
    key = [key] if isinstance(key, str) else list(key)
    names = ["t", *order, *machine.cols]
    src = df.withWatermark(ts, watermark).withColumn("t", F.unix_micros(ts))
    src = _flagged(src.select(*dict.fromkeys([*key, *names])), names[1:])  # without ts itself Spark leaves late rows to us
    own = list(T._parse_datatype_string(machine.schema).fields)
    return _run(src, key, own, lambda idle, columns, whole: _Machine(machine, names, len(order), idle, columns, whole), idle_s)


def on_time(df: DataFrame) -> DataFrame:
    """The results without late rows and their columns."""
    return df.where(~F.col("late")).drop("late", "late_row")


class _Copies(Reordered):
    """First copies: a nonce is refused for ``ttl`` microseconds after the copy that was accepted."""

    def __init__(self, ttl: int, *args):
        super().__init__(*args)
        self.ttl = ttl

    def begin(self, handle) -> None:
        self.seen = handle.getMapState("seen", "nonce string", "t long")

    def feed(self, rows):
        made = []
        for r in rows:
            nonce = (r[-2],)
            first = self.seen.getValue(nonce)[0] if self.seen.containsKey(nonce) else None
            accepted = first is None or r[0] - first >= self.ttl
            if accepted:
                self.seen.updateValue(nonce, (r[0],))
            made.append((accepted, r[-1]))
        end = rows[-1][0]
        for (nonce,), (t,) in [x for x in self.seen.iterator() if end - x[1][0] >= self.ttl]:
            self.seen.removeKey((nonce,))
        return made

    def forget(self) -> None:
        self.seen.clear()


def verify_ordered(df: DataFrame, key: bytes, expected: Column, watermark: str = "12 seconds", keys: Sequence[str] = ("receiver", "channel"), ttl: float = S.REPLAY_TTL_S,
                   order: Sequence[str] = ("seq",), max_age: Column | float = S.MAX_AGE_S, skew: float = S.CLOCK_SKEW_S, parts: int = 32) -> DataFrame:
    """C3 to C6 on a stream: every message that passes the other checks, with payload and all its columns.

    Returns the columns of ``inspect`` with ``reject_reason`` null, ``replay``, or ``late`` for a message behind the
    watermark, which is judged no more. One cache per ``keys`` maps nonces to the time of the accepted copy; a copy is
    refused up to, not including, ``ttl`` seconds after it, as in the batch plan. Caches are split in ``parts`` by
    nonce, so that one receiver of most messages isn't one task's work. What fails another check is told by
    ``joins.refused`` and needs no state.
    """
    seen = S.inspect(df.withWatermark("recv_ts", watermark), key, expected, max_age, skew)
    body = F.to_json(F.struct(*seen.columns), AS_JSON)
    ok = seen.where(F.col("reject_reason").isNull())
    src = ok.select(*keys, F.pmod(F.xxhash64("nonce"), F.lit(parts)).alias("part_"), F.unix_micros("recv_ts").alias("t"), *order, F.col("nonce").alias("nonce_"), body.alias("row_"))
    names, own = ["t", *order, "nonce_", "row_"], [T.StructField("accepted", T.BooleanType()), T.StructField("row_", T.StringType())]
    out = _run(src, [*keys, "part_"], own, lambda idle, columns, whole: _Copies(int(ttl * 1e6), names, len(order), idle, columns, whole), ttl)
    whole = F.from_json(F.coalesce("row_", F.get_json_object("late_row", "$.row_")), seen.schema, AS_JSON)
    reason = F.when(F.col("late"), "late").when(~F.col("accepted"), "replay")
    return out.select(whole.alias("_m"), reason.alias("_r")).select(*[F.col("_r" if c == "reject_reason" else f"_m.{c}").alias(c) for c in seen.columns])


class _Episode(StatefulProcessor):
    """Sums of one episode, given out when the watermark passes its last row or a long silence."""

    def __init__(self, idle: int, last: Sequence[str], columns: Sequence[str]):
        self.idle, self.last, self.columns = idle, list(last), list(columns)

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "reward double, steps long, step long, held string, latest long, ends long, timer long, done boolean")

    def close(self) -> None:
        pass

    def _answer(self, key, s: list, late: list[tuple]) -> pd.DataFrame:
        rows = [(*key, s[0], s[1], *json.loads(s[3]), False, None)] if s else []
        rows += [(*key, None, None, *[None] * len(self.last), True, json.dumps(dict(zip(("t", "step", "reward"), map(_no_nan, r))))) for r in late]
        out = pd.DataFrame(rows, columns=self.columns)
        out["steps"] = out["steps"].astype("Int64")
        return out

    def _arm(self, s: list, now_ms: int) -> None:
        at = max(-(-(s[5] if s[5] is not None and not s[7] else s[4] + self.idle) // 1000), now_ms + 1)
        if s[6] != at:
            if s[6] is not None:
                self.handle.deleteTimer(s[6])
            self.handle.registerTimer(at)
            s[6] = at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        s = list(self.sums.get()) if self.sums.exists() else [None, 0, None, None, None, None, None, False]
        late, done = [], s[7] or (s[5] is not None and s[5] <= now * 1000)  # passed, even if its timer comes after these rows
        for pdf in rows:
            for t, step, reward, closing, *last in _tuples(pdf, ["t", "step", "reward", "closing_", *self.last]):
                if done or 0 < now * 1000 >= t:
                    late.append((t, step, reward))
                    continue
                if reward is not None:
                    s[0] = reward if s[0] is None else s[0] + reward
                s[1] += 1
                if s[3] is None or (step is not None and (s[2] is None or step > s[2])):
                    s[2], s[3] = step, json.dumps([_plain(v) for v in last])
                s[4] = t if s[4] is None else max(s[4], t)
                if closing:
                    s[5] = t if s[5] is None else max(s[5], t)
        if s[4] is not None and not done:
            self._arm(s, now)
            self.sums.update(tuple(s))
        if late:
            yield self._answer(key, [], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        s = list(self.sums.get())
        s[6] = None
        given = not s[7]
        if s[4] + self.idle <= now * 1000:
            self.sums.clear()
        else:  # closed by its last row; what still comes for it is late
            s[7] = True
            self._arm(s, now)
            self.sums.update(tuple(s))
        if given:
            yield self._answer(key, s, [])


def episode_rollup(steps: DataFrame, closing: Column, watermark: str = "10 minutes", idle_s: float = DAY_S, last: Sequence[str] = ("event",)) -> DataFrame:
    """F5 for steps (run_id, episode, step, step_ts, reward, ...): one row per episode, however long it lasts.

    An episode is given out once the watermark has passed a row for which ``closing`` holds, or ``idle_s`` seconds after
    its last row. Returns run_id, episode, reward, steps and the ``last`` columns of the highest step, ``late`` and
    ``late_row``: rows behind the watermark or of an episode already given out.
    """
    src = steps.withWatermark("step_ts", watermark).select("run_id", "episode", F.unix_micros("step_ts").alias("t"), "step", "reward", F.coalesce(closing, F.lit(False)).alias("closing_"), *last)
    src = _flagged(src, ["reward", *last])
    _ready(steps.sparkSession)
    kinds = [T.StructField(c, src.schema[c].dataType) for c in last]
    fields = [*[T.StructField(k, src.schema[k].dataType) for k in ("run_id", "episode")], T.StructField("reward", T.DoubleType()), T.StructField("steps", T.LongType()), *kinds,
              T.StructField("late", T.BooleanType()), T.StructField("late_row", T.StringType())]
    return src.groupBy("run_id", "episode").transformWithStateInPandas(_Episode(int(idle_s * 1e6), last, [f.name for f in fields]), T.StructType(fields), "append", "EventTime")


class _Totals(StatefulProcessor):
    """Running totals over windows, which come closed and in order."""

    def __init__(self, names: Sequence[str], idle_ms: int, columns: Sequence[str]):
        self.names, self.idle, self.columns = list(names), idle_ms, list(columns)

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "sums string, timer long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("window_start", kind="stable")
        held = self.totals.get() if self.totals.exists() else ("[]", None)
        before = np.array(json.loads(held[0]) or [0] * len(self.names), np.int64)
        sums = pdf[self.names].to_numpy(np.int64).cumsum(0) + before
        for i, n in enumerate(self.names):
            pdf[f"{n}_total"] = sums[:, i]
        at = max(int(pdf["end_"].iloc[-1]) // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle
        if held[1] is not None:
            self.handle.deleteTimer(held[1])
        self.handle.registerTimer(at)
        self.totals.update((json.dumps(sums[-1].tolist()), at))
        pdf["robot_id"] = key[0]
        yield pdf[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.clear()
        return iter(())


def detector_hits(at_ticks: DataFrame, detectors=("d1", "d2", "d3", "d4", "d5", "d6"), every: str = "5 seconds", watermark: str = "5 seconds", idle_s: float = 30 * DAY_S) -> DataFrame:
    """hits per interval and their running totals, two stateful steps in a row.

    Intervals are closed by the watermark and come in order, so totals follow in the same trigger. Totals of a robot
    are dropped ``idle_s`` seconds after its last interval.
    """
    _ready(at_ticks.sparkSession)
    sums = [F.count(F.when(F.col(d), 1)).alias(d) for d in detectors]
    per = at_ticks.withWatermark("tick_ts", watermark).groupBy("robot_id", F.window("tick_ts", every).alias("_w")).agg(*sums)
    per = per.select("robot_id", F.col("_w.start").alias("window_start"), F.unix_micros("_w.end").alias("end_"), *detectors)
    columns = ["robot_id", "window_start", *detectors, *[f"{d}_total" for d in detectors]]
    schema = T.StructType([per.schema["robot_id"], T.StructField("window_start", T.TimestampType()), *[T.StructField(c, T.LongType()) for c in columns[2:]]])
    return per.groupBy("robot_id").transformWithStateInPandas(_Totals(detectors, int(idle_s * 1000), columns), schema, "append", "EventTime")


class _FirstBadTopic(StatefulProcessor):
    """Per tick and watched topic the first names and how many there are; the tick is judged when the watermark passes it."""

    def __init__(self, shown: int, columns: Sequence[str]):
        self.shown, self.columns = shown, list(columns)

    def init(self, handle) -> None:
        self.handle = handle
        self.bags = handle.getMapState("bags", "rank int", "topic string, nodes string, total long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bags: dict[int, list] = {}
        for pdf in rows:
            for rank, topic, node in zip(pdf["rank_"].tolist(), pdf["topic"].tolist(), pdf["node_name"].tolist()):
                if rank not in bags:
                    held = self.bags.getValue((rank,)) if self.bags.containsKey((rank,)) else (topic, "[]", 0)
                    bags[rank] = [topic, json.loads(held[1]), held[2]]
                bag = bags[rank]
                bag[1] = sorted([*bag[1], node])[: self.shown]
                bag[2] += 1
        for rank, (topic, nodes, total) in bags.items():
            self.bags.updateValue((rank,), (topic, json.dumps(nodes), total))
        at = key[1] // 1000 + (key[1] % 1000 > 0)
        if at > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(at)
        else:  # behind the watermark: judged, and nothing kept
            self.bags.clear()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (_, (topic, nodes, total)) = min(self.bags.iterator(), key=lambda x: x[0][0])
        self.bags.clear()
        nodes = json.loads(nodes)
        yield pd.DataFrame([(key[0], key[1], topic, nodes, total - len(nodes))], columns=self.columns)


def unauthorised_publishers(publishers: DataFrame, allow: DataFrame, topics=G.WATCHED_TOPICS, watermark: str = "5 seconds", shown: int = 10) -> DataFrame:
    """D5 on streams: (robot_id, tick_ts, topic, nodes, more) of each tick's first watched topic with unlisted publishers.

    ``nodes`` are the first ``shown`` names in order, equal names listed as often as they publish; ``more`` counts the
    rest. A tick is judged once the watermark has passed it; what comes later for it is not counted.
    """
    _ready(publishers.sparkSession)
    bad = publishers.withWatermark("tick_ts", watermark).where((F.col("node_name") != G.UNKNOWN_PUBLISHER) & F.col("topic").isin(*topics)).join(allow.select("topic", "node_name"), ["topic", "node_name"], "left_anti")
    src = bad.select("robot_id", F.unix_micros("tick_ts").alias("us_"), "topic", "node_name", G._rank(topics).alias("rank_"))
    columns = ["robot_id", "us_", "topic", "nodes", "more"]
    schema = T.StructType([src.schema["robot_id"], T.StructField("us_", T.LongType()), T.StructField("topic", T.StringType()), T.StructField("nodes", T.ArrayType(T.StringType())), T.StructField("more", T.LongType())])
    out = src.groupBy("robot_id", "us_").transformWithStateInPandas(_FirstBadTopic(shown, columns), schema, "append", "EventTime")
    return out.select("robot_id", F.timestamp_micros("us_").alias("tick_ts"), "topic", "nodes", "more")
