"""Order-dependent state machines and greedy thinning, batch side.

A machine is a small object: ``initial()`` gives the state, ``run(rows, state)``
eats ordered row tuples and returns ``(output tuples, state)``. The same object
serves the stream (``streaming.stateful``). Spark partitions by key and sorts;
a task walks its sorted rows batch by batch and holds one state, not a key.

A key too large for one task is cut along its order. Where a machine forgets, say
after a silence longer than all its limits (``rests``), rows before which its
state is surely that of the start are known from one pass over the order; slices
are cut there and all run at once. Machines that never forget, and stretches of a
key without such a row, start every slice from a guessed entry state; exit states
are handed to the next slice and slices whose guess was wrong run again until
nothing changes. Either way the result is the sequential one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpointed, ship
from .timeline import Timeline, axis_of


def _struct(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def _plain(column: pa.Array) -> list:
    """The column's values as Python objects; numbers and lists of them in bulk."""
    kind = column.type
    if pa.types.is_list(kind):
        ends, inner = column.offsets.to_pylist(), _plain(column.values)
        real = pc.is_valid(column).to_pylist() if column.null_count else [True] * len(column)
        return [inner[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], real)]
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy().tolist()
    values = pc.fill_null(column, 0).to_numpy().tolist()
    return [v if ok else None for v, ok in zip(values, pc.is_valid(column).to_numpy(zero_copy_only=False).tolist())]


def _walk(df: DataFrame, group: Sequence[str], order: Sequence[str], machine, exits: bool = False) -> DataFrame:
    """Runs the machine over every group of ``df`` (columns: group, order, ``t``, cols, maybe ``_in``).

    Gives the machine's rows, or with ``exits`` one row per group with its entry
    and exit state.
    """
    group, seeded = list(group), "_in" in df.columns
    fed = ["t", *machine.cols]
    own = T._parse_datatype_string(machine.schema).fields
    if exits:
        own = [T.StructField("_in", T.StringType()), T.StructField("_out", T.StringType())]
    schema = T.StructType([*_struct(df, group), *own])
    arrow = to_arrow_schema(schema)
    first = json.dumps(machine.initial())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, entry = None, None, None

        def pack(rows: list) -> pa.RecordBatch:
            cols = zip(*rows) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            keys = list(zip(*[_plain(batch.column(g)) for g in group]))
            rows = list(zip(*[_plain(batch.column(c)) for c in fed]))
            starts = batch.column("_in").to_pylist() if seeded else None
            out, i, n = [], 0, len(rows)
            while i < n:
                j = i
                while j < n and keys[j] == keys[i]:
                    j += 1
                if keys[i] != key:
                    if exits and key is not None:
                        out.append((*key, entry, json.dumps(state)))
                    key, entry = keys[i], starts[i] if seeded else first
                    state = json.loads(entry) if seeded else machine.initial()
                made, state = machine.run(rows[i:j], state)
                if not exits:
                    out.extend((*key, *m) for m in made)
                i = j
            if out:
                yield pack(out)
        if exits and key is not None:
            yield pack([(*key, entry, json.dumps(state))])

    ship(df.sparkSession)
    sorted_rows = df.repartition(*group).sortWithinPartitions(*group, *order)
    wanted = [*dict.fromkeys([*group, *fed, *(["_in"] if seeded else [])])]
    return sorted_rows.select(*wanted).mapInArrow(walk, schema)


def replay(df: DataFrame, tl: Timeline, machine) -> DataFrame:
    """Runs ``machine`` over every key's rows in order.

    The machine sees ``t`` (the order axis as a long) and its ``cols``; its
    output columns are added to the key.
    """
    key, order = list(tl.key), list(tl.order)
    src = df.withColumn("t", axis_of(df, order[0]).cast("long"))
    src = src.select(*dict.fromkeys([*key, *order, "t", *machine.cols]))
    if tl.hot is None:
        return _walk(src, key, order, machine)

    fresh = getattr(machine, "rests", None)
    if fresh is not None:
        parts, group = cut_at_rests(src, tl, lambda rows: fresh(rows, tl))
        if parts is not None:
            return _walk(parts, group, order, machine).drop("_from")
    cut = tl.cut(src)
    cold = _walk(cut.where(~F.col("_hot")), key, order, machine)
    slot = [*key, "_slice"]
    rows = checkpointed(cut.where("_hot").drop("_hot"))
    hot = _walk(rows.join(entries(rows, tl, machine), slot), slot, order, machine).drop("_slice")
    return cold.unionByName(hot)


def entries(rows: DataFrame, tl: Timeline, machine) -> DataFrame:
    """The state with which each slice of cut keys begins: (key, _slice, _in), found by rounds until nothing changes."""
    key, slot = list(tl.key), [*tl.key, "_slice"]
    first = json.dumps(machine.initial())
    todo = rows.select(*slot).distinct().withColumn("_in", F.lit(first))
    known = None
    while True:
        ran = _walk(rows.join(todo, slot), slot, list(tl.order), machine, exits=True)
        known = checkpointed(ran if known is None else known.join(todo.select(*slot), slot, "left_anti").unionByName(ran))
        along = W.partitionBy(*key).orderBy("_slice")
        entry = known.withColumn("_want", F.coalesce(F.lag("_out").over(along), F.lit(first)))
        todo = checkpointed(entry.where(F.col("_want") != F.col("_in")).select(*slot, F.col("_want").alias("_in")))
        if todo.isEmpty():
            return known.select(*slot, "_in")


#: A stretch without a resting row may hold so many times the rows of a task before it is cut by rounds.
STRETCH = 4


def cut_at_rests(df: DataFrame, tl: Timeline, rests: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, list[str]]:
    """Rows of cut keys in groups (key, _from) that begin where ``rests`` finds ``_fresh`` rows; None if some stretch is too long.

    A group takes the slice of its first fresh row; slices without one belong to the group before.
    """
    marked = rests(df)
    body = tl.cut(marked).drop("_hot")
    at = F.when(F.col("_fresh"), F.col("_slice"))
    parts = tl.running(body, {"_from": ("last", at)}).withColumn("_from", F.coalesce("_from", F.lit(-1))).drop("_fresh", "_slice")
    group = [*tl.key, "_from"]
    longest = parts.groupBy(*group).count().agg(F.max("count")).first()[0]
    return (None if (longest or 0) > STRETCH * tl.limit else parts), group


def after_silence(df: DataFrame, tl: Timeline, micros: int, eligible: Column | None = None) -> DataFrame:
    """``_fresh``: no eligible row of the key within ``micros`` before."""
    t = axis_of(df, tl.order[0]).cast("long")
    ok = F.lit(True) if eligible is None else eligible
    seen = tl.running(df.withColumn("_when", t).withColumn("_counts", ok), {"_last": ("last", F.when(F.col("_counts"), F.col("_when")))}, before=True)
    return seen.withColumn("_fresh", F.col("_last").isNull() | (F.col("_when") - F.col("_last") >= micros)).drop("_when", "_last", "_counts")


class CooldownMachine:
    """Keeps a row iff it is far enough after the last kept one."""

    schema = "_kept_t long, _kept_tie long"
    cols = ("_ok",)

    def __init__(self, gap: int):
        self.gap = gap

    def initial(self):
        return None

    def run(self, rows, last):
        kept = []
        for t, ok in rows:
            if ok and (last is None or t - last >= self.gap):
                last = t
                kept.append((t, 0))
        return kept, last


def _marking(df: DataFrame, group: Sequence[str], order: Sequence[str], gap: int, mark: str | None, drop: Sequence[str]) -> DataFrame:
    """One sorted walk that marks the kept rows where they stand, or passes only those on, with all their columns.

    ``_t`` is the time, ``_ok`` who may be kept, ``_in`` (if there) the last kept time before the group, as JSON.
    """
    group, seeded = list(group), "_in" in df.columns
    given = [c for c in df.columns if c not in drop]
    schema = T.StructType([df.schema[c] for c in given] + ([T.StructField(mark, T.BooleanType())] if mark else []))
    arrow = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for g in group:
                codes = pc.dictionary_encode(batch.column(g), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = True
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], n)
            when = batch.column("_t")
            ok = np.asarray(pc.and_(pc.fill_null(batch.column("_ok"), False), pc.is_valid(when)).to_numpy(zero_copy_only=False), bool)
            t = pc.fill_null(when, 0).to_numpy(zero_copy_only=False)
            hit = np.zeros(n, bool)
            alone = (end - begin == 1) & (not seeded)
            alone[[0, -1]] = False
            hit[begin[alone]] = ok[begin[alone]]
            for s, e in zip(begin[~alone].tolist(), end[~alone].tolist()):
                here = tuple(batch.column(g)[s].as_py() for g in group)
                if here != key:
                    key, last = here, json.loads(batch.column("_in")[s].as_py()) if seeded else None
                at = s + np.flatnonzero(ok[s:e])
                times = t[at]
                i = 0 if last is None else int(np.searchsorted(times, last + gap))
                while i < len(times):
                    hit[at[i]] = True
                    last = int(times[i])
                    i += int(np.searchsorted(times[i:], last + gap))
            out = [batch.column(c) for c in given]
            made = pa.RecordBatch.from_arrays([*out, pa.array(hit)] if mark else out, schema=arrow)
            yield made if mark else made.filter(pa.array(hit))

    ship(df.sparkSession)
    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(walk, schema)


def thin(
    df: DataFrame,
    tl: Timeline,
    seconds: float,
    strict: bool = False,
    mark: str | None = None,
    eligible: Column | None = None,
) -> DataFrame:
    """Greedy cooldown: keep a row iff >= ``seconds`` after the last kept row.

    ``strict`` asks for more than ``seconds``. The timeline's order is
    ``(time, tie)`` with an integral tie that is unique per key and time. With
    ``mark`` all rows stay and that boolean column tells the kept ones; rows
    that are not ``eligible``, or without a time, are passed over by the rule.

    Rows are shuffled and sorted once and walked batch by batch with all their
    columns. Cut keys walk the same way in groups that begin after a silence of
    ``seconds``; keys that never pause so long get each slice's entry by rounds.
    """
    key, order = list(tl.key), list(tl.order)
    gap = int(seconds * 1e6) + (1 if strict else 0)
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    rows = df.withColumn("_t", axis_of(df, order[0]).cast("long")).withColumn("_ok", ok)
    helpers = ["_t", "_ok", "_from", "_slice", "_hot", "_in"]
    if tl.hot is None:
        return _marking(rows, key, order, gap, mark, helpers)
    parts, group = cut_at_rests(rows, tl, lambda r: after_silence(r, tl, gap, F.col("_ok")))
    if parts is not None:
        return _marking(parts, group, order, gap, mark, helpers)
    cut = checkpointed(tl.cut(rows))
    narrow = cut.where("_hot").select(*key, "_slice", *order, F.col("_t").alias("t"), "_ok")
    slot = [*key, "_slice"]
    begun = cut.where("_hot").join(entries(narrow, tl, CooldownMachine(gap)), slot)
    cold = _marking(cut.where("NOT _hot"), key, order, gap, mark, helpers)
    return cold.unionByName(_marking(begun.select(*cut.columns, "_in"), slot, order, gap, mark, helpers))
