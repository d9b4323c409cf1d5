"""Runs the state machines on streams: one state value per key."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

#: Pandas can't tell null from NaN in a number column, so a flag goes with each. No leading underscore: named tuples drop those names.
NAN = "nan_of_"


def _tuples(pdf: pd.DataFrame, names: Sequence[str]) -> list[tuple]:
    """Rows as tuples; null is None, and NaN stays NaN where its flag column says so."""
    cols = []
    for n in names:
        c = pdf[n]
        values = c.astype(object).where(c.notna(), None).tolist() if c.isna().any() else c.tolist()
        if NAN + n in pdf:
            values = [math.nan if f else v for v, f in zip(values, pdf[NAN + n])]
        cols.append(values)
    return list(zip(*cols))


def run_stream(df: DataFrame, key, ts: str, machine, watermark: str = "12 seconds", order: Sequence[str] = ("seq",),
               idle_s: float | None = None) -> DataFrame:
    """``plans.replay`` for a stream.

    Rows of one trigger are sorted per key; triggers must bring a key's rows in
    time order, as a log partitioned by key does. With ``idle_s`` the state of a
    silent key is dropped (``machine.expire`` may still emit rows), which bounds
    the state by the keys active within that time.
    """
    key = [key] if isinstance(key, str) else list(key)
    ties = [c for c in order if c not in machine.cols]
    src = df.withWatermark(ts, watermark).withColumn("t", F.unix_micros(ts))
    src = src.select(*dict.fromkeys([*key, ts, "t", *ties, *machine.cols]))
    floats = [c for c in machine.cols if isinstance(src.schema[c].dataType, T.FractionalType)]
    src = src.withColumns({NAN + c: F.coalesce(F.isnan(c), F.lit(False)) for c in floats if not isinstance(src.schema[c].dataType, T.DecimalType)})
    fed = ["t", *machine.cols]
    own = T._parse_datatype_string(machine.schema).fields
    out_schema = T.StructType([*[T.StructField(k, src.schema[k].dataType) for k in key], *own])
    names = [f.name for f in out_schema]
    whole = {f.name for f in own if isinstance(f.dataType, T.IntegralType)}

    def pack(k: tuple, rows: list) -> pd.DataFrame:
        out = pd.DataFrame([(*k, *r) for r in rows], columns=names)
        for c in whole:
            out[c] = out[c].astype("Int64")
        return out

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = getattr(machine, "expire", None)
            rows = last(json.loads(state.get[0])) if last else []
            state.remove()
            if rows:
                yield pack(k, rows)
            return
        held = json.loads(state.get[0]) if state.exists else machine.initial()
        parts = list(pdfs)
        pdf = (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(["t", *order], kind="stable")
        rows, held = machine.run(_tuples(pdf, fed), held)
        state.update((json.dumps(held),))
        if idle_s is not None:
            state.setTimeoutTimestamp(max(int(pdf["t"].iloc[-1] / 1000 + idle_s * 1000), state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pack(k, rows)

    timeout = GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.EventTimeTimeout
    ship(df.sparkSession)
    return src.groupBy(*key).applyInPandasWithState(step, out_schema, "state string", "append", timeout)
