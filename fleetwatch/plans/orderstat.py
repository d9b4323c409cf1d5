"""The first n rows of an order over a whole table, without one task that sees more than a few of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Buckets of one histogram, and rows of the last bucket from which it is simply sorted.
BUCKETS, SMALL = 4_096, 10_000


def first_rows(rows: DataFrame, n: int, keys: Sequence[Column], small: int = SMALL) -> DataFrame:
    """The ``n`` rows that come first by ``keys``: numbers, nulls first, the earlier key deciding; ties beyond are open.

    A histogram of the first key tells the bucket in which the n-th row lies; all before are in. That bucket is divided
    again until it holds at most ``small`` rows or one value, then the next key decides within it. Only the rows of the
    last bucket are sorted. Each round is one aggregate over the given rows; the driver sees at most ``BUCKETS`` counts.
    """
    if n <= 0:
        return rows.limit(0)
    names = [f"_key{i}" for i in range(len(keys))]
    ranked = rows.select("*", *[k.alias(c) for k, c in zip(keys, names)])
    surely, edge, need = F.lit(False), F.lit(True), n
    for c in names:
        while True:
            x = F.col(c).cast("double")
            found = ranked.where(edge).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("n"), F.count(c).alias("known")).first()
            if found["n"] <= need:
                return ranked.where(surely | edge).drop(*names)
            if found["n"] <= small:
                return ranked.where(surely).unionByName(ranked.where(edge).orderBy(*names).limit(need)).drop(*names)
            nulls = found["n"] - found["known"]
            if nulls >= need:
                edge = edge & F.col(c).isNull()
                break
            if nulls:
                surely, edge, need = surely | (edge & F.col(c).isNull()), edge & F.col(c).isNotNull(), need - nulls
            if found["lo"] == found["hi"]:
                break
            bucket = F.least(F.floor((x - found["lo"]) / (found["hi"] - found["lo"]) * BUCKETS), F.lit(BUCKETS - 1))
            for b in sorted(ranked.where(edge).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect(), key=lambda b: b["lo"]):
                if b["n"] >= need:
                    surely, edge = surely | (edge & (F.col(c) < b["lo"])), edge & F.col(c).between(b["lo"], b["hi"])
                    break
                need -= b["n"]
            if b["lo"] == b["hi"]:
                break
    return ranked.where(surely).unionByName(ranked.where(edge).orderBy(*names).limit(need)).drop(*names)
