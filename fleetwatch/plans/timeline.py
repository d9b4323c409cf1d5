"""Windows, running values and held values over ordered rows per key.

Telemetry is ordered per robot, so nearly every operator is a window over
``robot_id``. A plain window puts a whole key in one task; one chatty robot can
hold a third of all rows. A ``Timeline`` therefore measures the keys once
(one column-pruned aggregate) and, only for keys above ``rows_per_task``, cuts
the order in slices of about equal depth that become part of the partitioning.
Cells of equal width come first; a cell that still holds too many rows is cut at
quantiles of (time, tie) from a KLL sketch, so neither a burst nor one instant
stays whole:

* row frames get the last n rows of the preceding slices copied in front;
* running values are computed per slice and joined with the carry of the
  slices before, which is a table of one row per slice;
* results are identical to the plain window.

Where no key is that large the plan is the plain window and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

ROWS_PER_TASK = 500_000
OVERSPLIT = 4
MAX_BROADCAST_KEYS = 100_000
#: Quantiles taken of a crowded cell (at most so many pieces, less one), the sketch's accuracy, and cells whose cuts are broadcast.
PIECES, ACCURACY, MAX_BROADCAST_CELLS = 256, 2048, 5_000


def rows_per_task(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.fleetwatch.rowsPerTask", str(ROWS_PER_TASK)))


def ntz_micros(name: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone."""
    day = F.unix_date(F.col(name).cast("date")).cast("long") * 86_400_000_000
    second = (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")
    return day + F.hour(name).cast("long") * 3_600_000_000 + F.minute(name).cast("long") * 60_000_000 + second


def axis_of(df: DataFrame, name: str) -> Column:
    """The order column as a number that keeps differences (micros for time)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.TimestampNTZType):
        return ntz_micros(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(name)
    return F.col(name)


@dataclass(frozen=True)
class Timeline:
    """Keys, total order and the cut of keys too large for one task."""

    key: tuple[str, ...]
    order: tuple[str, ...]
    hot: DataFrame | None = None
    fine: DataFrame | None = None
    limit: int = ROWS_PER_TASK

    @staticmethod
    def of(df: DataFrame, key, order, limit: int | None = None) -> "Timeline":
        key = (key,) if isinstance(key, str) else tuple(key)
        order = (order,) if isinstance(order, str) else tuple(order)
        limit = limit or rows_per_task(df)
        # rows alone are counted first: where no key is large, what the order is made of needn't be computed
        if df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).isEmpty():
            return Timeline(key, order, limit=limit)
        x, tie = axis_of(df, order[0]), Timeline._tie(df, order)
        sizes = (
            df.dropna(subset=list(key))
            .groupBy(*key)
            .agg(F.count(F.lit(1)).alias("_n"), F.min(x).alias("_t0"), F.max(x).alias("_t1"), F.min(tie).alias("_a"), F.max(tie).alias("_b"))
            .where(F.col("_n") > limit)
            .select(
                *key,
                "_t0",
                ((F.col("_t1") - F.col("_t0") + 1) / F.ceil(F.col("_n") * OVERSPLIT / F.lit(limit))).alias("_w"),
                "_a",
                (F.col("_b").cast("double") - F.col("_a").cast("double") + 1).alias("_ties"),
            )
        )
        found = sizes.limit(MAX_BROADCAST_KEYS + 1).collect()
        if len(found) <= MAX_BROADCAST_KEYS:
            sizes = F.broadcast(df.sparkSession.createDataFrame(found, sizes.schema))
        tl = Timeline(key, order, sizes, limit=limit)
        return replace(tl, fine=tl._refined(df))

    @staticmethod
    def _tie(df: DataFrame, order: tuple[str, ...]) -> Column:
        """The second order column where it is a whole number, else null."""
        whole = len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.IntegralType)
        return F.col(order[1]).cast("long") if whole else F.lit(None).cast("long")

    def _celled(self, df: DataFrame) -> DataFrame:
        """Adds ``_hot``, ``_cell`` and ``_v``, the place within the cell: it never falls along (time, tie)."""
        kind = df.schema[self.order[0]].dataType
        x = axis_of(df, self.order[0])
        start = F.col("_t0") + F.col("_cell") * F.col("_w")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.IntegralType)):
            # whole steps from the cell's start and a fraction below one for the tie
            part = (F.col("_tiebreak").cast("double") - F.col("_a")) / F.col("_ties")
            place = (x.cast("long") - F.floor(start)).cast("double") + F.coalesce(F.greatest(F.lit(0.0), F.least(part, F.lit(1 - 2**-20))), F.lit(0.0))
        else:
            place = x.cast("double") - start
        return (
            df.withColumn("_tiebreak", self._tie(df, self.order))
            .join(self.hot, [c for c in self.hot.columns if c in self.key], "left")
            .withColumn("_hot", F.col("_t0").isNotNull())
            .withColumn("_cell", F.coalesce(F.floor((x.cast("double") - F.col("_t0")) / F.col("_w")), F.lit(0)))
            .withColumn("_v", place)
            .drop("_tiebreak", "_t0", "_w", "_a", "_ties")
        )

    def _refined(self, df: DataFrame) -> DataFrame | None:
        """Cuts of the cells that hold more than ``limit`` rows, or None."""
        keys = [c for c in self.hot.columns if c in self.key]
        narrow = df.select(*dict.fromkeys([*self.key, *self.order[:2]]))
        inside = self._celled(narrow).where("_hot")
        crowded = inside.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > self.limit)
        found = crowded.limit(MAX_BROADCAST_CELLS + 1).collect()
        if not found:
            return None
        if len(found) <= MAX_BROADCAST_CELLS:
            crowded = F.broadcast(df.sparkSession.createDataFrame(found, crowded.schema))
        ranks = F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)])
        pieces = F.least(F.ceil(F.col("_n") * OVERSPLIT / F.lit(self.limit)), F.lit(PIECES))
        cuts = inside.join(crowded, [*keys, "_cell"]).groupBy(*keys, "_cell", "_n").agg(F.kll_sketch_agg_double("_v", F.lit(ACCURACY)).alias("_s"))
        cuts = cuts.select(*keys, "_cell", "_n", F.kll_sketch_get_quantile_double("_s", ranks).alias("_q"))
        some = F.filter("_q", lambda q, i: F.floor((i + 1) * pieces / PIECES) > F.floor(i * pieces / PIECES))
        cuts = cuts.select(*keys, "_cell", F.array_distinct(some).alias("_cuts"))
        if len(found) <= MAX_BROADCAST_CELLS:
            return F.broadcast(df.sparkSession.createDataFrame(cuts.collect(), cuts.schema))
        return cuts

    def ordered_by(self, *order: str) -> "Timeline":
        """Same keys and cut, other order columns on the same axis."""
        return replace(self, order=tuple(order))

    def within(self, *more: str) -> "Timeline":
        """Finer keys: a part of a key needs no more cutting than the key."""
        return replace(self, key=(*self.key, *more))

    # -- cutting -----------------------------------------------------------

    @property
    def parts(self) -> tuple[str, ...]:
        return self.key if self.hot is None else (*self.key, "_slice")

    def cut(self, df: DataFrame) -> DataFrame:
        """Adds ``_slice`` and ``_hot`` when some key has to be cut."""
        if self.hot is None:
            return df
        body, piece = self._celled(df), F.lit(0)
        if self.fine is not None:
            body = body.join(self.fine, [c for c in self.fine.columns if c in (*self.key, "_cell")], "left")
            piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))), F.lit(0))
        return body.withColumn("_slice", F.col("_cell") * PIECES + piece).drop("_cell", "_v", "_cuts")

    def _sorted(self, ahead: bool = False) -> list[Column]:
        return [F.col(c).desc() if ahead else F.col(c).asc() for c in self.order]

    # -- row frames ----------------------------------------------------------

    def frame(self, df: DataFrame, n: int, build: Callable[[W], dict[str, Column]], ahead: bool = False) -> DataFrame:
        """Columns that look at no more than ``n`` rows before (or ahead of) each row.

        ``build`` receives the ordered window; with ``ahead`` the order is
        reversed, so ``lag`` looks forward.
        """
        out = list(df.columns)
        if self.hot is None:
            w = W.partitionBy(*self.key).orderBy(*self._sorted(ahead))
            return df.select(*out, *[c.alias(k) for k, c in build(w).items()])
        body = self.cut(df)
        rows = body.withColumn("_warm", F.lit(False)).unionByName(self._copies(body, n, ahead))
        w = W.partitionBy(*self.parts).orderBy(*self._sorted(ahead))
        return (
            rows.select(*out, "_warm", *[c.alias(k) for k, c in build(w).items()])
            .where(~F.col("_warm"))
            .drop("_warm")
        )

    def _copies(self, body: DataFrame, n: int, ahead: bool) -> DataFrame:
        """The last n rows of each slice, addressed to the slices they reach into."""
        key = list(self.key)
        back = W.partitionBy(*key, "_slice").orderBy(*self._sorted(not ahead))
        tail = body.where("_hot").withColumn("_d", F.row_number().over(back)).where(F.col("_d") <= n)
        counts = tail.groupBy(*key, "_slice").agg(F.count(F.lit(1)).alias("_c"))
        step = F.col("_slice").desc() if ahead else F.col("_slice").asc()
        later = W.partitionBy(*key).orderBy(step).rowsBetween(1, n)
        hops = counts.select(
            *key, "_slice", F.collect_list(F.struct(F.col("_slice").alias("to"), "_c")).over(later).alias("_next")
        )

        def reach(e: Column, i: Column) -> Column:
            between = F.aggregate(F.slice("_next", 1, i), F.lit(0).cast("long"), lambda a, b: a + b["_c"])
            return F.struct(e["to"].alias("to"), (F.col("_d") + between).alias("need"))

        return (
            tail.join(hops, [*key, "_slice"])
            .withColumn("_go", F.explode(F.filter(F.transform("_next", reach), lambda g: g["need"] <= n)))
            .withColumn("_slice", F.col("_go.to"))
            .withColumn("_warm", F.lit(True))
            .drop("_d", "_next", "_go")
        )

    # -- running values ------------------------------------------------------

    def running(self, df: DataFrame, aggs: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
        """Running ``sum/count/max/min/last/first`` up to each row.

        ``last`` and ``first`` skip nulls. With ``before`` the row itself is
        left out.
        """
        out = list(df.columns)
        end = -1 if before else 0

        def local(kind: str, c: Column, w) -> Column:
            if kind in ("last", "first"):
                return getattr(F, kind)(c, ignorenulls=True).over(w)
            return getattr(F, kind)(c).over(w)

        if self.hot is None:
            w = W.partitionBy(*self.key).orderBy(*self._sorted()).rowsBetween(W.unboundedPreceding, end)
            return df.select(*out, *[local(k, c, w).alias(n) for n, (k, c) in aggs.items()])

        body = self.cut(df)
        key = list(self.key)
        w = W.partitionBy(*self.parts).orderBy(*self._sorted()).rowsBetween(W.unboundedPreceding, end)
        here = body.select(*out, "_slice", *[local(k, c, w).alias(n) for n, (k, c) in aggs.items()])

        at = F.struct(*self.order)
        whole = {
            "sum": lambda c: F.sum(c),
            "count": lambda c: F.count(c),
            "max": lambda c: F.max(c),
            "min": lambda c: F.min(c),
            "last": lambda c: F.max_by(c, F.when(c.isNotNull(), at)),
            "first": lambda c: F.min_by(c, F.when(c.isNotNull(), at)),
        }
        merge = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}
        totals = (
            body.where("_hot").groupBy(*key, "_slice").agg(*[whole[k](c).alias(f"_s_{n}") for n, (k, c) in aggs.items()])
        )
        wp = W.partitionBy(*key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        carry = totals.select(
            *key,
            "_slice",
            *[
                (
                    getattr(F, k)(f"_s_{n}", ignorenulls=True) if k in ("last", "first") else merge[k](f"_s_{n}")
                )
                .over(wp)
                .alias(f"_c_{n}")
                for n, (k, _) in aggs.items()
            ],
        )
        both = {
            "sum": lambda a, b: F.coalesce(a + b, a, b),
            "count": lambda a, b: a + F.coalesce(b, F.lit(0)),
            "max": lambda a, b: F.greatest(a, b),
            "min": lambda a, b: F.least(a, b),
            "last": lambda a, b: F.coalesce(a, b),
            "first": lambda a, b: F.coalesce(b, a),
        }
        return here.join(carry, [*key, "_slice"], "left").select(
            *out, *[both[k](F.col(n), F.col(f"_c_{n}")).alias(n) for n, (k, _) in aggs.items()]
        )

    def previous(self, df: DataFrame, cols: dict[str, str]) -> DataFrame:
        """``{new: source}`` values of the row just before."""
        return self.frame(df, 1, lambda w: {new: F.lag(src).over(w) for new, src in cols.items()})

    def following(self, df: DataFrame, cols: dict[str, str]) -> DataFrame:
        """``{new: source}`` values of the row just after."""
        return self.frame(df, 1, lambda w: {new: F.lag(src).over(w) for new, src in cols.items()}, ahead=True)
