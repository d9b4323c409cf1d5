"""Reproducible randomness: every number is hashed from a seed and the row's own ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.crypto import unit_hash
from ..plans.orderstat import first_rows
from ..plans.timeline import axis_of

# Ranges and chances of the episode perturbations.
RANGES = {"noise": (0.0, 0.02), "dropout": (0.0, 0.05), "max_lin": (0.18, 0.22), "max_ang": (1.2, 1.8)}
NEUTRAL = {"noise": 0.0, "dropout": 0.0, "max_lin": 0.22, "max_ang": 1.5}
ATTACK_P, BIAS_RANGE = 0.05, (0.03, 0.08)
START_LIMIT, START_FALLBACK = 1.8, (0.5, 0.5)


def between(u: Column, low: float, high: float) -> Column:
    return low + (high - low) * u


def episode_params(seeds: DataFrame, evaluate: bool = False, seed: str = "seed") -> DataFrame:
    def u(name: str) -> Column:
        return unit_hash(F.col(seed), F.lit(name))

    if evaluate:
        values = {**{k: F.lit(v) for k, v in NEUTRAL.items()}, "bias": F.lit(0.0), "burst": F.lit(False), "jam": F.lit(False)}
    else:
        values = {k: between(u(k), *r) for k, r in RANGES.items()}
        values["bias"] = F.when(u("bias?") < ATTACK_P, between(u("bias"), *BIAS_RANGE)).otherwise(F.lit(0.0))
        values["burst"] = u("burst?") < ATTACK_P
        values["jam"] = u("jam?") < ATTACK_P
    return seeds.select("*", *[c.alias(k) for k, c in values.items()])


def perturb_scans(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Noise, dropout to 1, bias and a burst every tenth step on scaled beams.

    Rows carry the parameters of ``episode_params`` and (seed, step).
    """

    def u(name: str, i: Column) -> Column:
        return unit_hash(F.col("seed"), F.col("step"), F.lit(name), i)

    def beam(x: Column, i: Column) -> Column:
        normal = F.sqrt(-2.0 * F.log(1.0 - u("n1", i))) * F.cos(2 * math.pi * u("n2", i))
        y = x + F.col("noise") * normal
        y = F.when(u("drop", i) < F.col("dropout"), F.lit(1.0)).otherwise(y)
        y = y + F.col("bias")
        y = y + F.when(F.col("burst") & (F.col("step") % 10 == 0), between(u("burst", i), -0.1, 0.1)).otherwise(F.lit(0.0))
        return F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))

    return df.withColumn(frame, F.transform(frame, beam))


def safe_positions(points: DataFrame, obstacles: DataFrame, clearance: float = 0.5, limit: float = START_LIMIT) -> DataFrame:
    """Points inside the limit and clear of every obstacle.

    Obstacles fall into square cells as wide as the clearance; a point looks at
    its cell and the eight around it, so this is an equi-join of any size.
    """
    inside = points.where((F.abs("x") <= limit) & (F.abs("y") <= limit)).withColumn("_id", F.struct("x", "y"))

    def cell(c: Column) -> Column:
        return F.floor(c / clearance)

    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    cells = (
        obstacles.select("ox", "oy", cell(F.col("ox")).alias("_cx"), cell(F.col("oy")).alias("_cy"))
        .withColumn("_dx", F.explode(around))
        .withColumn("_dy", F.explode(around))
        .select("ox", "oy", (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy"))
    )
    placed = inside.withColumn("_cx", cell(F.col("x"))).withColumn("_cy", cell(F.col("y")))
    close = (placed["_cx"] == cells["_cx"]) & (placed["_cy"] == cells["_cy"]) & (
        F.hypot(placed["x"] - cells["ox"], placed["y"] - cells["oy"]) < clearance
    )
    return placed.join(cells, close, "left_anti").drop("_cx", "_cy", "_id")


def sample_starts(seeds: DataFrame, obstacles: DataFrame, tries: int = 2000, clearance: float = 0.5, batch: int = 8,
                  seed: str = "seed") -> DataFrame:
    """(seed, x, y, yaw): the first hashed candidate clear of obstacles, else the fallback.

    Almost every seed succeeds within a few tries, so candidates are judged in
    growing batches and only seeds still open go on.
    """
    from ..session import checkpointed

    def u(name: str, n: Column | None = None) -> Column:
        parts = [F.col(seed), F.lit(name)] + ([n] if n is not None else [])
        return unit_hash(*parts)

    wanted = seeds.select(seed).distinct()
    open_seeds, found, begin = wanted, None, 0
    while begin < tries:
        end = min(tries, begin + batch)
        cand = open_seeds.withColumn("_try", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))))
        cand = cand.withColumn("x", between(u("x", F.col("_try")), -START_LIMIT, START_LIMIT)).withColumn(
            "y", between(u("y", F.col("_try")), -START_LIMIT, START_LIMIT)
        )
        first = safe_positions(cand, obstacles, clearance).groupBy(seed).agg(F.min_by(F.struct("x", "y"), "_try").alias("_p"))
        first = checkpointed(first)
        found = first if found is None else found.unionByName(first)
        open_seeds = checkpointed(open_seeds.join(first.select(seed), seed, "left_anti"))
        if open_seeds.isEmpty():
            break
        begin, batch = end, batch * 4
    yaw = between(u("yaw"), -math.pi, math.pi)
    return wanted.join(found, seed, "left").select(
        seed,
        F.coalesce("_p.x", F.lit(START_FALLBACK[0])).alias("x"),
        F.coalesce("_p.y", F.lit(START_FALLBACK[1])).alias("y"),
        yaw.alias("yaw"),
    )


def sample_routes(seeds: DataFrame, waypoints: DataFrame, seed: str = "seed", max_wp: str = "max_wp") -> DataFrame:
    """(seed, seq, name, x, y): the route's points in hashed order, 1..max_wp of them.

    Seeds carry ``route_id``; routes are short, so each seed sorts its own few.
    """
    points = waypoints.groupBy("route_id").agg(F.collect_list(F.struct("seq", "name", "x", "y")).alias("_wps"))
    count = (F.floor(unit_hash(F.col(seed), F.lit("count")) * F.col(max_wp)) + 1).cast("int")
    keyed = F.transform("_wps", lambda w: F.struct(unit_hash(F.col(seed), F.lit("wp"), w["seq"]).alias("_u"), w.alias("w")))
    picked = F.slice(F.array_sort(keyed), F.lit(1), count)
    out = seeds.join(points, "route_id").select(seed, F.posexplode(picked).alias("_p", "_k"))
    return out.select(seed, (F.col("_p") + 1).alias("seq"), "_k.w.name", "_k.w.x", "_k.w.y")


def minibatch(rows: DataFrame, n: int, seed: int, ids: list[str]) -> DataFrame:
    """n rows uniformly without replacement: those whose hash comes first, found from a histogram of the hashes."""
    return first_rows(rows, n, [unit_hash(F.lit(seed), *[F.col(c) for c in ids]), *[F.col(c) for c in ids]])


def keep_latest(rows: DataFrame, capacity: int, key: str | None = None, order=("recv_ts",)) -> DataFrame:
    """First-in first-out retention, per key or over the whole table.

    Per key, every task keeps ``capacity`` rows before the shuffle. Over the
    whole table histograms find where the capacity is reached; only the rows
    of the last bucket are sorted. Order columns are times or numbers.
    """
    if key is not None:
        w = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
        return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= capacity).drop("_r")
    return first_rows(rows, capacity, [-axis_of(rows, c) for c in order])
