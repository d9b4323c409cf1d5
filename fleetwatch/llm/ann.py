"""Approximate nearest neighbours: balanced parts of a neighbour graph, learned by a small classifier that routes queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetwatch.plans.orderstat import first_rows

from .common import saved

#: The index is fitted on at most so many vectors, drawn by a hash of their ids; every vector is indexed.
SAMPLE = 6_000
PARTS = 16
#: Neighbours of a sample vector in the graph, and hidden units of the classifier.
NEIGHBOURS, HIDDEN = 10, 128
#: Share of the sample's true neighbours that routing must find on held-out queries.
TARGET = 0.95
#: Vectors and queries that one task compares.
VECTOR_BLOCK, QUERY_BLOCK = 2_048, 512


@dataclass
class Router:
    """A two-layer classifier of vectors into parts, and how many parts a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        hidden = np.maximum(x @ self.w1 + self.b1, 0)
        return np.argsort(-(hidden @ self.w2 + self.b2), axis=1, kind="stable")


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        near = x[at : at + 512] @ x.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        out[at : at + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, x: np.ndarray, parts: int, rounds: int = 20, slack: float = 1.05) -> np.ndarray:
    """Parts of a neighbour graph with few cut edges, none above ``slack`` times the mean size.

    Starts from median splits along leading directions; then vertices move, in
    order of gain, to the part that holds most of their neighbours while there
    is room.
    """
    n = len(x)
    part = np.zeros(n, np.int64)
    cells = [np.arange(n)]
    while len(cells) < parts:
        cells.sort(key=len)
        cell = cells.pop()
        centred = x[cell] - x[cell].mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = np.argsort(centred @ axis, kind="stable")
        cells += [cell[order[: len(cell) // 2]], cell[order[len(cell) // 2 :]]]
    for i, cell in enumerate(cells):
        part[cell] = i
    room = int(np.ceil(slack * n / parts))
    back = np.repeat(np.arange(n), near.shape[1])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (back, part[near.ravel()]), 1)
        np.add.at(votes, (near.ravel(), part[back]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < room:
                size[part[v]] -= 1
                size[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if moved < n // 500:
            break
    return part


def fit(x: np.ndarray, parts: int = PARTS, target: float = TARGET, seed: int = 7) -> Router:
    """Graph, partition and classifier of sample vectors (rows of x)."""
    rng = np.random.default_rng(seed)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    n, d = x.shape
    parts = max(1, min(parts, n // (2 * NEIGHBOURS)))
    if parts == 1:
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32), 1)
    near = _neighbours(x, NEIGHBOURS)
    part = balanced_parts(near, x, parts)
    soft = np.zeros((n, parts), np.float32)
    np.add.at(soft, (np.repeat(np.arange(n), NEIGHBOURS), part[near.ravel()]), 1.0 / (2 * NEIGHBOURS))
    soft[np.arange(n), part] += 0.5
    held = rng.permutation(n)[: max(50, n // 10)]
    train = np.setdiff1d(np.arange(n), held)
    shape = [(d, HIDDEN), (HIDDEN,), (HIDDEN, parts), (parts,)]
    w = [rng.normal(0, np.sqrt(2 / s[0]), s).astype(np.float32) if len(s) == 2 else np.zeros(s, np.float32) for s in shape]
    m1, m2, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(30):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            a, t = x[batch], soft[batch]
            h = np.maximum(a @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - t) / len(batch)
            gh = (g @ w[2].T) * (h > 0)
            step += 1
            for i, grad in enumerate((a.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m1[i] = 0.9 * m1[i] + 0.1 * grad
                m2[i] = 0.999 * m2[i] + 0.001 * grad * grad
                w[i] = w[i] - 0.003 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(*w, visits=parts)
    # a neighbour is found if the part that the classifier puts it in is among those its query visits
    home = router.ranked(x)[:, 0]
    asked = router.ranked(x[held])
    place = np.argmax(asked[:, :, None] == home[near[held]][:, None, :], axis=1)
    found = [(place < v).mean() for v in range(1, parts + 1)]
    router.visits = next(v for v, share in enumerate(found, 1) if share >= target or v == parts)
    return router


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on: equal vectors get equal scores wherever they stand."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _best(frame_v: pd.DataFrame, frame_q: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of one block of vectors for each query of a block."""
    out = []
    if len(frame_v) and len(frame_q):
        v, q = (np.stack(f.to_numpy()).astype(np.float64) for f in (frame_v["vector"], frame_q["q_vector"]))
        ids, asked = frame_v["id"].to_numpy(), frame_q["q_id"].to_numpy()
        near = q @ v.T
        near[asked[:, None] == ids[None, :]] = -np.inf
        top = min(k, len(v))
        margin = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
        bar = np.partition(near, len(v) - top, axis=1)[:, len(v) - top] - margin
        for i in range(len(q)):
            some = np.flatnonzero((near[i] >= bar[i]) & (near[i] > -np.inf))
            exact = _scores(np.broadcast_to(q[i], (len(some), q.shape[1])), v[some])
            order = np.lexsort((ids[some], -exact))[:k]
            out.append((np.full(len(order), asked[i]), ids[some][order], exact[order]))
    cols = [np.concatenate([o[c] for o in out]) if out else [] for c in range(3)]
    return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, parts: int = PARTS, visits: int | None = None) -> DataFrame:
    """The k nearest vectors of each query by inner product, in double precision.

    ``vectors`` and ``queries`` have vec_id (long) and embedding. Every vector is put in
    the part that the classifier finds most probable; a query visits its most
    probable parts and is compared with all their vectors. Returns query_id,
    rank, vec_id and score. Parts are cut into blocks, so that neither a large
    part nor a vector that fills one makes a large task.

    Vectors that are null, zero, hold null or non-finite components or have
    another length than the sample's commonest take no part, nor do null ids;
    a query's own id is never its neighbour; rows of equal id and vector count
    once; ties go to the smaller id. Empty tables give an empty result; other
    columns are ignored. A query that finds fewer than k visits all parts.
    """
    vec = F.col("embedding").cast("array<double>").alias("vector")
    clean = saved(vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), vec).distinct(), "vectors")
    lengths = clean.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    d = lengths[0]["d"] if lengths else 0
    clean = clean.where(F.size("vector") == d)
    asked = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), vec).where(F.size("vector") == d).distinct()
    drawn = first_rows(clean.withColumn("h", F.xxhash64("id")), SAMPLE, [F.col("h"), F.col("id")]).collect()
    sample = [r.vector for r in sorted(drawn, key=lambda r: (r.h, r.id))]
    router = fit(np.array(sample), parts) if sample else Router(np.zeros((1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    n_parts = router.w2.shape[1]
    tried = min(visits or router.visits, n_parts)

    def routed(df: DataFrame, first: int, last: int) -> DataFrame:
        def run(frames):
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["vector"].to_numpy())
                    found = router.ranked((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
                    frame = frame.assign(parts=[row[first:last].tolist() for row in found])
                else:
                    frame = frame.assign(parts=[])
                yield frame[["id", "vector", "parts"]]

        return df.select("id", "vector").mapInPandas(run, "id long, vector array<double>, parts array<int>").select("id", "vector", F.explode("parts").alias("part"))

    placed = saved(routed(clean, 0, 1), "placed")
    n_vectors = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}

    def compared(asked: DataFrame) -> DataFrame:
        asked = saved(asked, "routed-queries")
        n_asked = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
        blocks = [(p, -(-n // VECTOR_BLOCK), -(-n_asked.get(p, 0) // QUERY_BLOCK)) for p, n in n_vectors.items()]
        sizes = placed.sparkSession.createDataFrame(blocks, "part int, v_blocks int, q_blocks int")
        spread = lambda df, own, other: (df.join(F.broadcast(sizes), "part").where("q_blocks > 0")
                                         .withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).cast("int"))
                                         .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))))
        left = spread(placed, "v", "q").select("part", "v", "q", "id", "vector")
        right = spread(asked, "q", "v").select(F.col("part").alias("q_part"), F.col("v").alias("q_v"), F.col("q").alias("q_q"), F.col("id").alias("q_id"), F.col("vector").alias("q_vector"))
        return left.groupBy("part", "v", "q").cogroup(right.groupBy("q_part", "q_v", "q_q")).applyInPandas(lambda a, b: _best(a, b, k), "query_id long, vec_id long, score double")

    found = saved(compared(routed(asked, 0, tried)), "nearest")
    if tried < n_parts:
        enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
        short = asked.join(enough, asked["id"] == enough["query_id"], "left_anti")
        found = found.unionByName(compared(routed(short, tried, n_parts)))
    # each block's ranks come first, so a query's window holds k rows a block
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
