"""Near-duplicate vectors: a hierarchical navigable small-world graph per shard, every shard queried by all vectors that a bound can't rule out, beams widened until audits pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fleetwatch.session import ship

from .ann import usable
from .common import saved
from .components import components

COSINE = 0.93
#: Vectors of one shard, and bytes of their components in double precision; whichever is less.
SHARD, SHARD_BYTES = 8_192, 8 << 20
#: Links of a vector in an upper layer (twice as many in the lowest), beam while building, first beam of a search.
LINKS, BUILD_BEAM, BEAM = 16, 96, 64
#: Vectors of a shard that an audit compares with all of it, and the share of their links and nearest vectors to be found.
AUDITED, RECALL = 128, 0.99
#: Queries that walk a graph together, and rows of one product.
TOGETHER = 256
#: Shards on each side of the pairs that one task compares.
SIDE = 4


@dataclass
class Graph:
    """Unit vectors, those of upper layers first: layer l holds the first ``sizes[l]``; ``near[l]`` lists their links, -1 where none."""

    x: np.ndarray
    sizes: list[int]
    near: list[np.ndarray]


def _layer(x: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first walk of one layer by many queries at once: (nodes, similarities) of each query's beam, -1 where it isn't full."""
    many, n = len(q), len(near)
    beam = min(beam, n)
    at_once = max(1, beam // 16)
    seen = np.zeros((many, n), bool)
    nodes, value, open_ = np.full((many, beam), -1, np.int32), np.full((many, beam), -np.inf, np.float32), np.zeros((many, beam), bool)

    def offer(row: np.ndarray, node: np.ndarray) -> None:
        """Unseen nodes compete for their queries' beams. row: sorted."""
        if not len(row):
            return
        new = np.einsum("ij,ij->i", q[row], x[node])
        good = new > value[row].min(1)
        row, node, new = row[good], node[good], new[good]
        if not len(row):
            return
        some, first, count = np.unique(row, return_index=True, return_counts=True)
        slot = beam + np.arange(len(row)) - np.repeat(first, count)
        wide = beam + int(count.max())
        k = np.repeat(np.arange(len(some)), count)
        all_nodes, all_value, all_open = np.full((len(some), wide), -1, np.int32), np.full((len(some), wide), -np.inf, np.float32), np.zeros((len(some), wide), bool)
        all_nodes[:, :beam], all_value[:, :beam], all_open[:, :beam] = nodes[some], value[some], open_[some]
        all_nodes[k, slot], all_value[k, slot], all_open[k, slot] = node, new, True
        top = np.argpartition(-all_value, beam - 1, axis=1)[:, :beam]
        nodes[some], value[some], open_[some] = (np.take_along_axis(a, top, 1) for a in (all_nodes, all_value, all_open))

    def unseen(row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.unique(row[node >= 0].astype(np.int64) * n + node[node >= 0])
        key = key[~seen.ravel()[key]]
        seen.ravel()[key] = True
        return key // n, key % n

    live = np.arange(many)
    offer(*unseen(np.repeat(live, start.shape[1]), start.ravel()))
    while len(live):
        rank = np.where(open_[live], value[live], -np.inf)
        pick = np.argpartition(-rank, at_once - 1, axis=1)[:, :at_once]
        chosen = np.take_along_axis(rank, pick, 1) > -np.inf
        more = chosen.any(1)
        live, pick, chosen = live[more], pick[more], chosen[more]
        if not len(live):
            break
        row, col = np.repeat(live, at_once)[chosen.ravel()], pick.ravel()[chosen.ravel()]
        open_[row, col] = False
        nb = near[nodes[row, col]]
        offer(*unseen(np.repeat(row, nb.shape[1]), nb.ravel()))
    return nodes, value


def walk(g: Graph, q: np.ndarray, beam: int, own: np.ndarray | None = None, layer: int = 0, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Down the layers to ``layer``, where the walk has the full beam; ``own``: the queries' own nodes, from which it starts too."""
    start = np.zeros((len(q), 1), np.int32)
    for level in range(len(g.sizes) - 1, layer, -1):
        nodes, value = _layer(g.x, g.near[level], q, start, 4)
        start = np.take_along_axis(nodes, value.argmax(1)[:, None], 1)
    if own is not None:
        start = np.concatenate((start, own[:, None].astype(np.int32)), 1)
    return _layer(g.x, g.near[layer], q, start, beam)


def _diverse(x: np.ndarray, nodes: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates up to ``most``: nearest first those nearer to the row's vector than to any taken; the nearest others fill up."""
    order = np.argsort(-value, axis=1, kind="stable")
    nodes, value = np.take_along_axis(nodes, order, 1), np.take_along_axis(value, order, 1)
    some, wide = nodes.shape
    out = np.full((some, most), -1, np.int32)
    for at in range(0, some, 256):
        c, v = nodes[at : at + 256], value[at : at + 256]
        xc = x[np.maximum(c, 0)]
        between = xc @ xc.transpose(0, 2, 1)
        taken = np.zeros(c.shape, bool)
        for k in range(wide):
            hides = (taken[:, :k] & (between[:, k, :k] >= v[:, k : k + 1])).any(1)
            taken[:, k] = (c[:, k] >= 0) & ~hides & (taken[:, :k].sum(1) < most)
        rank = np.where(c < 0, 2 * wide, np.where(taken, 0, wide) + np.arange(wide))
        best = np.argsort(rank, axis=1, kind="stable")[:, :most]
        own = np.take_along_axis(c, best, 1)
        out[at : at + 256, : own.shape[1]] = own
    return out


def _exact_nearest(x: np.ndarray, above: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's BUILD_BEAM nearest others and its LINKS nearest among the first ``above`` rows: (nodes, similarities), -1 where a node is listed before."""
    n = len(x)
    few, high = min(BUILD_BEAM, n - 1), min(LINKS, above)
    nodes, value = np.empty((n, few + high), np.int32), np.empty((n, few + high), np.float32)
    for at in range(0, n, TOGETHER):
        s = x[at : at + TOGETHER] @ x.T
        rows = np.arange(len(s))
        s[rows, at + rows] = -np.inf
        pick = np.argpartition(s, n - few, axis=1)[:, n - few :]
        if high:
            top = np.argpartition(s[:, :above], above - high, axis=1)[:, above - high :]
            pick = np.concatenate((pick, top), 1)
        nodes[at : at + len(s)], value[at : at + len(s)] = pick, np.take_along_axis(s, pick, 1)
    order = np.argsort(nodes, axis=1, kind="stable")
    nodes, value = np.take_along_axis(nodes, order, 1), np.take_along_axis(value, order, 1)
    again = np.zeros(nodes.shape, bool)
    again[:, 1:] = nodes[:, 1:] == nodes[:, :-1]
    again |= value == -np.inf
    nodes[again], value[again] = -1, -np.inf
    return nodes, value


def _linked_layer(x: np.ndarray, above: int, width: int) -> np.ndarray:
    """Links of one layer: each node's diverse candidates and the links back to it; of more than ``width`` the most diverse."""
    n = len(x)
    near = np.full((n, width), -1, np.int32)
    if n < 2:
        return near
    chosen = _diverse(x, *_exact_nearest(x, above), LINKS)
    a, b = np.repeat(np.arange(n), LINKS), chosen.ravel().astype(np.int64)
    a, b = a[b >= 0], b[b >= 0]
    edge = np.unique(np.concatenate((a * n + b, b * n + a)))
    a, b = edge // n, edge % n
    value = np.einsum("ij,ij->i", x[a], x[b])
    order = np.lexsort((-value, a))
    a, b, value = a[order], b[order], value[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    a, b, value, place = (v[place < BUILD_BEAM] for v in (a, b, value, place))
    listed, sims = np.full((n, int(place.max()) + 1), -1, np.int32), np.full((n, int(place.max()) + 1), -np.inf, np.float32)
    listed[a, place], sims[a, place] = b, value
    least = min(width, listed.shape[1])
    near[:, :least] = listed[:, :least]
    over = np.flatnonzero((listed >= 0).sum(1) > width)
    if len(over):
        near[over] = _diverse(x, listed[over], sims[over], width)
    return near


def build(x: np.ndarray, seed: int = 11) -> tuple[Graph, np.ndarray]:
    """The graph of unit vectors and the order it has them in; candidates for links are the nearest by exact products within a layer."""
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 6)
    order = np.argsort(-level, kind="stable")
    x, level = np.ascontiguousarray(x[order], dtype=np.float32), level[order]
    sizes = [n, *(int((level >= k).sum()) for k in range(1, int(level.max(initial=0)) + 1))]
    near = [_linked_layer(x[:m], above, 2 * LINKS if not k else LINKS) for k, (m, above) in enumerate(zip(sizes, [*sizes[1:], 0]))]
    return Graph(x, sizes, near), order


@lru_cache(maxsize=4)
def _basis(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0].astype(np.float32)


def heads(x: np.ndarray) -> np.ndarray:
    """Half of the components in a fixed turned basis and the length of the rest: no product of two vectors exceeds that of their heads."""
    turned = x @ _basis(x.shape[1])
    some = (x.shape[1] + 1) // 2
    return np.ascontiguousarray(np.concatenate((turned[:, :some], np.linalg.norm(turned[:, some:], axis=1, keepdims=True)), 1))


def open_pairs(a: np.ndarray, b: np.ndarray, cosine: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of the other heads each row may link with: a row with 0 surely has no link. own: a row doesn't count itself."""
    of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    for at in range(0, len(a), 64):
        s = a[at : at + 64] @ b.T
        if own:
            s[np.arange(len(s)), at + np.arange(len(s))] = -1
        some = np.flatnonzero(s.max(1) >= cosine - 1e-4)
        if len(some):
            may = s[some] >= cosine - 1e-4
            of_a[at + some] = np.count_nonzero(may, axis=1)
            of_b += np.count_nonzero(may, axis=0)
    return of_a, of_b


def _linked(g: Graph, exact: np.ndarray, q: np.ndarray, own: np.ndarray | None, cosine: float, beam: int) -> np.ndarray:
    """Which nodes each query links with, as a matrix; a beam full of links is widened, at last to the whole shard. q: double precision."""
    out = np.zeros((len(q), len(exact)), bool)
    near_enough = cosine - 1e-4  # single precision finds candidates, double precision decides
    todo = np.arange(len(q))
    while len(todo):
        full = []
        for at in range(0, len(todo), TOGETHER):
            rows = todo[at : at + TOGETHER]
            if 4 * beam >= len(exact):
                out[rows] = q[rows] @ exact.T >= cosine
                continue
            nodes, value = walk(g, q[rows].astype(np.float32), beam, None if own is None else own[rows])
            i, j = np.nonzero(value >= near_enough)
            sure = np.einsum("ij,ij->i", q[rows[i]], exact[nodes[i, j]]) >= cosine
            out[rows[i[sure]], nodes[i, j][sure]] = True
            full.append(rows[value.min(1) >= near_enough])
        todo, beam = np.concatenate(full) if full else todo[:0], 4 * beam
    return out


def audited_beam(g: Graph, exact: np.ndarray, q: np.ndarray, own: np.ndarray | None, cosine: float, recall: float) -> int:
    """The least beam, from BEAM doubled, that finds ``recall`` of the links and nearest vectors of evenly drawn queries."""
    drawn = np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(int))
    near = q[drawn] @ exact.T
    if own is not None:
        near[np.arange(len(drawn)), own[drawn]] = -np.inf
    wanted = near >= cosine
    wanted[np.arange(len(drawn)), near.argmax(1)] = True
    beam = BEAM
    while 4 * beam < len(exact):
        nodes, _ = walk(g, q[drawn].astype(np.float32), beam, None if own is None else own[drawn])
        found = np.zeros(wanted.shape, bool)
        i, j = np.nonzero(nodes >= 0)
        found[i, nodes[i, j]] = True
        found |= _linked(g, exact, q[drawn], None if own is None else own[drawn], cosine, beam)
        if (found & wanted).sum() >= recall * wanted.sum():
            break
        beam *= 2
    return beam


def _parts(linked: np.ndarray) -> np.ndarray:
    """Least member of each node's connected part, of a symmetric matrix of links."""
    n = len(linked)
    part = np.full(n, -1)
    for v in range(n):
        if part[v] < 0:
            part[v] = v
            edge = np.array([v])
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(0) & (part < 0))
                part[edge] = v
    return part


def _parts_across(linked: np.ndarray) -> np.ndarray:
    """Least member of each row's and column's connected part, of links between rows and columns; columns count after all rows."""
    n, m = linked.shape
    part = np.full(n + m, -1)
    for v in range(n):
        if part[v] < 0:
            part[v] = v
            rows = np.array([v])
            while len(rows):
                cols = np.flatnonzero(linked[rows].any(0) & (part[n:] < 0))
                part[n + cols] = v
                rows = np.flatnonzero(linked[:, cols].any(1) & (part[:n] < 0))
                part[rows] = v
    return np.where(part < 0, np.arange(n + m), part)


INDEX = "label string, d int, shards int, shard int, keys binary, cids binary, copies binary, vectors binary, sizes array<int>, links array<binary>"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(frame: pd.DataFrame) -> pd.DataFrame:
    """One shard as a row: class keys and ids, copies and vectors as given in graph order, and the graph's layers."""
    frame = frame.sort_values("key")
    given = np.stack(frame["vector"].to_numpy())
    g, order = build(_unit(given))
    as_bytes = lambda c: frame[c].to_numpy(np.int64)[order].tobytes()
    first = frame.iloc[0]
    place = np.int16 if len(given) < 2**15 else np.int32
    return pd.DataFrame({"label": [first["label"]], "d": [first["d"]], "shards": [first["shards"]], "shard": [first["shard"]], "keys": [as_bytes("key")], "cids": [as_bytes("cid")], "copies": [as_bytes("copies")],
                         "vectors": [given[order].tobytes()], "sizes": [g.sizes], "links": [[a.astype(place).tobytes() for a in g.near]]})


@dataclass
class Shard:
    """Class keys, ids and copies of a shard, its unit vectors in double precision, their heads and the graph."""

    keys: np.ndarray
    cids: np.ndarray
    copies: np.ndarray
    x: np.ndarray
    heads: np.ndarray
    graph: Graph


def _read(keys: bytes, cids: bytes, copies: bytes, vectors: bytes, d: int, sizes: list[int], links: list[bytes]) -> Shard:
    keys, cids, copies = (np.frombuffer(b, np.int64) for b in (keys, cids, copies))
    x = _unit(np.frombuffer(vectors, np.float32 if len(vectors) == 4 * d * len(keys) else np.float64).reshape(-1, d))
    place = np.int16 if len(keys) < 2**15 else np.int32
    near = [np.frombuffer(b, place).reshape(s, -1).astype(np.int32) for b, s in zip(links, sizes)]
    single = x.astype(np.float32)
    return Shard(keys, cids, copies, x, heads(single), Graph(single, list(sizes), near))


def _queried(to: Shard, of: Shard, rows: np.ndarray, may: np.ndarray, cols: np.ndarray, cosine: float, recall: float) -> np.ndarray:
    """Links of some rows of a shard, each with ``may`` open pairs, with the open columns of another or its own, as a matrix.

    Rows walk the graph with an audited beam. Those that could fill it are
    compared with all open columns, as are all where an audit, which compares
    AUDITED rows and walks for them at each beam, costs more than it saves.
    """
    out = np.zeros((len(rows), len(cols)), bool)
    walks = may <= BEAM // 2
    if walks.sum() <= 8 * AUDITED:
        walks[:] = False
    direct, few = np.flatnonzero(~walks), np.flatnonzero(walks)
    for at in range(0, len(direct), TOGETHER):
        out[direct[at : at + TOGETHER]] = of.x[rows[direct[at : at + TOGETHER]]] @ to.x[cols].T >= cosine
    if len(few):
        q, own = of.x[rows[few]], rows[few] if to is of else None
        beam = audited_beam(to.graph, to.x, q, own, cosine, recall)
        for at in range(0, len(few), TOGETHER):
            part = slice(at, at + TOGETHER)
            out[few[part]] = _linked(to.graph, to.x, q[part], None if own is None else own[part], cosine, beam)[:, cols]
    return out


def _pair(one: Shard, two: Shard, cosine: float, recall: float) -> pd.DataFrame:
    """Links within a shard, or between two, each queried by the other's vectors: (key, cid, links, root) of each linked vector; root: least place in its part.

    Vectors whose heads rule out every link with a shard don't walk its graph.
    """
    of_one, of_two = open_pairs(one.heads, two.heads, cosine, one is two)
    if one is two:  # both halves of a product may be rounded differently
        of_one = of_two = np.maximum(of_one, of_two)
    i, j = np.flatnonzero(of_one), np.flatnonzero(of_two)
    linked = _queried(two, one, i, of_one[i], j, cosine, recall)
    if one is two:
        linked |= linked.T
        linked[np.arange(len(i)), np.arange(len(i))] = False
        keys, cids, part = one.keys[i], one.cids[i], _parts(linked)
    else:
        linked |= _queried(one, two, j, of_two[j], i, cosine, recall).T
        keys, cids, part = np.concatenate((one.keys[i], two.keys[j])), np.concatenate((one.cids[i], two.cids[j])), _parts_across(linked)
    count = [linked[at : at + 1024] @ two.copies[j] for at in range(0, len(i), 1024)]
    if one is not two:
        count += [linked[:, at : at + 1024].T @ one.copies[i] for at in range(0, len(j), 1024)]
    count = np.concatenate([*count, np.zeros(0, np.int64)])
    some = np.flatnonzero(count > 0)
    return pd.DataFrame({"key": keys[some], "cid": cids[some], "links": count[some], "root": cids[part[some]]})


def _compare(rows: pd.DataFrame, cosine: float, recall: float) -> pd.DataFrame:
    """All pairs of shards of two sides, or of one side with itself; what :func:`_pair` returns."""
    shards = {r.shard: _read(r.keys, r.cids, r.copies, r.vectors, r.d, r.sizes, r.links) for r in rows.itertuples(index=False)}
    side = {s: s // SIDE for s in shards}
    one, two = int(rows["one"].iloc[0]), int(rows["two"].iloc[0])
    pairs = [(s, t) for s in sorted(shards) for t in sorted(shards) if side[s] == one and side[t] == two and s <= t]
    return pd.concat([_pair(shards[s], shards[t], cosine, recall) for s, t in pairs])


def near_copies(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, shard: int = SHARD) -> DataFrame:
    """Links between vectors (vec_id long, embedding, label) of equal label with a cosine of ``cosine`` or more.

    Equal vectors of one label are one class. The classes of a label are dealt into shards of at most about ``shard``
    vectors by hash, each shard gets a graph, and the vectors of every shard query all shards of their label, from
    both sides. A bound on their cosines first tells which vectors can link with a shard at all; none that links is
    ruled out. Where these are many they walk the shard's graph, else they are compared directly. What is found counts
    as a link only by its cosine in double precision. Beams start narrow; they widen until an audit against all vectors
    of the shard passes, and where they are full of links. Tasks return counts and spanning links, never all pairs, and
    components are united from those.

    Returns vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable, itself included) and
    kept (vec_id = component_id), one row per input row. Vectors that are null, zero or hold null or non-finite
    components, and all with a null label, link with nothing; vectors of different lengths don't link. A null id stands
    alone (component null, kept). Repeated rows count once and get a row each. Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("vector"))
    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    full = given.select("vec_id", F.when(part, F.col("label")).alias("label"), F.when(part, F.col("vector")).alias("vector"))
    full = full.withColumns({"f": F.xxhash64("vector"), "g": F.xxhash64(F.lit(1), "vector"), "d": F.size("vector")})
    marked = saved(full.drop("vector"), "vectors")
    once = marked.where("label IS NOT NULL").dropDuplicates(["vec_id", "label", "f", "g"])
    classes = saved(once.groupBy("label", "f", "g").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"), F.first("d").alias("d")).withColumn("key", F.monotonically_increasing_id()), "classes")
    per = F.greatest(F.least(F.lit(shard), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("d")))), F.lit(64))
    sizes = saved(classes.groupBy("label", "d").agg(F.ceil(F.count("*") / F.first(per)).cast("int").alias("shards")), "shards")
    sides = F.ceil(F.col("shards") / SIDE).cast("long")
    total = sizes.agg(F.sum("shards"), F.sum(sides * (sides + 1) / 2)).first()
    # several partitions a key, so that few keys seldom meet in one of them
    tasks = lambda n: max(1, min(4 * int(n or 1), 8 * spark.sparkContext.defaultParallelism))
    dealt = classes.join(sizes, ["label", "d"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int")).drop("d")
    each = full.where("label IS NOT NULL").groupBy("label", "f", "g").agg(F.first("vector").alias("vector"), F.first("d").alias("d"))
    dealt = each.join(dealt.hint("merge"), ["label", "f", "g"])
    dealt = dealt.select("label", "d", "shards", "shard", "key", "cid", "copies", "vector").repartition(tasks(total[0]), "label", "d", "shard")
    index = saved(dealt.groupBy("label", "d", "shard").applyInPandas(lambda frame: _index(frame), INDEX), "graphs")
    keys = ["label", "d", "one", "two"]
    side, other = (F.col("shard") / SIDE).cast("int"), F.explode(F.sequence(F.lit(0), ((F.col("shards") - 1) / SIDE).cast("int")))
    both = index.withColumns({"side": side, "other": other}).withColumns({"one": F.least("side", "other"), "two": F.greatest("side", "other")}).drop("shards", "side", "other")
    both = both.repartition(tasks(total[1]), *keys).groupBy(*keys)
    found = saved(both.applyInPandas(lambda frame: _compare(frame, cosine, recall), "key long, cid long, links long, root long"), "shard-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    # ids that stand in more than one class (equal ids, different vectors) unite them
    twice = once.groupBy("vec_id").count().where("count > 1").select("vec_id")
    of_id = once.join(twice, "vec_id", "left_semi").join(classes.select("label", "f", "g", "cid"), ["label", "f", "g"]).select("vec_id", "cid")
    least = of_id.groupBy("vec_id").agg(F.min("cid").alias("least"))
    across = of_id.join(least, "vec_id").where("cid <> least").select(F.col("cid").alias("a"), F.col("least").alias("b"))
    label = components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")).unionByName(across))
    of_class = classes.join(links, "key", "left").join(label.withColumnRenamed("node", "cid"), "cid", "left")
    of_class = of_class.select("label", "f", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    out = marked.select("vec_id", "label", "f", "g").join(of_class, ["label", "f", "g"], "left")
    component = F.coalesce("component", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
