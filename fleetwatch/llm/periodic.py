"""Periodic runs of words: repeated suffixes joined by falling common prefix, new neighbours at period distance seed the runs."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetwatch.session import ship

from .common import words_of

#: Least words of a run, by default.
LEAST = 12
#: Words of the texts that are sorted together; a longer text goes alone.
TOGETHER = 400_000
#: Places in one block of an ordered set.
BLOCK = 512


class Places:
    """An ordered set of places in blocks, so that even a very large one takes a new place in little time."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, place: int):
        self.blocks, self.firsts, self.size = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def around(self, place: int) -> tuple[int | None, int | None]:
        """The members just before and after a place that is none."""
        b = bisect_right(self.firsts, place) - 1
        if b < 0:
            return None, self.firsts[0]
        block = self.blocks[b]
        i = bisect_left(block, place)
        if i < len(block):
            return block[i - 1], block[i]
        return block[-1], self.firsts[b + 1] if b + 1 < len(self.firsts) else None

    def add(self, place: int) -> None:
        b = max(bisect_right(self.firsts, place) - 1, 0)
        block = self.blocks[b]
        insort(block, place)
        self.firsts[b] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[b : b + 1] = [block[:half], block[half:]]
            self.firsts[b : b + 1] = [block[0], block[half]]


def sorted_repeats(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next ``least`` words stand twice in their text: in suffix order, and the class of equal ``least`` words of each.

    ``ids`` numbers the words, of each text apart, and has a number of its own after every text.
    Ranks are doubled, of what is not yet alone in its class only.
    """
    count = np.bincount(ids)
    rank = (np.cumsum(count) - count)[ids]
    some = np.flatnonzero(count[ids] > 1)

    def refined(some: np.ndarray, shift: int) -> np.ndarray:
        key = rank[some] << 32 | rank[some + shift]
        order = np.argsort(key)
        some, key = some[order], key[order]
        own = rank[some]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        old = np.concatenate(([True], own[1:] != own[:-1]))
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        rank[some] = own + first[group] - np.flatnonzero(old)[np.cumsum(old) - 1]
        return some[np.diff(np.append(first, len(some)))[group] > 1]

    known = 1
    while known < least and len(some):
        shift = min(known, least - known)
        some = refined(some, shift)
        known += shift
    repeated, classes = some, rank[some]
    while len(some):
        some = refined(some, known)
        known *= 2
    order = np.argsort(rank[repeated])
    return repeated[order], classes[order]


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words, by start, then period.

    ``ids`` is as for :func:`sorted_repeats` and starts with one more number of its own. Classes of suffixes with the
    same beginning are united by falling common prefix l (neighbours in suffix order are the edges). Two places that
    become neighbours in their class at distance d <= l repeat a word sequence of length d, and no shorter period
    fits: its place would lie between them. The pair at the run's first word has nothing equal before it; the run is
    then l + d words long.
    """
    floor = -(-least // 2)  # a run of length n and period q has n - q >= least / 2 words in common
    order, classes = sorted_repeats(ids, floor)
    if not len(order):
        return []
    # common prefix of each suffix with the one before it, in text order: at most one less than its left neighbour's
    before = np.full(len(order), -1)
    before[1:][classes[1:] == classes[:-1]] = order[:-1][classes[1:] == classes[:-1]]
    by_place = np.argsort(order)
    words, common = ids.tolist(), [0] * len(order)
    last, known = -2, 0
    for k, at, other in zip(by_place.tolist(), order[by_place].tolist(), before[by_place].tolist()):
        known = max(known - 1, floor) if at == last + 1 else floor
        last = at
        if other >= 0:
            while words[at + known] == words[other + known]:
                known += 1
            common[k] = known
        else:
            known = floor
    common_of = np.array(common)
    edges = np.flatnonzero(common_of)
    edges = edges[np.argsort(-common_of[edges], kind="stable")]
    parent = list(range(len(order)))
    places: list[Places | None] = [None] * len(order)
    place = order.tolist()
    out = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def seed(i: int, j: int, shared: int) -> None:
        if j - i <= shared and shared + j - i >= least and words[i - 1] != words[j - 1]:
            out.append((i, shared + j - i, j - i))

    for k in edges.tolist():
        shared = common[k]
        a, b = root(k - 1), root(k)
        large, small = places[a] or Places(place[a]), places[b] or Places(place[b])
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        new = list(small)
        for i, x in enumerate(new):
            left, right = large.around(x)
            if left is not None and (i == 0 or new[i - 1] < left):
                seed(left, x, shared)
            if right is not None and (i + 1 == len(new) or new[i + 1] > right):
                seed(x, right, shared)
        for x in new:
            large.add(x)
        parent[b], places[b], places[a] = a, None, large
    out.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those of a run after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    gone = np.cumsum(cover)[:-1] > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def _found(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, collapsed text) of each text."""
    split = [t.split() for t in texts]  # bytes split at the six ASCII white spaces only
    ids, begins, next_id, at = [[0]], [], 1, 1
    for words in split:
        known: dict[bytes, int] = {}
        own = [known.setdefault(w, len(known)) for w in words]
        ids.append(np.array([*own, len(known)], np.int64) + next_id)
        begins.append(at)
        at += len(own) + 1
        next_id += len(known) + 1
    mine: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = find_runs(np.concatenate(ids).astype(np.int64), least)
    for (start, length, period), t in zip(runs, (np.searchsorted(begins, [r[0] for r in runs], "right") - 1).tolist()):
        mine[t].append((start - begins[t], length, period))
    return [(len(words), own, collapsed(words, own)) for words, own in zip(split, mine)]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """Runs of repeated words in every whole text.

    A run is a stretch of words with smallest period q, at least max(``least``, 2 q) long, that no word beside it
    extends. Returns the ``keep`` columns, n_words, runs (structs of start, length and period, by start, then period)
    and collapsed: the words that no run holds after its first q words, joined by one space.

    One row per input row, without a shuffle; equal rows give equal rows. Null, empty and blank texts have no words, no
    runs and an empty collapsed text. Very long texts are sorted alone. Other columns are left out, so their names
    don't matter; an empty table gives an empty result.
    """
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("binary").alias("__text"))
    kept = source.drop("__text").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

    def answer(batch, texts):
        found = _found(texts, least)
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for _, own, _ in found]
        columns = [pa.array([x[0] for x in found], pa.int64()), pa.array(rows, pa.list_(RUN)), pa.array([x[2] for x in found], pa.binary()).cast(pa.string(), safe=False)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *columns], [*keep, "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            first, texts, size = 0, [], 0
            for i, text in enumerate(batch.column(len(keep))):
                data = text.as_py() or b""
                if texts and size + len(data) > 6 * TOGETHER:
                    yield answer(batch.slice(first, len(texts)), texts)
                    first, texts, size = i, [], 0
                texts.append(data)
                size += len(data)
            if texts:
                yield answer(batch.slice(first, len(texts)), texts)

    ship(df.sparkSession)
    return source.mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Makes one document in ten periodic from some word on, as its id's checksum says; a null id: unchanged."""
    words = words_of(F.col("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    periodic = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), periodic).otherwise(F.col("text")))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed text, from the result of :func:`runs`."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length, period = longest["length"], -longest["q"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-longest["s"]).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
