"""Alignment of two tokenizers: byte ranges of a text become fragments, composed by an associative operation up a tree of Spark tasks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from fleetwatch.session import ship

from .bpe import SPLIT, byte_alphabet
from .common import saved

#: Characters of a text that one task takes; longer texts are dealt out in byte ranges of about so many characters.
RANGE = 65_536
#: Fragments that one step of the tree composes.
FAN = 8
#: Bytes of short texts that are aligned together, and links of one group from which equal pairs are counted instead of listed.
TOGETHER, MANY = 1 << 20, 4_096
#: The commonest pairs, at most so many, whose counts each task holds; all others are joined by a shuffle.
COMMON = 65_536
#: Bits of a pair in a key of text and pair.
PAIR_BITS = 40
#: A single space between two letters or digits: both tokenizers cut there whatever stands around.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])")
NO_PLACE = -1


class Tokenizers:
    """The byte-level vocabulary (A) and the piece vocabulary (B): ids and bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken

        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        special = {t["id"] for t in spec.get("added_tokens") or []}
        ranks = {t: i for t, i in vocab.items() if i not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError("ids of merged tokens must rise with the rank of their merge")
        self.a = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = self._table({i: t for t, i in vocab.items()})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece with a space after other characters would join words")
        self.b_bytes = self._table({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)})
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = ([(f"{i},", f"{i}{end}") for i in range(len(x))] for x, end in ((self.a_bytes, "|"), (self.b_bytes, ";")))
        self.a_name, self.b_name = (np.array(x, dtype=object) for x in (self.a_name, self.b_name))

    @staticmethod
    def _table(of: dict[int, bytes]) -> list[bytes]:
        return [of.get(i, b"") for i in range(max(of) + 1)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A over space + text and of B over text; None where their bytes aren't those of space + text, or there are none."""
        pieces = self.b.encode(texts, num_threads=1)
        out = []
        for text, b in zip(texts, pieces):
            whole = " " + text
            a, data = self.a.encode_ordinary(whole), whole.encode()
            good = bool(text) and b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if good else None)
        return out


@lru_cache(maxsize=2)
def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path)


EMPTY = np.empty(0, np.int64)


@dataclass
class Fragment:
    """Tokens of a byte range: up to its first common end, the closed groups after it, and what follows the last common end.

    ``cut`` is the byte where the open prefix ends, or NO_PLACE: then all tokens are in the prefix. ``closed`` lists
    groups (byte of the end, A ids, B ids). Fragments are composed in the order of their ranges; the operation is
    associative and Fragment() is its identity.
    """

    cut: int = NO_PLACE
    prefix: tuple[np.ndarray, np.ndarray] = (EMPTY, EMPTY)
    closed: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)
    suffix: tuple[np.ndarray, np.ndarray] = (EMPTY, EMPTY)


def _chained(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate((x[0], y[0])), np.concatenate((x[1], y[1]))


def compose(f: Fragment, g: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges: the left one's open suffix and the right one's open prefix close a group."""
    if f.cut == NO_PLACE:
        return Fragment(g.cut, _chained(f.prefix, g.prefix), g.closed, g.suffix)
    if g.cut == NO_PLACE:
        return Fragment(f.cut, f.prefix, f.closed, _chained(f.suffix, g.prefix))
    return Fragment(f.cut, f.prefix, [*f.closed, (g.cut, *_chained(f.suffix, g.prefix)), *g.closed], g.suffix)


def cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B end at or before each common end."""
    at = np.minimum(np.searchsorted(b_ends, a_ends), max(len(b_ends) - 1, 0))
    same = np.flatnonzero(b_ends[at] == a_ends) if len(b_ends) else EMPTY
    return same + 1, at[same] + 1


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of a range with these tokens and the bytes where they end."""
    i, j = cuts(a_ends, b_ends)
    if not len(i):
        return Fragment(NO_PLACE, (a, b))
    closed = [(int(a_ends[i[k] - 1]), a[i[k - 1] : i[k]], b[j[k - 1] : j[k]]) for k in range(1, len(i))]
    return Fragment(int(a_ends[i[0] - 1]), (a[: i[0]], b[: j[0]]), closed, (a[i[-1] :], b[j[-1] :]))


def ranges(text: str, size: int) -> Iterator[tuple[int, int, int, int, int, str]]:
    """(number, first byte, last byte, byte where the part starts, is the last, part) of byte ranges of space + text.

    A token belongs to the range that holds its end. ``part`` is what a tokenizer has to see for it: from the last safe
    cut before the range to the first after it, without the space there. A border with no safe cut within ``size``
    characters on both sides is left out, so parts overlap by little and are of bounded length wherever a text has spaces.
    """
    n, number = len(text), 0
    low, left, left_byte = 0, 0, 0  # left: where the part starts in the text; its space is at left_byte of space + text
    border, byte = 0, 0
    while True:
        step = text[border : border + size]
        border, byte = border + len(step), byte + len(step.encode())
        last = border >= n
        if not last:
            before = None
            for before in SAFE.finditer(text, max(border - size, 0), border):
                pass
            after = SAFE.search(text, border, min(border + size, n))
            if before is None or after is None:
                continue
        high = byte + 1  # of space + text
        yield number, low, high, left_byte, last, text[left : n if last else after.start()]
        if last:
            return
        number, low, left = number + 1, high, before.end()
        left_byte = high - len(text[before.start() : border].encode())


def _listed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: group and place within it of each member."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def linked(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of the links in groups of na and nb tokens; owner: each group's text; pair = A id * width + B id."""
    a_at, b_at = np.cumsum(na) - na, np.cumsum(nb) - nb
    links = na * nb
    some = np.flatnonzero(links <= MANY)
    group, place = _listed(links[some])
    group = some[group]
    pair = a[a_at[group] + place // nb[group]] * width + b[b_at[group] + place % nb[group]]
    keys, times = [owner[group] << PAIR_BITS | pair], [np.ones(len(pair), np.int64)]
    for g in np.flatnonzero(links > MANY).tolist():
        left, n = np.unique(a[a_at[g] : a_at[g] + na[g]], return_counts=True)
        right, m = np.unique(b[b_at[g] : b_at[g] + nb[g]], return_counts=True)
        keys.append(owner[g] << PAIR_BITS | (left[:, None] * width + right[None, :]).ravel())
        times.append((n[:, None] * m[None, :]).ravel())
    key, back = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else EMPTY
    total = np.add.reduceat(back[order], first) if len(first) else EMPTY
    return key[first] >> PAIR_BITS, key[first] & ((1 << PAIR_BITS) - 1), total


def named(t: Tokenizers, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The groups' text in pieces, one for each token, each group closed by a semicolon."""
    a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_last[np.cumsum(na) - 1], b_last[np.cumsum(nb) - 1] = 1, 1
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + np.repeat(np.cumsum(nb) - nb, na)] = t.a_name[a, a_last]
    out[np.arange(len(b)) + np.repeat(np.cumsum(na), nb)] = t.b_name[b, b_last]
    return out


def _sha(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).removesuffix(";").encode()).hexdigest()


def _short(t: Tokenizers, texts: list[str | None]) -> list[dict]:
    """Rows of texts that a task takes whole: their bytes follow one another, so common ends of all of them are found at once."""
    rows = [dict(n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="", pairs=[], times=[]) for _ in texts]
    some = [i for i, x in enumerate(texts) if x]
    coded = {i: c for i, c in zip(some, t.encode([texts[i] for i in some])) if c is not None}
    if not coded:
        return rows
    which = list(coded)
    a, b = (np.concatenate([c[k] for c in coded.values()]) for k in (0, 1))
    i, j = cuts(np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b]))
    na, nb = np.diff(i, prepend=0), np.diff(j, prepend=0)
    a_upto, b_upto = (np.cumsum([len(c[k]) for c in coded.values()]) for k in (0, 1))
    g_upto = np.searchsorted(i, a_upto, "right")
    owner = np.repeat(np.arange(len(which)), np.diff(g_upto, prepend=0))
    text, pair, times = linked(a, b, na, nb, owner, len(t.b_bytes))
    p_upto = np.searchsorted(text, np.arange(len(which)), "right")
    parts, links = named(t, a, b, na, nb), np.cumsum(na * nb)
    before = dict.fromkeys("abgpl", 0)
    for k, (ae, be, ge, pe) in enumerate(zip(a_upto.tolist(), b_upto.tolist(), g_upto.tolist(), p_upto.tolist())):
        le = int(links[ge - 1])
        rows[which[k]] = dict(n_a=ae - before["a"], n_b=be - before["b"], n_groups=ge - before["g"], n_links=le - before["l"],
                              groups_sha256=_sha(parts[before["a"] + before["b"] : ae + be]), pairs=pair[before["p"] : pe], times=times[before["p"] : pe])
        before = dict(a=ae, b=be, g=ge, p=pe, l=le)
    return rows


COUNTS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]
LEAF = pa.schema([("key", pa.int64()), *COUNTS, ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
                  ("number", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("base", pa.int64()), ("last", pa.bool_()), ("part", pa.string())])
LEAF_SQL = "key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>, number long, low long, high long, base long, last boolean, part string"


def _leaves(source: DataFrame, keep: list[str], byte_path: str, piece_path: str, size: int) -> DataFrame:
    """One row for each text that a task takes whole, with its groups and pairs; one row for each range of a longer one."""
    kept = source.select(*(F.col(f"`{c}`") for c in keep)).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", " + LEAF_SQL

    def run(batches):
        t, at = tokenizers(byte_path, piece_path), TaskContext.get().partitionId() << 40

        def answer(batch, first, texts):
            nonlocal at
            short = iter(_short(t, [x for x in texts if x is None or len(x) <= size]))
            rows, which = [], []
            for i, text in enumerate(texts):
                if text is None or len(text) <= size:
                    rows.append({"key": at, **next(short)})
                    which.append(first + i)
                else:
                    for number, low, high, base, last, part in ranges(text, size):
                        rows.append(dict(key=at, number=number, low=low, high=high, base=base, last=last, part=part))
                        which.append(first + i)
                at += 1
            columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in LEAF]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(which)) for i in range(len(keep))), *columns], [*keep, *LEAF.names])

        for batch in batches:
            first, texts, used = 0, [], 0
            for i, data in enumerate(batch.column(len(keep)).cast(pa.binary())):
                text = None if data.as_py() is None else data.as_py().decode("utf-8", "replace")
                if texts and used + len(text or "") > TOGETHER:
                    yield from answer(batch, first, texts)
                    first, texts, used = i, [], 0
                texts.append(text)
                used += len(text or "")
            if texts:
                yield from answer(batch, first, texts)

    return source.mapInArrow(run, schema)


NODE = "key long, number long, last boolean, good boolean, n_a long, n_b long, cut long, prefix_a array<long>, prefix_b array<long>, suffix_a array<long>, suffix_b array<long>"
PIECE = "place long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def _piece(t: Tokenizers, closed: list[tuple[int, np.ndarray, np.ndarray]]) -> dict:
    """The closed groups of a fragment as one row."""
    if not closed:
        return dict(place=None, n_groups=0, n_links=0, groups="", pairs=[], times=[])
    a, b = (np.concatenate([g[k] for g in closed]) for k in (1, 2))
    na, nb = (np.array([len(g[k]) for g in closed], np.int64) for k in (1, 2))
    _, pair, times = linked(a, b, na, nb, np.zeros(len(na), np.int64), len(t.b_bytes))
    return dict(place=closed[0][0], n_groups=len(closed), n_links=int((na * nb).sum()), groups="".join(named(t, a, b, na, nb)), pairs=pair, times=times)


def _node(key: int, number: int, last: bool, good: bool, n_a: int, n_b: int, f: Fragment) -> dict:
    return dict(key=key, number=number, last=last, good=good, n_a=n_a, n_b=n_b, cut=f.cut, prefix_a=f.prefix[0], prefix_b=f.prefix[1], suffix_a=f.suffix[0], suffix_b=f.suffix[1])


def _range_fragments(parts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The fragment of each byte range: its open ends, and its closed groups as a piece."""
    def run(frames):
        t = tokenizers(byte_path, piece_path)
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                f, good, sizes = Fragment(), False, (0, 0)
                if (coded := t.encode([r.part])[0]) is not None:
                    ids, ends = list(coded), [r.base + np.cumsum(s[x]) for x, s in zip(coded, (t.a_size, t.b_size))]
                    for k in range(2):
                        own = (ends[k] > r.low) & (ends[k] <= r.high)
                        ids[k], ends[k] = ids[k][own], ends[k][own]
                    f, good, sizes = fragment(ids[0], ends[0], ids[1], ends[1]), True, (len(ids[0]), len(ids[1]))
                rows.append(_node(r.key, r.number, r.last, good, *sizes, f) | _piece(t, f.closed))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in f"{NODE}, {PIECE}".split(", ")])

    return parts.select("key", "number", "low", "high", "base", "last", "part").mapInPandas(run, f"{NODE}, {PIECE}")


def _composed(nodes: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One step up the tree: FAN neighbouring fragments become one; the groups that close by it are its piece."""
    def run(key, frame):
        f, n_a, n_b, good, last = Fragment(), 0, 0, True, False
        for r in frame.sort_values("number").itertuples(index=False):
            g = Fragment(r.cut, (np.asarray(r.prefix_a), np.asarray(r.prefix_b)), [], (np.asarray(r.suffix_a), np.asarray(r.suffix_b)))
            f, n_a, n_b, good, last = compose(f, g), n_a + r.n_a, n_b + r.n_b, good and r.good, r.last
        pieces = [_piece(tokenizers(byte_path, piece_path), [group]) for group in f.closed] or [_piece(None, [])]
        # the node's row takes the first group that closed; rows without a number take the others, which have places apart
        rows = [_node(key[0], key[1], last, good, n_a, n_b, f) | pieces[0]] + [_node(key[0], -1, False, good, 0, 0, Fragment()) | p for p in pieces[1:]]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in f"{NODE}, {PIECE}".split(", ")])

    return nodes.withColumn("up", F.floor(F.col("number") / FAN)).groupBy("key", "up").applyInPandas(lambda key, frame: run(key, frame.drop(columns="up")), f"{NODE}, {PIECE}")


def _first_groups(roots: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The open prefix of a whole text is its first group; nothing is open at its end."""
    def run(frames):
        t = tokenizers(byte_path, piece_path)
        for frame in frames:
            rows = [{"key": r.key} | _piece(t, [(r.cut, np.asarray(r.prefix_a), np.asarray(r.prefix_b))]) for r in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["key", *(c.split()[0] for c in PIECE.split(", "))])

    return roots.select("key", "cut", "prefix_a", "prefix_b").mapInPandas(run, f"key long, {PIECE}")


def _digests(pieces: DataFrame) -> DataFrame:
    """(key, n_groups, n_links, groups_sha256) of texts from their pieces: one walk in order, holding one piece at a time."""
    def run(frames):
        key, state = None, None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.key != key:
                    if state:
                        out.append((key, state[1], state[2], state[0].hexdigest()))
                    key, state = r.key, [hashlib.sha256(), 0, 0]
                state[0].update(((";" if state[1] else "") + r.groups.removesuffix(";")).encode())
                state[1] += r.n_groups
                state[2] += r.n_links
            if out:
                yield pd.DataFrame(out, columns=["key", "n_groups", "n_links", "groups_sha256"])
        if state:
            yield pd.DataFrame([(key, state[1], state[2], state[0].hexdigest())], columns=["key", "n_groups", "n_links", "groups_sha256"])

    ordered = pieces.select("key", "place", "n_groups", "n_links", "groups").repartition("key").sortWithinPartitions("key", "place")
    return ordered.mapInPandas(run, "key long, n_groups long, n_links long, groups_sha256 string")


def _long(parts: DataFrame, byte_path: str, piece_path: str) -> tuple[DataFrame, DataFrame]:
    """Texts given by ranges: (key, counts, groups_sha256; zeros if a range fails) and their pairs (key, pair, times)."""
    level = saved(_range_fragments(parts.repartition("key", "number"), byte_path, piece_path), "range-fragments")
    levels = [level]
    while not level.where("number > 0").isEmpty():
        level = saved(_composed(level.where("number >= 0").select(*(c.split()[0] for c in NODE.split(", "))), byte_path, piece_path), "composed-fragments")
        levels.append(level)
    roots = level.where("number = 0")
    good = roots.where("good")
    columns = ["key", *(c.split()[0] for c in PIECE.split(", "))]
    pieces = _first_groups(good, byte_path, piece_path)
    for one in levels:
        pieces = pieces.unionByName(one.where("place IS NOT NULL").select(*columns).join(good.select("key"), "key", "left_semi"))
    pieces = saved(pieces, "closed-groups")
    counts = roots.select("key", "good", "n_a", "n_b").join(_digests(pieces), "key", "left")
    zero = lambda c: F.when(F.col("good"), F.col(c)).otherwise(0).alias(c)
    counts = counts.select("key", zero("n_a"), zero("n_b"), zero("n_groups"), zero("n_links"), F.when(F.col("good"), F.col("groups_sha256")).otherwise("").alias("groups_sha256"))
    return counts, _listed_pairs(pieces).groupBy("key", "pair").agg(F.sum("times").alias("times"))


def _listed_pairs(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def _bar(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` pairs reach it; found from at most some hundred size classes."""
    step = F.floor(F.log2("texts") * 8).cast("int")
    classes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("texts").alias("least")).orderBy(F.desc("step")).collect()
    bar, seen = None, 0
    for c in classes:
        seen += c["n"]
        if seen > most:
            break
        bar = c["least"]
    return (1 << 62) if bar is None else bar


def align(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Aligns two tokenizations of every whole text.

    Tokens of the byte-level vocabulary A over space + text and of the piece vocabulary B over text are cut into groups
    at the bytes where both end. Every A and B token of one group are linked; a pair of ids counts the texts that hold
    it linked. Texts of up to ``size`` characters are aligned whole in the task that reads them. Longer ones are dealt
    out in byte ranges; each gives a fragment with open ends, and fragments are composed :data:`FAN` by FAN over
    tasks. Groups stay where they close; only open ends and totals move up the tree.

    Returns two tables: per input row the ``keep`` columns, n_a, n_b, n_groups, n_links, n_best (links whose pair has the
    highest count of all pairs of its A id, ties included), count_sum (counts over all links) and groups_sha256 (ids of
    the groups as ``a1,a2|b1;a3|b2``); and per linked pair a_id, b_id, texts and best.

    Null and empty texts, and texts whose tokens don't spell space + text byte for byte, have no tokens: zeros and an
    empty digest. Equal rows count as texts of their own. Other columns are left out, so their names don't matter; an
    empty table gives empty results.
    """
    spark = docs.sparkSession
    ship(spark)
    t = tokenizers(byte_path, piece_path)
    width, names = len(t.b_bytes), [f"kept_{i}" for i in range(len(keep))]
    source = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), F.col(f"`{text_col}`").alias("text"))
    leaves = saved(_leaves(source, names, byte_path, piece_path, size), "alignments")
    whole, parts = leaves.where("part IS NULL"), leaves.where("part IS NOT NULL")
    measures = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = whole.select(*names, *measures)
    pairs = _listed_pairs(whole)
    if not parts.isEmpty():
        counts, more = _long(parts, byte_path, piece_path)
        more = saved(more, "long-pairs")
        rows = rows.unionByName(parts.where("number = 0").select(*names, "key").join(counts, "key"))
        pairs = pairs.unionByName(more)
    counted = saved(pairs.groupBy("pair").agg(F.count("*").alias("texts")), "pair-counts")
    a_id = lambda: F.floor(F.col("pair") / width).cast("long")
    highest = counted.groupBy(a_id().alias("a_id")).agg(F.max("texts").alias("highest"))  # a row for each id of A at most
    known = saved(counted.withColumn("a_id", a_id()).join(highest, "a_id").select("pair", "a_id", "texts", (F.col("texts") == F.col("highest")).alias("best")), "pairs")
    bar = _bar(known, COMMON)
    common, rare = known.where(F.col("texts") >= bar), known.where(F.col("texts") < bar)
    met = pairs.join(F.broadcast(common.select("pair", "texts", "best")), "pair", "left")
    score = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("texts")).alias("count_sum")]
    found = met.where("texts IS NOT NULL").groupBy("key").agg(*score)
    rest = met.where("texts IS NULL").select("pair", "key", "times").join(rare.select("pair", "texts", "best"), "pair").groupBy("key").agg(*score)
    total = found.unionByName(rest).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.join(total, "key", "left")
    n: list[Column] = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    listed = known.select("a_id", (F.col("pair") - F.col("a_id") * width).alias("b_id"), "texts", "best")
    return out.select(*(F.col(k).alias(c) for k, c in zip(names, keep)), *n, "groups_sha256"), listed
