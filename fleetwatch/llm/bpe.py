"""BPE by automaton: merges compiled gadget by gadget, words encoded by its transitions, decoded by its arc labels."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

#: The splitting rule of byte-level vocabularies, white space as Unicode's White_Space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries of a worker's word memory and of its arc memory; beyond it they start anew.
CACHED = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Deterministic automaton over token arcs that accepts just the sequences BPE produces.

    It starts as state 0 with a loop per byte. The gadget of merge (u, v) adds
    one state, numbered as the merge: a copy of the state that u's arcs lead to
    (``goes``), without arc v. u's arcs lead to the copy, and every state with
    an arc u gets a new arc uv that leads where v led. Copies made for one
    token (``owner``) form a line that begins where its right part's arcs led
    when the token was made (``origin``). The transition table is kept as the
    arc each copy lost (``without``): a state has an arc unless it, or the part
    of a line it comes from, lost the arc or a left part of it before that arc
    was made.

    A word is encoded by transitions: from each state along the longest arc
    whose label stands there. Only one accepted sequence leads to each place
    of a word, so a place from which no arc goes on is never tried again.
    """

    def __init__(self, spec: dict):
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.labels: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max(vocab.values()) + 1
        # of tokens: state their arcs lead to, left part, merge that made them, state their line begins from
        self.goes, self.left, self.made, self.origin = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size, array("i", [0]) * size
        # of states: token they were copied for; of (token, arc): state that lost the arc
        self.owner, self.without = array("i", [-1]), {}
        self.known: dict[int, bool] = {}
        never = set()
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if not self._gadget(vocab[a], vocab[b], vocab[a + b], never):
                never.add(vocab[a + b])
        # arc of each label, and the longest label that begins with two bytes
        self.arcs = {self.labels[i]: i for i in vocab.values() if i not in never and (self.made[i] >= 0 or len(self.labels[i]) == 1)}
        self.reach: dict[bytes, int] = {}
        for label in self.arcs:
            self.reach[label[:2]] = max(self.reach.get(label[:2], 1), len(label))
        self.labels |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile(SPLIT)
        self.stops = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _gadget(self, u: int, v: int, uv: int, never: set[int]) -> bool:
        """Adds the state of a merge, whose number is its place among the merges plus one; False if u and v never meet."""
        state = len(self.owner)
        if self.made[uv] >= 0:
            raise ValueError("merges must make each token once, from tokens made before")
        met = u not in never and v not in never and self.has(self.goes[u], v)
        self.goes[uv] = self.origin[uv] = self.goes[v]
        self.owner.append(u)
        self.without[u << 32 | v] = self.goes[u] = state
        self.left[uv], self.made[uv] = u, state
        return met

    def has(self, state: int, token: int) -> bool:
        """Whether a state has an arc of a token."""
        owner, origin, left, made, without = self.owner, self.origin, self.left, self.made, self.without
        while state:
            of = owner[state]
            arc, until = token, state
            while arc >= 0:
                lost = without.get(of << 32 | arc)
                if lost is not None and lost <= until:
                    return False
                until, arc = min(state, made[arc]), left[arc]
            state = origin[of]
        return True

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Tokens of one pre-split word."""
        token = self.arcs.get(word)
        if token is not None:
            return (token,)
        n, arcs, reach, goes, labels, known = len(word), self.arcs, self.reach, self.goes, self.labels, self.known
        out: list[int] = []
        ends = bytearray(n + 1)  # places that lead nowhere
        at = state = 0
        to = min(n, reach.get(word[:2], 1))
        while at < n:
            while to > at:
                token = arcs.get(word[at:to])
                if token is not None and not ends[to]:
                    fits = known.get(state << 32 | token)
                    if fits is None:
                        if len(known) >= CACHED:
                            known.clear()
                        fits = known[state << 32 | token] = self.has(state, token)
                    if fits:
                        break
                to -= 1
            else:
                if not out:
                    raise ValueError("a byte without a token")
                ends[at] = 1
                to = at - 1
                at -= len(labels[out.pop()])
                state = goes[out[-1]] if out else 0
                continue
            out.append(token)
            at, state = to, goes[token]
            to = min(n, at + reach.get(word[at : at + 2], 1))
        return tuple(out)

    def pieces(self, text: str) -> Iterator[str | int]:
        """Pre-split words of a text; a special token's string gives its id."""
        at = 0
        if self.stops is not None:
            for m in self.stops.finditer(text):
                yield from self.split.findall(text, at, m.start())
                yield self.special[m.group()]
                at = m.end()
        yield from (self.split.findall(text, at) if at else self.split.findall(text))

    def encode(self, text: str) -> list[int]:
        return [i for w in self.pieces(text) for i in ((w,) if isinstance(w, int) else self.encode_word(w.encode("utf-8", "surrogatepass")))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        return Automaton(json.load(f))


class Words(dict):
    """Per word: its ids, those ids joined by commas, the arc labels joined."""

    def __init__(self, machine: Automaton):
        self.machine = machine

    def __missing__(self, word: str | int):
        ids = (word,) if isinstance(word, int) else self.machine.encode_word(word.encode("utf-8", "surrogatepass"))
        if len(self) >= CACHED:
            self.clear()
        found = self[word] = ids, ",".join(map(str, ids)), b"".join(map(self.machine.labels.__getitem__, ids))
        return found


@lru_cache(maxsize=2)
def words_of_machine(path: str) -> Words:
    return Words(automaton(path))


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def tokenize(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the ``keep`` columns, n_tokens, ids_sha256 (of the decimal ids
    joined by commas), decoded_sha256 and, if asked for, ``ids``; one row per
    input row. Null and empty texts have no tokens. The vocabulary file at
    ``path`` is read by each worker once. Other columns are left out, so their
    names don't matter; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").alias("__text"))
    kept = source.select(*(F.col(f"`{c}`") for c in keep)).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", " + SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches):
        words = words_of_machine(path)
        for batch in batches:
            n, ids_hash, text_hash, ids_out = [], [], [], []
            for text in batch.column(len(keep)).to_pylist():
                found = [words[w] for w in words.machine.pieces(text)] if text else []
                n.append(sum(len(x[0]) for x in found))
                ids_hash.append(hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest())
                decoded = b"".join([x[2] for x in found]).decode("utf-8", "replace")
                text_hash.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                if with_ids:
                    ids_out.append([i for x in found for i in x[0]])
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def detokenize(df: DataFrame, path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text of an ``ids`` array (null: null) as column ``to``; bytes that are no UTF-8 become U+FFFD."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{to}` string"
    at = df.columns.index(ids_col)

    def run(batches):
        machine = automaton(path)
        for batch in batches:
            text = [None if ids is None else machine.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, to])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
