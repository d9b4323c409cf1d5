"""Alignment of two tokenizers against brute force with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache, reduce

import numpy as np
import public_tokenizers
import pytest

from fleetwatch.llm import align
from fleetwatch.llm.queries import QUERIES

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TRICKY = ["", None, "a", " ", "  two  spaces ", "x▁y", "tab\there\n\nand \x0b there", "nul \x00 byte", "ﬁ ½ é é Ünï 😀😀 中文字符 かな", " x　y  z", "<s> </s> <unk> <0x41>",
          "<|endoftext|> is text", "=" * 300, " " * 200, "\n" * 150, "9" * 500, "don't we'll I'M", "a" * 3000, "中" * 900, "� ﻿", "é" * 50 + " " * 7 + "ß"]


@lru_cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute_groups(text):
    """Groups of (A ids, B ids), or none."""
    if not text:
        return []
    a_lib, b_lib = libraries()
    alphabet = align.byte_alphabet()
    a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
    a_bytes = [bytes(alphabet[c] for c in a_lib.id_to_token(i)) for i in a]
    pieces = [b_lib.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return []
    ends = lambda parts: np.cumsum([len(x) for x in parts]).tolist()
    a_ends, b_ends = ends(a_bytes), ends(b_bytes)
    common, out, i, j = sorted(set(a_ends) & set(b_ends)), [], 0, 0
    for c in common:
        ga, gb = [], []
        while i < len(a) and a_ends[i] <= c:
            ga.append(a[i])
            i += 1
        while j < len(b) and b_ends[j] <= c:
            gb.append(b[j])
            j += 1
        out.append((ga, gb))
    return out


def brute(rows):
    groups = [(i, brute_groups(t)) for i, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for _, g in groups]
    count = Counter(p for own in links for p in set(own))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, g), own in zip(groups, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return Counter(out), count


def rows_of(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def same(x, y):
    flat = lambda f: (f.cut, [p.tolist() for p in (*f.prefix, *f.suffix)], [(c, a.tolist(), b.tolist()) for c, a, b in f.closed])
    return flat(x) == flat(y)


def test_fragments_are_a_monoid():
    rnd = random.Random(2)
    for _ in range(300):
        size = rnd.randrange(1, 60)
        ends = [np.array(sorted({*rnd.sample(range(1, size + 1), rnd.randrange(size)), size})) for _ in range(2)]
        ids = [np.arange(len(e)) + 100 * k for k, e in enumerate(ends)]
        whole = align.fragment(ids[0], ends[0], ids[1], ends[1])
        borders = [0, *sorted(rnd.sample(range(size + 1), min(size, 4))), size]
        parts = []
        for low, high in zip(borders, borders[1:]):
            own = [(e > low) & (e <= high) for e in ends]
            parts.append(align.fragment(*(x for k in range(2) for x in (ids[k][own[k]], ends[k][own[k]]))))
        assert same(reduce(align.compose, parts), whole)
        at = rnd.randrange(len(parts))
        left, right = (reduce(align.compose, p, align.Fragment()) for p in (parts[:at], parts[at:]))
        assert same(align.compose(left, right), whole)
        assert same(align.compose(align.Fragment(), whole), whole) and same(align.compose(whole, align.Fragment()), whole)


def test_ranges_tokenize_as_the_whole():
    t = align.tokenizers(BYTES, PIECES)
    rnd = random.Random(4)
    words = ["alpha", "Ünï", "中文", "x", "it's", "42", "--", "=" * 9, "\n", " ", "é", "longerword", "we'll", " "]
    for _ in range(60):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120)))
        whole = t.encode([text])[0]
        ends = [np.cumsum(s[x]) for x, s in zip(whole, (t.a_size, t.b_size))]
        got, reach = [[], []], 0
        for number, low, high, base, last, part in align.ranges(text, rnd.choice([8, 20, 64])):
            assert low == reach
            reach = high
            for k, (x, s) in enumerate(zip(t.encode([part])[0], (t.a_size, t.b_size))):
                e = base + np.cumsum(s[x])
                own = (e > low) & (e <= high)
                got[k] += list(zip(x[own].tolist(), e[own].tolist()))
        assert last and reach == len((" " + text).encode())
        assert got == [list(zip(x.tolist(), e.tolist())) for x, e in zip(whole, ends)]


def test_a_text_without_spaces_is_one_range():
    assert [r[0] for r in align.ranges("中" * 5000, 100)] == [0]
    assert len(list(align.ranges("中文 字 " * 500, 100))) > 10


@pytest.mark.parametrize("size,common", [(65_536, 65_536), (40, 65_536), (300, 50), (300, 0)])
def test_against_brute_force(spark, monkeypatch, size, common):
    monkeypatch.setattr(align, "COMMON", common)
    rnd = random.Random(size)
    words = "the quick brown fox jumps over lazy dogs Ünï cödé 中文 x1 42 naïve tokenization alignment".split()
    texts = [*TRICKY, *(" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 90))) for _ in range(40)), "tie tie", "tie tie", "bad ▁ here " * 60]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)]
    rows += [rows[-1]]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, pair string").repartition(3)
    got, listed = align.align(docs, BYTES, PIECES, size=size)
    want, count = brute(rows)
    assert rows_of(got) == want
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    assert {(r.a_id, r.b_id): (r.texts, r.best) for r in listed.collect()} == {p: (n, n == best[p[0]]) for p, n in count.items()}


def test_many_links_in_one_group(monkeypatch):
    a, b = np.array([1, 1, 2, 5]), np.array([7, 7, 7, 8])
    want = align.linked(a, b, np.array([3, 1]), np.array([3, 1]), np.array([0, 0]), 100)
    monkeypatch.setattr(align, "MANY", 2)
    assert [x.tolist() for x in align.linked(a, b, np.array([3, 1]), np.array([3, 1]), np.array([0, 0]), 100)] == [x.tolist() for x in want] == [[0, 0, 0], [107, 207, 508], [6, 3, 1]]


def test_odd_rows(spark, odd_documents):
    got = rows_of(align.align(odd_documents, BYTES, PIECES)[0])
    assert got == brute([(r.doc_id, r.text) for r in odd_documents.collect()])[0]
    empty, pairs = align.align(odd_documents.limit(0), BYTES, PIECES)
    assert empty.count() == pairs.count() == 0


def test_query(spark, sf):
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])[0]
    assert rows_of(QUERIES["op12_token_alignment"](spark, sf)) == want
