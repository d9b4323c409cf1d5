"""Periodic runs of words against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetwatch.llm import periodic
from fleetwatch.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(least, 2 * q) and not smaller:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def brute_row(doc_id, words):
    runs = brute_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows_of(df):
    return Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in df.collect())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_against_brute_force(least):
    rnd = random.Random(least)
    cases = [list("aaaaaaaaaaaaaaaaaaaaaaa"), fibonacci(200), list("abaababaabaab" * 6), [], ["x"], ["x"] * 12, ["x"] * 11, list("abcdef" * 2), list("abcdefg" * 2)]
    cases += [[rnd.choice("ab") for _ in range(rnd.randrange(0, 60))] for _ in range(150)]
    for _ in range(60):
        unit = [rnd.choice("abc") for _ in range(rnd.randrange(1, 9))]
        cases.append([rnd.choice("abcd") for _ in range(rnd.randrange(9))] + unit * rnd.randrange(1, 7) + unit[: rnd.randrange(len(unit))] + [rnd.choice("abc") for _ in range(rnd.randrange(9))])
    found = periodic._found([" ".join(c).encode() for c in cases], least)
    for words, (n, runs, _) in zip(cases, found):
        assert (n, runs) == (len(words), brute_runs(words, least))


def test_large_ordered_sets(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 4)
    rnd = random.Random(3)
    for _ in range(40):
        words = [rnd.choice("aab") for _ in range(120)]
        assert periodic._found([" ".join(words).encode()], 2)[0][1] == brute_runs(words, 2)


def test_very_long_texts_take_time_in_proportion():
    took = []
    for n in (50_000, 200_000):
        start = time.process_time()
        found = periodic._found([b"a " * n, b"a b c d e f g " * (n // 7)], 12)
        took.append(time.process_time() - start)
        assert [r[1] for r in found] == [[(0, n, 1)], [(0, n // 7 * 7, 7)]]
    assert took[1] < 12 * took[0] + 1


def test_odd_rows(spark, odd_documents):
    extra = spark.createDataFrame([(20, "a b c " * 9, "runs"), (20, "a b c " * 9, "runs"), (21, "\x0bw\x0cw\tw\nw\rw w w w w w w w w", None), (22, "\x85a\xa0a " * 14, "x")], "doc_id long, text string, collapsed string")
    docs = odd_documents.unionByName(extra, allowMissingColumns=True)
    want = Counter(brute_row(r.doc_id, WORD.findall(r.text or "")) if len(r.text or "") < 5000 else None for r in docs.collect())
    got = periodic.digest(periodic.runs(docs))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = rows_of(got)
    assert all(found[k] == n for k, n in want.items() if k) and sum(found.values()) == docs.count()
    assert rows_of(periodic.digest(periodic.runs(docs.limit(0)))) == Counter()


def test_real_outputs(spark):
    docs = spark.createDataFrame([("k", "go " + "x y " * 7 + "end")], "name string, body string")
    row = periodic.runs(docs, "body", ("name",)).first()
    assert (row.name, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("k", 16, [(1, 14, 2)], "go x y end")


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = [r for r in docs if len(WORD.findall(r.text or "")) <= 1500]
    got = rows_of(QUERIES["op13_periodic_runs"](spark, sf))
    assert sum(got.values()) == len(docs) and len(short) > 150
    want = Counter(brute_row(r.doc_id, planted(r.doc_id, r.text)) for r in short)
    assert all(got[k] == n for k, n in want.items())
    assert sum(1 for k in want if k[1]) >= 10
