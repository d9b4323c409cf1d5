"""Archives, repeats, near duplicates, neighbours, mixing and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetwatch.llm import ann, mixing, neardup, repeats, shingles, suffixes, warc
from fleetwatch.llm.components import components


def test_archives_round_trip(spark, tmp_path):
    body = "<p>" + "same words " * 30 + "</p>"
    rows = [(3, "http://a/1", body), (1, None, body), (2, "http://a/2\r\nX: y", body), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", body), (9, "ü", "ü" * 60), (10, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    folder = f"file://{tmp_path}/arc"
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(pages, folder).collect()}
    want = set()
    for i, _, t in rows:
        data = (t or "").encode()
        revisit = t == body and i != 1
        want.add((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    assert got == want
    assert warc.archive(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_dictionary_frame_and_single_record_frames(spark, sf, tmp_path):
    import struct

    import zstandard

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    dictionary = warc.train_dictionary(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert dictionary
    listed = warc.write_archives(warc.roles(pages), f"file://{tmp_path}", dictionary).collect()
    data = open(listed[0].path, "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8 : 8 + size] == dictionary
    trained, rest, n = zstandard.ZstdCompressionDict(dictionary), data[8 + size :], 0
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, n = one.unused_data, n + 1
    assert n == listed[0].records


def test_dictionary_sample_is_of_different_payloads(spark):
    import random

    rnd = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    long = ["<p>" + " ".join(rnd.choice(words) for _ in range(6_000)) + "</p>" for _ in range(20)]
    same = "<p>" + "one page " * 40 + "</p>"
    pages = spark.createDataFrame([(i, t) for i, t in enumerate([same] * 1500 + long + [None, ""])], "page_id long, html string")
    assert len(warc.train_dictionary(pages)) > 20_000  # from pieces of the long ones; the copies count once
    with pytest.warns(UserWarning, match="without a dictionary"):
        assert warc.train_dictionary(pages.where("page_id < 1500")) == b""
    with pytest.warns(UserWarning, match="without a dictionary"):
        assert warc.train_dictionary(pages.limit(0)) == b""


def brute_repeats(texts, window):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if count[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rnd = random.Random(seed)
    make = lambda n: "".join(rnd.choice("abcd é\n") for _ in range(n))
    shared = [make(n) for n in (399, 400, 401, 450, 700, 1500)]
    texts = [make(rnd.randrange(0, 900)) + rnd.choice(shared)[rnd.randrange(3) :] + make(rnd.randrange(0, 300)) + rnd.choice(shared) for _ in range(60)]
    near = make(1200)
    texts += [near[:i] + "#" + near[i + 1 :] for i in range(100, 1200, 90)]
    return texts + [None, "", "short", "z" * 399, "z" * 400, "z" * 401, "y" * 5000, "xyz" * 700, "same row " * 60, "same row " * 60]


@pytest.mark.parametrize("family", [500, 2])
def test_repeats(spark, monkeypatch, family):
    monkeypatch.setattr(repeats, "FAMILY", family)
    texts = passages(family)
    ids = [*range(len(texts) - 2), 999, 999]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, found int, k1 string")
    got = Counter(tuple(r) for r in repeats.remove_repeats(docs).collect())
    assert got == Counter((i, *b) for i, b in zip(ids, brute_repeats(texts, 400)))
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_return_bytes_and_runs(spark):
    rnd = random.Random(5)
    a = "".join(rnd.choice("abcdef") for _ in range(600))
    docs = spark.createDataFrame([(None, "left " + a), (2, a + " right")], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), [(x.begin, x.end) for x in r.removed]) for r in repeats.remove_repeats(docs, keep_bytes=True).collect()}
    assert got == {None: (b"left ", [(5, 605)]), 2: (b" right", [(0, 600)])}


def test_maximal_repeats():
    rnd = random.Random(1)
    for _ in range(60):
        base = bytes(rnd.choice(b"ab") for _ in range(60))
        strings = []
        for _ in range(rnd.randrange(1, 6)):
            at = rnd.randrange(50)
            strings.append(base[at : at + rnd.randrange(5, 50)])
        least = rnd.choice([8, 12, 20])
        places = defaultdict(list)
        for i, s in enumerate(strings):
            for p in range(len(s)):
                for n in range(least, len(s) - p + 1):
                    places[s[p : p + n]].append((i, p))
        want = set()
        for w, at in places.items():
            left = {strings[i][p - 1] if p else (i, p) for i, p in at}
            right = {strings[i][p + len(w)] if p + len(w) < len(strings[i]) else (i, "end") for i, p in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(w), tuple(sorted(at))))
        got = {(int(n), tuple(sorted(zip(o.tolist(), p.tolist())))) for n, o, p in suffixes.maximal_repeats(strings, least, max(map(len, strings)))}
        assert got == want


def test_shingles():
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())

    rnd = random.Random(2)
    texts = [None, "", " ", "A", "a b C", "Ä b\x0bc\x85d e f g"] + [" ".join(rnd.choice("a A b bb c é").strip() or "x" for _ in range(rnd.randrange(40))) for _ in range(200)]
    sets = [brute(t) for t in texts]
    made = [shingles.shingle_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(m) for m in made]
    assert len(set().union(*sets)) == len({int(x) for m in made for x in m})


def test_super_min_hash_is_exact_and_unbiased():
    def plain(items, m):
        best = [None] * m
        for e in items:
            order = list(range(m))
            for j in range(m):
                with np.errstate(over="ignore"):
                    drawn = int(shingles.mix(np.array([e], np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j + 1))[0])
                at = j + ((drawn & 0xFFFFFFFF) * (m - j) >> 32)
                order[j], order[at] = order[at], order[j]
                offer = j << 32 | drawn >> 32
                if best[order[j]] is None or offer < best[order[j]]:
                    best[order[j]] = offer
        return best

    rng = np.random.default_rng(0)
    for n in (1, 3, 20, 200):
        items = rng.integers(0, 2**63, n).astype(np.uint64)
        assert neardup.super_min_hash(items, 16).tolist() == plain(items.tolist(), 16)
    both = [rng.integers(0, 2**63, 300).astype(np.uint64) for _ in range(60)]
    agree = [np.mean(neardup.super_min_hash(x[:200]) == neardup.super_min_hash(x[100:])) for x in both]
    assert abs(np.mean(agree) - 1 / 3) < 0.02


def grouped(texts, ids):
    sets = [set(shingles.shingle_set(t).tolist()) for t in texts]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 85 * (len(a) + len(sets[j]) - n):
                x, y = root(ids[i]), root(ids[j])
                up[max(x, y)] = min(x, y)
    return Counter((i, len(s), root(i), root(i) == i) for i, s in zip(ids, sets))


def test_near_duplicates(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(200)]
    texts = [" ".join(base)] * 3 + [" ".join(base).upper()]
    for k in range(120):  # drifting family: base is near all, they are not all near each other
        copy = list(base)
        for _ in range(rnd.randrange(1, 6)):
            copy[rnd.randrange(200)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(150)]
    for k in range(20):
        chain[rnd.randrange(150)] = word()
        texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(rnd.randrange(1, 80))) for _ in range(100)] + ["a b", "A  b", "a b c", None, "", "", " "]
    ids = list(range(1000, 1000 + len(texts)))
    rnd.shuffle(ids)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, f int, bands string")
    assert Counter(tuple(r) for r in neardup.groups(docs).collect()) == grouped(texts, ids)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _, k in grouped(texts, ids) if k}


def test_pipeline_near_duplicates_are_of_080(spark, sf):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts, kept, band = [], set(), 0
    for _ in range(60):
        a = [word() for _ in range(300)]
        b = list(a)
        for at in rnd.sample(range(5, 295), rnd.randrange(5, 9)):
            b[at] = word()
        one, two = (set(shingles.shingle_set(" ".join(x)).tolist()) for x in (a, b))
        share = len(one & two) / len(one | two)
        kept |= {len(texts)} | ({len(texts) + 1} if share < 0.8 else set())
        band += 0.8 <= share < 0.85
        texts += [" ".join(a), " ".join(b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert band > 5 and {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == kept
    assert Counter(tuple(r) for r in neardup.groups(docs).collect()) == grouped(texts, list(range(len(texts))))


def test_near_duplicates_of_nothing(spark, odd_documents):
    assert neardup.groups(odd_documents.limit(0)).count() == 0
    rows = neardup.groups(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (5, 6)} == {5: 5, 6: 5}


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def vectors(spark, x, extra=()):
    return spark.createDataFrame([(i, v, 7) for i, v in [*((int(i), [float(a) for a in r]) for i, r in enumerate(x)), *extra]], "vec_id long, embedding array<double>, part int")


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(0, 20, 2000)] + 0.4 * rng.normal(size=(2000, 24))
    x[100:700] = x[100]  # one very common vector
    df = vectors(spark, x)
    rows = ann.search(df, df.where("vec_id % 20 = 0")).collect()
    found, right = defaultdict(dict), 0
    for r in rows:
        found[r.query_id][r["rank"]] = r.vec_id
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12)
    assert set(found) == set(range(0, 2000, 20)) and all(sorted(v) == list(range(1, 21)) for v in found.values())
    for q, v in found.items():
        near = x @ x[q]
        near[q] = -np.inf
        best = np.lexsort((np.arange(2000), -np.round(near, 9)))[:20]
        right += len(set(best.tolist()) & set(v.values()))
    assert right / (20 * len(found)) >= 0.9
    assert [found[100][k] for k in range(1, 21)] == list(range(101, 121))


def test_neighbours_of_few_and_of_bad_vectors(spark):
    bad = [(50, None), (51, [0.0, 0.0]), (52, [float("nan"), 1.0]), (53, [None, 1.0]), (None, [1.0, 1.0]), (54, [float("inf"), 1.0]), (55, [1.0, 2.0, 3.0])]
    df = vectors(spark, [[1, 0], [0, 1], [1, 1], [1, 1]], bad)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id in (0, 2, 50, 52)")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 1, 0.0), (2, 1, 3, 2.0), (2, 2, 0, 1.0), (2, 3, 1, 1.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0 and ann.search(df, df.limit(0)).count() == 0


def test_budgets_stay_among_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)], "domain string, lang string, source string, tokens long")
    weights = spark.createDataFrame([("domain", "a", 3.0), ("domain", "b", 1.0)], "level string, name string, weight double")
    got = {r.source: r.budget for r in mixing.budgets(leaves, weights, 800, 1).collect()}
    assert got == {"s1": 10, "s2": 290, "s3": 300, "s4": 200}  # what s1 can't take goes to s2, its sibling
    got = {r.source: r.budget for r in mixing.budgets(leaves.where("source <> 's3'"), weights, 1900, 1).collect()}
    assert got == {"s1": 10, "s2": 1000, "s4": 890}  # all of a is too little: the rest moves to b


def test_mix_epochs_and_odd_rows(spark, odd_documents):
    weights = spark.createDataFrame([("lang", "en", 1.0)], "level string, name string, weight double")
    every = mixing.mix(odd_documents, weights, 1.0, domain=F.lit("d"))
    assert every.select("row.*").columns == odd_documents.columns
    assert every.count() >= odd_documents.where("text <> ''").count()
    twice = mixing.mix(odd_documents, weights, 2.0, epochs=2, domain=F.lit("d")).groupBy("epoch").agg(F.sum("tokens").alias("n")).collect()
    assert sorted((r.epoch, r.n) for r in twice) == [(e, odd_documents.agg(F.sum(F.length("text"))).first()[0]) for e in (0, 1)]
    assert mixing.mix(odd_documents.limit(0), weights, 0.5, domain=F.lit("d")).count() == 0


def test_pipeline(spark, sf, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "tokens"]
    docs = documents
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from fleetwatch.llm import bpe, lines, quality
    from fleetwatch.llm.queries import vocabulary

    out = corpus_pipeline.run(spark, sf)
    good = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    rest = docs.where(F.col("doc_id").isin(sorted(good)))
    text = {r.row.doc_id: r.kept_text for r in lines.dedup_lines(rest).collect() if r.n_removed == 0 or r.kept_text.strip(" \t\n\x0b\f\r")}
    ids = sorted(text)
    kept = {i for i, _, _, k in grouped([text[i] for i in ids], ids) if k}
    got = {r.doc_id: r.ids for r in out.collect()}
    assert set(got) <= kept and len(got) >= 0.6 * len(kept)
    machine = bpe.automaton(vocabulary())
    assert all(machine.encode(text[i]) == v for i, v in got.items())


def test_tables_that_grow_with_documents_are_not_broadcast(spark, documents, monkeypatch):
    plans = []

    def recorded(df, name, *rest, kept=neardup.saved):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name, *rest)

    for module in ("neardup", "components"):
        monkeypatch.setattr(f"fleetwatch.llm.{module}.saved", recorded)
    last = neardup.groups(documents.select("doc_id", "text"))
    assert {"open-buckets", "pairs", "open-members", "block-pairs", "labels"} <= {name for name, _ in plans}
    assert [name for name, plan in [*plans, ("groups", last._jdf.queryExecution().executedPlan().toString())] if "BroadcastHashJoin" in plan] == []
    mixed = mixing.mix(documents, corpus_pipeline.weight_table(spark), 0.5, tokens=F.length("text"), domain=F.lit("web"))
    joins = re.findall(r"(\w+Join) \[coalesce\(id", mixed._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}
