"""Quality rules, line dedup, secrets, pseudonyms and tokens against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from fleetwatch.llm import bpe, lines, pii, quality, secrets
from fleetwatch.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    some = [x for x in text.split("\n") if WORD.search(x)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(threes)
    covered = {i + k for i, t in enumerate(threes) if count[t] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(some) - len(set(some)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_base_columns(spark, documents, odd_documents):
    docs = documents.select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text")).unionByName(
        spark.createDataFrame([(100, "a b c a b c x y\nq\nq\nq # $ <>"), (101, "z " * 80), (102, " ".join(f"v{i}" for i in range(60)))], "doc_id long, text string"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = quality.judge(docs, labels).collect()
    want = Counter((r.doc_id, *base(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want


def hash_long(x, seed):
    return xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)


def grams(text):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(x) % quality.BUCKETS for x in h] + [signed(hash_long(b, hash_long(a, 42))) % quality.BUCKETS for a, b in zip(h, h[1:])]


def test_quality_ratio_and_verdict(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    text = {r.doc_id: r.text for r in documents.collect()}
    label = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    raw, target = Counter(), Counter()
    for i, t in text.items():
        raw.update(grams(t))
        if label.get(i) == (1, 0):
            target.update(grams(t))
    r, g = sum(raw.values()), sum(target.values())
    weight = [math.log((target[b] + 1) / (g + quality.BUCKETS)) - math.log((raw[b] + 1) / (r + quality.BUCKETS)) for b in range(quality.BUCKETS)]
    for row in quality.judge(documents, labels).collect():
        mine = grams(text[row.doc_id])
        score = sum(weight[b] for b in mine) / len(mine) if mine else 0.0
        assert row.score == pytest.approx(score, abs=1e-9)
        assert row.kept == (not row.base_failed and row.score >= row.threshold)


def test_quality_keeps_good_and_refuses_bad(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(documents, labels).join(labels, "doc_id").where("NOT base_failed")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.9 and share.get(0, 0) < 0.1
    kept = {r.doc_id for r in quality.keep_good(documents, labels).collect()}
    assert kept == {r.doc_id for r in quality.judge(documents, labels).where("kept").collect()}


def test_quality_without_labels_or_rows(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.judge(documents.limit(20), labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.threshold is None for r in rows)
    assert quality.judge(documents.limit(0), labels).count() == 0
    assert quality.keep_good(documents.limit(0), labels).columns == documents.columns


def test_quality_is_fitted_on_every_label(spark):
    n = 120_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "bad").otherwise("good").alias("text"))
    labels = docs.select("doc_id", (F.col("text") == "good").cast("int").alias("quality"), F.lit(0).alias("toxic"))
    good, bad, size = n * 2 // 3, n // 3, quality.BUCKETS
    score = {"good": math.log((good + 1) / (good + size)) - math.log((good + 1) / (n + size)), "bad": math.log(1 / (good + size)) - math.log((bad + 1) / (n + size))}
    got = {r.doc_id % 3 > 0: r.score for r in quality.judge(docs, labels).where("doc_id < 3").collect()}
    assert got == pytest.approx({True: score["good"], False: score["bad"]}, abs=1e-12)


def brute_lines(rows, least):
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for n, x in enumerate((t or "").split("\n")):
            if WORD.search(x):
                if s is not None:
                    sites[x].add(s)
                place = (i is not None, i or 0, n)
                first[x] = min(first.get(x, place), place)
    return Counter((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if len(sites[x]) < least or not WORD.search(x) or first[x] == (i is not None, i or 0, n))) for i, t, s in rows)


def test_lines(spark, odd_documents):
    rows = [(i, f"line {i}\nshared by all\nshared by {i % 3}\n\nend", f"s{i % 7}") for i in range(40)] + [(None, "shared by all", None), (50, None, "s1"), (51, "shared by all\nshared by all", "s9")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, removed int, parts string")
    for least in (2, 3, 7, 8):
        got = Counter((r.row.doc_id, r.kept_text) for r in lines.dedup_lines(docs, least).collect())
        assert got == brute_lines(rows, least)
    out = lines.without_boilerplate(odd_documents, 2)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()  # lines of one site only
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_near_threshold_sites_are_counted_exactly(spark):
    rows = [(i * 100 + j, f"on {i} sites", f"site{j}") for i in range(1, 40) for j in range(i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r.row.text for r in lines.dedup_lines(docs, 20).where("n_removed > 0").collect()}
    assert gone == {f"on {i} sites" for i in range(20, 40)}


def test_secret_base_spans():
    text = 'Api_KEY = "abcdefgh" apikey:short token=0123456789abcdef0123456789abcdef AKIAABCDEFGHIJKL AKIA123 Key paſsword=longenough1'
    got = secrets.base_spans(text)
    assert [(k, text[s:e]) for s, k, e in got] == [("assign", 'Api_KEY = "abcdefgh'), ("assign", "token=0123456789abcdef0123456789abcdef"), ("hex", "0123456789abcdef0123456789abcdef"), ("access", "AKIAABCDEFGHIJKL")]


def test_weak_parts_need_their_counterparts(spark, odd_documents):
    secret = "aB3dE5gH7jK9mN1pQ3sT5vW7"
    far = " word" * 200
    rows = [(1, f"client_id=robot7 {secret} https://api.example.com/v1"), (2, f"alone {secret} here"), (3, "https://api.example.com/v1 only"), (4, f"user: robot{far} {secret}"),
            (5, f"AKIAABCDEFGHIJKL then {secret}"), (6, None), (7, ""), (None, f"client_id=robot7 {secret}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "kind": F.lit("x")})
    kinds = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in secrets.scan(docs).collect()}
    assert kinds == {1: ["weak_id", "weak_secret", "endpoint"], 2: [], 3: [], 4: [], 5: ["access", "weak_secret"], 6: [], 7: [], None: ["weak_id", "weak_secret"]}
    assert secrets.scan(odd_documents).count() == odd_documents.count() and secrets.scan(docs.limit(0)).count() == 0


def test_links_equal_brute_force(spark):
    secret, ident, end = "aB3dE5gH7jK9mN1pQ3sT5vW7", "user=bob1", "http://x.y/z"
    rows = [(n, ("." * n).join(p) + " " * (n % 7) + q) for n in range(0, 900, 60) for p in ((ident + " ", " " + secret), (secret + " ", " " + ident, " " + end + " ")) for q in ("", " " + end)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for r in secrets.scan(docs).collect():
        text = rows[r.doc_id][1]
        parts = secrets.weak_parts(text, [])
        near = lambda s, kind: any(k == kind and abs(t - s) <= secrets.SCOPE for t, k, _ in parts)
        want = [f"{k}:{s}:{e}" for s, k, e in parts if all(near(s, o) for o in {"weak_id": ["weak_secret"], "weak_secret": ["weak_id"], "endpoint": ["weak_id", "weak_secret"]}[k])]
        assert r.spans == ",".join(want)


def test_parts_of_env_files_and_addresses(spark):
    secret = "aB3dE5gH7jK9mN1pQ3sT5vW7xY9zA2cD4fG6hJ8k"
    url = "https://h/cb?client_id=robot7&client_secret=ABCDEFGH12345678"
    rows = [(1, f"AWS_ACCESS_KEY_ID=AKIAABCDEFGHIJKL\nAWS_SECRET_ACCESS_KEY={secret}"), (2, f"client_id=robot7\nprivate_key={secret}=="), (3, f"private_key={secret}"),
            (4, url), (5, f"{url} user=bob1 token=ABCDEFGH12345678 https://x.y/z")]
    got = {r.doc_id: [(k, rows[r.doc_id - 1][1][int(s) : int(e)]) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    weak_id, assign = ("weak_id", "client_id=robot7"), ("assign", "secret=ABCDEFGH12345678")
    assert got == {1: [("access", "AKIAABCDEFGHIJKL"), ("weak_secret", secret)], 2: [weak_id, ("weak_secret", secret + "==")], 3: [], 4: [weak_id, assign],
                   5: [weak_id, assign, ("weak_id", "user=bob1"), ("assign", "token=ABCDEFGH12345678"), ("endpoint", "https://x.y/z")]}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(spark):
    texts = ["card 4041894974608795, again 4041-8949-7460-8795; not 4041894974608796", "me.1@mail8.example.com at 42.144.35.254 not 999.1.1.1", "+1 (988) 555-2485 or (988) 555-2485",
             "2023-02-28 28.02.2023 2023-02-30 1850-12-31 0999-01-01", "123-45-6789 000-12-3456", None, "", "none"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    new = {r.row.doc_id: (r.safe_text, r.n_found, r.n_replaced) for r in pii.pseudonymize(docs, "k").collect()}
    assert [new[i][2] for i in range(8)] == [2, 2, 2, 3, 1, 0, 0, 0]
    cards = re.findall(r"[0-9][0-9-]{14,}[0-9]", new[0][0])
    assert cards[0] == cards[1].replace("-", "") != "4041894974608795" and luhn(cards[0]) and cards[2] == "4041894974608796"
    assert re.fullmatch(r"[a-z]{2}\.\d@mail8\.example\.com at (\d+\.){3}\d+ not 999\.1\.1\.1", new[1][0])
    assert all(int(x) < 256 for x in re.search(r"at ([\d.]+) not", new[1][0])[1].split("."))
    iso, dmy, bad, *_ = new[3][0].split(" ")
    assert iso.split("-") == dmy.split(".")[::-1] and bad == "2023-02-30" and new[3][0].endswith("0999-01-01")
    assert (new[5], new[6], new[7]) == ((None, 0, 0), ("", 0, 0), ("none", 0, 0))
    other = {r.row.doc_id: r.safe_text for r in pii.pseudonymize(docs, "other").collect()}
    assert other[0] != new[0][0] and pii.pseudonymize(docs.limit(0), "k").count() == 0


def test_cards_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    near = [("", " 12/27"), ("", " 123"), ("", " 03/2027"), ("order 12 ", ""), ("12 34 ", " 5 6"), ("1234 ", " 12-27"), ("", " 12/03/2027"), ("", " 10.0.0.1"), ("", " 12x")]
    texts = [a + c + b for a, b in near for c in (card, card.replace(" ", ""), card.replace(" ", "-"))]
    texts += [card, "3782 822463 10005 1234", f"{card} 4041894974608795 99", "12345 988-555-2485", f"988-555-2485 {card} 123-45-6789", "411111 1111111111 12345", "1 2 3 4 5 6 " * 5000 + card]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r for r in pii.pseudonymize(docs, "k").collect()}
    k = 3 * len(near)
    safe = got[k].safe_text
    assert safe != card and luhn(safe.replace(" ", ""))
    for i, (a, b) in enumerate(near):
        for j, c in enumerate((safe, safe.replace(" ", ""), safe.replace(" ", "-"))):
            r = got[3 * i + j]
            assert r.safe_text.startswith(a + c) and (b in (" 12/03/2027", " 10.0.0.1")) == (not r.safe_text.endswith(c + b)), r
            assert r.n_replaced == (2 if b in (" 12/03/2027", " 10.0.0.1") else 1)
    assert got[k + 1].n_replaced == 1 and got[k + 1].safe_text.endswith(" 1234") and got[k + 2].n_replaced == 2 and got[k + 2].safe_text.startswith(safe)
    assert got[k + 3].n_replaced == 1 and got[k + 3].safe_text.startswith("12345 ") and got[k + 4].n_replaced == 3 and got[k + 5].n_replaced == 1
    assert got[k + 6].n_replaced == 1 and got[k + 6].safe_text == "1 2 3 4 5 6 " * 5000 + safe


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(189 * 7).select("id", pii.feistel(F.array((F.col("id") / 7).cast("int"), (F.col("id") % 7).cast("int")), F.array(F.lit(189), F.lit(7)), "k", "t").alias("p"))
    got = {tuple(r.p) for r in pairs.collect()}
    assert got == {(a, b) for a in range(189) for b in range(7)}


def test_tokens_equal_the_library(spark, documents, odd_documents):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    machine = bpe.automaton(vocabulary())
    rnd = random.Random(3)
    mixed = ["".join(rnd.choice("ab etnhis'.,!1 2\n\t\u2009—éß字\U0001f600") for _ in range(60)) for _ in range(300)] + ["".join(rnd.choice("ABCDEFabcdef0123456789+/") for _ in range(5000))]
    tricky = [*mixed, "<|endoftext|>a <|endoftext|>", "a" * 300, "!" * 77, "   \n\n x\t y", "I'll we've 'S", "\x1c\x1f\u0085​　字😀", "= " * 50, "…" * 20]
    texts = tricky + [r.text for r in documents.limit(80).collect()]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert machine.encode(t) == want and machine.decode(want) == library.decode(want, skip_special_tokens=False)
    for r, t in zip(bpe.tokenize(odd_documents, vocabulary(), with_ids=True).collect(), odd_documents.collect()):
        want = library.encode(t.text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids) == (t.doc_id, len(want), want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t.text or "").encode()).hexdigest()
    back = bpe.detokenize(bpe.tokenize(documents, vocabulary(), with_ids=True), vocabulary())
    assert back.join(documents.withColumnRenamed("text", "was"), "doc_id").where(F.coalesce("was", F.lit("")) != F.col("text")).count() == 0
    assert bpe.tokenize(documents.limit(0), vocabulary()).count() == 0


def test_endpoints_equal_one_pattern_and_take_time_in_proportion():
    import random
    import time

    old = re.compile(r"""(?:\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3|sftp)://[^\s"'<>]+|\bendpoint["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:amazonaws|azure|googleapis)\.com\b)""", re.I | re.A)
    rnd = random.Random(1)
    parts = ["a", "-", "--", ".", "..", "_", "azure", "amazonaws", ".azure.com", ".amazonaws.com", "com", "https://", "endpoint", "=", ":", " ", "x-1", "é", ".googleapis.com", "\n", "'"]
    for _ in range(20_000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))
        assert secrets.endpoints(s) == [(m.start(), m.end()) for m in old.finditer(s)], s
    for piece in ("a-", "a.", "b.azure.com ", "x@b.", "1 ", "a.azure.com.", "endpoint ", "AKIA", "=", "user_id=", "f"):
        took = []
        for n in (100_000, 1_000_000):
            text = (piece * n)[:n]
            start = time.process_time()
            secrets.weak_parts(text, secrets.base_spans(text))
            took.append(time.process_time() - start)
        assert took[1] < 30 * took[0] + 1, piece


def test_pseudonyms_of_hostile_texts(spark):
    import time

    pieces = ["a-", "b.", "1 ", "@a", "x@b.", "x@b.b.", "1", "4111 ", "+44 20 ", "1.", "1-", "(", "+1", "x@" + "b." * 3000 + "com "]
    took = []
    for n in (100_000, 400_000):
        docs = spark.createDataFrame([(i, (p * n)[:n]) for i, p in enumerate(pieces)], "doc_id long, text string").repartition(len(pieces))
        start = time.time()
        rows = pii.pseudonymize(docs, "k").collect()
        took.append(time.time() - start)
        assert len(rows) == len(pieces) and all(len(r.safe_text) == n for r in rows)
    assert took[1] < 12 * took[0] + 5


def test_phones_beside_cards_and_their_calling_codes(spark):
    card = "4111 1111 1111 1111"
    texts = [f"+44 20 7946 0958 {card}", f"+49 30 1234567 {card}, {card}", f"{card} +44 20 7946 0958", f"+44 20 7946 0958 {card.replace(' ', '')}", f"call +351 912 345 678 {card} now",
             "988 555 2485", "+351 912 345 678", "+7 912 345 67 89", "+34 912 345 678", "+44 20 7946 0958 123 456 789 12", "12 988 555 2485"]
    got = [r.safe_text for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("row.doc_id").collect()]
    hidden = pii.pseudonymize(spark.createDataFrame([(0, card)], "doc_id long, text string"), "k").first().safe_text
    for i in range(5):
        assert card not in got[i] and card.replace(" ", "") not in got[i] and "7946 0958" not in got[i] and "1234567" not in got[i] and "345 678" not in got[i], got[i]
        assert hidden.replace(" ", "") in got[i].replace(" ", "")
    assert got[5] != texts[5] and re.fullmatch(r"\d{3} \d{3} \d{4}", got[5])
    assert got[6].startswith("+351 ") and got[6] != texts[6] and got[7].startswith("+7 ") and got[7] != texts[7] and got[8].startswith("+34 ") and got[8] != texts[8]
    assert "20 7946 0958" not in got[9] and got[10] == texts[10]
    assert [len(x) for x in got] == [len(x) for x in texts]
