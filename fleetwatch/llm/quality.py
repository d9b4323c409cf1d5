"""Quality rules: base rules, then a length-normalised log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, saved, words_of

BUCKETS = 10_000
BIN = 0.005
SYMBOLS = "#*$%&|<>"


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _upto(n: Column, less: int) -> Column:
    """0, 1, .. up to n - 1 - less; empty if there is none."""
    return F.when(n > less, F.sequence(F.lit(0), n - 1 - less)).otherwise(F.array().cast("array<int>"))


def hashed_words(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_h``, a hash of each word, ``_n``, the number of words, and ``_chars``, their characters."""
    df = df.withColumn("_w", words_of(F.col(text)))
    return df.withColumns({"_h": F.transform("_w", lambda w: F.xxhash64(w)), "_n": F.size("_w"), "_chars": F.length(F.array_join("_w", ""))}).drop("_w")


def base_columns(df: DataFrame, text: str) -> DataFrame:
    """Adds the base counts and ``base_failed`` to what :func:`hashed_words` returns.

    Words in repeated three-word windows: window hashes packed with their
    place are sorted, equal neighbours give places, and their union is counted.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    plain = t
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    df = df.withColumns({
        "n_words": F.col("_n").cast("long"),
        "n_symbols": (F.length(t) - F.length(plain)).cast("long"),
        "word_chars": F.col("_chars").cast("long"),
        "_lines": lines,
        "_three": F.transform(_upto(F.col("_n"), 2), lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2))),
        "_bits": F.length(F.bin(F.col("_n"))),
    })
    df = df.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_again": F.size("_three") > F.size(F.array_distinct("_three")),
    }).drop("_lines")
    none = F.array().cast("array<bigint>")
    packed = F.transform("_three", lambda g, i: F.call_function("shiftleft", g, F.col("_bits")).bitwiseOR(i.cast("long")))
    df = df.withColumn("_packed", F.when(F.col("_again"), F.sort_array(packed)).otherwise(none))
    place = lambda p: (p - F.call_function("shiftleft", F.call_function("shiftright", p, F.col("_bits")), F.col("_bits"))).cast("int")
    same = lambda a, b: (F.call_function("shiftright", a, F.col("_bits")) == F.call_function("shiftright", b, F.col("_bits"))) & (F.get("_three", place(a)) == F.get("_three", place(b)))
    found = F.filter("_packed", lambda p, i: F.coalesce(same(p, F.get("_packed", i + 1)), F.lit(False)) | F.coalesce(same(p, F.get("_packed", i - 1)), F.lit(False)))
    start = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n"))
    cover = F.aggregate(F.sort_array(F.transform(found, place)), start,
                        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
                        lambda acc: acc["n"])
    df = df.withColumn("n_repeat_words", F.when(F.col("_again"), cover).otherwise(0).cast("long")).drop("_three", "_packed", "_again", "_bits")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def with_score(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds ``score``: the mean weight of a document's words and word pairs; 0 for one without words."""
    df = df.withColumn("_weights", weights.scalar())
    one = lambda h: F.get("_weights", _bucket(h))
    both = lambda acc, i: acc + one(F.get("_h", i)) + F.when(i > 0, one(F.xxhash64(F.get("_h", i - 1), F.get("_h", i)))).otherwise(0.0)
    total = F.aggregate(_upto(F.col("_n"), 0), F.lit(0.0), both)
    return df.withColumn("score", F.when(F.col("_n") > 0, total / (2 * F.col("_n") - 1)).otherwise(0.0)).drop("_weights")


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with a label: (_text, _good, _q). Ids labelled several times are good if all their labels are."""
    one = labels.select(F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("_q"), (F.coalesce("toxic", F.lit(0)) == 1).alias("_t"))
    ids = one.where("_id IS NOT NULL AND _q IS NOT NULL").groupBy("_id").agg(F.min(F.col("_q") & ~F.col("_t")).alias("_good"), F.min("_q").alias("_q"))
    return docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(ids.hint("shuffle_hash"), "_id").drop("_id")


def _gram_counts(texts: DataFrame, text: str, name: str) -> DataFrame:
    """(b, name): how often the words and word pairs of whole texts fall into each bucket."""
    pairs = F.inline(F.arrays_zip(F.col("_h").alias("b"), F.concat(F.array(F.lit(None).cast("long")), F.col("_h")).alias("a")))
    grams = hashed_words(texts.select(text), text).select(pairs.alias("b", "a")).where("b IS NOT NULL")
    each = F.explode(F.array(_bucket(F.col("b")), F.when(F.col("a").isNotNull(), _bucket(F.xxhash64("a", "b")))))
    return grams.select(each.alias("b")).where("b IS NOT NULL").groupBy("b").agg(F.count("*").alias(name))


def gram_weights(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: ``weights``, the log ratio of target and raw probability of each bucket, with one added to each count.

    Raw counts cover every document, target counts every good one of
    :func:`labelled_texts`. Without any good document all weights are 0.
    """
    raw = saved(_gram_counts(docs, "text", "raw"), "raw-counts")
    target = saved(_gram_counts(labelled.where("_good"), "_text", "target"), "target-counts")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    full = every.join(F.broadcast(raw), "b", "left").join(F.broadcast(target), "b", "left").na.fill(0)
    both = full.agg(F.array_sort(F.collect_list(F.struct("b", "target", "raw"))).alias("c"), F.sum("target").alias("t"), F.sum("raw").alias("r"))
    ratio = lambda x: F.log((x["target"] + 1) / (F.col("t") + BUCKETS)) - F.log((x["raw"] + 1) / (F.col("r") + BUCKETS))
    return both.select(F.when(F.col("t") > 0, F.transform("c", ratio)).otherwise(F.array_repeat(F.lit(0.0), BUCKETS)).alias("weights"))


def fit_threshold(labelled: DataFrame, weights: DataFrame) -> float | None:
    """The score from which labelled documents are kept.

    Of all cuts between bins of all labelled scores the one with the largest
    share of good documents kept plus share of bad ones refused; of equal ones
    the middle of the lowest run. Without bad labels nothing is refused.
    """
    scored = with_score(hashed_words(labelled, "_text"), weights).select(F.floor(F.col("score") / BIN).alias("bin"), "_q")
    bins = sorted(scored.groupBy("bin").agg(F.count(F.when(F.col("_q"), 1)).alias("good"), F.count(F.when(~F.col("_q"), 1)).alias("bad")).collect())
    good, bad = sum(r.good for r in bins), sum(r.bad for r in bins)
    if not good or not bad:
        return None
    gain, best, cuts = 0.0, -1.0, []
    for r in bins:
        if gain > best + 1e-12:
            best, cuts = gain, [r.bin]
        elif abs(gain - best) <= 1e-12:
            cuts.append(r.bin)
        gain += r.bad / bad - r.good / good
    low = max([b.bin for b in bins if b.bin < cuts[0]], default=cuts[0])
    return BIN * (low + 1 + cuts[0]) / 2


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base rules and likelihood ratio of every document, fitted on all labelled ones.

    ``docs`` has doc_id and text, ``labels`` doc_id, quality and toxic. Returns
    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, threshold and kept, one row per input row. Null and
    empty texts have no words and fail the base rules; a null id is kept in the
    result and never labelled; repeated rows are judged alike; an empty table
    gives an empty result; other columns are ignored. The verdict is score >=
    threshold; without good and bad labels the base rules decide alone.
    """
    docs = docs.select("doc_id", "text")
    labelled = saved(labelled_texts(docs, labels), "labelled", "zstd")
    weights = saved(gram_weights(docs, labelled), "weights")
    cut = fit_threshold(labelled, weights)
    out = with_score(base_columns(hashed_words(docs, "text"), "text"), weights)
    cut_col = F.lit(cut).cast("double")
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= cut_col, F.lit(True))
    # written, so that a filter on the verdict doesn't make the optimizer copy the long expressions below it
    return saved(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", cut_col.alias("threshold"), kept.alias("kept")), "judged")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that :func:`judge` keeps, with all their columns."""
    labelled = saved(labelled_texts(docs, labels), "labelled", "zstd")
    weights = saved(gram_weights(docs, labelled), "weights")
    cut = fit_threshold(labelled, weights)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("text"))
    judged = with_score(base_columns(hashed_words(packed, "text"), "text"), weights)
    good = ~F.col("base_failed") & F.coalesce(F.col("score") >= F.lit(cut).cast("double"), F.lit(True))
    # the place can't be moved, so the optimizer doesn't copy the long expressions above it into the filter
    kept = judged.withColumn("kept", good).withColumn("place", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("place") >= 0))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
