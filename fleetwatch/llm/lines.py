"""Line dedup: lines spread over many sites are boilerplate; all but their first place go."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, row_of, saved, unrow

MIN_SITES = 10
#: Logarithm of a sketch's registers; the relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 11


def row_keys(id_: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that name a row by its id and text; never null. Rows equal in both share them."""
    return F.xxhash64(F.lit(1), id_, text), F.xxhash64(text, F.lit(2), id_)


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line with a word of (k1, k2, id, site, text): k1, k2, id, site, i and the line's 128-bit hash (a, b)."""
    split = docs.select("k1", "k2", "id", "site", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    some = split.where(F.col("line").rlike(f"[^{SPACES}]"))
    return some.select("k1", "k2", "id", "site", "i", F.xxhash64(F.lit(1), "line").alias("a"), F.xxhash64("line", F.lit(2)).alias("b"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, first) of each line on at least ``min_sites`` distinct sites, with its first place (id, i).

    Sketches of sites merge map-side, so a very common line is one row per task.
    Estimates within four standard errors of the threshold (one site at least)
    are replaced by exact distinct counts; the others are beyond doubt.
    """
    margin = max(1, math.ceil(4 * 1.04 / math.sqrt(2**LG_K) * min_sites))
    sketched = lines.groupBy("a", "b").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min(F.struct("id", "i")).alias("first"))
    wide = saved(sketched.where(F.col("sites") >= min_sites - margin), "wide-lines")
    near = wide.where(F.col("sites") <= min_sites + margin)
    exact = (lines.select("a", "b", "site").join(near.select("a", "b"), ["a", "b"], "left_semi")
             .groupBy("a", "b", "site").count().groupBy("a", "b").agg(F.count("site").alias("exact")))
    sure = wide.where(F.col("sites") > min_sites + margin).select("a", "b", "first")
    return sure.unionByName(near.join(exact, ["a", "b"]).where(F.col("exact") >= min_sites).select("a", "b", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Remove cross-site boilerplate lines from every document.

    Returns one row per input row: ``row`` (all input columns), ``n_lines``,
    ``n_removed`` and ``kept_text``. A line goes if equal lines stand on at
    least ``min_sites`` distinct non-null sites, except at its first place by
    (id, line number), null ids first. Lines without a word are never counted
    or removed. Null texts stay null with no lines; rows equal in id and text
    are treated alike, so a first place there is kept in each of them; an empty
    table gives an empty result; other columns pass through under any name.
    """
    k1, k2 = row_keys(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    packed = docs.select(row_of(docs).alias("row"), k1.alias("k1"), k2.alias("k2"))
    lines = line_table(docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{site_col}`").alias("site"), F.col(f"`{text_col}`").alias("text")))
    found = saved(boilerplate(lines, min_sites), "boilerplate")
    gone = lines.join(found, ["a", "b"]).where(~F.struct("id", "i").eqNullSafe(F.col("first")))
    by_row = gone.groupBy("k1", "k2").agg(F.collect_set("i").alias("removed"))
    out = packed.join(by_row.hint("shuffle_hash"), ["k1", "k2"], "left").withColumn("text", F.col("row")[text_col])
    parts = F.split("text", "\n")
    out = out.withColumns({"parts": F.when(F.col("removed").isNotNull(), parts), "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))})
    places = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("removed"))
    rest = F.array_join(F.transform(places, lambda i: F.get("parts", i)), "\n")
    return out.select("row", F.col("n_lines").cast("long").alias("n_lines"),
                      F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
                      F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest).alias("kept_text"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with what :func:`dedup_lines` leaves of their text, n_chars renewed; those left without a word go."""
    out = dedup_lines(docs, min_sites)
    out = out.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(f"[^{SPACES}]"))
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row")["n_chars"]).cast(kind)
    return unrow(out, docs, **new)


SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
b AS (SELECT line FROM w GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k FROM w JOIN b USING (line)) WHERE k > 1)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(r.i)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN r USING (doc_id, i) GROUP BY doc_id"""
