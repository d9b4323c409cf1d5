"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import align, ann, bpe, hnsw, lines, mixing, neardup, periodic, pii, quality, repeats, secrets, warc
from .common import words_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_learned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op5_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"))


def op6_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).drop("url")


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def vocabulary() -> str:
    """The public 50k byte-level vocabulary; installed beside Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(_table(spark, sf_dir, "documents"), vocabulary())


#: Target weights of the mixing queries; sources not listed weigh the same.
WEIGHTS = {("domain", "web"): 0.5, ("domain", "books"): 0.3, ("domain", "forum"): 0.2, ("lang", "en"): 0.4, ("lang", "de"): 0.25, ("lang", "fr"): 0.2, ("lang", "es"): 0.15}
#: The tables name no domain; the number of a source stands in for it.
DOMAIN_SQL = "CASE WHEN regexp_extract(source, '[0-9]+', 0) = '' OR source IS NULL THEN 'web' WHEN regexp_extract(source, '[0-9]+', 0)::BIGINT % 3 = 0 THEN 'web' WHEN regexp_extract(source, '[0-9]+', 0)::BIGINT % 3 = 1 THEN 'books' ELSE 'forum' END"
SHARE, SEED, EPOCHS = 0.5, 17, 2


def domain_of(source: str = "source") -> Column:
    number = F.pmod(F.regexp_extract(source, "[0-9]+", 0).try_cast("bigint"), F.lit(3))
    return F.when(number == 1, "books").when(number == 2, "forum").otherwise("web")


def weight_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(level, name, w) for (level, name), w in WEIGHTS.items()], "level string, name string, weight double")


def op8_hierarchical_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), weight_table(spark), SHARE, SEED, EPOCHS, tokens=F.size(words_of(F.col("text"))), domain=domain_of())
    return out.select("row.doc_id", "epoch")


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(_table(spark, sf_dir, "documents"), key="replace this key")
    return out.select("row.doc_id", F.col("safe_text").alias("text"), "n_found", "n_replaced")


def op10_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op11_shard_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_copies(_table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(_table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.runs(periodic.with_planted_runs(_table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_warc_dictionary, op2_suffix_repeats, op3_line_spread, op4_learned_parts, op5_super_minhash, op6_quality_ratio, op7_bpe_automaton, op8_hierarchical_budgets, op9_feistel_pseudonyms, op10_credential_links, op11_shard_graphs, op12_token_alignment, op13_periodic_runs)}
SQL = {
    "op1_warc_dictionary": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f""",
    "op3_line_spread": lines.SQL,
    "op8_hierarchical_budgets": mixing.oracle("documents", DOMAIN_SQL, "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))", WEIGHTS, SHARE, SEED, EPOCHS),
}
