"""The registered queries of the operators, over the whole given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, decontam, extract, hpylm, licenses, merkle, oracles, quality, secrets, simhash, substring, urlrules, warc

#: The rank file that op7 encodes with.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The vocabularies that op12 aligns.
PAIRED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: The host and path rules that op3 is asked to judge by.
HOST_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    first = F.col("tiles")[0]["text_word"].cast("long")
    return found.select("doc_id", "item_id", "item_words", "matched_words", "coverage", F.size("tiles").cast("long").alias("n_tiles"), first.alias("first_word"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.select(
        "page_id", "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type",
        "content_length", "block_digest", "payload_digest", "source_headers", F.sha2("header", 256).alias("header_sha256"),
    )


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = [(p, p, action, "pattern") for p, action in urlrules.DEFAULT_PATTERNS]
    rules = urlrules.rules_table(spark, urlrules.host_rules(HOST_RULES) + patterns)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates_table(spark))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[F.col(f"stats.{x}") for x in quality.BASE], "base_failed", "kept", "rule")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hpylm.score(table(spark, sf_dir, "documents"))
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(table(spark, sf_dir, "pages"), carry=("url",))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), (*map(public_tokenizers.path, PAIRED), public_tokenizers.PATTERN), digest=True)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_url_rules": op3_url_rules,
    "op4_license_scan": op4_license_scan,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_bpe": op7_bpe,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_main_text": op10_main_text,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_secret_scan": op13_secret_scan,
}

#: The others are beyond SQL: tests hold them against brute force, an exact round trip or held-out accuracy.
ORACLES = {
    "op2_warc_derivatives": oracles.WARC,
    "op3_url_rules": oracles.url_rules(HOST_RULES, urlrules.DEFAULT_PATTERNS),
    "op4_license_scan": oracles.license_scan(),
    "op9_substring_dedup": oracles.SUBSTRING,
    "op11_merkle_manifest": oracles.MERKLE,
}
