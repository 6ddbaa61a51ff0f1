"""The queries of this subpackage, opN_<name>, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm import byte_cnn, decontamination, html_text, lexical_search, minhash_dedup, mixing, parity_join, quality_rules, secret_scan, sharding, token_counts, url_reputation, vector_codes
from retort.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extracted(pages, html_text.train(pages, table(spark, sf_dir, "documents")))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.filtered(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = byte_cnn.train(docs, labels.where(~byte_cnn.held_out()))
    scored = byte_cnn.apply(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", byte_cnn.held_out().alias("held_out"), "score", "predicted")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.joined(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_secret_scans": op5_secret_scans,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_decontamination": op9_decontamination,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_ngram_join": op11_ngram_join,
    "op12_vector_codes": op12_vector_codes,
    "op13_lexical_search": op13_lexical_search,
}

SQL: dict[str, str] = {"op3_minhash_dedup": minhash_dedup.SQL, "op5_secret_scans": secret_scan.SQL, "op4_url_filters": url_reputation.SQL, "op8_mixing": mixing.SQL, "op11_ngram_join": parity_join.SQL, "op12_vector_codes": vector_codes.SQL, "op13_lexical_search": lexical_search.SQL}
