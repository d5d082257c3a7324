"""The op queries over the driver tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import oracles

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.ngram_model import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.quality import score_quality

    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.html_text import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op5_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.quotes import link_quotes

    return link_quotes(_table(spark, sf_dir, "conversations"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.pieces import encode_samples

    return encode_samples(_table(spark, sf_dir, "documents"), TOKENIZER)


def op8_simhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.suffix_dedup import dedup_suffixes

    return dedup_suffixes(_table(spark, sf_dir, "documents")).drop("kept")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.media import text_media

    return text_media(_table(spark, sf_dir, "documents")).withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")


def op11_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.voting import score_by_neighbours

    return score_by_neighbours(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.ranked import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lantern.llm.merkle import manifest

    return manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bloom_lm_scores, op2_quality_rules, op3_html_extraction, op4_source_mixing, op5_quote_linking, op6_secret_scan, op7_sampled_pieces,
        op8_simhash_neighbours, op9_suffix_dedup, op10_media_columns, op11_neighbour_votes, op12_ranked_search, op13_merkle_manifest,
    )
}

ORACLE_SQL: dict[str, str] = {"op12_ranked_search": oracles.RANKED, "op13_merkle_manifest": oracles.MERKLE}
