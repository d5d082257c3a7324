"""The corpus pipeline: quality rules, SimHash near-dedup, secret scans, source mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents. run() writes every stage's rows as Parquet in the shared folder and rereads them for the next one.

Every stage counts a null text as empty, takes an empty table to an empty one, texts of any length whole, and repeated
rows as its operator's docstring says. Rows of one doc_id with different texts are different documents in all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lantern.llm.mixing import mixed_documents
from lantern.llm.pieces import encode_samples
from lantern.llm.quality import kept_documents
from lantern.llm.queries import TOKENIZER
from lantern.llm.secrets import redact
from lantern.llm.similar import without_copies
from lantern.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; of repeated rows all or none. Labels that are missing or null train nothing."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard 0.8 or more, chains included), that of the smallest doc_id.

    Texts without words are copies of each other; rows without a doc_id come after all others; repeated rows become one.
    """
    return without_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, reported secrets replaced by [secret]; null texts stay null, other columns as they are."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, none of them more than twice; documents without words are gone."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every row; copies of a document give equal rows."""
    return encode_samples(docs, TOKENIZER, most_edges=3_900_000)


STAGES = [("quality_rules", quality), ("simhash_dedup", near_dedup), ("secret_scan", secrets), ("source_mixing", mixing), ("piece_encoding", encoding)]

#: None: hashes of byte n-grams, chains of near copies and sampled lattices have no SQL form; tests/llm compares brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
