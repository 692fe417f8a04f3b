"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next.
All but the last return the columns of documents.

Nulls, empty and very long texts, ties, repeated rows and extra columns are treated as the operators of the stages say: a
null or empty text fails the quality rules, so later stages see none unless they are called alone, where it counts as
empty. Rows that share a doc_id or a text stay or go each by itself in quality_rules and personal_data; near_duplicates
keeps one row of equal texts, mixing draws rows of one id together. Of empty tables each stage returns an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, mixing, pii, quality, simhash
from weftline.llm.common import table, written
from weftline.llm.queries import BYTE_BPE, tokenizer_path

#: SQL can't express the perplexity model or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced, n_chars counted anew."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return bpe.digests(bpe.encode_documents(docs, tokenizer_path(BYTE_BPE)))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
