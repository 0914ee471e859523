"""A training-data pipeline of five stages over the documents table.

STAGES: each function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result
as Parquet in the shared folder and hands the reread table to the next stage. All stages but the
last return the columns of documents; the last adds what it has made to doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortgrid.llm import bpe, contamination, language, repeats, simhash
from cohortgrid.llm.shared import Written

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; null texts and texts without a letter go.

    Profiles are learnt from the given documents' own lang column, over all that aren't held out.
    """
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 4 or fewer fingerprint bits: the one with the least doc_id.

    Fingerprints are those of the op2 query: shingles of four words, whole texts.
    """
    return simhash.keep_one(docs, radius=4, shingle=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that a smaller doc_id also has.

    A document that loses words gets its other words joined by one space, and their length as
    n_chars; one that loses all its words goes; every other stays as it is.
    """
    return repeats.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word window of a benchmark item."""
    return contamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the kept texts."""
    return bpe.token_digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can express neither the rank-order profiles nor the tokens; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. An empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        table = Written(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = table.df, table
    return docs
