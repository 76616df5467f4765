"""The corpus pipeline: quality rules, near-duplicates, secret redaction, source mixing, packing.

Each stage takes the rows the stage before it left and returns rows of the same columns; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import jaccard, mixing, packing, quality, secrets
from loomgraph.runtime import saved, ship, table


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like the trusted ones."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return jaccard.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secrets masked."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    ship(spark)
    return mixing.apply(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", good_text),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]
#: SQL can express neither the hashed ratios nor the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again.

    Every stage takes nulls in any column, empty and very long texts, repeated rows and columns of any names. Documents
    with a null or empty text fail the quality rules, so the later stages see none; of repeated rows the near-duplicate
    stage keeps one. A document with a null doc_id is judged like any other. Ties are settled as the operators say. Empty
    table: no rows. The tables written on the way stay in the shared folder until runtime.clear().
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
