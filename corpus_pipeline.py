"""The corpus pipeline: five stages over the documents table, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of documents; the last returns the id, the number of tokens and the digests of ids and decoded bytes of each document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import byte_bpe, decontaminate, exact_dedup, near_dedup, quality
from seriesloom.llm.queries import RANKS
from seriesloom.llm.tables import table
from seriesloom.session import shared_folder, ship


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier does not reject."""
    ship(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text."""
    ship(spark)
    return exact_dedup.deduplicate(docs)


def distinct_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, for each group of near copies (five-word shingles, 0.8)."""
    ship(spark)
    return near_dedup.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    ship(spark)
    return byte_bpe.digests(byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN))


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_texts),
    ("near dedup", distinct_groups),
    ("benchmark decontamination", clean_of_benchmark),
    ("byte-level BPE", tokens),
]

#: the classifier, the signatures and the tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
