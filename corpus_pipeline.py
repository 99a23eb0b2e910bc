"""Training-data pipeline over documents: toxicity, SimHash near-dedup, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import near_copies, packing, pii, toxicity
from tidewater.llm.shared import documents, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; labels of rejected or absent documents play no part. Rows without an id stay if their text does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_below(docs, toxicity.train(docs, labels), 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the row of the smallest doc_id, nulls last.

    Near copies have a Jaccard similarity of 0.8 or more in shingles of five words. Rows are told apart
    by doc_id and text: rows that share an id but not their text are documents of their own.
    """
    return near_copies.kept(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind."""
    return pii.redact(docs, pii.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.token_pieces(docs, path, public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Learned models decide; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
