"""A training corpus in five stages, each by one of the corpus operators.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns the columns of ``documents``; the last adds token ids and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from alertloom.llm.bpe_tree import encode_documents, read_ranks
from alertloom.llm.common import written
from alertloom.llm.decision_list import keep_good
from alertloom.llm.lsi_decontam import drop_contaminated
from alertloom.llm.near_copies import drop_near_copies
from alertloom.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of 0.8 or more stays."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind."""
    return redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_documents(docs, ranks, public_tokenizers.PATTERN, keep_ids=True, extra=("lang", "source", "n_chars"))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scan", secrets),
    ("byte-level bpe", encode),
]

#: The learned rules, the fingerprints and the latent axes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
