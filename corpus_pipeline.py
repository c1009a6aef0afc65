"""From raw documents to token ids: quality, near duplicates, secrets, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result as Parquet in the
shared folder and gives it, read again, to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perimetra.llm import mixing, ngram_join, piece_codec, quality, secrets
from perimetra.llm.common import discard, materialize, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at rates that bring the domains' tokens to their target shares."""
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of each document's whole text."""
    return piece_codec.encode_documents(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality", good_quality),
    ("near_copies", no_near_copies),
    ("secrets", no_secrets),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: Boosted tables, minhashes, inferred automata and BPE cannot be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(docs)
        docs = kept
    return docs
