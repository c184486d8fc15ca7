"""A training corpus from documents: languages, quality rules, near duplicates, mixing, tokens.

Each stage reads what the stage before it kept, as Parquet. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushtext.llm import bpe, fertility_rules, language_id, mixing, ngram_join
from hushtext.llm._common import stored


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus languages; those that are undetermined go."""
    return language_id.kept(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of their language, fitted to the labelled ones among them."""
    return fertility_rules.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet") if sf_dir else None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least doc_id."""
    return ngram_join.first_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix: doc_id, n_tokens, digests of its ids and of their decoded text."""
    return bpe.round_trip_digests(docs)


STAGES = [
    ("language ID", known_languages),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("BPE encoding", tokens),
]

#: Language models, token vocabularies and MinHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
    return docs
