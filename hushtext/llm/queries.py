"""The queries of this subpackage, with the parameters of production, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushtext.llm import bpe, fertility_rules, filter_audit, language_id, media_chunks, mixing, ngram_join, periodic_runs, quality_resample, sharding, token_files, toxicity, vector_search
from hushtext.llm._common import fresh_path

SHARD_BYTES = 64 << 20


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write(_documents(spark, sf_dir), path)
    return token_files.checksums(token_files.read(spark, path))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_documents(spark, sf_dir), SHARD_BYTES)[0]


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).select("doc_id", *language_id.RESULTS)


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_resample.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    return fertility_rules.judge_fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), text=False).drop("lang")


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "media")
    media_chunks.write(_documents(spark, sf_dir), path)
    return media_chunks.digests(media_chunks.read(spark, path))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.take(_documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source a pattern of its own, copies apart: the quotas and the choice of documents, which SQL can express."""
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.take(docs, copies=False).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find(_documents(spark, sf_dir))


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_round_trip, op2_language_id, op3_token_files, op4_sharding, op5_quality_resample, op6_toxicity, op7_fertility_rules, op8_media_chunks, op9_mixing, op10_ngram_join, op11_filter_audit, op12_periodic_runs, op13_vector_search, language_id_pages, mixing_by_source)} | {
        # the same operator at a limit at which small tables split too
        "sharding_small_limit": lambda spark, sf_dir: sharding.assign(_documents(spark, sf_dir), 128 << 10)[0],
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.oracle(SHARD_BYTES), "sharding_small_limit": sharding.oracle(128 << 10), "mixing_by_source": mixing.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op13_vector_search": vector_search.ORACLE}
