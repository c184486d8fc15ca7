"""Caches that several runs share: keyed by what they are made of, and made in chunks that a killed run needn't repeat."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushtext.functions.text import plain_name
from hushtext.operators.storage import exists

#: Documents of a chunk, chunks of a table at most, and waves (jobs) in which they are made.
CHUNK_DOCS, MOST_CHUNKS, WAVES = 10_000, 1_024, 16


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A digest of these columns of all rows, whatever their order: their number, and sums of two hashes of each.

    Nulls differ from empty values, and repeated rows count. One pass, one row to the driver.
    """
    marked = [c for x in columns for c in (F.col(x), F.col(x).isNull())]
    wide = lambda seed: F.sum(F.xxhash64(*marked, F.lit(seed)).cast("decimal(38,0)"))
    row = df.agg(F.count("*").alias("n"), wide(1).alias("a"), wide(2).alias("b")).first()
    return hashlib.sha256(f"{','.join(columns)}|{row.n}|{row.a}|{row.b}".encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Cache:
    """Tables under root of one dataset and one model. about: all that their rows depend on, as JSON can hold it."""

    spark: SparkSession
    root: str
    dataset: str
    model: str
    about: dict

    @property
    def path(self) -> str:
        """Another dataset, model, or content of the tables has another path."""
        digest = hashlib.sha256(json.dumps({"dataset": self.dataset, "model": self.model} | self.about, sort_keys=True).encode()).hexdigest()[:16]
        return f"{self.root}/{plain_name(self.dataset)}_{plain_name(self.model)}_{digest}_cache"

    def _manifest(self, part: str) -> str:
        return f"{self.path}/{part}.manifest"

    def finished(self, part: str) -> DataFrame:
        """chunk, of (chunks of the table): chunks that are written in whole."""
        if not exists(self.spark, self._manifest(part)):
            return self.spark.createDataFrame([], "chunk int, of int")
        return self.spark.read.schema("chunk int, of int").parquet(self._manifest(part)).distinct()

    def table(self, part: str, docs: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """make(docs), a document (doc_id) at a time as far as make is concerned, written in chunks of documents by hash.

        Chunks that the manifest names aren't made again; a chunk enters it when all of it is written, and replaces what a
        killed run left of it. Waves of chunks are a job each.
        """
        n = docs.count()
        of = min(MOST_CHUNKS, max(1, math.ceil(n / CHUNK_DOCS)))
        chunks = self.spark.range(of).select(F.col("id").cast("int").alias("chunk"), F.lit(of).alias("of"))
        todo = sorted(r.chunk for r in chunks.join(self.finished(part), ["chunk", "of"], "left_anti").collect())  # MOST_CHUNKS at most
        dealt = docs.withColumn("__chunk", F.pmod(F.xxhash64("doc_id"), F.lit(of)).cast("int"))
        path, size = f"{self.path}/{part}-{of}", math.ceil(of / WAVES)
        for at in range(0, len(todo), size):
            wave = todo[at : at + size]
            made = make(dealt.where(F.col("__chunk").isin(wave)).drop("__chunk")).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(of)).cast("int"))
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)
            self.spark.createDataFrame([(c, of) for c in wave], "chunk int, of int").coalesce(1).write.mode("append").parquet(self._manifest(part))
        return self.spark.read.schema(make(docs.limit(0)).schema).parquet(path).drop("chunk")


def once(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write df so that rows of a run that is repeated, or runs twice at a time, replace one another: keys are folders."""
    df.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
