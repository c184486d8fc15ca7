"""Quality by importance resampling.

Two generative models of hashed word n-grams, of target texts (labelled good) and of all texts, give each
document an importance weight: the ratio of its likelihoods, whose logarithm is the sum of its n-grams' log-ratios.
Gumbel noise keyed by the document makes the top k a sample without replacement in proportion to the weights. The k-th key is found by counting digits of keys, never by a sort
of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtext.llm._common import map_batches, stored, word_hashes
from hushtext.llm.sharding import HASH_BITS, key_hash

BUCKET_BITS = 14
#: Labelled rows from which the target model is counted, least hashes first. The raw model counts all rows.
TARGET_ROWS = 50_000
KEEP = 0.9
WORD = re.compile(r"\w+|[^\w\s]")
DIGIT_BITS = 12
#: Keys are weights plus KEY_ZERO in units of 1 / KEY_SCALE: 59 bits, as log weights of texts up to gigabytes lie within KEY_ZERO of 0.
KEY_ZERO, KEY_SCALE = 1 << 34, 1 << 24


def buckets(text: str) -> np.ndarray:
    """Buckets of the words and word pairs of a text."""
    words = word_hashes().of(WORD.findall(text.lower()))
    with np.errstate(over="ignore"):
        pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ words[1:]
        both = np.concatenate([words, pairs]) * np.uint64(0xBF58476D1CE4E5B9)
    return (both >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _counts(docs: DataFrame) -> np.ndarray:
    """Counts by class: all rows, and rows with target true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for t, good in zip(batch.column("text"), batch.column("target").to_pylist()):
                n = np.bincount(buckets(t.as_py() or ""), minlength=1 << BUCKET_BITS)
                total[0] += n
                if good:
                    total[1] += n
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k, at])], ["k", "slot", "n"])

    out = np.zeros((2, 1 << BUCKET_BITS))
    found = map_batches(docs.select("text", "target"), run, "k int, slot int, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas()
    out[found["k"].to_numpy(np.int64), found["slot"].to_numpy(np.int64)] = found["n"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log-ratio of target to raw by bucket. Target: rows of docs whose doc_id has quality 1 in labels."""
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    good = labels.where("doc_id is not null and quality = 1").select("doc_id").distinct().orderBy(order).limit(TARGET_ROWS)
    good = good.withColumn("target", F.lit(True))
    n = _counts(docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left"))  # at most TARGET_ROWS ids
    logs = np.log((n + 1.0) / (n.sum(axis=1, keepdims=True) + n.shape[1]))
    return (logs[1] - logs[0]).astype(np.float32)


def threshold(keys: DataFrame, k: int, bits: int = 60) -> int:
    """The k-th largest of the non-negative integers in column key, by counting them digit by digit."""
    low, left = 0, k
    for shift in range(bits - DIGIT_BITS, -1, -DIGIT_BITS):
        inside = keys.where(F.shiftright("key", shift + DIGIT_BITS) == F.lit(low >> (shift + DIGIT_BITS)))
        digit = F.shiftright("key", shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        rows = inside.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()  # 4096 rows at most
        for r in sorted(rows, key=lambda r: -r["d"]):
            if left <= r["n"]:
                low |= r["d"] << shift
                break
            left -= r["n"]
    return low


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: str = "quality") -> DataFrame:
    """doc_id, log_weight, selected: the keep share of rows with the largest weight plus Gumbel noise.

    Null, empty and wordless texts have the least weight and are never selected. Rows with equal keys are
    selected together, so repeated rows fare alike and a few more than asked may be selected; null doc_ids
    share one noise; a very long text is read whole; an empty table gives no rows; columns other than doc_id and text go.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = []
            for t in batch.column("text"):
                b = buckets(t.as_py() or "")
                w.append(float(ratio.value[b].sum(dtype=np.float64)) if len(b) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w, "float64")], ["doc_id", "log_weight"])

    rows = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, log_weight double")
    uniform = (key_hash(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) + 0.5) / float(1 << HASH_BITS)
    noisy = F.col("log_weight") - F.log(-F.log(uniform))
    # order-preserving and non-negative
    key = F.floor((noisy + float(KEY_ZERO)) * KEY_SCALE).cast("long")
    rows = stored(rows.withColumn("key", key), "quality-keys")
    scored = rows.where("key is not null")
    k = int(rows.count() * keep)
    cut = threshold(scored, k) if k else None
    chosen = F.lit(False) if cut is None else F.coalesce(F.col("key") >= cut, F.lit(False))
    return rows.select("doc_id", "log_weight", chosen.alias("selected"))
