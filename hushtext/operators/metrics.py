"""Utility of sanitized text: cosine, BLEU, ROUGE, BERTScore, perplexity, F1 and a downstream classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtext.operators.stemming import stem


def shared(a: Counter, b: Counter) -> int:
    """How many items two bags share, each counted as often as the bag with fewer has it."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    return sum(min(n, large[x]) for x, n in small.items() if x in large)


def runs(words: list[str], n: int) -> Counter:
    """How often each run of n words stands in words."""
    return Counter(zip(*(words[i:] for i in range(n))))


def bleu_of(original: str | None, sanitized: str | None) -> float:
    """4-gram sentence BLEU over lower-case words between white space; a count of no matches beyond single words is
    taken as 0.1. No words, or none shared: 0."""
    hyp, ref = (sanitized or "").lower().split(), (original or "").lower().split()
    logs = 0.0
    for n in (1, 2, 3, 4):
        matches = shared(runs(hyp, n), runs(ref, n))
        if n == 1 and not matches:
            return 0.0
        logs += math.log((matches or 0.1) / max(len(hyp) - n + 1, 1)) / 4
    return min(1.0, math.exp(1 - len(ref) / len(hyp))) * math.exp(logs)


def bleu(original: Column, sanitized: Column) -> Column:
    """bleu_of each pair of texts: linear in their words."""
    return F.arrow_udf(lambda a, b: pa.array(map(bleu_of, a.to_pylist(), b.to_pylist()), pa.float64()), "double")(original, sanitized)


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit for each token of a."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=100_000)
def _stemmed(word: str) -> str:
    return stem(word) if len(word) > 3 else word


def rouge_of(original: str | None, sanitized: str | None, stemmed: bool = True) -> dict[str, float]:
    """F-measures rouge1, rouge2, rougeL over lower-case runs of a-z and 0-9, stemmed after Porter unless told not to."""
    both = []
    for t in (sanitized, original):
        words = re.findall("[a-z0-9]+", (t or "").lower())
        both.append([_stemmed(w) for w in words] if stemmed else words)
    hyp, ref = both

    def f(same: int, n: int, m: int) -> float:
        p, r = same / max(n, 1), same / max(m, 1)
        return 2 * p * r / (p + r) if p + r else 0.0

    out = {f"rouge{n}": f(shared(runs(hyp, n), runs(ref, n)), len(hyp) - n + 1, len(ref) - n + 1) for n in (1, 2)}
    return out | {"rougeL": f(longest_common(hyp, ref), len(hyp), len(ref))}


def rouge(original: Column, sanitized: Column, stemmed: bool = True) -> Column:
    """rouge_of each pair of texts, as a struct."""
    kind = pa.struct([(x, pa.float64()) for x in ("rouge1", "rouge2", "rougeL")])
    run = F.arrow_udf(lambda a, b: pa.array([rouge_of(x, y, stemmed) for x, y in zip(a.to_pylist(), b.to_pylist())], kind), "struct<rouge1:double,rouge2:double,rougeL:double>")
    return run(original, sanitized)


def greedy_match(original: np.ndarray, sanitized: np.ndarray) -> dict[str, float]:
    """Precision, recall and F of matching each of two lists of unit vectors with its nearest in the other. An empty list scores 0."""
    if not len(original) or not len(sanitized):
        return {"precision": 0.0, "recall": 0.0, "f1": 0.0}
    cosine = sanitized @ original.T
    p, r = float(cosine.max(axis=1).mean()), float(cosine.max(axis=0).mean())
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r > 0 else 0.0}


_MATCHED = pa.struct([(x, pa.float64()) for x in ("precision", "recall", "f1")])


def bert_scores_of_texts(original: Column, sanitized: Column, load: Callable[[], Callable[[str], np.ndarray]]) -> Column:
    """Precision, recall and F of greedy matching of a model's token vectors. load makes a function from a text to vectors
    of its tokens, once in a worker; see word_vectors for what serves without a model."""
    held: list = []

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        if not held:
            held.append(load())
        return pa.array([greedy_match(held[0](x), held[0](y)) for x, y in zip(a.to_pylist(), b.to_pylist())], _MATCHED)

    return F.arrow_udf(run, "struct<precision:double,recall:double,f1:double>")(original, sanitized)


def perplexity(rows: DataFrame, nll: str = "nll", n: str = "n_tokens") -> DataFrame:
    """perplexity: the exponential of the mean loss of all tokens. rows: mean loss and number of tokens of each text."""
    return rows.agg(F.exp(F.sum(F.col(nll) * F.col(n)) / F.sum(n)).alias("perplexity"))


def word_losses(rows: DataFrame, text: str, corpus: DataFrame, corpus_text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, nll and n_tokens of each row: losses under the word counts of a corpus, plus one each. The simplest model, to
    compare others with; see language_model for the one in use. key: one or more columns' struct."""
    words = lambda df, t: F.explode(F.filter(F.split(F.lower(F.col(t)), r"\s+"), lambda x: x != ""))
    known = corpus.select(words(corpus, corpus_text).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total, kinds = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    found = rows.select(key, words(rows, text).alias("w")).groupBy(key, "w").agg(F.count("*").alias("m")).join(known, "w", "left")
    loss = -F.ln((F.coalesce("n", F.lit(0)) + 1.0) / (total + kinds + 1.0))
    return found.groupBy(key).agg((F.sum(F.col("m") * loss) / F.sum("m")).alias("nll"), F.sum("m").alias("n_tokens"))


def language_model_losses(rows: DataFrame, text: str, load: Callable[[], Callable[[list[str]], tuple]], batch: int = 8) -> DataFrame:
    """rows with nll and n_tokens from a language model that load makes in each task."""

    @F.pandas_udf("struct<nll:double,n_tokens:long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = load()
        for part in parts:
            texts = part.fillna("").tolist()
            found = [np.stack(score(texts[i : i + batch]), axis=1) for i in range(0, len(texts), batch)]
            yield pd.DataFrame(np.concatenate(found), columns=["nll", "n_tokens"]).astype({"n_tokens": "int64"})

    return rows.withColumn("__m", run(F.col(text))).select(*rows.columns, "__m.nll", "__m.n_tokens")


def f1_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """f1_macro over all labels of either column, and f1_micro, from one count of label pairs."""
    pairs = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("m")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("hit"), F.col("n").alias("m")))).alias("s")).select("s.*")
    each = sides.groupBy("label").agg((2.0 * F.sum("hit") / F.sum("m")).alias("f1"), F.sum("hit").alias("hit"), F.sum("m").alias("m"))
    return each.agg(F.avg("f1").alias("f1_macro"), (2.0 * F.sum("hit") / F.sum("m")).alias("f1_micro"))


def downstream_f1(train: DataFrame, test: DataFrame, features: str = "embedding", label: str = "label") -> DataFrame:
    """f1_macro and f1_micro on test of a logistic regression fitted on train, with an L2 weight of one row."""
    rows = train.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"))
    n, kinds = rows.agg(F.count("*"), F.countDistinct("y")).first()
    family = "binomial" if kinds <= 2 else "multinomial"
    model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=1000, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, family=family).fit(rows)
    found = model.transform(test.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y")))
    return f1_scores(found, "y", "prediction")


def text_metrics(pairs: DataFrame, original: str = "original", sanitized: str = "sanitized", by: list[str] | None = None) -> DataFrame:
    """BLEU mean and deviation, and mean ROUGE, in one pass over pairs of texts."""
    rows = pairs.select(*(by or []), bleu(F.col(original), F.col(sanitized)).alias("b"), rouge(F.col(original), F.col(sanitized)).alias("r"))
    return rows.groupBy(*(by or [])).agg(F.avg("b").alias("bleu_mean"), F.stddev_pop("b").alias("bleu_std"), F.avg("r.rouge1").alias("rouge1"), F.avg("r.rouge2").alias("rouge2"), F.avg("r.rougeL").alias("rougeL"))
