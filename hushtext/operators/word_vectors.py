"""Vectors of words from what stands near them in a public corpus, and rarity weights: for matching two texts by words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtext.operators.embedding import hashed_rows
from hushtext.operators.index import list_column, matrix
from hushtext.operators.retrieval import fit_pca
from hushtext.operators.storage import stored

#: Context words (the most frequent ones), words on either side that count as near, and components that are kept.
CONTEXTS, WINDOW, DIM = 256, 3, 32
#: Components of the part that a word's letters give, and words of a text that are matched.
LETTERS_DIM, MOST_WORDS = 64, 512
TOKEN = r"\w+|[^\w\s]"


def tokens(text: Column, most: int = MOST_WORDS) -> Column:
    """Lower-case words and marks of a text, as far as most of them; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?U)({TOKEN})"), F.lit(1))
    return F.slice(found, 1, most) if most else found


@dataclass(frozen=True)
class Vectors:
    """word, learnt (a unit vector) of the words of a corpus, and their dimension."""

    table: DataFrame
    dim: int


def fit(corpus: DataFrame, text: str = "text", dim: int = DIM) -> Vectors:
    """Words as their positive pointwise mutual information with the CONTEXTS most frequent ones, cut to dim components.

    A pair counts for each time that a context word stands within WINDOW places. Counts are grouped, with partial sums
    before the shuffle; a word's row has CONTEXTS numbers, whatever the corpus. Words near no context word have no vector;
    with fewer context words than dim there are so many components less, and with none there are no vectors.
    """
    spark = corpus.sparkSession
    texts = stored(corpus.select(tokens(F.col(text), 0).alias("ws")), "vectors-words")
    counts = stored(texts.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "vectors-counts")
    top = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(CONTEXTS).collect()]
    dim = min(dim, len(top))
    if not dim:
        return Vectors(spark.createDataFrame([], "word string, learnt array<double>"), 0)
    contexts = spark.createDataFrame(list(zip(top, range(len(top)))), "near string, place int")
    placed = texts.select("ws", F.posexplode("ws").alias("at", "word"))
    around = F.concat(F.slice("ws", F.greatest(F.col("at") - WINDOW + 1, F.lit(1)), F.least(F.col("at"), F.lit(WINDOW))), F.slice("ws", F.col("at") + 2, WINDOW))
    pairs = placed.select("word", F.explode(around).alias("near")).join(F.broadcast(contexts), "near").groupBy("word", "place").agg(F.count("*").alias("n"))
    pairs = stored(pairs, "vectors-pairs")
    by_word, by_place = pairs.groupBy("word").agg(F.sum("n").alias("of_word")), pairs.groupBy("place").agg(F.sum("n").alias("of_place"))
    total = by_place.agg(F.sum("of_place")).first()[0] or 0
    if not total:
        return Vectors(spark.createDataFrame([], "word string, learnt array<double>"), 0)
    shared = F.greatest(F.ln(F.col("n") * float(total) / (F.col("of_word") * F.col("of_place"))), F.lit(0.0))
    rows = pairs.join(by_word, "word").join(F.broadcast(by_place), "place").select("word", "place", shared.alias("x"))
    wide = len(top)

    @F.arrow_udf("array<double>")
    def dense(places: pa.Array, values: pa.Array) -> pa.Array:
        out = np.zeros((len(places), wide))
        owner = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
        out[owner, places.flatten().to_numpy()] = values.flatten().to_numpy()
        return list_column(out)

    gathered = rows.groupBy("word").agg(F.collect_list("place").alias("ps"), F.collect_list("x").alias("xs"))  # CONTEXTS at most
    rows = stored(gathered.select("word", dense("ps", "xs").alias("v")), "vectors-rows")
    project = fit_pca(rows, "v", dim)

    @F.arrow_udf("array<double>")
    def cut(v: pa.Array) -> pa.Array:
        made = (matrix(v) - project.mean) @ project.parts
        return list_column(made / np.maximum(np.sqrt((made * made).sum(axis=1, keepdims=True)), 1e-10))

    return Vectors(stored(rows.select("word", cut("v").alias("learnt")), "vectors"), dim)


def rarity(references: DataFrame, text: str) -> tuple[DataFrame, float]:
    """word and weight, the logarithm of (texts + 1) / (texts with the word + 1), of all words of the references; and the weight
    of a word that none has."""
    n = references.count()
    held = references.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return held.select("word", F.ln(F.lit(n + 1.0) / (F.col("df") + 1)).alias("weight")), float(np.log(n + 1.0))


def weighted_match(original: np.ndarray, sanitized: np.ndarray, weight: np.ndarray, other: np.ndarray) -> dict[str, float]:
    """Precision, recall and F of matching each of two lists of vectors with its nearest by cosine in the other, where
    each match counts by its own weight. An empty list scores 0; if all weights of a list are 0 they count alike."""
    if not len(original) or not len(sanitized):
        return {"precision": 0.0, "recall": 0.0, "f1": 0.0}
    size = lambda v: np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    cosine = (sanitized / size(sanitized)) @ (original / size(original)).T
    mean = lambda x, w: float(x @ w / w.sum()) if w.sum() > 0 else float(x.mean())
    p, r = mean(cosine.max(axis=1), other), mean(cosine.max(axis=0), weight)
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r > 0 else 0.0}


_MATCHED = pa.struct([(x, pa.float64()) for x in ("precision", "recall", "f1")])


def matched(original: Column, sanitized: Column, weight: Column, other: Column) -> Column:
    """weighted_match of two arrays of vectors and their weights, as a struct."""

    def rows(v) -> np.ndarray:
        return matrix(v.values) if len(v.values) else np.zeros((0, 1))

    def run(a: pa.Array, b: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        out = [weighted_match(*(rows(v) if v.is_valid else np.zeros((0, 1)) for v in vs), *(np.array(w.as_py() or [], np.float64) for w in ws)) for *vs, ws in zip(a, b, zip(x, y))]
        return pa.array(out, _MATCHED)

    return F.arrow_udf(run, "struct<precision:double,recall:double,f1:double>")(original, sanitized, weight, other)


def scores(pairs: DataFrame, vectors: Vectors, key: str = "doc_id", original: str = "original", sanitized: str = "sanitized") -> DataFrame:
    """key, precision, recall, f1 of each pair of texts: greedy matching of word vectors, weighed by rarity in the originals.

    A word's vector is what was learnt and its letters' hashed runs of three, half each; a word without a learnt
    one has its letters only. Distinct words get their vectors by joins, then meet again by text.
    """
    known, unknown = rarity(pairs, original)
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), tokens(F.col(c)).alias("ws")) for i, c in enumerate((original, sanitized))])).alias("s")
    held = stored(pairs.select(F.col(key), sides).select(key, "s.side", F.posexplode("s.ws").alias("at", "word")), "match-words")
    dim = vectors.dim

    @F.arrow_udf("array<double>")
    def whole(word: pa.Array, learnt: pa.Array) -> pa.Array:
        letters = hashed_rows([[f"^{w}$"[i : i + 3] for i in range(len(w))] for w in word.to_pylist()], LETTERS_DIM)
        out = np.zeros((len(word), dim + LETTERS_DIM))
        out[:, dim:] = letters
        has = learnt.is_valid().to_numpy(zero_copy_only=False)
        if has.any() and dim:
            out[has, :dim] = matrix(learnt.filter(learnt.is_valid()))
            out[has] *= np.sqrt(0.5)
        return list_column(out)

    table = held.select("word").distinct().join(vectors.table, "word", "left").join(known, "word", "left")
    table = stored(table.select("word", whole("word", "learnt").alias("v"), F.coalesce("weight", F.lit(unknown)).alias("weight")), "match-vectors")
    side = lambda i: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == i, F.struct("at", "weight", "v")))), lambda x: F.struct(x.weight.alias("weight"), x.v.alias("v")))
    texts = held.join(table, "word").groupBy(key).agg(side(0).alias("a"), side(1).alias("b"))  # MOST_WORDS a side at most
    texts = pairs.select(key).join(texts, key, "left").select(key, *[F.coalesce(F.col(x), F.array().cast(texts.schema[x].dataType)).alias(x) for x in ("a", "b")])
    return texts.select(key, matched(F.col("a.v"), F.col("b.v"), F.col("a.weight"), F.col("b.weight")).alias("s")).select(key, "s.*")
