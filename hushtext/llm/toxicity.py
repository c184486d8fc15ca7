"""Toxicity from class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, of toxic and of ordinary text, are counted from labelled rows. Both
end in one unigram of continuation counts over both classes, so an expression that a class has hardly seen
gets nearly the same probability from either model. A text's evidence is the difference of the two
log-likelihoods: its mean over the whole text, and its largest sum over a short window, each normalised by
length. A logistic curve over these, fitted on labelled rows that no count has seen, makes a score of 0 to 1.

Counts are grouped aggregations over all labelled rows of the folds to learn from, so they grow with the input;
only the curve takes a bounded sample. The difference that a word makes, and what its context adds to it, are
worked out by joins of the counts. Scoring is one pass with that table on the workers while it has MODEL_ENTRIES
entries at most; a larger one is joined to the words of the texts, with the same scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtext.llm._common import map_batches, stored, word_hashes

#: Labelled rows of each class on which the curve is fitted; least hashes first. The models are counted from all rows.
CURVE_ROWS = 6_000
#: Labelled ids that are broadcast, of 12 bytes each; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Entries of the evidence that are broadcast to workers, of 12 bytes each; more are joined.
MODEL_ENTRIES = 8_000_000
#: Taken off each count, so that what a class has once is left to the shared counts: the largest Kneser-Ney discount.
DISCOUNT = 1.0
#: Added to each word's shared count: the rarer a word, the more both classes have of it.
SHARED_MORE = 10.0
#: Bound, in nats, of what a word's context adds to its evidence.
CONTEXT_MOST = 0.5
WINDOW = 6
WORD = re.compile(r"\w+")
_START = np.uint64(0x51_7C_C1_B7_27_22_0A_95)


def _hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return word_hashes().of(words)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair of words."""
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _keys(words: np.ndarray) -> np.ndarray:
    """Under which the evidence has each word, and the pair of each word with the one before it."""
    return np.concatenate([words, _pair(np.concatenate([[_START], words[:-1]]), words)])


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in sorted keys; the number of keys where there is none."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, len(keys)) if len(keys) else np.zeros(len(wanted), np.int64)


def _features(d: np.ndarray) -> list[float]:
    """Length-normalised evidence from the differences of a text's words: a constant, the mean over the text, the best
    window, the best word."""
    if not len(d):
        return [1.0, 0.0, 0.0, 0.0]
    sums = np.concatenate([[0.0], np.cumsum(d)])
    w = min(WINDOW, len(d))
    return [1.0, float(d.mean()) * 10, float((sums[w:] - sums[:-w]).max()) / math.sqrt(WINDOW), float(d.max())]


class Model:
    """evidence: key, d, a stored table of the log-likelihoods as toxic less those as ordinary text, of words and of
    what pairs add to them; entries: its rows; weights: of the curve over the features of a text."""

    def __init__(self, evidence: DataFrame, entries: int):
        self.evidence, self.entries = evidence, entries
        self.weights, self._told = np.array([-2.0, 0.0, 0.5, 0.5]), None

    def told(self):
        """The sorted keys and their differences, broadcast."""
        if self._told is None:
            columns = _columns(self.evidence)
            keys = columns["key"].view(np.uint64)
            order = np.argsort(keys)
            self._told = self.evidence.sparkSession.sparkContext.broadcast((keys[order], np.append(columns["d"][order], np.float32(0))))
        return self._told

    def looked_up(self, docs: DataFrame) -> DataFrame:
        """docs without its texts, and x, the features of each."""
        return self._by_broadcast(docs) if self.entries <= MODEL_ENTRIES else self._by_join(docs)

    def _by_broadcast(self, docs: DataFrame) -> DataFrame:
        told, names = self.told(), [c for c in docs.columns if c != "text"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, d = told.value
            for batch in batches:
                x = []
                for t in batch.column("text"):
                    words = _hashes(t.as_py() or "")
                    found = d[_find(keys, _keys(words))].astype(np.float64) if len(words) else d[:0]
                    x.append(_features(found[: len(words)] + found[len(words) :]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

        schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
        return map_batches(docs, run, f"{schema}, x array<double>")

    def _by_join(self, docs: DataFrame) -> DataFrame:
        """Equal texts are looked up once; a word that a third of all places hold is a skewed key of a sort-merge join,
        which adaptive execution splits."""
        docs = docs.withColumn("__text", F.md5(F.coalesce("text", F.lit("")).cast("binary")))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, t in zip(batch.column("__text"), batch.column("text")):
                    words = _hashes(t.as_py() or "")
                    at = pa.array(np.tile(np.arange(len(words), dtype=np.int32), 2))
                    n = pa.array(np.full(2 * len(words), len(words), np.int32))
                    keys = pa.array(_keys(words).view(np.int64) if len(words) else [], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(at)), n, at, keys], ["__text", "n", "at", "key"])

        def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = []
                for n, found in zip(batch.column("n").to_pylist(), batch.column("found")):
                    at, d = found.values.flatten()
                    sums = np.zeros(n)
                    np.add.at(sums, at.to_numpy(), d.to_numpy().astype(np.float64))
                    x.append(_features(sums))
                yield pa.RecordBatch.from_arrays([batch.column("__text"), pa.array(x, pa.list_(pa.float64()))], ["__text", "x"])

        texts = docs.select("__text", "text").dropDuplicates(["__text"])
        found = map_batches(texts, places, "__text string, n int, at int, key long").join(self.evidence, "key")
        found = found.groupBy("__text").agg(F.first("n").alias("n"), F.collect_list(F.struct("at", "d")).alias("found"))
        x = map_batches(found, put_together, "__text string, x array<double>")
        none = F.array(*[F.lit(v) for v in _features(np.zeros(0))])
        return docs.join(x, "__text", "left").withColumn("x", F.coalesce("x", none)).drop("__text", "text")


def fold(doc_id: Column) -> Column:
    """CRC-32 of a document's id as text, modulo 4; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression whose slopes aren't negative, so that more evidence never lowers a score: evidence that would
    get a negative slope is left out, the most negative first. weight: of how many rows each row stands."""
    used = list(range(x.shape[1]))
    while True:
        w = _newton(x[:, used], y, weight)
        if len(used) == 1 or w[1:].min() >= 0:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out
        del used[1 + int(w[1:].argmin())]


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _columns(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a bounded table, by Arrow, which makes no Python object of a row."""
    table = df.toArrow()
    return {c: table[c].to_numpy() for c in table.column_names}


def _least(labelled: DataFrame, n: int) -> DataFrame:
    """The n rows of least hash of each class."""
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    return labelled.where("toxic = 1").orderBy(key, "doc_id").limit(n).unionByName(labelled.where("toxic = 0").orderBy(key, "doc_id").limit(n))


def _pairs(rows: DataFrame) -> DataFrame:
    """a, b, n0, n1: in how many ordinary and toxic texts word b stands after word a."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for t, k in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                words = _hashes(t.as_py() or "")
                if len(words):
                    before = np.concatenate([[_START], words[:-1]])
                    pair, once = np.unique(_pair(before, words), return_index=True)  # a text counts once for what it repeats
                    parts.append((pair, before[once], words[once], np.full(len(once), k)))
            if parts:
                pair, a, b, k = map(np.concatenate, zip(*parts))
                _, first, which = np.unique(pair, return_index=True, return_inverse=True)
                toxic = np.bincount(which, k, len(first)).astype(np.int64)
                columns = [a[first].view(np.int64), b[first].view(np.int64), np.bincount(which) - toxic, toxic]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "n0", "n1"])

    return map_batches(rows, count, "a long, b long, n0 long, n1 long").groupBy("a", "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _left(n: str) -> Column:
    """What the discount leaves of a count."""
    return F.greatest(F.col(n) - F.lit(DISCOUNT), F.lit(0.0))


def _evidence(pairs: DataFrame) -> DataFrame:
    """key, d: for each word what its log-likelihood as toxic has more than that as ordinary text, with no context;
    for each pair of words what the first adds to that of the second. Where it's 0, there is no row.

    Both classes back off with one weight, so what neither has direct counts of makes no difference. A context
    that one class lacks says nothing.
    """
    endings = pairs.groupBy("b").agg(F.count_if(F.col("n0") > 0).alias("c0"), F.count_if(F.col("n1") > 0).alias("c1"), F.count("*").alias("shared"))
    endings = stored(endings, "toxic-endings")
    totals = endings.agg(F.sum(_left("c0")), F.sum(_left("c1")), F.sum(F.col("c0") + F.col("c1")), F.sum("shared"), F.count("*")).first()
    left0, left1, seen, shared, words = (float(x or 0) for x in totals)
    weight = 1 - (left0 + left1) / max(1.0, seen) if left0 and left1 else 1.0
    base = (F.col("shared") + SHARED_MORE) / (shared + SHARED_MORE * max(1.0, words))
    p0, p1 = (_left(c) * ((1 - weight) / max(left, 1e-9)) + base * weight for c, left in (("c0", left0), ("c1", left1)))
    endings = endings.select("b", "c0", "c1", p0.alias("p0"), p1.alias("p1"))
    contexts = pairs.groupBy("a").agg(F.sum(F.col("n0") + F.col("n1")).alias("seen"), F.sum(_left("n0")).alias("m0"), F.sum(_left("n1")).alias("m1"))
    contexts = stored(contexts.where("m0 > 0 and m1 > 0").withColumn("back", 1 - (F.col("m0") + F.col("m1")) / F.col("seen")), "toxic-contexts")
    direct = pairs.where(F.greatest("n0", "n1") > DISCOUNT).join(contexts, "a").join(endings, "b")
    q0, q1 = ((1 - F.col("back")) * _left(f"n{k}") / F.col(f"m{k}") + F.col("back") * F.col(f"p{k}") for k in (0, 1))
    # passages that copies share make rare pairs look certain: a context moves a word's evidence by so much at most
    more = F.log(F.greatest(q1, F.lit(1e-300)) / F.greatest(q0, F.lit(1e-300))) - F.log(F.col("p1") / F.col("p0"))
    more = F.greatest(F.lit(-CONTEXT_MOST), F.least(F.lit(CONTEXT_MOST), more))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(_pair(a, b).view(np.int64)), batch.column("d")], ["key", "d"])

    of_pairs = map_batches(direct.select("a", "b", more.cast("float").alias("d")), keyed, "key long, d float")
    of_words = endings.where(F.greatest("c0", "c1") > DISCOUNT).select(F.col("b").alias("key"), F.log(F.col("p1") / F.col("p0")).cast("float").alias("d"))
    return of_words.unionByName(of_pairs).where("d != 0")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from rows of docs whose doc_id has a label (0 or 1) in column toxic; others aren't used.

    Counts come from all rows of folds 0 and 1, the curve from fold 3; fold 2 is never learned from. The curve
    takes CURVE_ROWS rows of each class. A row of it stands for as many labelled rows as its class has for each
    that was taken, so scores keep their scale where the bound cuts one class more than the other. Repeated
    labels of a document: the highest counts. Equal texts count once, as toxic if one of them is; without rows
    of both classes in fold 3 the curve has fixed weights.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known.withColumn("fold", fold(F.col("doc_id"))).where("fold != 2"), "toxic-labels")
    sizes = known.groupBy("toxic", (F.col("fold") == 3).alias("curve")).agg(F.count("*").alias("n")).collect()  # 4 rows at most
    in_curve = {r["toxic"]: r["n"] for r in sizes if r["curve"]}
    some = known.where("fold < 2").unionByName(_least(known.where("fold = 3"), CURVE_ROWS))
    some = some.select("doc_id", "toxic", (F.col("fold") == 3).alias("curve"))
    small = sum(r["n"] for r in sizes) <= BROADCAST_LABELS
    rows = docs.select("doc_id", "text").join(F.broadcast(some) if small else some, "doc_id")
    rows = stored(rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("curve").alias("curve")), "toxic-rows")
    evidence = stored(_evidence(stored(_pairs(rows.where("not curve")), "toxic-pairs")), "toxic-evidence")
    model = Model(evidence, evidence.count())
    seen = model.looked_up(rows.where("curve").select("toxic", "text")).toArrow()  # at most 2 * CURVE_ROWS
    y = seen["toxic"].to_numpy().astype(np.float64)
    if len(np.unique(y)) == 2:
        x = seen["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        order = np.lexsort((*x.T, y))  # sums don't depend on the order of rows
        stands = np.array([max(1.0, in_curve.get(k, 0) / CURVE_ROWS) for k in (0, 1)])
        model.weights = _fit_curve(x[order], y[order], stands[y[order].astype(int)])
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    Null, empty and wordless texts get the score of no evidence. Equal texts score alike; repeated rows stay;
    a null doc_id stays null (its fold is that of the empty text); a very long text is scored whole; an empty
    table gives no rows; columns other than doc_id and text go.
    """
    seen = model.looked_up(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    z = sum((F.col("x")[i] * float(w) for i, w in enumerate(model.weights)), F.lit(0.0))
    s = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    scored = seen.select("doc_id", s.alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
