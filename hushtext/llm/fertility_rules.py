"""Quality rules from tokeniser fertility.

Two public vocabularies split the words of a text: one with byte fallback, and one of bytes for many languages.
Characters per token of either, the share of byte-fallback tokens and the entropy of the token distribution fall into
narrow bands for prose of one language or script, and outside them for dumps, encodings and spam. Base rules count words, symbols,
repeated lines and words in repeated windows. Texts are measured
once, with no shuffle; bands are fitted to the measures of all labelled rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hushtext.llm._common import UnitMemo, aside, map_batches, only, stored

DEFAULT_VOCABULARY, SECOND_VOCABULARY = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: Characters of a piece of a word that the second vocabulary can't take whole, as it is too long for its pattern.
PIECE_CHARS = 10_000
#: The six characters that end a word; bytes.split() knows the same.
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30


class Band(NamedTuple):
    """Rejection limits: characters per token, share of byte-fallback tokens, bits of token entropy, and characters per
    token of the second vocabulary.

    Entropy grows with a text's length, so its limits are taken from the entropy that is usual at that length: a
    curve a * x * x + b * x + c of x, the binary logarithm of the number of tokens, held to span.
    """

    chars_low: float
    chars_high: float
    bytes_high: float
    entropy_low: float
    entropy_high: float
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    span: tuple[float, float] = (0.0, 64.0)
    second_low: float = 0.0
    second_high: float = 1e9


#: Bands without labelled text, by script: what lies outside is hardly prose of any language. Text of words that the
#: vocabularies know has more characters per token, so the upper limits are wide for all, and never fitted.
DEFAULTS: dict[str, Band] = {
    "latin": Band(1.5, 9.0, 0.2, 2.5, 13.0, second_low=1.4),
    "cyrillic": Band(1.1, 9.0, 0.2, 2.5, 13.0),
    "greek": Band(0.5, 9.0, 0.5, 2.5, 13.0),
    "cjk": Band(0.3, 4.0, 0.85, 2.5, 13.0),
    "other": Band(0.2, 9.0, 0.95, 2.5, 13.0),
}
#: Share of good labelled text beyond a fitted limit, before it is moved out by MARGIN of its distance from the middle;
#: good labelled rows that a language or script must have.
TAIL, MARGIN, LEAST_LABELLED = 0.001, 0.1, 100
#: First code point of each block, and its script.
BLOCKS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2E80, "cjk"), (0xE000, "other")]
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, second_chars_per_token double, script string"


def script(text: str) -> str:
    """The script of most letters; of digits and marks alone, other."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    points, counts = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_counts=True)
    letter = np.array([chr(p).isalpha() for p in points.tolist()])
    if not letter.any():
        return "other"
    at = np.searchsorted([b for b, _ in BLOCKS], points[letter], "right") - 1
    votes: dict[str, int] = {}
    for block, n in zip(at.tolist(), counts[letter].tolist()):
        votes[BLOCKS[block][1]] = votes.get(BLOCKS[block][1], 0) + n
    return max(votes, key=votes.get)


def repeated_window_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window found twice or more. words: a number for each distinct word."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        hashes = np.zeros(n, np.uint64)
        for i in range(window):
            hashes = hashes * np.uint64(0xBF58476D1CE4E5B9) + mixed[i : i + n]
    if len(np.unique(hashes)) == n:  # equal windows have equal hashes
        return 0
    # numbers of windows of 2, 4, 8 ... words, from those of their halves: exact
    number, width = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while width < window:
        step = min(width, window - width)
        pairs = number[: len(number) - step] * (len(number) + 1) + number[step:]
        number, width = np.unique(pairs, return_inverse=True)[1].astype(np.int64), width + step
    twice = np.bincount(number)[number] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


class Fertility:
    def __init__(self, path: str, second: str):
        import sentencepiece
        from tiktoken import Encoding

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.memo = UnitMemo(lambda words: self.model.encode([w.decode() for w in words], num_threads=1), 250_000, self._second_tokens)
        with open(second, "rb") as f:
            ranks = {base64.b64decode(form): int(rank) for form, rank in map(bytes.split, f)}
        self.second = Encoding(second, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, np.int64)
        self.opens[[i for form, i in ranks.items() if form[:1] == b" "]] = 1

    def _second_tokens(self, words: list[bytes]) -> list[int]:
        """Tokens of each word with a space before it, as it stands in a text."""
        try:
            ids = self.second.encode_to_numpy(f" {b' '.join(words).decode()}", disallowed_special=())
        except ValueError:
            ids = np.empty(0, np.int64)
        of = np.cumsum(self.opens[ids]) - 1  # a space opens the first token of a word, and no other
        if len(ids) and of[0] == 0 and of[-1] == len(words) - 1:
            return np.bincount(of, minlength=len(words)).tolist()
        return [self._second(f" {w.decode()}") for w in words]

    def _second(self, word: str) -> int:
        try:
            return len(self.second.encode_to_numpy(word, disallowed_special=()))
        except ValueError:
            return sum(len(self.second.encode_to_numpy(word[i : i + PIECE_CHARS], disallowed_special=())) for i in range(0, len(word), PIECE_CHARS))

    def measure(self, text: str) -> tuple:
        words = text.encode().split()
        chars = len(text) - sum(map(text.count, BLANKS))
        symbols = sum(map(text.count, SYMBOLS))
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        numbers, ids, second = self.memo.both(words)
        repeats = repeated_window_words(numbers)
        base = (len(words), chars, symbols, len(lines) - len(set(lines)), repeats)
        if not len(ids):
            return (*base, 0, None, None, None, None, script(text))
        counts = np.bincount(ids)
        p = counts[counts > 0] / len(ids)
        return (*base, len(ids), chars / len(ids), float(self.byte[ids].mean()), float(-(p * np.log2(p)).sum()), chars / second, script(text))


def model(path: str, second: str) -> Fertility:
    return only(f"fertility {path} {second}", lambda: Fertility(path, second))


def measure(docs: DataFrame, path: str | None = None, second: str | None = None) -> DataFrame:
    """All columns of docs and METRICS, whose names replace columns of docs."""
    path, second = path or public_tokenizers.path(DEFAULT_VOCABULARY), second or public_tokenizers.path(SECOND_VOCABULARY)
    names = [x.split()[0] for x in METRICS.split(", ")]
    docs = docs.drop(*names)

    def run(batches):
        m = model(path, second)
        for batch in batches:
            rows = [m.measure(t.as_py() or "") for t in batch.column("text")]
            kinds = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[x.split()[1]] for x in METRICS.split(", ")]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    schema = StructType(list(docs.schema.fields))
    for x in METRICS.split(", "):
        schema = schema.add(*x.split())
    return map_batches(docs, run, schema)


def _base(rows: DataFrame) -> DataFrame:
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    return rows.withColumn("base_failed", (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words))


def _language(df: DataFrame, language: str):
    return F.lower(F.col(language)) if language in df.columns else F.lit(None).cast("string")


def fit_bands(docs: DataFrame, labels: DataFrame, path: str | None = None, second: str | None = None, language: str = "lang") -> dict[str, Band]:
    """Bands by language, and by script, of all good labelled rows (quality 1) that pass the base rules.

    The lower limits of characters per token and of entropy are quantiles at TAIL, moved out; that of byte-fallback
    tokens is the quantile at the other end. Entropy is taken from a curve of least squares, by sums of each group;
    it is held to the lengths of the labelled rows. A language or script with fewer than LEAST_LABELLED rows gets no
    band: the default of the script holds. Labels join by doc_id, null ones don't; the rows of a doc_id count one by
    one. No labels, or an empty table: the defaults.
    """
    wanted = docs.select("doc_id", "text", _language(docs, language).alias(language))
    ids = _good(labels)  # texts without one needn't be measured
    return fit_measured(_base(measure(wanted.join(ids, F.col("doc_id").cast("long") == ids["__good"], "left_semi"), path, second)), labels, language)


def _good(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__good")).distinct()


def fit_measured(measured: DataFrame, labels: DataFrame, language: str = "lang") -> dict[str, Band]:
    """fit_bands() of rows that have METRICS and base_failed: only these are joined to labels, in one shuffle of no texts."""
    spark = measured.sparkSession
    rows = measured.where("not base_failed").withColumn("language", _language(measured, language)).select(F.col("doc_id").cast("long").alias("__id"), "language", "script", "n_tokens", "token_entropy", "chars_per_token", "second_chars_per_token", "byte_share")
    rows = rows.join(_good(labels), F.col("__id") == F.col("__good"), "left_semi")
    names = F.explode(F.array_distinct(F.filter(F.array("language", F.col("script")), lambda x: x.isNotNull())))
    held = stored(rows.select(names.alias("name"), F.log2("n_tokens").alias("x"), F.col("token_entropy").alias("y"), "chars_per_token", "second_chars_per_token", "byte_share"), "bands-rows")
    high = held.groupBy("name").agg(F.count("*").alias("n"), F.percentile_approx("x", 0.99, 10_000).alias("high")).where(F.col("n") >= LEAST_LABELLED)
    held = held.join(F.broadcast(high), "name").withColumn("x", F.least(F.greatest("x", F.lit(math.log2(MIN_WORDS))), "high"))  # a row a language
    powers = [F.sum(F.pow("x", F.lit(i))).alias(f"x{i}") for i in range(5)] + [F.sum(F.col("y") * F.pow("x", F.lit(i))).alias(f"y{i}") for i in range(3)]
    curves = {}
    for r in held.groupBy("name", "high").agg(*powers).collect():
        fit = np.linalg.lstsq(np.array([[r[f"x{i + j}"] for j in range(3)] for i in range(3)]), np.array([r[f"y{i}"] for i in range(3)]), rcond=None)[0]
        curves[r["name"]] = (tuple(float(v) for v in fit[::-1]), float(r["high"]))
    if not curves:
        return dict(DEFAULTS)
    told = F.broadcast(spark.createDataFrame([(k, *c) for k, (c, _) in curves.items()], "name string, c2 double, c1 double, c0 double"))
    rest = held.join(told, "name").withColumn("bits", F.col("y") - (F.col("x") * F.col("x") * F.col("c2") + F.col("x") * F.col("c1") + F.col("c0")))
    quantiles = lambda c, qs: F.percentile_approx(c, qs, 100_000).alias(c)
    out = dict(DEFAULTS)
    found = rest.groupBy("name").agg(*[quantiles(c, [TAIL, 0.5]) for c in ("chars_per_token", "second_chars_per_token", "bits")], quantiles("byte_share", [0.5, 1 - TAIL]))
    for r in found.collect():
        low = lambda c: r[c][0] - MARGIN * (r[c][1] - r[c][0])  # noqa: B023, E731
        curve, high = curves[r["name"]]
        out[r["name"]] = Band(low("chars_per_token"), 9.0, r["byte_share"][1] + 0.05, low("bits"), 13.0, curve, (math.log2(MIN_WORDS), high), low("second_chars_per_token"))
    return out


def judge(docs: DataFrame, path: str | None = None, second: str | None = None, bands: Mapping[str, Band] = DEFAULTS, language: str = "lang") -> DataFrame:
    """docs with METRICS, base_failed and kept.

    The band is that of the language column, if there is one and bands has its value, else of the script.
    Null and empty texts have no words and so fail the base rules; a row is judged by itself, so repeated
    rows fare alike; a very long text is measured whole; an empty table gives no rows. Columns of docs with the names
    of results are replaced.
    """
    return _judged(_base(measure(docs.drop("base_failed", "kept"), path, second)), bands, language)


def judge_fitted(docs: DataFrame, labels: DataFrame, path: str | None = None, second: str | None = None, language: str = "lang", text: bool = True) -> DataFrame:
    """judge() with the bands that fit_bands() gives for docs and labels. Texts are measured once, and what was measured is stored;
    without text the column text is left out."""
    measured = _base(measure(docs.drop("base_failed", "kept"), path, second))
    measured = stored(measured if text else measured.drop("text"), "measured")
    return _judged(measured, fit_measured(measured, labels, language), language)


def _judged(rows: DataFrame, bands: Mapping[str, Band], language: str) -> DataFrame:
    lang = _language(rows, language)
    name = F.when(F.coalesce(lang.isin(*bands), F.lit(False)), lang).otherwise(F.col("script"))
    inside = F.lit(False)
    for key, b in bands.items():
        x = F.least(F.greatest(F.log2(F.col("n_tokens")), F.lit(b.span[0])), F.lit(b.span[1]))
        bits = F.col("token_entropy") - (x * x * b.curve[0] + x * b.curve[1] + b.curve[2])
        fits = F.col("chars_per_token").between(b.chars_low, b.chars_high) & (F.col("byte_share") <= b.bytes_high) & bits.between(b.entropy_low, b.entropy_high) & F.col("second_chars_per_token").between(b.second_low, b.second_high)
        inside = inside | ((name == key) & fits)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


RESULTS = (*[x.split()[0] for x in METRICS.split(", ")], "base_failed", "kept")


def kept(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The rows of docs that pass, with the columns of docs, whatever their names. labels: bands are fitted to them."""
    rows, back = aside(docs, RESULTS)
    return back((judge(rows, **options) if labels is None else judge_fitted(rows, labels, **options)).where("kept"))
