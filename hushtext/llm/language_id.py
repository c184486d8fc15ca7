"""Language identification by Bayesian evidence fusion.

A page's language has a prior from its host, and three kinds of evidence: its text, the language that its
markup (or metadata) declares, and the suffix of its address. Host priors come from grouped aggregation and
are smoothed hierarchically: a host towards its suffix, a suffix towards the whole table. Text likelihoods
come from byte n-grams. Likelihoods of declarations and of suffixes under each language are grouped counts too, of rows by the
language that their text alone tells. The class und (undetermined) models text in none of the languages as bytes without an order.

The passes that count read no text. The one that decides moves no rows: hosts are joined by a broadcast of
checked size, or by a salted shuffle beyond it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hushtext.llm._common import aside, map_batches, only, stored

#: Rows of each declared language from which the text model is counted, least hashes first.
TRAIN_ROWS = 2_000
GRAM_BITS = 16
#: Strength of a prior in rows: of a suffix for its hosts, and of the whole table for a suffix.
HOST_PRIOR, SUFFIX_PRIOR = 20.0, 100.0
#: Rows of each language that are added to the counts of declarations and suffixes by it, spread as in the whole table.
EVIDENCE_PRIOR = 50.0
#: Bytes of text that count as independent evidence: n-grams overlap, so a text says less than their product.
TEXT_TEMPER = 0.25
MIN_POSTERIOR = 0.5
BROADCAST_HOSTS = 100_000
#: Copies of a host's row where it has more than HOT_ROWS rows, for a join by shuffle.
SALTS, HOT_ROWS = 64, 1_000_000
UND = "und"
_BLOCK = 1 << 20
RESULTS = ("language", "posterior", "text_language", "kept")


def _grams(data: np.ndarray) -> np.ndarray:
    """Slots of the 3-byte grams of data."""
    x = data.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)


#: Marks and digits to a space, so that only letters tell.
_LETTERS = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def letters(text: str) -> np.ndarray:
    """The text's bytes in lower case; runs of other characters than letters are one space."""
    raw = _LETTERS[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    return raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]


class TextModel:
    """Mean log-likelihoods by language of hashed 3-byte grams, and und, in which all grams are alike."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UND]
        logs = np.log((counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * counts.shape[1]))
        # und: letters in any order, that is, grams spread over what the languages use and the rest alike
        self.table = np.vstack([logs, np.full(counts.shape[1], np.log(1 / 4096))]).T.astype(np.float32).copy()

    def log_likelihoods(self, text: str) -> np.ndarray | None:
        """By language; None for a text without letters."""
        data = letters(text)
        if len(data) < 3:
            return None
        out = np.zeros(len(self.languages))
        for at in range(0, len(data) - 2, _BLOCK):
            out += self.table[_grams(data[at : at + _BLOCK + 2])].sum(axis=0, dtype=np.float64)
        return out * TEXT_TEMPER


_LANG = re.compile(r"\slang\s*=\s*[\"']?([a-z]{2,3})", re.I | re.A)
_HTML, _OPEN = re.compile("<html", re.I | re.A), re.compile(r"<(script|style)\b", re.I | re.A)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I | re.A) for name in ("script", "style")}
_ENTITY = re.compile(r"&#?\w+;", re.A)


def declared_in(html: str) -> str | None:
    """The lang attribute of the first html tag that has one, the last one in it, without its region. Each tag is
    searched once, as far as its end, so time grows with the page alone."""
    at = 0
    while m := _HTML.search(html, at):
        end = html.find(">", m.end())
        end = len(html) if end < 0 else end
        if found := _LANG.findall(html, m.end(), end):
            return found[-1].lower()
        at = end
    return None


def text_in(html: str) -> str:
    """A page's text: without scripts, styles, comments and tags; those that are never closed are text, as is a lone <.

    What is looked for in vain once isn't looked for again: one pass over the page, whatever it holds.
    """
    out, at, seen = [], 0, 0
    lost: set[str] = set()
    while m := _OPEN.search(html, seen):
        name = m.group(1).lower()
        end = None if name in lost else _CLOSE[name].search(html, m.end())
        if end:
            out += html[at : m.start()], " "
            at = seen = end.end()
        else:
            lost.add(name)
            seen = m.end()
    bare = "".join([*out, html[at:]])
    out, at, seen = [], 0, 0
    lost.clear()
    while (start := bare.find("<", seen)) >= 0:
        end = -1
        for opening, closing in (("<!--", "-->"), ("<", ">")):
            if closing not in lost and bare.startswith(opening, start):
                end = bare.find(closing, start + len(opening))
                if end >= 0:
                    end += len(closing)
                    break
                lost.add(closing)
        if end >= 0:
            out += bare[at:start], " "
            at = seen = end
        else:
            seen = start + 1
    return _ENTITY.sub(" ", "".join([*out, bare[at:]]))


def declared_language(html) -> "F.Column":
    """declared_in of a column."""
    return F.arrow_udf(lambda x: pa.array([None if t is None else declared_in(t) for t in x.to_pylist()], pa.string()), "string")(html)


def host_of(url) -> "F.Column":
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def suffix_of(host) -> "F.Column":
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def page_text(html) -> "F.Column":
    """text_in of a column."""
    return F.arrow_udf(lambda x: pa.array([None if t is None else text_in(t) for t in x.to_pylist()], pa.string()), "string")(html)


def fit_text(items: DataFrame, languages: list[str]) -> TextModel:
    """A text model from at most TRAIN_ROWS rows that declare each of the languages. items: text, declared, key."""
    order = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary"))
    keys = items.select("key", "declared").where("key is not null")
    some = None
    for name in languages:
        part = keys.where(F.col("declared") == name).orderBy(order, "key").limit(TRAIN_ROWS)
        some = part if some is None else some.unionByName(part)
    some = stored(some.distinct(), "language-rows")
    rows = items.select("text", "declared", "key").join(F.broadcast(some), ["key", "declared"])  # at most TRAIN_ROWS keys a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << GRAM_BITS), np.int64)
        for batch in batches:
            for t, name in zip(batch.column("text"), batch.column("declared").to_pylist()):
                data = letters(t.as_py() or "")
                for at in range(0, len(data) - 2, _BLOCK):
                    total[languages.index(name)] += np.bincount(_grams(data[at : at + _BLOCK + 2]), minlength=1 << GRAM_BITS)
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k, at])], ["k", "slot", "n"])

    counts = np.zeros((len(languages), 1 << GRAM_BITS))
    found = map_batches(rows.select("text", "declared"), run, "k int, slot int, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts[found["k"].to_numpy(np.int64), found["slot"].to_numpy(np.int64)] = found["n"].to_numpy()
    return TextModel(languages, counts)


def _evidence(rows: DataFrame, text: str, told, names: list[str]) -> DataFrame:
    """__declared, __suffix, and for each language the number of rows whose text alone tells it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = only("language", lambda: None) or told.value  # gives back what a stage before held
        for batch in batches:
            found: dict = {}
            for t, *k in zip(batch.column(text), batch.column("__declared").to_pylist(), batch.column("__suffix").to_pylist()):
                said = model.log_likelihoods(t.as_py() or "")
                if said is not None and (best := int(said.argmax())) < len(names):
                    found.setdefault(tuple(k), [0] * len(names))[best] += 1
            kinds = [pa.string(), pa.string(), *[pa.int64()] * len(names)]
            columns = zip(*[(*k, *n) for k, n in found.items()]) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["__declared", "__suffix", *names])

    known = rows.where("__declared is not null or __suffix is not null").select(text, "__declared", "__suffix")
    counted = map_batches(known, run, "__declared string, __suffix string, " + ", ".join(f"`{x}` long" for x in names))
    return stored(counted.groupBy("__declared", "__suffix").agg(*[F.sum(x).alias(x) for x in names]), "language-evidence")


def _with_hosts(rows: DataFrame, table: DataFrame, name: str, key: str) -> DataFrame:
    """rows joined with a row of table for each value of the column name: by broadcast up to BROADCAST_HOSTS, else salted."""
    if table.count() <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(table), name, "left")
    # only values of many rows are dealt over salts
    hot = rows.groupBy(name).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT_ROWS).select(name, F.lit(SALTS).alias("__salts"))
    hot = F.broadcast(stored(hot, "language-hot"))  # at most the table's rows / HOT_ROWS
    salted = table.join(hot, name, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    salt = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.coalesce("__salts", F.lit(1))).cast("int")
    return rows.join(hot, name, "left").withColumn("__salt", salt).drop("__salts").join(salted, [name, "__salt"], "left").drop("__salt")


def identify(docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source", suffix: str | None = None, key: str = "doc_id", languages: tuple[str, ...] = ("de", "en", "es", "fr"), min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """docs with language (of the highest posterior), posterior, text_language (by text alone) and kept.

    kept: the language is not und and its posterior is min_posterior or more. A row's own declaration doesn't
    count in its host's prior. Null, empty and letterless texts are und with posterior 1 and not kept; a null
    declaration, host or suffix is no evidence; of equal posteriors the first language by name wins; rows
    are judged one by one, so repeated rows fare alike; a very long text is read whole; an empty table gives no rows.
    Columns of docs with the names of results are replaced.
    """
    docs = docs.drop(*RESULTS)
    none = F.lit(None).cast("string")
    column = lambda c: F.col(c) if c else none
    known = F.lower(column(declared))
    names = sorted(languages)
    rows = docs.withColumns({"__declared": F.when(known.isin(names), known), "__host": column(host), "__suffix": F.lower(column(suffix))})
    counts = rows.groupBy("__host", "__suffix").agg(*[F.sum((F.coalesce(F.col("__declared"), F.lit("")) == x).cast("long")).alias(x) for x in names])
    counts = stored(counts, "language-hosts")
    total = counts.agg(*[F.sum(x).alias(x) for x in names]).first()
    whole = np.array([float(total[x] or 0) for x in names]) + 1.0
    whole /= whole.sum()
    model = fit_text(rows.select(F.col(text).alias("text"), F.col("__declared").alias("declared"), F.col(key).alias("key")), names)
    suffixes = counts.groupBy("__suffix").agg(*[F.sum(x).alias(x) for x in names])
    by_suffix = suffixes.select("__suffix", F.array(*names).cast("array<double>").alias("__by_suffix"))
    by_host = counts.where("__host is not null").groupBy("__host").agg(F.max("__suffix").alias("__hs"), *[F.sum(x).alias(x) for x in names])
    by_host = by_host.select("__host", F.col("__hs").alias("__suffix_of_host"), F.array(*names).cast("array<double>").alias("__by_host"))
    told = docs.sparkSession.sparkContext.broadcast(model)
    evidence = _evidence(rows, text, told, names)
    by_declared = {r["__declared"]: np.array(r["n"]) for r in evidence.where("__declared is not null").groupBy("__declared").agg(F.array(*[F.sum(x) for x in names]).alias("n")).collect()}  # one of names each
    seen = np.array([by_declared.get(x, np.zeros(len(names))) for x in names], np.float64)  # by declaration and language
    share = (seen.sum(axis=1) + 1) / (seen.sum() + len(names))
    say = np.log((seen + EVIDENCE_PRIOR * share[:, None]) / (seen.sum(axis=0) + EVIDENCE_PRIOR))
    by_end = stored(evidence.where("__suffix is not null").groupBy("__suffix").agg(F.array(*[F.sum(x) for x in names]).cast("array<double>").alias("__ends")), "language-suffixes")
    with_suffix = np.array(by_end.agg(*[F.coalesce(F.sum(F.col("__ends")[i]), F.lit(0.0)) for i in range(len(names))]).first(), np.float64)
    rows = _with_hosts(rows, by_end, "__suffix", key)
    priors = by_host.join(by_suffix, F.col("__suffix_of_host").eqNullSafe(F.col("__suffix")), "left").select("__host", "__by_host", "__by_suffix")
    priors = stored(priors, "language-priors")
    rows = _with_hosts(rows, priors, "__host", key)
    inputs = ["__declared", "__ends", "__by_host", "__by_suffix"]
    kept_columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        n = len(names)
        neutral = np.log(1 / n)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t, d, s, h, hs in zip(batch.column(text), *(batch.column(c).to_pylist() for c in inputs)):
                said = model.log_likelihoods(t.as_py() or "")
                if said is None:
                    for x, v in zip(out, (UND, 1.0, UND, False)):
                        x.append(v)
                    continue
                own = np.zeros(n)
                if d is not None:
                    own[names.index(d)] = 1
                prior = whole
                if hs is not None:
                    rest = np.maximum(np.array(hs) - own, 0)
                    prior = (rest + SUFFIX_PRIOR * prior) / (rest.sum() + SUFFIX_PRIOR)
                if h is not None:
                    rest = np.maximum(np.array(h) - own, 0)
                    prior = (rest + HOST_PRIOR * prior) / (rest.sum() + HOST_PRIOR)
                log = said + np.append(np.log(prior * 0.99), np.log(0.01))
                if d is not None:
                    log += np.append(say[names.index(d)], neutral)
                if s is not None:  # the row itself is one of those that were counted
                    ends = np.maximum(np.array(s) - own, 0)
                    usual = (ends.sum() + 1) / (with_suffix.sum() + 1)
                    ends = np.log((ends + EVIDENCE_PRIOR * usual) / (with_suffix + EVIDENCE_PRIOR))
                    log += np.append(ends, np.log(usual))
                post = np.exp(log - log.max())
                post /= post.sum()
                best = int(post.argmax())
                name = model.languages[best]
                for x, v in zip(out, (name, float(post[best]), model.languages[int(said.argmax())], name != UND and post[best] >= min_posterior)):
                    x.append(v)
            made = [pa.array(x, k) for x, k in zip(out, (pa.string(), pa.float64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept_columns), *made], [*kept_columns, *RESULTS])

    schema = StructType([docs.schema[c] for c in kept_columns])
    for name, kind in zip(RESULTS, ("string", "double", "string", "boolean")):
        schema = schema.add(name, kind)
    return map_batches(rows.select(*kept_columns, *inputs), run, schema)


def kept(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs in one of the languages, with the columns of docs, whatever their names."""
    rows, back = aside(docs, RESULTS)
    return back(identify(rows, **options).where("kept"))


def identify_pages(pages: DataFrame, **options) -> DataFrame:
    """page_id, language, posterior, text_language, kept of web pages (page_id, url, html). Null pages are und; a null or
    broken url gives no host and no suffix; repeated rows stay; an empty table gives no rows; further columns go."""
    host = host_of(F.col("url"))
    rows = pages.select("page_id", page_text(F.col("html")).alias("text"), declared_language(F.col("html")).alias("lang"), host.alias("host"), suffix_of(host).alias("suffix"))
    return identify(rows, host="host", suffix="suffix", key="page_id", **options).select("page_id", *RESULTS)
