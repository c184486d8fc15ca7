"""What the operators of this subpackage share: the shared folder, cut lineage, memoised units."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushtext.operators.storage import fresh_path, stored

__all__ = ["fresh_path", "stored"]

#: Entries after which a worker starts its memo anew. It bounds memory only; results never depend on it.
MEMO_LIMIT = 300_000
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return map_batches(df, run, schema)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow, with this package on the workers' path."""
    worker_path(df.sparkSession)
    return df.mapInArrow(run, schema)


def worker_path(spark: SparkSession) -> None:
    """Bound the batches of Python workers, and put this package on the path of those that the driver's machine starts."""
    # rows and bytes of text that a batch holds, in the JVM and in Python
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def aside(docs: DataFrame, names) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns of these names put by under other names, and what brings docs' own columns back."""
    moved = {c: f"__own_{c}" for c in docs.columns if c.lower() in {n.lower() for n in names}}

    def back(df: DataFrame) -> DataFrame:
        return df.select(*[df[moved.get(c, c)].alias(c) for c in docs.columns])

    return docs.withColumnsRenamed(moved), back


#: Rows of a table that spread_join broadcasts (some 100 bytes each); beyond, the join shuffles, and keys of more than
#: HOT_ROWS rows are spread over SALTS keys.
BROADCAST_ROWS, HOT_ROWS, SALTS = 200_000, 10_000, 64


def text_print(text: str = "text"):
    """A digest of 16 bytes that tells texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def spread_join(rows: DataFrame, key: str, by: str, table: DataFrame, its: str, n: str) -> DataFrame:
    """rows with the columns of table (but n), which is stored and has its as key, once each; n: rows that have the key. Rows
    whose key it lacks have nulls.

    However many rows a key has, no task gets them all: the table is broadcast, or rows of hot keys are dealt over salts by
    the hash of column by.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(n)), F.col(key) == F.col(its), "left")
    is_hot = F.col(n) > HOT_ROWS
    # hot keys are few: there is one for each HOT_ROWS rows at most
    few = table.where(is_hot).select(F.col(its).alias("__hot"))
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)
    spread = rows.join(few, F.col(key) == F.col("__hot"), "left").withColumn("__salt", salt)
    salted = table.withColumn("__its_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0))))
    return spread.join(salted, (F.col(key) == F.col(its)) & (F.col("__salt") == F.col("__its_salt")), "left").drop("__hot", "__salt", "__its_salt", n)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts of a batch one at a time; null counts as empty."""
    for x in batch.column(name):
        yield x.as_py() or ""


def portions(items: Iterator[str], size: int = 8_000_000) -> Iterator[list[str]]:
    """Lists of texts of about so many characters together."""
    part, n = [], 0
    for t in items:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


_HELD: dict = {}


def only(name: str, make: Callable):
    """What a worker keeps between batches: one object at a time, so that stages of a job don't add up."""
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)  # give what it held back to the system
        _HELD[name] = make()
    return _HELD[name]


class WordHash(dict):
    """64-bit hashes of words, memoised: map(self.__getitem__, words) stays in C for words seen before."""

    def __missing__(self, word) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Generations:
    """Values of keys seen lately, in two generations of bounded size.

    make: a bytes value for each of a list of keys. When the young generation is full it becomes the old one, and
    what is asked for again comes back from there; so usual keys stay known, and rare ones go.
    """

    def __init__(self, make: Callable[[list], list[bytes]], limit: int):
        self.make, self.limit = make, limit
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def learn(self, keys: set) -> dict:
        """A dict that has all of keys until the next call."""
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        new, old, young = [], self.old, self.young
        for k in keys.difference(young):
            if (v := old.get(k)) is None:
                new.append(k)
            else:
                young[k] = v
                self.size += 150 + len(k) + len(v)  # a string, a bytes object and their place in the dict
        for k, v in zip(new, self.make(new) if new else ()):
            young[k] = v
            self.size += 150 + len(k) + len(v)
        return young


class UnitMemo:
    """Ids of text units, memoised as offsets into one flat array.

    encode: ids of each of a list of units. A text is a list of units whose ids stand one after another. weigh: a number
    of each of a list of units, of which both() gives the sum.
    """

    def __init__(self, encode: Callable[[list], list], limit: int = MEMO_LIMIT, weigh: Callable[[list], list[int]] | None = None):
        self.encode, self.limit, self.weigh = encode, limit, weigh or (lambda units: [0] * len(units))
        self._clear()

    def _clear(self) -> None:
        self.index: dict = {}
        self.flat, self.starts, self.sizes, self.weights = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32)
        self.n_flat = self.n_units = 0

    def _learn(self, units: list) -> None:
        new = self.encode(units)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        need, many = self.n_flat + int(sizes.sum()), self.n_units + len(new)
        while len(self.flat) < need:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.starts) < many:
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.empty_like(self.sizes)])
            self.weights = np.concatenate([self.weights, np.empty_like(self.weights)])
        self.flat[self.n_flat : need] = np.fromiter((i for x in new for i in x), np.int32, need - self.n_flat)
        self.sizes[self.n_units : many] = sizes
        self.weights[self.n_units : many] = self.weigh(units)
        self.starts[self.n_units : many] = self.n_flat + np.cumsum(sizes) - sizes
        self.index.update(zip(units, range(self.n_units, many)))
        self.n_flat, self.n_units = need, many

    def both(self, units: list) -> tuple[np.ndarray, np.ndarray, int]:
        """numbers and ids of units, and the sum of their weights."""
        at = self.numbers(units)
        return at, self._ids(at), int(self.weights[at].sum())

    def numbers(self, units: list) -> np.ndarray:
        """A number for each unit, valid until the next call."""
        if self.n_units > self.limit:
            self._clear()
        found = list(map(self.index.get, units))
        if None in found:
            self._learn([u for u in dict.fromkeys(units) if u not in self.index])
            found = list(map(self.index.__getitem__, units))
        return np.array(found, np.int64)

    def _ids(self, at: np.ndarray) -> np.ndarray:
        sizes = self.sizes[at].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]


def word_hashes() -> WordHash:
    return only("words", WordHash)
