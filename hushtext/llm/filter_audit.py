"""How filters of a corpus act together, from a packed bitmap index.

Each partition packs what its rows fail, how they are labelled and the part they belong to into bitsets: rows of a part stand
together, from a whole word of 64 bits on, so a part's bitset is a range of words. AND-NOT and popcounts of these
give, for each set of filters, the rows of a part that pass them all; sums over partitions are all that is shuffled. An
order of the filters is a path through these sets, so all orders follow from 2**n counts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtext.llm._common import map_arrow, map_batches, spread_join, stored, text_print

#: Rows that a worker packs at once.
CHUNK_ROWS = 1 << 18
FILTERS = "ABCDE"
LETTERS, MARKS = bytes(range(65, 91)), b"#$%&*|"
#: Fixed limits of the five filters.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2


def failures(text: str) -> int:
    """Bits of the filters A, B, C and D that a text fails."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    few = n < MIN_WORDS
    repeated = 100 * len(set(words)) < MIN_DISTINCT_PERCENT * n
    capitals = 100 * (len(raw) - len(raw.translate(None, LETTERS))) > MAX_CAPITAL_PERCENT * len(text)
    marks = len(raw) != len(raw.translate(None, MARKS))
    return few | repeated << 1 | capitals << 2 | marks << 3


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, a boolean for each of FILTERS (true where it fails), good and toxic, of each row of docs.

    Texts are compared by a hash of 128 bits. E: a row with a smaller doc_id has the same text; null doc_ids
    are neither smaller nor larger than others.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        fails = np.fromiter((failures(t.as_py()) for t in batch.column("text")), np.int8, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("hash"), pa.array(fails)], ["doc_id", "part", "hash", "fails"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_print().alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(map_arrow(rows, f, "doc_id long, part string, hash binary, fails byte"), "audit-rows")
    copied = rows.groupBy("hash").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copied = stored(copied.select(F.col("hash").alias("copied"), "least", "n"), "audit-copied")
    rows = spread_join(rows, "hash", "doc_id", copied, "copied", "n")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(known, F.col("doc_id") == F.col("labelled"), "left")
    bits = [(F.col("fails").bitwiseAND(F.lit(1 << i).cast("byte")) != 0).alias(x) for i, x in enumerate(FILTERS[:4])]
    return rows.select("part", *bits, F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)).alias(FILTERS[4]), *[F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")])


def bitmaps(flags: DataFrame, names: list[str], part: str = "part") -> DataFrame:
    """The index: part, n (rows) and a bitset for each of names (boolean columns), a row for each part of each chunk.

    Bit i of a bitset (least first) is the chunk's i-th row of the part; bitsets end in zeros up to a whole word.
    Nulls are false; a null part stays one. What it holds grows with the rows, whatever the number of parts.
    """
    schema = "part string, n long, " + ", ".join(f"`{x}` binary" for x in names)

    def packed(chunk: pa.Table) -> pa.RecordBatch:
        codes = chunk["part"].combine_chunks().dictionary_encode(null_encoding="encode")
        code = codes.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        sizes = np.bincount(code, minlength=len(codes.dictionary))
        words = -(-sizes // 64)
        # each row's bit: its part's first word, and its place in the part
        starts = np.cumsum(words) - words
        bit = np.repeat(64 * starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(code))
        out = []
        for x in names:
            flags = np.zeros(64 * int(words.sum()), bool)
            flags[bit] = chunk[x].fill_null(False).combine_chunks().to_numpy(zero_copy_only=False)[order]
            raw = np.packbits(flags, bitorder="little").tobytes()
            out.append(pa.array([raw[8 * a : 8 * (a + n)] for a, n in zip(starts.tolist(), words.tolist())], pa.binary()))
        return pa.RecordBatch.from_arrays([codes.dictionary, pa.array(sizes, pa.int64()), *out], ["part", "n", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    return map_batches(flags.select(F.col(part).cast("string").alias("part"), *names), run, schema)


def prefix_counts(index: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """part, passed (a set of filters, as bits), n_all, n_<label> (the rows of a part, and those with the label, that pass
    all filters of the set), and alone_<i>: rows that fail the i-th filter only, in the row of the full set.

    Each set is one AND-NOT more than the set without its last filter.
    """
    n_filters = len(filters)
    names = [*(f"n_{x}" for x in ("all", *labels)), *(f"alone_{i}" for i in range(n_filters))]
    schema = "part string, passed int, " + ", ".join(f"{x} long" for x in names)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = batch.column("n").to_numpy()
        words = -(-sizes // 64)
        ends = np.cumsum(words)
        starts = ends - words
        valid = np.full(int(words.sum()), ~np.uint64(0))
        rest = sizes % 64
        valid[(ends - 1)[rest > 0]] = (np.uint64(1) << rest[rest > 0].astype(np.uint64)) - np.uint64(1)
        bits = {x: np.frombuffer(b"".join(batch.column(x).to_pylist()), "<u8") for x in (*filters, *labels)}

        def count(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(np.bitwise_count(x).astype(np.int64), starts)

        out: dict[str, list] = {x: [] for x in names}
        alive = [valid]
        for s in range(1 << n_filters):
            if s:
                last = s.bit_length() - 1
                alive.append(alive[s ^ (1 << last)] & ~bits[filters[last]])
            for x in ("all", *labels):
                out[f"n_{x}"].append(count(alive[s] if x == "all" else alive[s] & bits[x]))
        full = (1 << n_filters) - 1
        for i in range(n_filters):
            alone = count(alive[full ^ (1 << i)]) - count(alive[full])
            out[f"alone_{i}"] = [alone if s == full else np.zeros_like(alone) for s in range(1 << n_filters)]
        sets = np.repeat(np.arange(1 << n_filters, dtype=np.int32), len(sizes))
        parts = pa.concat_arrays([batch.column("part")] * (1 << n_filters))
        return pa.RecordBatch.from_arrays([parts, pa.array(sets), *[pa.array(np.concatenate(out[x])) for x in names]], ["part", "passed", *names])

    counts = map_arrow(index, f, schema)
    return counts.groupBy("part", "passed").agg(*[F.sum(x).alias(x) for x in names])


def orders(spark, filters: list[str]) -> DataFrame:
    """filter_order, step (from 1), filter (its place in filters), before and after (sets of filters): a row a step of each
    order. There are as many orders as permutations, whatever the corpus."""
    rows = []
    for order in itertools.permutations(range(len(filters))):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            rows.append((name, step, i, before, before | 1 << i))
            before |= 1 << i
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int, after int")


def audit(counts: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, a <label>_lost for each label, and shapley."""
    spark, n = counts.sparkSession, len(filters)
    full = (1 << n) - 1
    # counts of a part: one row with a map from a set to its counts
    fields = F.struct("n_all", *[f"n_{x}" for x in labels])
    alone = F.array(*[F.max(F.when(F.col("passed") == full, F.col(f"alone_{i}"))) for i in range(n)])
    parts = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("passed", fields.alias("c")))).alias("sets"), alone.alias("alone"))
    at = lambda s: F.col("sets")[s]
    shapley = []
    for i in range(n):
        total = F.lit(0).cast("long")
        for s in range(1 << n):
            if not s >> i & 1:
                paths = math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())  # orders with this set before i
                total = total + paths * (at(F.lit(s)).n_all - at(F.lit(s | 1 << i)).n_all)
        shapley.append(total)
    parts = parts.withColumn("shapley", F.array(*shapley))
    rows = parts.join(F.broadcast(orders(spark, filters)))  # a row for each step of each order, for each part
    before, after = at(F.col("before")), at(F.col("after"))
    removed = before.n_all - after.n_all
    failing = at(F.lit(0)).n_all - at(F.col("after") - F.col("before")).n_all
    lost = [(before[f"n_{x}"] - after[f"n_{x}"]).alias(f"{x}_lost") for x in labels]
    return rows.select("part", "filter_order", "step", after.n_all.alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"), F.get("alone", F.col("filter")).alias("unique_fails"), *lost, F.get("shapley", F.col("filter")).alias("shapley"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each
    source, order of the five filters and step, zeros included.

    Null texts count as empty, and fail A; null sources are the part of the empty string; rows that repeat
    a doc_id count one by one, and of equal texts those with the least doc_id don't fail E; null doc_ids fail no E and
    have no labels; labels of a doc_id add up (good or toxic if any row says so, null says nothing). Very
    long texts are measured whole; an empty table gives no rows. Columns other than doc_id, text and source don't matter.
    """
    filters, kinds = list(FILTERS), ["good", "toxic"]
    index = stored(bitmaps(flagged(docs, labels), [*filters, *kinds]), "audit-index")
    return audit(stored(prefix_counts(index, filters, kinds), "audit-counts"), filters, kinds)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (CASE WHEN len(ws) < {MIN_WORDS} THEN 1 ELSE 0 END) + (CASE WHEN 100 * list_unique(ws) < {MIN_DISTINCT_PERCENT} * len(ws) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MAX_CAPITAL_PERCENT} * length(t) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN least < w.doc_id THEN 16 ELSE 0 END) AS fails,
        coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w JOIN firsts USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
bits AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
perms AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM bits a, bits b, bits c, bits d, bits e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
steps AS (SELECT filter_order, step, s.b AS bit, (SELECT coalesce(sum(p.b), 0) FROM bits p WHERE strpos(filter_order, p.x) < step) AS before
  FROM perms, range(1, 6) r(step) JOIN bits s ON s.x = substr(filter_order, step, 1)),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (before + bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
