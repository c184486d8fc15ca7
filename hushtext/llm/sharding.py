"""Shards by extendible hashing, with DataFrame operations only.

A directory is indexed by the leading bits of a hash of the document's key. A bucket splits on one more bit
only while its bytes exceed the limit. Whether a bucket at some depth splits depends on its own bytes alone,
so one histogram over enough leading bits gives the bytes of all buckets above it, and each directory entry
takes the least depth whose bucket fits. Only entries that still don't fit are counted again over more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtext.llm._common import stored

HASH_BITS = 60
#: Bits beyond those that evenly filled shards would need.
SPARE_BITS = 3
#: Directory entries of 40 bytes or so that are broadcast; larger directories are joined by a shuffle.
BROADCAST_ENTRIES = 200_000


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of a key as text; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ENTRIES else df


def _leading(bits: int) -> Column:
    return F.shiftright("hash", HASH_BITS - bits)


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Shards of docs, and their directory.

    Shards: key, n_bytes (of the text in UTF-8), depth, shard (its leading bits as a number), shard_bytes,
    shard_docs; a row for each row of docs. Directory: entry_bits, entry, and the same of its shard.
    Rows of one key stay together. A key that alone exceeds the limit has a shard of its own, at the least
    depth at which it is alone; no other shard exceeds it. Null texts have no bytes; null keys share one
    hash with the empty key; an empty table has no shards; further columns go.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    items = docs.select(F.col(key), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), key_hash(F.col(key)).alias("hash"))
    total = items.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + SPARE_BITS))
    shards, directory, rest = None, None, items
    while True:
        cells = rest.groupBy(_leading(bits).alias("entry")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        cells = stored(cells, "shard-cells")
        levels = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn("shard", F.expr(f"shiftright(entry, {bits} - depth)"))
        buckets = levels.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("low").alias("low"), F.max("high").alias("high"))
        fitting = buckets.where((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high"))).drop("low", "high")
        best = levels.select("entry", "depth", "shard").join(fitting, ["depth", "shard"]).groupBy("entry").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_docs")).alias("s"))
        found = stored(best.select(F.lit(bits).alias("entry_bits"), "entry", "s.*"), "shard-directory")
        n = found.count()
        part = rest.withColumn("entry", _leading(bits)).join(_small(found, n), "entry").select(key, "n_bytes", "depth", "shard", "shard_bytes", "shard_docs")
        shards, directory = (part, found) if shards is None else (shards.unionByName(part), directory.unionByName(found))
        open_cells = cells.join(found, "entry", "left_anti").select("entry")
        n_open = open_cells.count()
        if not n_open:
            return shards, directory
        # only what is still too large is looked at again
        rest = rest.withColumn("entry", _leading(bits)).join(_small(stored(open_cells, "shard-open"), n_open), "entry", "left_semi").drop("entry")
        bits = min(HASH_BITS, bits + 8)


def write(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """Write docs as Parquet in one folder a shard (shard=depth-bits), each of at most limit bytes of text."""
    shards, _ = assign(docs.select(key, text), limit, key, text)
    names = shards.select(key, F.concat_ws("-", "depth", "shard").alias("shard")).distinct()
    docs.join(names, docs[key].eqNullSafe(names[key])).drop(names[key]).repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int) -> str:
    return f"""
WITH items AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
cells AS (SELECT h, sum(n_bytes) AS b, count(*) AS n FROM items GROUP BY h),
levels AS (SELECT h, b, n, d.depth::INT AS depth, h >> ({HASH_BITS} - d.depth)::INT AS shard FROM cells, range(0, {HASH_BITS + 1}) AS d(depth)),
buckets AS (SELECT depth, shard, sum(b)::BIGINT AS shard_bytes, sum(n)::BIGINT AS shard_docs, min(h) = max(h) AS one FROM levels GROUP BY depth, shard),
fits AS (SELECT l.h, min(l.depth) AS depth FROM levels l JOIN buckets k ON l.depth = k.depth AND l.shard = k.shard WHERE k.shard_bytes <= {limit} OR k.one GROUP BY l.h)
SELECT i.doc_id, i.n_bytes, f.depth, k.shard, k.shard_bytes, k.shard_docs
FROM items i JOIN fits f ON i.h = f.h JOIN buckets k ON k.depth = f.depth AND k.shard = i.h >> ({HASH_BITS} - f.depth)::INT"""
