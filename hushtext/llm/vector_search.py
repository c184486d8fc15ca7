"""Exact top-k search by integer inner product.

Queries are dealt into blocks and rows into shards; each pair of a block and a shard is a tile: one matrix product,
of which the best of each query are selected. The lists of a query are then merged as a tree: FAN shards at a time, until
one list is left. No task holds more than a tile or FAN lists of some queries, whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtext.llm._common import map_arrow, stored, worker_path

#: Bytes of a side of a tile in double precision, and rows that make a shard worth a task.
SIDE_BYTES, LEAST_ROWS = 32 << 20, 512
#: Scores that a worker holds at once.
SCORES = 2_000_000
#: Lists that a merge takes for each query, and queries of a merge.
FAN, MERGED_QUERIES = 16, 512
#: Stands for a null id, which comes after all others.
NO_ID = np.iinfo(np.int64).max
LISTS = "dim int, block int, part int, shard int, query long, query_id long, ids array<long>, scores array<long>"
PACKED = "uid long, id long, is_query boolean, dim int, packed binary"


def pack(rows: pa.RecordBatch, scale: float) -> pa.RecordBatch:
    """uid, id, is_query, dim, packed (floor(scale * x) of each component) of the rows whose vector is whole and finite."""
    column = rows.column("vector")
    column = column.filter(column.is_valid()) if column.null_count else column
    rows = rows.filter(rows.column("vector").is_valid())
    sizes = np.diff(column.offsets.to_numpy())
    x = np.floor(scale * column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))  # null becomes nan
    ends = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    keep = np.flatnonzero(bad[ends[1:]] == bad[ends[:-1]])
    parts = []
    for i in keep:
        v = x[ends[i] : ends[i + 1]]
        parts.append(v.astype("<i2").tobytes() if not len(v) or np.abs(v).max() < 1 << 15 else v.astype("<f8").tobytes())
    some = rows.take(pa.array(keep)).select(["uid", "id", "is_query"])
    return pa.RecordBatch.from_arrays([*some.columns, pa.array(sizes[keep], pa.int32()), pa.array(parts, pa.binary())], [x.split()[0] for x in PACKED.split(", ")])


def unpack(packed: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of one length, a row each, in double precision."""
    parts = packed.to_pylist()
    narrow = [len(b) == 2 * dim for b in parts]
    if all(narrow):
        return np.frombuffer(b"".join(parts), "<i2").reshape(len(parts), dim).astype(np.float64)
    return np.stack([np.frombuffer(b, "<i2" if n else "<f8").astype(np.float64) for b, n in zip(parts, narrow)])


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers. Beyond 2**53 they are summed as Python's integers, and held to what a long holds."""
    if not left.size or not right.size or np.abs(left).max() * np.abs(right).max() * left.shape[1] < 1 << 53:
        return (left @ right.T).astype(np.int64)
    whole = [[int(x) for x in v] for v in right.tolist()]
    top = NO_ID
    return np.array([[max(-top, min(top, sum(int(a) * b for a, b in zip(u, v)))) for v in whole] for u in left.tolist()], np.int64)


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """A mask of the k largest scores of each row, of equal ones those that come first."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
    above, ties = scores > least, scores == least
    return above | ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True))


def merge(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, best first; query: a number for each entry."""
    order = np.lexsort((ids, -scores, query))
    sorted_query = query[order]
    first = np.concatenate([[True], sorted_query[1:] != sorted_query[:-1]]) if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _lists(owner: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    """A list of values for each of n owners; owner is sorted."""
    return pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32), values)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def top_k(rows: DataFrame, wanted: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product for each row for which wanted holds.

    A component x counts as floor(scale * x) in double precision, so scores are whole numbers: they are exact, and held
    to what a long holds. Of equal scores the smaller key comes first; a null key comes last. A row is no candidate of
    itself; rows that repeat a key are rows of their own, as queries too. Null vectors and those that hold null, NaN
    or an infinity take no part. Vectors meet those of their own length only; empty ones score 0. Fewer candidates
    than k give fewer rows, an empty table none. wanted may use any column of rows; columns other than key and vector
    don't matter. A null of wanted is no query.
    """
    spark = rows.sparkSession
    worker_path(spark)
    named = rows.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("id"), F.coalesce(wanted, F.lit(False)).alias("is_query"), F.col(vector).alias("vector"))
    packed = stored(map_arrow(named, lambda batch: pack(batch, scale), PACKED), "search-rows")
    side = F.greatest(F.floor(F.lit(SIDE_BYTES) / (8 * F.greatest("dim", F.lit(1)))), F.lit(1))
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a row for each length of vectors
    cuts = packed.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).where("q > 0")
    shards = F.greatest(F.ceil(F.col("n") / side), F.least(F.lit(wide), F.ceil(F.col("n") / LEAST_ROWS)))
    cuts = cuts.select("dim", shards.cast("int").alias("shards"), F.ceil(F.col("q") / side).cast("int").alias("blocks"), F.ceil(F.col("q") / MERGED_QUERIES).cast("int").alias("parts"))
    cuts = stored(cuts, "search-cuts")
    spread = packed.join(F.broadcast(cuts), "dim")
    number = F.xxhash64("uid")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = spread.where("is_query").select("dim", F.pmod(number, F.col("blocks")).cast("int").alias("block"), each("shards").alias("shard"), F.pmod(F.xxhash64("uid", F.lit(1)), F.col("parts")).cast("int").alias("part"), "uid", "id", "packed")
    dealt = packed.join(F.broadcast(cuts), "dim").toDF(*spread.columns)
    right = dealt.select(F.col("dim").alias("dim"), each("blocks").alias("block"), F.pmod(number, F.col("shards")).cast("int").alias("shard"), F.col("uid").alias("uid"), F.coalesce("id", F.lit(NO_ID)).alias("id"), F.col("packed").alias("packed"))

    def tile(at: tuple, some: pa.Table, block: pa.Table) -> pa.Table:
        dim, number, shard = (x.as_py() for x in at)
        block = block.sort_by("id") if len(some) else block.slice(0, 0)
        vectors, ids, uids = unpack(block["packed"], dim) if len(block) else np.zeros((0, dim)), block["id"].to_numpy(), block["uid"].to_numpy()
        by_uid = np.argsort(uids)
        sought, own = unpack(some["packed"], dim) if len(some) else np.zeros((0, dim)), some["uid"].to_numpy()
        owner, place, found = [], [], []
        step = max(1, SCORES // max(len(ids), 1))
        for i in range(0, len(sought) if len(ids) else 0, step):
            scores, mine = products(sought[i : i + step], vectors), own[i : i + step]
            self_at = by_uid[np.minimum(np.searchsorted(uids, mine, sorter=by_uid), len(uids) - 1)]
            here = np.flatnonzero(uids[self_at] == mine)
            scores[here, self_at[here]] = np.iinfo(np.int64).min  # below any score
            q, j = np.nonzero(select(scores, k))
            value = scores[q, j]
            keep = value > np.iinfo(np.int64).min
            owner.append(q[keep] + i)
            place.append(j[keep])
            found.append(value[keep])
        owner, place, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, place, found))
        n = len(some)
        same = [pa.array(np.full(n, v, np.int32)) for v in (dim, number)]
        columns = [*same, some["part"], pa.array(np.full(n, shard, np.int32)), some["uid"], some["id"], _lists(owner, n, ids[place]), _lists(owner, n, found)]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in LISTS.split(", ")])

    tiles = ["dim", "block", "shard"]
    lists = left.groupBy(*tiles).cogroup(right.groupBy(*tiles)).applyInArrow(tile, LISTS)

    def merged(some: pa.Table) -> pa.Table:
        query, numbers = np.unique(some["query"].to_numpy(), return_inverse=True)
        ids, sizes = _flat(some["ids"])
        scores, _ = _flat(some["scores"])
        at = merge(number := np.repeat(numbers, sizes), ids, scores, k)
        first = some.take(pa.array(np.unique(numbers, return_index=True)[1]))
        owner, n = number[at], len(query)
        return pa.Table.from_arrays([first["dim"], first["block"], first["part"], first["shard"], first["query"], first["query_id"], _lists(owner, n, ids[at]), _lists(owner, n, scores[at])], names=some.column_names)

    left_over = cuts.agg(F.max("shards")).first()[0] or 0
    while left_over > 0:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int")).groupBy("dim", "block", "part", "shard").applyInArrow(merged, LISTS)
        left_over = 0 if left_over <= FAN else -(-left_over // FAN)
    best = lists.select(F.col("query_id"), F.posexplode(F.arrays_zip("ids", "scores")).alias("rank", "c"))
    return best.select("query_id", (F.col("rank") + 1).alias("rank"), F.nullif(F.col("c.ids"), F.lit(NO_ID)).alias("vec_id"), F.col("c.scores").alias("score"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.e, r.e)::BIGINT AS score
      FROM v q JOIN v r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""
