"""Similarity join on word n-grams by MinHash banding.

Documents with one set of n-grams are one node, so copies cost one row. Nodes are dealt by the hashes of the
bands of their MinHash signature; band and row counts follow from the target recall at the threshold. Nodes
that share a bucket are verified on their full n-gram sets: a bucket is cut into blocks of bounded size, each
pair of blocks is a task of its own, and a pair of nodes is verified only in the first band in which they
agree. A task gives back links counted by node and a spanning forest of its links, never the pairs, so what
moves grows with the nodes, not with the square of a group. Classes are the connected components.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtext.llm._common import map_arrow, map_batches, stored, text_print, word_hashes, worker_path

WORD = re.compile(r"\w+")
#: Nodes, and bytes of n-gram sets, of a block of a bucket, on the average.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Nodes whose ids of 16 bytes are broadcast; beyond, joins shuffle.
BROADCAST_NODES = 1_000_000
#: Nodes in which dense products are faster than sets.
DENSE = 24


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows: the most rows, and so the fewest false candidates, with which at most that many
    hashes find a pair at the threshold with the wanted probability."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("more hashes are needed for this recall")
    return best


@lru_cache(maxsize=4)
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(0, 2**63, n, dtype=np.uint64) * 2 + 1, rng.integers(0, 2**63, n, dtype=np.uint64)


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words in lower case; a shorter text is one run."""
    words = word_hashes().of(WORD.findall(text.lower()))
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            out = (out ^ words[i : len(words) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(grams: np.ndarray, bands: int, rows: int) -> list[int]:
    """A hash of each band of the MinHash signature, as signed 64-bit integers."""
    a, b = _factors(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 2048):
            mixed = a[:, None] * grams[None, at : at + 2048] + b[:, None]
            np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=1), out=least)
        h = np.zeros(bands, np.uint64)
        for column in least.reshape(bands, rows).T:
            h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h.view(np.int64).tolist()


def node_id(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def _same(sets: list[np.ndarray], pairs: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (rows of positions in sets)."""
    if len(pairs) <= DENSE * (len(left) + len(right)):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    union, number = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    twice = np.bincount(number) > 1
    owner, number = owner[twice[number]], (np.cumsum(twice) - 1)[number[twice[number]]]
    order = np.argsort(number, kind="stable")
    owner, number, total, wide = owner[order], number[order], int(twice.sum()), 4096
    out = np.zeros((len(left), len(right)), np.float32)
    row, col = np.full(ends.size, -1), np.full(ends.size, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, total, wide):
        a, b = np.searchsorted(number, [at, at + wide])
        x, y = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        r, c, k = row[owner[a:b]], col[owner[a:b]], number[a:b] - at
        x[r[r >= 0], k[r >= 0]] = 1
        y[c[c >= 0], k[c >= 0]] = 1
        out += x @ y.T
    return out[row[pairs[:, 0]], col[pairs[:, 1]]].astype(np.int64)


def verify(nodes: list[bytes], copies: np.ndarray, sides: np.ndarray, band: int, hashes: np.ndarray, sets: list[np.ndarray], threshold: float, own: bool) -> tuple[dict, list]:
    """Links of the pairs of a block with itself (own, all sides 0), or of side 0 with side 1, which may be empty.

    Gives the documents linked to each node, and links (node, least node) of a spanning forest.
    """
    left = np.flatnonzero(sides == 0)
    right = left if own else np.flatnonzero(sides == 1)
    sizes, links, parent = np.array([len(s) for s in sets]), {}, list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    # as many rows at a time as keep the pairs of a turn below a million
    for at in range(0, len(left), BLOCK):
        some = left[at : at + BLOCK]
        i, j = np.meshgrid(some, right, indexing="ij")
        ok = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j])
        if right is left:
            ok &= i < j
        for k in range(band):
            ok &= hashes[i, k] != hashes[j, k]
        pairs = np.stack([i[ok], j[ok]], axis=1)
        if not len(pairs):
            continue
        both = _same(sets, pairs, some, right)
        pairs = pairs[both >= threshold * (sizes[pairs].sum(axis=1) - both) - 1e-9]
        n = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(nodes)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(nodes))
        for x in np.flatnonzero(n):
            links[nodes[x]] = links.get(nodes[x], 0) + int(n[x])
        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            if x != y:
                low, high = (x, y) if nodes[x] < nodes[y] else (y, x)
                parent[high] = low
    return links, [(nodes[x], nodes[find(x)]) for x in range(len(nodes)) if find(x) != x]


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root: the least node of each connected component of edges (a, b).

    Large and small stars in turn: each node is linked to the least node it knows, until nothing changes.
    Every step is written to the shared folder.
    """
    step = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "star")
    for _ in range(most):
        both = step.unionByName(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.unionByName(step.join(least, step.a == least.k).select("a", F.col("m").alias("b"))).where("a != b").distinct(), "star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, large.a == low.k)
        after = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        after = stored(after, "star")
        # a star: no node has two links, and no node that is linked to has one upwards
        roots = after.select(F.col("b").alias("a")).distinct()
        if after.groupBy("a").count().where("count > 1").isEmpty() and after.join(roots, "a", "left_semi").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        step = after
    raise RuntimeError("components did not settle")


def _told_apart(docs: DataFrame) -> DataFrame:
    """doc_id, print (a digest of the text) and text: rows of one doc_id and print are copies."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_print().alias("print"), "text")


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, print, node (null without words), grams (their number), bands."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, known = [], {}
        for t in batch.column("text"):
            t = t.as_py() or ""
            if (row := known.get(t)) is None:
                g = shingles(t, n)
                row = known[t] = (node_id(g), len(g), signature(g, bands, rows) if len(g) else None)
            out.append(row)
        node, grams, hashes = zip(*out)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array(node, "binary"), pa.array(grams, "int64"), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "print", "node", "grams", "bands"])

    return map_arrow(_told_apart(docs), f, "doc_id long, print binary, node binary, grams long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, set (packed hashes) of the wanted nodes (rep, its_print: doc_id and print of a row that has it, node)."""
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("print") == F.col("its_print"))
    some = _told_apart(docs).join(wanted.withColumnRenamed("node", "wanted"), same).select("wanted", "text")

    def run(batches):
        for batch in batches:
            nodes, grams = [], []
            for node, t in zip(batch.column("wanted"), batch.column("text")):
                g = shingles(t.as_py() or "", n)
                if node_id(g) == node.as_py():
                    nodes.append(node.as_py())
                    grams.append(g.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, "binary"), pa.array(grams, "binary")], ["node", "set"])

    # repeated rows give a node more than once
    return map_batches(some, run, "node binary, set binary").dropDuplicates(["node"])


def classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, print, node of each row of docs, and for each node class_id, n_links, and first (known, id, print of
    the first row of its class, by doc_id and print, null doc_ids first)."""
    spark = docs.sparkSession
    bands, rows = bands_for(threshold, recall)
    signed = stored(signatures(docs, n, bands, rows), "join-signatures")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), "print")
    nodes = signed.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min(order).alias("first"), F.min_by("bands", order).alias("bands"), F.first("grams").alias("grams"))
    nodes = stored(nodes.select("node", "copies", "first", "bands", "grams"), "join-nodes")
    keys = nodes.select("node", "grams", F.posexplode("bands").alias("band", "hash"))
    buckets = keys.groupBy("band", "hash").agg(F.count("*").alias("members"), F.sum("grams").alias("grams"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("print"), F.min("node").alias("low")).where("members > 1")
    # of buckets with the same members the first band's sees all their pairs
    first = buckets.groupBy("members", "print", "low").agg(F.min(F.struct("band", "hash", "grams")).alias("b")).select("b.*", "members")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.least(F.ceil(8 * F.col("grams") / BLOCK_BYTES), F.col("members"))).cast("int")
    first = stored(first.select("band", "hash", blocks.alias("blocks")), "join-buckets")
    n_buckets = first.count()
    members = keys.join(F.broadcast(first) if n_buckets <= BROADCAST_NODES else first, ["band", "hash"])
    members = stored(members.select("node", "band", "hash", "blocks"), "join-members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("first.id").alias("rep"), F.col("first.print").alias("its_print"), "node")
    wanted = stored(wanted, "join-wanted")
    sets = _sets(docs, F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted, n)
    known = stored(sets.join(nodes.select("node", "copies", "bands"), "node"), "join-sets")
    # each pair of blocks of a bucket: a member goes to all pairs that hold its block
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "band", "hash", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    worker_path(spark)

    def check(block: pd.DataFrame) -> pd.DataFrame:
        hashes = np.array(block["bands"].tolist(), np.int64)
        sets = [np.frombuffer(s, np.uint64) for s in block["set"]]
        links, forest = verify(block["node"].tolist(), block["copies"].to_numpy(), block["side"].to_numpy(), int(block["band"].iat[0]), hashes, sets, threshold, bool(block["x"].iat[0] == block["y"].iat[0]))
        up = dict(forest)
        return pd.DataFrame({"node": list(links), "links": list(links.values()), "up": [up.get(x) for x in links]}, columns=["node", "links", "up"])

    out = stored(dealt.join(known, "node").groupBy("band", "hash", "x", "y").applyInPandas(check, "node binary, links long, up binary"), "join-links")
    counts = out.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(out.where("up is not null").select(F.col("node").alias("a"), F.col("up").alias("b")))
    classed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classed.groupBy("root").agg(F.min("first").alias("first"))
    found = classed.drop("first").join(least, "root").join(counts, "node", "left").select("node", F.col("first.id").alias("class_id"), "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "print", "node"), found


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """doc_id, class_id, n_links: a row for each row of docs.

    Two rows are linked if the Jaccard similarity of their sets of n-word runs is threshold or more; n_links
    counts the other rows linked to a row, copies included. class_id is the least doc_id of the rows linked
    to each other, directly or through others. Words are runs of letters, digits and _ in lower case; a text
    of fewer than n words is one run of all its words; null, empty and wordless texts have no links and are
    classes of their own (their doc_id). Null doc_ids are less than others, so a class with one has
    a null class_id; repeated rows stay and link to each other; a very long text is compared whole; an empty table gives
    no rows; columns other than doc_id and text go.
    """
    signed, found = classes(docs, n, threshold, recall)
    alone = signed.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return signed.where("node is not null").select("doc_id", "node").join(found.drop("first"), "node").select("doc_id", "class_id", "n_links").unionByName(alone)


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each class: the first by doc_id and digest of the text, null doc_ids first; of rows with one
    doc_id and text, any one. Texts without words are classes of their own, and all stay."""
    signed, found = classes(docs, **options)
    rows = signed.where("node is not null").join(found.select("node", "first"), "node")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("print") == F.col("first.print"))
    rows = rows.groupBy("doc_id", "print").agg(F.bool_or(is_first).alias("stays"), F.count("*").alias("n")).select(F.col("doc_id").alias("__id"), F.col("print").alias("__its"), "stays", "n")
    rows = stored(rows.where("not stays or n > 1"), "join-later")
    few = rows.count() <= BROADCAST_NODES
    named = docs.withColumn("__print", text_print())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__its"))
    rest = named.join(F.broadcast(rows) if few else rows, same, "left_anti").select(docs.columns)
    again = rows.where("stays")
    if again.isEmpty():
        return rest
    # the first of its class stands in several rows: one of them stays
    twice = named.join(F.broadcast(again) if few else again, same, "left_semi").dropDuplicates(["doc_id", "__print"]).select(docs.columns)
    return rest.unionByName(twice)
