"""Media columns as content-defined chunks.

A payload is cut where a rolling gear hash of its last bytes has enough zero bits, so equal passages give equal
chunks wherever they stand. A chunk that several payloads share is kept once: Spark joins chunk digests to
the first row that holds each shared one (its owner). A stored row is a pack: the ordered digests of a
payload and the bytes of the chunks it owns. Bytes move between machines only for shared chunks; most packs
are read back where they lie. Each chunk is verified by its digest when a payload is put together again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushtext.llm._common import map_arrow, map_batches, stored

UNIT = 576
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 512, 11, 16_384
#: Shared digests or shared chunks' places, of 80 bytes or so, and bytes of shared chunks, that are broadcast; beyond, joins shuffle.
BROADCAST_DIGESTS = 200_000
BROADCAST_BYTES = 16 << 20
_BLOCK = 1 << 20
PACK = "doc_id long, n_bytes long, digests array<binary>, lengths array<int>, owned array<binary>"


def _gear() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)


GEAR = _gear()


def payload_of(text: str) -> tuple[bytes, int]:
    """The text in UTF-8 with bytes 255 up to a positive multiple of UNIT, and its length without them."""
    data = text.encode()
    return data + b"\xff" * (UNIT - len(data) if len(data) < UNIT else -len(data) % UNIT), len(data)


def _candidates(data: bytes) -> np.ndarray:
    """Positions behind which the gear hash of the last 64 bytes allows a cut."""
    found, raw = [], np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        for at in range(0, len(raw), _BLOCK):
            lead = min(at, 63)
            h = GEAR[raw[at - lead : at + _BLOCK]]
            for step in (1, 2, 4, 8, 16, 32):  # doubles the bytes that each hash has seen
                h[step:] = h[step:] + (h[:-step] << np.uint64(step))
            found.append(np.flatnonzero((h[lead:] >> np.uint64(64 - MASK_BITS)) == 0) + at + 1)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def cut(data: bytes) -> list[bytes]:
    """Chunks of data, of MIN_CHUNK to MAX_CHUNK bytes but for the last."""
    ends, start = [], 0
    for at in _candidates(data).tolist():
        while at - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if at - start >= MIN_CHUNK and at < len(data):
            ends.append(at)
            start = at
    while len(data) - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    return [data[a:b] for a, b in zip([0, *ends], [*ends, len(data)])]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def stored_form(chunks: list[bytes], digests: list[bytes]) -> bytes:
    """A payload as one object: its ordered chunk list, then each distinct chunk's bytes."""
    head = b"".join(len(c).to_bytes(4, "little") + d for c, d in zip(chunks, digests))
    return len(chunks).to_bytes(4, "little") + head + b"".join(dict(zip(digests, chunks)).values())


def feature(payload: bytes) -> str:
    """Samples' mean and deviation, and how the 16 ranges of their values are filled, in 255ths of the fullest."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 4, minlength=16)
    levels = bins * 255 // bins.max()
    mean = samples.mean()
    spread = np.sqrt(max(0.0, np.dot(np.bincount(samples, minlength=256), np.arange(256.0) ** 2) / len(samples) - mean * mean))
    return f"{mean:.3f}:{spread:.3f}:{bytes(levels.tolist()).hex()}"


def chunk_digests(docs: DataFrame) -> DataFrame:
    """doc_id, of (a hash of the text, which tells rows of one doc_id apart), pos, digest of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, of, pos, digests = [], [], [], []
            for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("of").to_pylist(), batch.column("text")):
                found = [digest(c) for c in cut(payload_of(t.as_py() or "")[0])]
                ids += [i] * len(found)
                of += [h] * len(found)
                pos += range(len(found))
                digests += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, "int64"), pa.array(of, "int64"), pa.array(pos, "int32"), pa.array(digests, "binary")], ["doc_id", "of", "pos", "digest"])

    return map_batches(_keyed(docs), run, "doc_id long, of long, pos int, digest binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("of"), "text")


def write(docs: DataFrame, path: str) -> None:
    """Store the payload of each row's text as a pack under path. Null texts count as empty; repeated rows stay.

    An owner is the first chunk with its digest by doc_id, hash of its text and place, null doc_ids first; rows that
    repeat both keep it. Very long texts are stored whole, an empty table as no rows. Columns other than doc_id and text go.
    """
    found = stored(chunk_digests(docs), "media-digests")
    shared = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "of", "pos")).alias("owner")).where("n > 1")
    shared = stored(shared.select("digest", F.col("owner.doc_id").alias("owner_id"), F.col("owner.of").alias("owner_of"), F.col("owner.pos").alias("owner_pos")), "media-shared")
    away = found.join(F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared, "digest").where("not (doc_id <=> owner_id and of = owner_of and pos = owner_pos)")
    away = stored(away.select(F.col("doc_id").alias("k"), F.col("of").alias("h"), F.struct("pos", "digest").alias("chunk")), "media-away")
    lists = away.groupBy("k", "h").agg(F.collect_set("chunk").alias("away"))  # at most the chunks of a payload
    lists = F.broadcast(lists) if away.count() <= BROADCAST_DIGESTS else lists
    rows = _keyed(docs).join(lists, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("of") == F.col("h")), "left").drop("k", "h", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = [], [], [], []
            for t, b in zip(batch.column("text"), batch.column("away")):
                payload, n = payload_of(t.as_py() or "")
                chunks = cut(payload)
                digests = [digest(c) for c in chunks]
                gone = {(x["pos"], x["digest"]) for x in b.as_py() or ()}
                out[0].append(n)
                out[1].append(digests)
                out[2].append([len(c) for c in chunks])
                out[3].append([None if (k, d) in gone else c for k, (c, d) in enumerate(zip(chunks, digests))])
            kinds = pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out, kinds)], ["doc_id", "n_bytes", "digests", "lengths", "owned"])

    packs = map_batches(rows, run, PACK).withColumn("pack", F.monotonically_increasing_id())
    packs = packs.withColumn("whole", ~F.exists("owned", lambda c: c.isNull()))
    packs.write.option("compression", "zstd").parquet(f"{path}/packs")
    shared.write.parquet(f"{path}/shared")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_bytes, digests, chunks (the payload's, in order; null where no stored row has one) of each stored row."""
    packs = spark.read.parquet(f"{path}/packs")
    shared = spark.read.parquet(f"{path}/shared").select("digest")
    whole = packs.where("whole").select("doc_id", "n_bytes", "digests", F.col("owned").alias("chunks"))
    held = packs.select(F.explode(F.arrays_zip("digests", "owned")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.owned").alias("bytes")).where("bytes is not null")
    n = shared.count()
    held = held.join(F.broadcast(shared) if n <= BROADCAST_DIGESTS else shared, "digest", "left_semi")
    held = stored(held.groupBy("digest").agg(F.first("bytes").alias("bytes")), "media-held")
    size = held.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    away = packs.where("not whole").select("pack", F.posexplode(F.arrays_zip("digests", "owned")).alias("pos", "c")).where("c.owned is null").select("pack", "pos", F.col("c.digests").alias("digest"))
    brought = away.join(F.broadcast(held) if size <= BROADCAST_BYTES else held, "digest", "left").groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("pos", "bytes"))).alias("brought"))
    joined = packs.where("not whole").join(brought, "pack", "left").select("doc_id", "n_bytes", "digests", F.transform("owned", lambda c, i: F.coalesce(c, F.col("brought")[i])).alias("chunks"))
    return whole.unionByName(joined)


def digests(media: DataFrame) -> DataFrame:
    """Verify chunks and give the digests of payloads and stored forms. A chunk that fails its digest ends the job."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for names, chunks in zip(batch.column("digests"), batch.column("chunks")):
            names, chunks = names.as_py(), chunks.as_py()
            if any(c is None or digest(c) != d for c, d in zip(chunks, names)):
                raise ValueError("a stored chunk doesn't match its digest")
            payload, form = b"".join(chunks), stored_form(chunks, names)
            for x, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload))):
                x.append(v)
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, out, kinds)], [x.split()[0] for x in schema.split(", ")])

    return map_arrow(media.select("doc_id", "n_bytes", "digests", "chunks"), f, schema)
