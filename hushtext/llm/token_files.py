"""Token ids in ORC files.

Documents are dealt into ranges of doc_id, sorted, encoded and written, one ORC file for each range. ORC keeps
integer columns in run-length encoding, an index entry for each stride of rows, and a Bloom filter on
doc_id; readers split files by stripes and pass over stripes and strides that a filter on doc_id rules out.
Texts are shuffled once, before they are encoded. Each row keeps its file's running count of ids, so the
place of a document among all ids needs only one sum for each file.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tiktoken import Encoding

from hushtext.llm._common import map_arrow, map_batches, only, texts
from hushtext.llm.bpe import byte_symbols

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
STRIPE_BYTES, FILE_BYTES = 64 << 20, 256 << 20
INDEX_STRIDE = 10_000
BLOOM_FPP = 0.01

#: The rule by which byte-level vocabularies part a text before merging.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Ids as the tokenizers library gives them for whole texts, special tokens in a text included.

    tiktoken merges by the ids themselves, so the file's ids must stand in the order of its merges. Texts whose
    runs of white space are too long for its pattern go to the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: a byte-level vocabulary is asked for")
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {form: i for form, i in spec["model"]["vocab"].items() if form not in special}
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if made != sorted(set(made)) or len(vocab) != 256 + len(made):
            raise ValueError(f"{path}: ids do not stand in the order of merges")
        byte = {symbol: b for b, symbol in enumerate(byte_symbols())}
        ranks = {bytes(map(byte.__getitem__, form)): i for form, i in vocab.items()}
        self.quick = Encoding(path, pat_str=PIECE, mergeable_ranks=ranks, special_tokens=special)
        self.slow = Tokenizer.from_file(path)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.quick.encode_to_numpy(text, allowed_special="all").astype(np.int32)
        except ValueError:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int32)


def codec(path: str) -> ByteBpe:
    return only(f"bytes {path}", lambda: ByteBpe(path))


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, files: int | None = None) -> None:
    """Encode each row's text, append end_id, and write ids in ascending doc_id order to ORC files under path.

    Null doc_ids come first; rows of equal doc_ids stand by a hash of their text, so that one id's rows may fill many
    files. Files hold some FILE_BYTES of text, and shuffles' partitions are their least number. Null and empty texts have
    the end id alone; very long ones are encoded whole. Repeated rows stay. An empty table gives a folder that read() takes for no rows. Columns other
    than doc_id and text go.
    """
    vocabulary = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    if not files:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, start = codec(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [np.append(c.encode(t), np.int32(end_id)) for t in texts(batch)]
            n = np.array([len(x) for x in ids], np.int64)
            ends = start + np.cumsum(n)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast("int64"), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(n), flat], ["doc_id", "part", "part_start", "n_tokens", "ids"])
            start = int(ends[-1]) if len(n) else start

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    dealt = dealt.repartitionByRange(files, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").drop("hash")
    map_batches(dealt, run, SCHEMA).write.option("compression", "zstd").option("orc.create.index", "true").option("orc.row.index.stride", INDEX_STRIDE).option("orc.stripe.size", STRIPE_BYTES).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP).orc(path)


def read(spark: SparkSession, path: str, where=None) -> DataFrame:
    """doc_id, start, n_tokens, ids of what write() wrote; where: a filter on doc_id, which goes down to the files.

    start counts the ids of all documents before. It takes one row for each file, found from two columns.
    """
    files = spark.read.schema(SCHEMA).orc(path)
    sizes = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n"))
    bases = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = files if where is None else files.where(where)
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")  # bases: a row a file


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids")
        flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, "int64")], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(tokens.select("doc_id", "start", "n_tokens", "ids"), f, "doc_id long, start long, n_tokens long, ids_crc32 long")
