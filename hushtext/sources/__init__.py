"""Readers of labelled documents: docs(split string, doc_id bigint, text string, label int)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushtext.functions.text import int_label

#: Rows of each split that are taken; 0 is all.
HEADS = {"amazon": {"train": 25_000, "test": 25_000}, "agnews": {"train": 25_000, "test": 7_600}}
#: Names of the datasets in the local hub cache.
HUB_NAMES = {"imdb": "imdb", "amazon": "amazon_polarity", "agnews": "ag_news"}
#: Columns of text and label.
COLUMNS = {"imdb": ("text", "label"), "snips": ("text", "label"), "amazon": ("content", "label"), "drugscom": ("review", "rating"), "agnews": ("text", "label")}


def binarized(rating: Column, least: float = 5) -> Column:
    """1 from least on, else 0; null is 0."""
    return F.when(rating >= least, 1).otherwise(0)


def head(docs: DataFrame, most: int) -> DataFrame:
    """The first most documents of each split, whose doc_ids count from 0; all for 0."""
    return docs.where(F.col("doc_id") < most) if most else docs


def read_csv_pair(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Two CSV files, or folders of them, with a header and columns text and label; label_raw keeps labels that are no numbers.

    Quoted fields may span lines, so a file isn't cut; doc_id is a row's place, by file name and row.
    """
    both = None
    for split, path in (("train", train), ("test", test)):
        rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
        rows = rows.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.monotonically_increasing_id()})
        files = rows.groupBy("__file").agg(F.min("__row").alias("__first"), F.count("*").alias("n"))  # a row a file
        files = files.select("__file", (F.sum("n").over(Window.orderBy("__file")) - F.col("n") - F.col("__first")).alias("__base"))
        rows = rows.join(F.broadcast(files), "__file").withColumn("doc_id", F.col("__base") + F.col("__row"))
        rows = rows.select(F.lit(split).alias("split"), "doc_id", "text", int_label(F.col("label")).alias("label"), F.col("label").alias("label_raw"))
        both = rows if both is None else both.unionByName(rows)
    return both


def read_parquet_snapshot(spark: SparkSession, root: str, text: str = "text", label: str = "label", heads: dict | None = None) -> DataFrame:
    """Parquet files named split-*.parquet under a folder: the split is the name up to the first -.

    doc_id is a row's place in its split, by file name and row: the same however the files are dealt to tasks.
    heads: rows of each split that are taken; splits that it doesn't name are left out, 0 is all.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    rows = spark.read.parquet(root).select(F.col(text).alias("text"), F.col(label).alias("label"), F.regexp_extract(name, r"^([^-.]+)", 1).alias("split"), name.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    rows = rows.where(F.col("split").isin("train", "test"))
    files = rows.groupBy("split", "__file").agg(F.count("*").alias("n"))
    before = Window.partitionBy("split").orderBy("__file")
    files = files.select("split", "__file", (F.sum("n").over(before) - F.col("n")).alias("__base"))
    rows = rows.join(F.broadcast(files), ["split", "__file"]).select("split", (F.col("__base") + F.col("__row")).alias("doc_id"), "text", "label")  # a row a file
    if not heads:
        return rows
    wanted = F.lit(False)
    for split, most in heads.items():
        wanted = wanted | ((F.col("split") == split) & (F.lit(not most) | (F.col("doc_id") < most)))
    return rows.where(wanted)


def hub_home() -> str:
    """The local hub cache: HF_HOME, else its usual place."""
    return os.environ.get("HF_HOME") or os.path.expanduser("~/.cache/huggingface")


def snapshot_folder(spark: SparkSession, repo: str, home: str, config: str = "plain_text") -> str | None:
    """The last snapshot of a dataset in a local hub cache: config's folder, else that named default; None if there is
    none with Parquet files. The cache may be in any store that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name in (config, "default"):
        pattern = hadoop.Path(f"{home.rstrip('/')}/hub/datasets--{repo.replace('/', '--')}/snapshots/*/{name}")
        files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        found = sorted(str(x.getPath()) for x in files.globStatus(pattern) or [])
        if found and files.globStatus(hadoop.Path(f"{found[-1]}/*.parquet")):
            return found[-1]
    return None


def _columns(name: str) -> Callable:
    def read(spark: SparkSession, root: str) -> DataFrame:
        text, label = COLUMNS[name]
        docs = read_parquet_snapshot(spark, root, text, label, HEADS.get(name))
        made = binarized(F.col("label")) if name == "drugscom" else int_label(F.col("label").cast("string"))
        return docs.select("split", "doc_id", "text", made.alias("label"))

    return read


READERS: dict[str, Callable] = {name: _columns(name) for name in COLUMNS} | {"atis": lambda spark, root: read_csv_pair(spark, f"{root}/train.csv", f"{root}/test.csv")}


def load(spark: SparkSession, name: str, root: str | None = None, max_samples: int = 0, home: str | None = None) -> DataFrame:
    """A dataset by name; the first max_samples documents of each split, or all for 0.

    Without root, the dataset's last snapshot in the local hub cache (home, else hub_home()) is read.
    """
    if name not in READERS:
        raise ValueError(f"unknown dataset {name}: one of {sorted(READERS)}")
    if root is None:
        root = snapshot_folder(spark, HUB_NAMES[name], home or hub_home()) if name in HUB_NAMES else None
        if root is None:
            raise ValueError(f"no snapshot of {name} in the local hub cache: give its folder")
    return head(READERS[name](spark, root), max_samples)
