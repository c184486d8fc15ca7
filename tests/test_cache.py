"""Caches that runs share: fingerprints, chunks that are made once, and results that are written once."""

import math

import pytest
from pyspark.sql import functions as F

from hushtext.operators import metrics
from hushtext.plans import cache, experiment


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"text {i % 7}" if i % 5 else None) for i in range(60)] + [(3, "text 3")], "doc_id long, text string")


def test_fingerprint(spark, docs):
    columns = ["doc_id", "text"]
    own = cache.fingerprint(docs, columns)
    assert own == cache.fingerprint(docs.repartition(9), columns) == cache.fingerprint(docs.orderBy(F.desc("doc_id")).withColumn("other", F.lit(1)), columns)
    changed = [docs.withColumn("text", F.coalesce("text", F.lit(""))), docs.where("doc_id != 9"), docs.dropDuplicates(), docs.withColumn("doc_id", F.col("doc_id") + 1), docs.limit(0), docs.union(docs.where("doc_id = 1")), docs.select(F.col("text").alias("doc_id"), F.col("doc_id").alias("text"))]
    assert len({own, *(cache.fingerprint(x, columns) for x in changed)}) == len(changed) + 1


def test_paths(spark):
    one = cache.Cache(spark, "/r", "a/b", "m", {"texts": "1"})
    others = [cache.Cache(spark, "/r", "a/c", "m", {"texts": "1"}), cache.Cache(spark, "/r", "a/b", "n", {"texts": "1"}), cache.Cache(spark, "/r", "a/b", "m", {"texts": "2"}), cache.Cache(spark, "/r", "a_b", "m", {"texts": "1"})]
    assert len({one.path, *(x.path for x in others)}) == 5 and one.path.startswith("/r/a_b_m_")


def test_a_killed_run_goes_on(spark, docs, tmp_path, monkeypatch):
    for name, value in (("CHUNK_DOCS", 5), ("WAVES", 4)):
        monkeypatch.setattr(cache, name, value)
    held = cache.Cache(spark, str(tmp_path), "d", "m", {})
    waves = []

    def make(some, die_at=None):
        if not some.isEmpty():
            waves.append({r.doc_id for r in some.collect()})
            if die_at == len(waves):
                # half of a wave is written when the run dies
                some.limit(2).withColumn("upper", F.lit("half")).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(13)).cast("int")).write.mode("append").partitionBy("chunk").parquet(f"{held.path}/t-13")
                raise KeyboardInterrupt
        return some.withColumn("upper", F.upper("text"))

    with pytest.raises(KeyboardInterrupt):
        held.table("t", docs, lambda some: make(some, 3))
    first = [set(w) for w in waves]
    assert len(first) == 3
    waves.clear()
    expected = sorted(map(str, docs.withColumn("upper", F.upper("text")).collect()))
    assert sorted(map(str, held.table("t", docs, make).collect())) == expected
    assert not set.union(*waves) & (first[0] | first[1]) and set.union(*waves) >= first[2]  # what was finished isn't made again
    waves.clear()
    assert sorted(map(str, held.table("t", docs, make).collect())) == expected and not waves
    assert held.table("none", docs.limit(0), make).count() == 0


def test_results_are_written_once(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = lambda e, v: spark.createDataFrame([(e, "m", "x", v, "run")], experiment.RESULTS).withColumn("budget", F.lit(experiment.budget_name(e)))
    for e, v in ((100.0, 1.0), (None, 2.0), (100.0, 3.0)):
        cache.once(rows(e, v), path, ["run_id", "budget"])
    got = spark.read.schema(experiment.RESULTS).parquet(path).collect()
    assert {(r.epsilon, r.value) for r in got} == {(100.0, 3.0), (None, 2.0)} and len(got) == 2
    assert {r.epsilon for r in experiment.finished(spark, path, "run").collect()} == {100.0, None}
    assert experiment.finished(spark, path, "other").count() == 0


def test_changed_data_and_a_model(spark, tmp_path):
    """Other texts under one name are other results and another cache; a model's embedder and language model run in plans."""
    config = experiment.Config(model="stub", n_clusters=0, pca_dim=0, max_private=6, skip_bertscore=True, skip_downstream=True)
    docs = spark.createDataFrame([(i, f"The river {i} is long. A stone bridge {i % 3} stands.") for i in range(20)], "doc_id long, text string")
    encode = lambda: lambda texts: [[float(len(t)), float(t.count("e")), 1.0] for t in texts]
    score = lambda: lambda texts: ([0.5 * len(t.split()) for t in texts], [len(t.split()) for t in texts])

    def losses(rows):
        return metrics.language_model_losses(rows, "text", score)

    run = lambda d, e: experiment.run(spark, d, config, e, str(tmp_path), "k", load=encode, losses=losses).collect()
    one = run(docs, [100.0])
    value = {(r.epsilon, r.metric): r.value for r in one}
    assert value[None, "cosine_similarity"] == pytest.approx(1) and 0.9 < value[100.0, "cosine_similarity"] <= 1 + 1e-9
    assert value[None, "perplexity"] == pytest.approx(math.exp(0.5 * 10)) and value[100.0, "rouge1"] > 0
    other = run(docs.withColumn("text", F.concat("text", F.lit(" More words here."))), [])
    assert {r.run_id for r in one} != {r.run_id for r in other} and len([x for x in tmp_path.iterdir() if x.name.endswith("_cache")]) == 2
