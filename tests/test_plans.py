import random

import pytest
from pyspark.sql import functions as F

from hushtext.operators import documents, embedding, retrieval, storage
from hushtext.plans import cache, experiment
from hushtext.plans.sanitize import Settings, sanitize, sanitize_paired
from hushtext.streaming import sanitize_sentences, sanitize_stream

WORDS = "river stone house garden light water bridge winter summer market".split()


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    rows = [("train" if i % 3 else "test", i, " ".join(" ".join(rnd.choices(WORDS, k=6)) + (" good." if i % 2 else " bad.") for _ in range(1 + i % 4)), i % 2) for i in range(60)]
    return spark.createDataFrame([*rows, ("train", 100, "", 1), ("train", 101, None, 0)], "split string, doc_id long, text string, label int")


@pytest.fixture(scope="module")
def parts(docs):
    found, split = embedding.embed(documents.split_sentences(docs), "sentence"), documents.public_split(docs)
    pool, centroids = retrieval.fit_clusters(documents.public_pool(found, split), k=4)
    return documents.private_sentences(docs, found, split), pool, centroids, split


def test_sanitize_and_empty_documents(docs, parts):
    private, pool, centroids, split = parts
    sentences = {r.sentence for r in pool.collect()}
    ids = {r.doc_id for r in split.where("not is_public").collect()}
    pairs = sanitize_paired(private, pool, centroids, [100.0], Settings("k")).collect()
    assert all(r.replacement in sentences for r in pairs) and len(pairs) == private.where("sentence is not null").count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for mode in ("placeholder", "passthrough", "drop"):
        made = {r.doc_id: r.sanitized for r in sanitize(docs, private, pool, centroids, [100.0], Settings("k", on_empty=mode)).collect()}
        empty = {i for i in ids if not (texts[i] or "")}
        assert set(made) == (ids - empty if mode == "drop" else ids)
        for i in empty & set(made):
            assert made[i] == ("" if mode == "placeholder" else texts[i])
        for i in ids - empty:
            assert made[i] == " ".join(r.replacement for r in sorted(pairs, key=lambda r: r.pos) if r.doc_id == i)
    with pytest.raises(ValueError):
        Settings("k", on_empty="keep")


def test_stream_gives_what_a_batch_gives(spark, parts, tmp_path):
    private, pool, centroids, _ = parts
    rows = private.where("sentence is not null").select("doc_id", "pos", "sentence", "embedding")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sanitize_stream(stream, pool, centroids, [100.0], Settings("k"), str(tmp_path / "out"), str(tmp_path / "check")).processAllAvailable()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
    assert sorted(got) == sorted(sanitize_paired(rows, pool, centroids, [100.0], Settings("k")).collect())


def test_experiment_resumes(spark, docs, tmp_path, monkeypatch):
    config = experiment.Config(n_clusters=4, pca_dim=3, dim=16, max_private=12)
    out = str(tmp_path)
    first = experiment.run(spark, docs, config, [100.0], out, "k").collect()
    names = {"cosine_similarity", "bleu_mean", "bleu_std", "rouge1", "rouge2", "rougeL", "bertscore_precision", "bertscore_recall", "bertscore_f1", "perplexity", "f1_macro", "f1_micro"}
    value = {(r.epsilon, r.metric): r.value for r in first}
    assert {m for e, m in value if e is None} == names and {m for e, m in value if e == 100.0} == names | {"seconds", "seconds_per_document"}
    assert value[None, "cosine_similarity"] == pytest.approx(1, abs=0.2) and value[None, "rouge1"] >= value[100.0, "rouge1"] and value[None, "f1_micro"] >= 0.4
    made = []
    monkeypatch.setattr(experiment, "sanitize", lambda *a: made.append(a[4]) or sanitize(*a))
    again = experiment.run(spark, docs, config, [100.0, 250.0], out, "k").collect()
    assert made == [[250.0]] and {r for r in again if r.epsilon != 250.0} == set(first) and len(again) == len(first) + len(names) + 2
    skipping = experiment.Config(**{**config.__dict__, "skip_perplexity": True, "skip_bertscore": True, "skip_downstream": True})
    assert skipping.run_id("x") != config.run_id("x") != config.run_id("y")
    made_chunks = []
    monkeypatch.setattr(cache.Cache, "table", lambda self, part, docs, make, table=cache.Cache.table: table(self, part, docs, lambda some: (made_chunks.append(some.count()), make(some))[1]))
    few = experiment.run(spark, docs, skipping, [], out, "k").collect()
    assert sum(made_chunks) == 0  # other settings share what was embedded
    assert {r.metric for r in few} == {"cosine_similarity", "bleu_mean", "bleu_std", "rouge1", "rouge2", "rougeL"}
    with pytest.raises(ValueError):
        experiment.run(spark, docs, experiment.Config(model="all-MiniLM-L6-v2"), [], out, "k")


def test_stream_of_sentences(spark, parts, tmp_path):
    """Sentences come one by one, in any order, in several batches: what whole documents give; and what lacks is not waited
    for beyond the watermark."""
    private, pool, centroids, _ = parts
    rows = private.where("sentence is not null").select("doc_id", "pos", "sentence", "embedding")
    counts = rows.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_sentences"))
    rows = rows.join(counts, "doc_id").withColumn("time", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pos")))
    whole = rows.select("doc_id", "pos", "sentence", "embedding")
    torn = counts.where("n_sentences > 2").agg(F.min("doc_id")).first()[0]  # its middle never comes
    batches = [rows.where(f"(pos + doc_id) % 3 = {i} and not (doc_id = {torn} and pos = 1)") for i in range(3)]
    late = rows.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "pos": F.lit(0), "n_sentences": F.lit(1), "time": F.timestamp_seconds(F.lit(1_800_000_000))})
    source = str(tmp_path / "in")
    batches[0].limit(0).write.parquet(source)
    ready = retrieval.Prepared(pool, centroids)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    out = sanitize_sentences(stream, pool, ready, [100.0, 250.0], Settings("k"))
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
    for batch in [*batches, batches[0], late]:  # the first one comes again
        batch.coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    got = {(r.epsilon, r.doc_id, r.pos): (r.original, r.replacement) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.doc_id < 10**6}
    expected = sanitize_paired(whole, pool, centroids, [100.0, 250.0], Settings("k")).where(f"doc_id != {torn}").collect()
    assert {k: v for k, v in got.items() if k[1] != torn} == {(r.epsilon, r.doc_id, r.pos): (r.original, r.replacement) for r in expected}
    assert {k for k in got if k[1] == torn} == {(e, torn, p) for e in (100.0, 250.0) for p in range(counts.where(f"doc_id = {torn}").first().n_sentences) if p != 1}
    with pytest.raises(ValueError):
        sanitize_sentences(stream, pool, ready, [100.0], Settings("k", denoise=True))


def test_stream_leaves_nothing_behind(spark, parts, tmp_path, monkeypatch):
    private, pool, centroids, _ = parts
    monkeypatch.setattr(retrieval, "POOL_BYTES", 0)
    rows = private.where("sentence is not null").select("doc_id", "pos", "sentence", "embedding")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    kept = []
    monkeypatch.setattr(storage, "delete", lambda spark, path, delete=storage.delete: (kept.append(path), delete(spark, path)))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sanitize_stream(stream, pool, centroids, [100.0], Settings("k"), str(tmp_path / "out"), str(tmp_path / "check")).processAllAvailable()
    assert kept and not any(storage.exists(spark, x) for x in kept)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_word_losses(spark):
    import math

    from hushtext.operators import metrics

    corpus = spark.createDataFrame([("a a b",)], "text string")
    r = metrics.word_losses(spark.createDataFrame([(1, "a C"), (2, "")], "doc_id int, text string"), "text", corpus).collect()
    assert len(r) == 1 and r[0].n_tokens == 2 and r[0].nll == pytest.approx(-(math.log(3 / 6) + math.log(1 / 6)) / 2)
    assert metrics.perplexity(spark.createDataFrame([(1.0, 1), (2.0, 3)], "nll double, n_tokens int")).select(F.round("perplexity", 6)).first()[0] == pytest.approx(math.exp(1.75), abs=1e-6)
