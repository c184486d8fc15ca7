"""The experiment: embed once, split, index the public pool, sweep budgets, keep results, resume."""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
import secrets
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushtext import sources
from hushtext.functions.vectors import dot
from hushtext.operators import documents, embedding, language_model, metrics, retrieval, word_vectors
from hushtext.operators.storage import exists, stored
from hushtext.plans.cache import Cache, fingerprint, once
from hushtext.plans.sanitize import Settings, sanitize

log = logging.getLogger(__name__)
RESULTS = "epsilon double, method string, metric string, value double, run_id string"


@dataclass(frozen=True)
class Config:
    """All that a result depends on; run_id is its digest, so that runs never mix."""

    dataset: str = "imdb"
    delta: float = 1e-5
    max_private: int = 200
    max_public: int = 0
    public_ratio: float = 0.5
    n_clusters: int = 50
    top_k_clusters: int = 3
    pca_dim: int = 16
    dim: int = 64
    chained_denoising: bool = False
    composition_mode: str = "honest_doc"
    model: str = "hashing"
    seed: int = 42
    max_sentences: int = 0
    skip_perplexity: bool = False
    skip_bertscore: bool = False
    skip_downstream: bool = False

    def run_id(self, data: str) -> str:
        """data: what tells the tables apart, a fingerprint."""
        return hashlib.sha256(json.dumps(asdict(self) | {"data": data}, sort_keys=True).encode()).hexdigest()[:16]


def budget_name(epsilon: float | None) -> str:
    """Names the folder of a budget's results."""
    return "baseline" if epsilon is None else repr(float(epsilon))


def finished(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Budgets of a run whose results are kept; none if the table isn't there. The baseline has a null budget."""
    if not exists(spark, path):
        return spark.createDataFrame([], "epsilon double")
    return spark.read.schema(RESULTS).parquet(path).where(F.col("run_id") == run_id).select("epsilon").distinct()


def remaining(wanted: DataFrame, done: DataFrame) -> DataFrame:
    return wanted.join(done, wanted.epsilon.eqNullSafe(done.epsilon), "left_anti")


@dataclass(frozen=True)
class Learnt:
    """What stands in for trained models: a language model and word vectors of the public texts."""

    model: language_model.Model | None
    vectors: word_vectors.Vectors | None

    @staticmethod
    def of(corpus: DataFrame, perplexity: bool = True, bertscore: bool = True) -> Learnt:
        return Learnt(language_model.fit(corpus) if perplexity else None, word_vectors.fit(corpus) if bertscore else None)


def evaluate(pairs: DataFrame, config: Config, learnt: Learnt, test: DataFrame | None = None, token_vectors: Callable | None = None, losses: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, float]:
    """Metrics by name. pairs: doc_id, original, sanitized, a, b (their embeddings), label, a row a private document.

    token_vectors: what bert_scores_of_texts loads; without it, word vectors of learnt. losses: from doc_id, text to
    doc_id, nll, n_tokens; without it, losses under learnt's language model. The downstream classifier learns b and
    label of pairs, and is judged on embedding and label of test.
    """
    out = pairs.agg(F.avg(dot(F.col("a"), F.col("b"))).alias("cosine_similarity")).first().asDict()
    out |= metrics.text_metrics(pairs).first().asDict()
    if not config.skip_bertscore:
        if token_vectors:
            found = pairs.select(metrics.bert_scores_of_texts(F.col("original"), F.col("sanitized"), token_vectors).alias("s")).select("s.*")
        else:
            found = word_vectors.scores(pairs, learnt.vectors)
        out |= found.agg(*[F.avg(x).alias(f"bertscore_{x}") for x in ("precision", "recall", "f1")]).first().asDict()
    if not config.skip_perplexity:
        texts = pairs.select("doc_id", F.col("sanitized").alias("text"))
        out |= metrics.perplexity(losses(texts) if losses else language_model.losses(texts, "text", learnt.model)).first().asDict()
    if not config.skip_downstream and test is not None:
        known = pairs.where("label is not null").select(F.col("b").alias("embedding"), "label")
        if known.select("label").distinct().limit(2).count() == 2:
            out |= metrics.downstream_f1(known, test.where("label is not null")).first().asDict()
        else:
            log.warning("fewer than two labels: no downstream classifier")
    return {k: float(v) for k, v in out.items() if v is not None}


def run(spark: SparkSession, docs: DataFrame, config: Config, epsilons: list[float], output: str, key: str, token_vectors: Callable | None = None, losses: Callable | None = None, load: Callable | None = None) -> DataFrame:
    """Results of the baseline (private texts as they are, null epsilon) and of all budgets: epsilon, method, metric,
    value, run_id. Each is kept once it is made, and those that are kept aren't made again.

    docs: split (train and test; without it all is train), doc_id, text, label (if there is one). Embeddings depend on
    dataset, model and texts alone: runs with other settings share them, and a run that was killed goes on with the
    chunks that lack. Other texts under the same name are another cache and other results. load: an embedder that
    config.model names, as embed() takes it; without it the name says which.
    """
    results, load = f"{output}/results", load or embedding.loader(config.model)
    docs = docs if "label" in docs.columns else docs.withColumn("label", F.lit(None).cast("int"))
    train, test = (docs.where(F.col("split") == x) for x in ("train", "test")) if "split" in docs.columns else (docs, None)

    def embedded(rows: DataFrame, column: str = "text", into: str = "embedding") -> DataFrame:
        return embedding.embed(rows, column, load, config.dim, into=into)

    def cache(rows: DataFrame) -> Cache:
        return Cache(spark, output, config.dataset, config.model, {"dim": 0 if load else config.dim, "texts": fingerprint(rows, ["doc_id", "text"])})

    of_train = cache(train)
    run_id = config.run_id(fingerprint(docs, [c for c in ("split", "doc_id", "text", "label") if c in docs.columns]))
    found = of_train.table("sentences", train.select("doc_id", "text"), lambda some: embedded(documents.split_sentences(some), "sentence"))
    found = found.where(F.col("pos") < config.max_sentences) if config.max_sentences else found
    of_docs = of_train.table("documents", train.select("doc_id", "text"), lambda some: embedded(some.select("doc_id", "text")).select("doc_id", "embedding"))
    split = stored(documents.public_split(train, config.seed, config.public_ratio, config.max_public, config.max_private), "split")
    # only private documents are compared; test documents judge the downstream classifier
    own = train.join(split.where("not is_public").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", "label")
    own = stored(own.join(of_docs, "doc_id"), "own")
    judged = None
    if test is not None and not config.skip_downstream:
        judged = cache(test).table("test", test.select("doc_id", "text"), lambda some: embedded(some.select("doc_id", "text")).select("doc_id", "embedding"))
        judged = test.select("doc_id", "label").join(judged, "doc_id")
    corpus = train.join(split.where("is_public").select("doc_id"), "doc_id", "left_semi")
    n_docs = own.count()
    log.info("%d private documents", n_docs)

    def keep(epsilon: float | None, method: str, sanitized: DataFrame, took: float | None) -> None:
        pairs = own.select("doc_id", F.col("text").alias("original"), F.col("embedding").alias("a"), "label").join(sanitized, "doc_id")
        pairs = stored(pairs, "pairs")
        if (n := pairs.count()) != n_docs:
            raise ValueError(f"{n} sanitized documents for {n_docs} private ones")
        values = evaluate(pairs, config, learnt, test=judged, token_vectors=token_vectors, losses=losses) if n else {}
        if took is not None:
            values |= {"seconds": took} | ({"seconds_per_document": took / n} if n else {})
        log.info("%s %s: %s", method, epsilon, values)
        rows = [(epsilon, method, k, v, run_id) for k, v in values.items()]
        once(spark.createDataFrame(rows, RESULTS).withColumn("budget", F.lit(budget_name(epsilon))), results, ["run_id", "budget"])

    wanted = spark.createDataFrame([(None,), *((float(e),) for e in epsilons)], "epsilon double")
    todo = [r[0] for r in remaining(wanted, finished(spark, results, run_id)).collect()]  # a row a budget
    learnt = Learnt.of(corpus, not (config.skip_perplexity or losses), not (config.skip_bertscore or token_vectors)) if todo else None
    if None in todo:
        keep(None, "baseline", own.select("doc_id", F.col("text").alias("sanitized"), F.col("embedding").alias("b")), None)
    if budgets := sorted(e for e in todo if e is not None):
        pool, private = documents.public_pool(found, split), documents.private_sentences(train, found, split)
        if config.pca_dim:
            project = retrieval.fit_pca(pool, "embedding", config.pca_dim)
            log.info("explained variance: %.4f", project.explained)
            pool, private = (x.withColumn("embedding", project(F.col("embedding"))) for x in (pool, private))
        pool, centroids = retrieval.fit_clusters(pool, k=config.n_clusters, seed=config.seed)
        settings = Settings(key, config.delta, config.top_k_clusters, mode=config.composition_mode, denoise=config.chained_denoising)
        ready = retrieval.Prepared(pool, centroids, settings.top_clusters, settings.weights)  # once for all budgets
    for e in budgets:
        start = time.time()
        made = stored(sanitize(train, private, pool, centroids, [e], settings, ready), "sanitized")
        keep(e, "retrieval", embedded(made.select("doc_id", "sanitized"), "sanitized", "b"), time.time() - start)
    return spark.read.schema(RESULTS).parquet(results).where(F.col("run_id") == run_id).select("epsilon", "method", "metric", "value", "run_id")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--root", help="folder of the dataset; without it, its last snapshot in the local hub cache")
    p.add_argument("--hub_home", help="the hub cache; HF_HOME or ~/.cache/huggingface without it")
    p.add_argument("--key_file", help="file that holds the secret key of the noise; a fresh key without it")
    p.add_argument("--output_dir", default="results")
    p.add_argument("--epsilons", type=float, nargs="+", default=[100.0, 250.0, 500.0, 1000.0])
    for name, value in asdict(Config()).items():
        p.add_argument(f"--{name}", **({"action": "store_true"} if isinstance(value, bool) else {"type": type(value), "default": value}))
    a = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.INFO)
    config = Config(**{k: a[k] for k in asdict(Config())})
    key = secrets.token_hex(32)
    if a["key_file"]:
        with open(a["key_file"], encoding="utf-8") as f:
            key = f.read().strip()
    spark = SparkSession.builder.appName("hushtext").getOrCreate()
    run(spark, sources.load(spark, config.dataset, a["root"], home=a["hub_home"]), config, a["epsilons"], a["output_dir"], key).orderBy("epsilon", "metric").show(200, False)


if __name__ == "__main__":
    main()
