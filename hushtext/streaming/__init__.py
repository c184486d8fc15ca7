"""Sanitizing streams against a fixed public pool: whole documents a micro-batch, or sentences as they come."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushtext.operators import privacy
from hushtext.operators.retrieval import Prepared
from hushtext.operators.storage import scratch
from hushtext.plans.sanitize import Settings, sanitize_paired

CHOSEN = "epsilon double, doc_id long, pos int, original string, pool_id long, score double"


def sanitize_stream(private: DataFrame, pool: DataFrame, centroids: DataFrame, epsilons: list[float], settings: Settings, path: str, checkpoint: str) -> StreamingQuery:
    """Write epsilon, doc_id, pos, original, replacement of a stream of sentences, a micro-batch at a time.

    A document's sentences (doc_id, pos, sentence, embedding) must come in one micro-batch; see sanitize_sentences
    for those that don't. The pool may be of any size, and is made ready once for all batches. Returns the query.
    """
    ready = Prepared(pool, centroids, settings.top_clusters, settings.weights)

    def write(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):  # what a batch leaves behind goes with it
            made = sanitize_paired(batch, pool, centroids, epsilons, settings, ready)
            made.write.mode("overwrite").parquet(f"{path}/batch={number}")  # the same batch again replaces itself

    return private.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def sanitize_sentences(private: DataFrame, pool: DataFrame, ready: Prepared, epsilons: list[float], settings: Settings, time: str = "time", delay: str = "10 minutes") -> DataFrame:
    """A stream of epsilon, doc_id, pos, original, replacement from a stream of sentences that come one by one.

    private: doc_id, pos (from 0), n_sentences (of the document), sentence, embedding, time. A sentence is
    answered when the next one is there, or at once if it is the document's last; the choice before it and sentences that
    wait are the document's state. Sentences may come in any order within delay. When the watermark passes a document's
    latest time, what waits is answered without what lacks, as if it were the whole document, and the state goes; later
    ones are dropped. Repeated positions count once, the first to come. The results of whole documents are those of
    sanitize_paired. The pool must be one that is broadcast, as a choice needs it at once; denoising looks two
    sentences ahead and is refused.
    """
    if settings.denoise:
        raise ValueError("sentences that come one by one can't be denoised: use sanitize_stream")
    if (told := ready.told) is None:
        raise ValueError("the pool is too large to be broadcast: use sanitize_stream")
    spark, key = private.sparkSession, settings.key
    budgets = spark.createDataFrame([(float(e),) for e in epsilons], "epsilon double")
    rows = private.where("sentence is not null").withWatermark(time, delay).join(F.broadcast(budgets))  # a row a budget
    sigma = privacy.sigma_column(F.col("epsilon"), F.col("n_sentences"), settings.delta, settings.mode)
    rows = rows.withColumn("noisy", privacy.privatized(F.col("embedding"), sigma, key, F.col("epsilon"), F.col("doc_id"), F.col("pos")))
    names = [x.split()[0] for x in CHOSEN.split(", ")]

    def choose(doc: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # place of the next sentence, the vector chosen before, and sentences that wait: pos -> (sentence, noisy)
        at, prev, waiting, n, latest = pickle.loads(state.get[0]) if state.exists else (0, None, {}, 0, 0)
        retriever, out = told.value, []

        def answer(pos: int, after: np.ndarray | None) -> None:
            nonlocal prev
            sentence, noisy = waiting.pop(pos)
            place, score = retriever.step(noisy, after, prev)
            prev = retriever.vectors[place].copy()
            out.append((*doc, pos, sentence, int(retriever.ids[place]), score))

        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.pos >= at and r.pos not in waiting:
                    waiting[int(r.pos)] = (r.sentence, np.array(r.noisy, np.float64))
                n, latest = int(r.n_sentences), max(latest, int(r.ms))
        if state.hasTimedOut:
            order = sorted(waiting)
            for pos, following in zip(order, [*order[1:], None]):
                answer(pos, None if following is None else waiting[following][1])
            state.remove()
        else:
            while at in waiting and (at + 1 in waiting or at + 1 >= n):
                answer(at, waiting[at + 1][1] if at + 1 in waiting else None)
                at += 1
            # a document that is done keeps its place until the watermark passes, so that repeats of it are known
            state.update((pickle.dumps((at, prev, waiting, n, latest)),))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=names)

    rows = rows.select("epsilon", "doc_id", "pos", "n_sentences", "sentence", "noisy", F.unix_millis(F.col(time)).alias("ms"), time)
    chosen = rows.groupBy("epsilon", "doc_id").applyInPandasWithState(choose, CHOSEN, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    named = chosen.join(pool.select("pool_id", F.col("sentence").alias("replacement")), "pool_id")
    return named.select("epsilon", "doc_id", "pos", "original", "replacement")
