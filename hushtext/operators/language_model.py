"""A language model of words from a public corpus: interpolated Kneser-Ney counts, and losses by joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushtext.operators.storage import stored

#: Stands before the first word of a text; no word is empty.
START = ""
DISCOUNT = 0.75
#: Distinct runs of the texts to be scored that are broadcast to those of the corpus; more are joined by shuffles.
BROADCAST_RUNS = 200_000


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def runs(docs: DataFrame, text: str, order: int, *keys: str) -> DataFrame:
    """keys, w1 ... w<order>: each word of each text, last, and the words before it; START where there is none."""
    tokens = docs.select(*keys, words(F.col(text)).alias("__w"))
    before = F.concat(F.array(*[F.lit(START)] * (order - 1)), F.col("__w")) if order > 1 else F.col("__w")
    every = tokens.select(*keys, before.alias("__b"), F.size("__w").alias("__n")).where("__n > 0")
    one = every.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.struct(*[F.get("__b", i + j).alias(f"w{j + 1}") for j in range(order)]))).alias("r"))
    return one.select(*keys, "r.*")


@dataclass(frozen=True)
class Model:
    """levels: by the number of words of a run, its discounted share. kinds and total: of single words."""

    order: int
    levels: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    unseen: float


def fit(corpus: DataFrame, text: str = "text", order: int = 3) -> Model:
    """Interpolated Kneser-Ney with one discount: runs of order words count how often they stand in the corpus, shorter ones
    by how many different words they stand.

    levels[n]: w1 ... wn and share = max(c - DISCOUNT, 0) / c(context). contexts[n]: w1 ... w<n-1> and rest, the share
    that goes to the next shorter run. Words not in the corpus share what is left of the single words evenly, with one place
    for all of them. Grouped counts, stored once; an empty corpus gives each word the same.
    """
    names = [f"w{i + 1}" for i in range(order)]
    counts = stored(runs(corpus, text, order).groupBy(*names).agg(F.count("*").alias("c")), "lm-runs")
    levels, contexts = {}, {}
    for n in range(order, 0, -1):
        own = names[:n]
        if n > 1:
            context = counts.groupBy(*own[:-1]).agg(F.sum("c").alias("total"), F.sum(F.least(F.col("c"), F.lit(DISCOUNT))).alias("off"))
            contexts[n] = stored(context.select(*own[:-1], "total", (F.col("off") / F.col("total")).alias("rest")), "lm-contexts")
            shared = counts.join(contexts[n].drop("rest"), own[:-1])
            levels[n] = stored(shared.select(*own, (F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / F.col("total")).alias("share")), "lm-shares")
            # the next shorter run: without its first word, counted once for each
            counts = stored(counts.groupBy(*[F.col(x).alias(y) for x, y in zip(own[1:], own)]).agg(F.count("*").alias("c")), "lm-continued")
    levels[1], unseen = _single_words(counts)
    return Model(order, levels, contexts, unseen)


def fit_for(corpus: DataFrame, rows: DataFrame, text: str = "text", order: int = 3) -> Model:
    """fit() of the whole corpus, of which levels and contexts hold what losses() of rows looks up, with the same values.

    Runs of the corpus move once, dealt by all their words but the first: so one pass counts them, counts the shorter runs
    that they go on as, and keeps those whose context stands in rows. What is stored is a row for each shorter run.
    """
    names = [f"w{i + 1}" for i in range(order)]
    scored = stored(runs(rows, text, order).distinct(), "lm-scored")
    few = scored.count() <= BROADCAST_RUNS

    def wanted(first: int, last: int) -> DataFrame:
        """The distinct runs of words first to last of those to be scored, as w1 and so on."""
        out = scored.select(*[F.col(x).alias(y) for x, y in zip(names[first:last], names)]).distinct()
        return F.broadcast(out) if few else out

    def kept(counts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """The level and the contexts of runs of n words; counts: all runs with a context that is wanted."""
        own = names[:n]
        context = counts.groupBy(*own[:-1]).agg(F.sum("c").alias("total"), F.sum(F.least(F.col("c"), F.lit(DISCOUNT))).alias("off"))
        context = stored(context.select(*own[:-1], "total", (F.col("off") / F.col("total")).alias("rest")), "lm-contexts")
        mine = counts.join(wanted(order - n, order), own, "left_semi").join(context.drop("rest"), own[:-1])
        return stored(mine.select(*own, (F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / F.col("total")).alias("share")), "lm-shares"), context

    levels, contexts = {}, {}
    counts = runs(corpus, text, order)
    if order > 1:
        rest = names[1:]
        counts = counts.repartition(*rest).groupBy(*names).agg(F.count("*").alias("c"))
        marked = counts.join(wanted(0, order - 1).withColumn("__near", F.lit(True)), names[:-1], "left")
        near = F.collect_list(F.when(F.col("__near"), F.struct("w1", "c"))).alias("near")
        held = stored(marked.groupBy(*rest).agg(F.count("*").alias("n"), near), "lm-continued")
        own = held.where(F.size("near") > 0).select(*rest, F.explode("near").alias("r")).select("r.w1", *rest, "r.c")
        levels[order], contexts[order] = kept(own, order)
        counts = held.select(*[F.col(x).alias(y) for x, y in zip(rest, names)], F.col("n").alias("c"))
    else:
        counts = stored(counts.groupBy("w1").agg(F.count("*").alias("c")), "lm-runs")
    for n in range(order - 1, 0, -1):
        if n > 1:
            own = names[:n]
            levels[n], contexts[n] = kept(counts.join(wanted(order - n, order - 1), own[:-1], "left_semi"), n)
            counts = stored(counts.groupBy(*[F.col(x).alias(y) for x, y in zip(own[1:], own)]).agg(F.count("*").alias("c")), "lm-continued")
    levels[1], unseen = _single_words(counts)
    return Model(order, levels, contexts, unseen)


def _single_words(counts: DataFrame) -> tuple[DataFrame, float]:
    total, kinds, off = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.least(F.col("c"), F.lit(DISCOUNT))), F.lit(0.0))).first()
    unseen = float(off) / total / (kinds + 1) if total else 1.0
    return counts.select("w1", ((F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / max(total, 1)) + unseen).alias("share")), unseen


def losses(rows: DataFrame, text: str, model: Model, key: str = "doc_id") -> DataFrame:
    """key, nll (mean loss of a word) and n_tokens of each text that has words.

    Each distinct run of the texts is scored once, from single words up, by joins on the words of the run, and then goes
    back to the texts that hold it.
    """
    names = [f"w{i + 1}" for i in range(model.order)]
    held = stored(runs(rows, text, model.order, key).groupBy(key, *names).agg(F.count("*").alias("m")), "lm-held")
    scored = held.select(*names).distinct()
    p: Column = F.lit(0.0)
    for n in range(1, model.order + 1):
        # the last n words of the run
        own, mine = names[model.order - n :], [f"w{i + 1}" for i in range(n)]
        level = model.levels[n].select(*[F.col(x).alias(f"__{x}") for x in mine], F.col("share").alias(f"__share{n}"))
        scored = scored.join(level, [F.col(x) == F.col(f"__{y}") for x, y in zip(own, mine)], "left").drop(*[f"__{x}" for x in mine])
        if n == 1:
            p = F.coalesce(F.col("__share1"), F.lit(model.unseen))
            continue
        context = model.contexts[n].select(*[F.col(x).alias(f"__{x}") for x in mine[:-1]], F.col("rest").alias(f"__rest{n}"))
        scored = scored.join(context, [F.col(x) == F.col(f"__{y}") for x, y in zip(own[:-1], mine[:-1])], "left").drop(*[f"__{x}" for x in mine[:-1]])
        p = F.coalesce(F.col(f"__share{n}"), F.lit(0.0)) + F.coalesce(F.col(f"__rest{n}"), F.lit(1.0)) * p
    scored = scored.select(*names, (-F.ln(p)).alias("loss"))
    found = held.join(scored, names)
    return found.groupBy(key).agg((F.sum(F.col("m") * F.col("loss")) / F.sum("m")).alias("nll"), F.sum("m").alias("n_tokens"))
