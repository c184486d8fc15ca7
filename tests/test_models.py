"""Embedders, the language model, word vectors and the scores that plans report, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushtext.operators import embedding, language_model, metrics, word_vectors
from hushtext.operators.stemming import stem

WORDS = "river stone house garden light water bridge winter summer market".split()


def test_a_model_embeds(spark):
    """Null and long texts, repeated ones, order, and weights that a worker gets once."""

    def stub(weights):
        """A stub: counts of letters, and the length; it refuses more than its batch may hold."""

        def encode(texts):
            assert len(texts) <= 4 and (len(texts) == 1 or len(texts) * max(map(len, texts)) <= 1000) and len(set(texts)) == len(texts)
            assert [len(t) for t in texts] == sorted(len(t) for t in texts)
            return [[weights["scale"] * t.count(c) for c in "abc"] + [float(len(t))] for t in texts]

        return encode

    rnd = random.Random(3)
    texts = [None, "", "abc" * 400_000, "a", "a", *("".join(rnd.choices("abcd ", k=rnd.randrange(300))) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    loads = spark.sparkContext.accumulator(0)

    def load(weights):
        loads.add(1)
        return stub(weights)

    made = embedding.embed(rows, "t", load, normalize=False, batch=4, into="v", weights={"scale": 2.0}, chars=1000)
    got = {r.i: r.v for r in made.select("i", "v").collect()}
    assert got == {i: [2.0 * (t or "").count(c) for c in "abc"] + [float(len(t or ""))] for i, t in enumerate(texts)}
    assert loads.value <= 4  # workers, not batches
    unit = {r.i: r.v for r in embedding.embed(rows, "t", lambda: stub({"scale": 1.0}), batch=4, into="v", chars=1000).select("i", "v").collect()}
    assert unit[0] == [0] * 4 and np.linalg.norm(unit[2]) == pytest.approx(1)
    with pytest.raises(Exception, match="gave"):
        embedding.embed(rows, "t", lambda: lambda some: np.zeros((1 + len(some), 2)), into="v").collect()


def _plain_model(texts, order):
    """Interpolated Kneser-Ney by its definition: the probability of a word after its context."""
    runs = Counter()
    for t in texts:
        ws = [""] * (order - 1) + (t or "").lower().split()
        runs.update(tuple(ws[i : i + order]) for i in range(len(ws) - order + 1))
    counts = {order: runs}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(k[1:] for k in counts[n + 1])
    totals = {n: defaultdict(int) for n in counts}
    off = {n: defaultdict(float) for n in counts}
    for n, table in counts.items():
        for k, c in table.items():
            totals[n][k[:-1]] += c
            off[n][k[:-1]] += min(c, 0.75)

    def p(run):
        n = len(run)
        if not n:
            return 1 / (len(counts[1]) + 1)
        context, below = run[:-1], p(run[1:])
        if not totals[n][context]:
            return below
        return (max(counts[n][run] - 0.75, 0) + off[n][context] * below) / totals[n][context]

    return p


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_against_its_definition(spark, order):
    rnd = random.Random(order)
    texts = [" ".join(rnd.choices(WORDS, k=rnd.randrange(1, 15))) for _ in range(40)] + ["", None, "River  RIVER river"]
    asked = [texts[0], "unknown words here river", "river", "", None, " ".join(rnd.choices(WORDS, k=50))]
    model = language_model.fit(spark.createDataFrame([(t,) for t in texts], "text string"), order=order)
    got = {r.doc_id: r for r in language_model.losses(spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string"), "text", model).collect()}
    p = _plain_model(texts, order)
    assert set(got) == {0, 1, 2, 5}
    for i, r in got.items():
        ws = [""] * (order - 1) + asked[i].lower().split()
        losses = [-math.log(p(tuple(ws[j : j + order]))) for j in range(len(ws) - order + 1)]
        assert r.n_tokens == len(losses) and r.nll == pytest.approx(np.mean(losses))
    assert sum(p(("",) * (order - 1) + (w,)) for w in [*WORDS, "unknown"]) == pytest.approx(1)  # one place for all unknown words


def test_language_model_of_nothing(spark):
    model = language_model.fit(spark.createDataFrame([], "text string"))
    r = language_model.losses(spark.createDataFrame([(1, "a b")], "doc_id int, text string"), "text", model).first()
    assert r.nll == 0 and r.n_tokens == 2


def test_language_model_beats_single_words(spark):
    """On text that it wasn't fitted to."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    held = docs.where("doc_id % 5 = 0")
    corpus = docs.where("doc_id % 5 != 0")
    own = metrics.perplexity(language_model.losses(held, "text", language_model.fit(corpus))).first()[0]
    assert own < 0.9 * metrics.perplexity(metrics.word_losses(held, "text", corpus)).first()[0]


def _match(a, b, x, y):
    cos = [[float(u @ v / max(np.linalg.norm(u) * np.linalg.norm(v), 1e-12)) for u in a] for v in b]
    p = sum(max(row) * w for row, w in zip(cos, y)) / sum(y)
    r = sum(max(row[i] for row in cos) * w for i, w in enumerate(x)) / sum(x)
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r)}


def test_weighted_match():
    rng = np.random.default_rng(4)
    a, b, x, y = rng.normal(size=(4, 3)), rng.normal(size=(5, 3)), rng.uniform(0, 2, 4), rng.uniform(0, 2, 5)
    assert word_vectors.weighted_match(a, b, x, y) == pytest.approx(_match(a, b, x, y))
    assert word_vectors.weighted_match(a, a, 0 * x, 0 * x)["f1"] == pytest.approx(1)
    assert word_vectors.weighted_match(a, b[:0], x, y[:0])["f1"] == 0


def test_word_vectors(spark):
    """Words of like company are near one another; the mutual information is that of plain counts."""
    rnd = random.Random(6)
    animals, tools = "cat dog horse sheep".split(), "hammer saw drill knife".split()
    texts = [" ".join(f"the {rnd.choice(animals)} {rnd.choice(['eats', 'sleeps', 'runs'])}" for _ in range(5)) for _ in range(150)]
    texts += [" ".join(f"a {rnd.choice(tools)} {rnd.choice(['cuts', 'breaks', 'lies'])}" for _ in range(5)) for _ in range(150)]
    vectors = word_vectors.fit(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string"), dim=4)
    v = {r.word: np.array(r.learnt) for r in vectors.table.collect()}
    assert vectors.dim == 4 and all(np.linalg.norm(x) == pytest.approx(1) for x in v.values())
    assert np.mean([v[a] @ v[b] for a in animals for b in animals]) > 0.8 > 0.3 > np.mean([v[a] @ v[b] for a in animals for b in tools])
    empty = word_vectors.fit(spark.createDataFrame([("",), (None,)], "text string"))
    assert empty.dim == 0 and empty.table.count() == 0
    pairs = spark.createDataFrame([(0, "The cat eats.", "the dog eats."), (1, "the cat eats", "a hammer cuts"), (2, "the cat eats", "the cat eats"), (3, None, "x"), (4, "zzyzx the", "zzyzx the")], "doc_id int, original string, sanitized string")
    got = {r.doc_id: r for r in word_vectors.scores(pairs, vectors).collect()}
    assert [got[2].f1, got[4].f1] == pytest.approx([1, 1]) and got[3].f1 == 0 and got[0].f1 > got[1].f1 + 0.2
    # against plain Python
    known, unknown = word_vectors.rarity(pairs, "original")
    weight = {r.word: r.weight for r in known.collect()}
    assert weight["the"] == pytest.approx(math.log(6 / 5)) and weight["zzyzx"] == pytest.approx(math.log(6 / 2)) and unknown == pytest.approx(math.log(6))

    def whole(w):
        letters = embedding.hashed_rows([[f"^{w}$"[i : i + 3] for i in range(len(w))]], word_vectors.LETTERS_DIM)[0]
        return np.concatenate([v[w], letters]) * math.sqrt(0.5) if w in v else np.concatenate([np.zeros(4), letters])

    a, b = "the cat eats .".split(), "the dog eats .".split()
    expected = _match([whole(w) for w in a], [whole(w) for w in b], [weight.get(w, unknown) for w in a], [weight.get(w, unknown) for w in b])
    assert got[0].asDict() == pytest.approx({"doc_id": 0, **expected})
    none = {r.doc_id: r.f1 for r in word_vectors.scores(pairs, empty).collect()}
    assert none[2] == pytest.approx(1) and none[1] < 0.8


def test_stemmed_rouge_and_its_mean(spark):
    """Stemmed runs, the longest common subsequence by the usual table, and means and deviation over pairs."""
    rnd = random.Random(9)
    forms = [w + e for w in ("walk", "hop", "relation", "cat", "good") for e in ("", "s", "ing", "ed", "ness", "al")]
    pairs = [(" ".join(rnd.choices(forms, k=rnd.randrange(12))), " ".join(rnd.choices(forms, k=rnd.randrange(12)))) for _ in range(40)]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b, 1):
                row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
        return row[-1]

    def f(same, n, m):
        p, r = same / max(n, 1), same / max(m, 1)
        return 2 * p * r / (p + r) if p + r else 0.0

    sums = defaultdict(list)
    for original, sanitized in pairs:
        r, h = ([stem(w) if len(w) > 3 else w for w in t.split()] for t in (original, sanitized))
        for n in (1, 2):
            x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (h, r))
            sums[f"rouge{n}"].append(f(sum((x & y).values()), len(h) - n + 1, len(r) - n + 1))
        sums["rougeL"].append(f(common(h, r), len(h), len(r)))
        sums["bleu"].append(metrics.bleu_of(original, sanitized))
    got = metrics.text_metrics(spark.createDataFrame(pairs, "original string, sanitized string")).first()
    assert [got.rouge1, got.rouge2, got.rougeL, got.bleu_mean, got.bleu_std] == pytest.approx([np.mean(sums["rouge1"]), np.mean(sums["rouge2"]), np.mean(sums["rougeL"]), np.mean(sums["bleu"]), np.std(sums["bleu"])])


@pytest.mark.parametrize("kinds", [2, 3])
def test_downstream_against_a_plain_solution(spark, kinds):
    """Logistic regression with an L2 weight of one row, by gradient steps in NumPy; then F of each label."""
    rng = np.random.default_rng(kinds)
    middle = rng.normal(size=(kinds, 4))
    labels = rng.integers(kinds, size=240)
    x = middle[labels] + rng.normal(size=(240, 4)) * 1.2
    train, test = slice(0, 160), slice(160, 240)
    one_hot = np.eye(kinds)[labels[train]]
    w, b = np.zeros((4, kinds)), np.zeros(kinds)
    for _ in range(20_000):
        z = x[train] @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        # for two labels the one weight vector is the difference of these two, each of which bears half of the penalty
        w -= 0.5 * (x[train].T @ (p - one_hot) + w * (2 if kinds == 2 else 1)) / 160
        b -= 0.5 * (p - one_hot).sum(axis=0) / 160
    guess, truth = (x[test] @ w + b).argmax(axis=1), labels[test]
    each = [2 * ((guess == k) & (truth == k)).sum() / ((guess == k).sum() + (truth == k).sum()) for k in range(kinds)]
    rows = lambda s: spark.createDataFrame([(v.tolist(), int(y)) for v, y in zip(x[s], labels[s])], "embedding array<double>, label int")
    got = metrics.downstream_f1(rows(train), rows(test)).first()
    assert got.f1_macro == pytest.approx(np.mean(each), abs=1e-6) and got.f1_micro == pytest.approx((guess == truth).mean(), abs=1e-6)


@pytest.mark.parametrize("order, few", [(1, 200_000), (2, 200_000), (3, 200_000), (3, 0), (4, 200_000)])
def test_model_of_what_is_scored(spark, monkeypatch, order, few):
    """The losses of the whole model, from a model that keeps only what the texts look up."""
    monkeypatch.setattr(language_model, "BROADCAST_RUNS", few)
    rnd = random.Random(order)
    corpus = spark.createDataFrame([(i, " ".join(rnd.choices("abcdef", k=12))) for i in range(60)] + [(90, None), (91, " ")], "doc_id long, text string")
    rows = spark.createDataFrame([(0, "a b c a"), (1, "x a b y f"), (2, "f e d c b a"), (3, None), (4, "z")], "doc_id long, text string")
    whole, slim = language_model.fit(corpus, order=order), language_model.fit_for(corpus, rows, order=order)
    found, expected = (sorted(language_model.losses(rows, "text", m).collect()) for m in (slim, whole))
    assert [(r.doc_id, r.n_tokens) for r in found] == [(r.doc_id, r.n_tokens) for r in expected] and len(found) == 4
    assert [r.nll for r in found] == pytest.approx([r.nll for r in expected], abs=1e-12) and slim.unseen == whole.unseen
    if order == 3:
        assert 0 < slim.levels[3].count() < whole.levels[3].count()
