import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hushtext.llm import bpe, fertility_rules, language_id, media_chunks, mixing, ngram_join, quality_resample, sharding, token_files, toxicity
from hushtext.llm._common import fresh_path

ODD = ["", "İstanbul ΣΑΣ ς", "a<|endoftext|>b", "!\x1c! x\x1dy", "a" * 40, "  é É ½ 12³", "it's we'll'S ''''ll", "🎉 日本語", "x\u0085 y", "a\n b \n  c ", "the cat sat " * 900]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "src0") for i, t in enumerate(ODD)] + [(90, None, None, None), (None, "null id", "en", "a"), (3, ODD[3], "en", "src0")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_trie_against_library():
    path = public_tokenizers.path(bpe.DEFAULT_VOCABULARY)
    mine, library = bpe.WordBpe(path), Tokenizer.from_file(path)
    for t in ODD:
        ids = library.encode(t, add_special_tokens=False).ids
        assert mine.encode(t).tolist() == ids
        assert mine.decode(mine.encode(t)) == library.decode(ids, skip_special_tokens=False)


def test_byte_encoder_against_library():
    path = public_tokenizers.path(token_files.DEFAULT_VOCABULARY)
    mine, library = token_files.ByteBpe(path), Tokenizer.from_file(path)
    for t in ODD:
        assert mine.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_bpe_rows(odd):
    r = bpe.round_trip_digests(odd).collect()
    assert len(r) == len(ODD) + 3 and next(x for x in r if x.doc_id == 90).ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.round_trip_digests(odd.limit(0)).count() == 0


def test_token_files(spark, odd):
    path = fresh_path(spark, "t")
    token_files.write(odd, path, files=3)
    r = sorted(token_files.checksums(token_files.read(spark, path)).collect(), key=lambda x: x.start)
    library = Tokenizer.from_file(public_tokenizers.path(token_files.DEFAULT_VOCABULARY))
    start = 0
    for x, (_, t) in zip(r, sorted(((d.doc_id if d.doc_id is not None else -1, d.text or "") for d in odd.collect()))):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read(spark, path, "doc_id = 5").count() == 1


def test_shards_fit(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(600)] + [(1000, "y" * 900), (7, "x" * 7)], "doc_id long, text string")
    shards, _ = sharding.assign(docs, 500)
    r = shards.collect()
    assert len(r) == 602
    for (_, _), rows in {(x.depth, x.shard): [y for y in r if (y.depth, y.shard) == (x.depth, x.shard)] for x in r}.items():
        assert sum(y.n_bytes for y in rows) == rows[0].shard_bytes and (rows[0].shard_bytes <= 500 or len(rows) == 1)


def test_fertility_counts():
    m = fertility_rules.Fertility(public_tokenizers.path(fertility_rules.DEFAULT_VOCABULARY), public_tokenizers.path(fertility_rules.SECOND_VOCABULARY))
    for t in [*ODD, "a b c d e f g h " * 3, "x y\nx y\n\n \nz"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(grams)
        covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if x.strip(fertility_rules.BLANKS)]
        assert m.measure(t)[3] == len(lines) - len(set(lines))
        pieces = [i for x in w for i in m.model.encode(x)]
        if pieces:
            share = np.array(list(Counter(pieces).values())) / len(pieces)
            figures = len(pieces), sum(map(len, w)) / len(pieces), np.mean([m.model.is_byte(i) for i in pieces]), -(share * np.log2(share)).sum(), sum(map(len, w)) / sum(len(m.second.encode(f" {x}", disallowed_special=())) for x in w)
            assert m.measure(t)[5:10] == pytest.approx(figures)
        assert m.measure(t)[:3] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t))) and m.measure(t)[4] == len(covered)


def test_fertility_rows(odd):
    r = {x.doc_id: x for x in fertility_rules.judge(odd.withColumnRenamed("source", "kept")).collect()}
    assert r[90].n_words == 0 and r[90].base_failed and not r[90].kept


def test_chunks_round_trip(spark, odd):
    rnd = random.Random(3)
    data = bytes(rnd.choices(range(97, 105), k=60_000))
    assert b"".join(media_chunks.cut(data)) == data
    shared = data.decode()
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(200, shared), (201, "lead " + shared), (202, shared), (202, "other")], "doc_id long, text string"))
    path = fresh_path(spark, "m")
    media_chunks.write(docs, path)
    r = Counter((x.doc_id, x.payload_sha256) for x in media_chunks.digests(media_chunks.read(spark, path)).collect())
    assert r == Counter((x.doc_id, hashlib.sha256(media_chunks.payload_of(x.text or "")[0]).hexdigest()) for x in docs.collect())


def test_quotas_and_flow():
    q = mixing.quotas({"a": 10, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 2})
    assert q["a"] == 30 and sum(q.values()) == pytest.approx(210) and q["c"] == pytest.approx(2 * q["b"])
    f = mixing.flow({"x": mixing.Pattern.of(10, ["a"]), "y": mixing.Pattern.of(10, ["a", "b"])}, {"a": 15, "b": 5})
    assert f == {("x", "a"): 10, ("y", "a"): 5, ("y", "b"): 5}


def test_mix_rows(odd):
    r = mixing.take(odd).collect()
    assert len(r) == len(ODD) + 3 and all(x.taken <= 3 * x["size"] for x in r)


def _brute(rows, threshold=0.8):
    sets = [set(ngram_join.shingles(t or "", 5).tolist()) for _, t in rows]
    n, root = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                n[i] += 1
                n[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return {rows[i][0]: (rows[root[i]][0], n[i]) for i in range(len(rows))}


def test_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = rnd.choices(words, k=120)
    rows = [(i, " ".join(rnd.choices(words, k=60))) for i in range(30)] + [(100 + i, " ".join([*base[:i], "new", *base[i + 1 :]])) for i in range(20)] + [(200, rows_text := "short text"), (201, rows_text), (202, ""), (203, None)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows)


def test_threshold(spark):
    keys = [5, 9, 9, 1 << 40, 7]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    assert [quality_resample.threshold(df, k) for k in (1, 2, 3, 5)] == [1 << 40, 9, 9, 5]


def test_language_and_toxicity(spark):
    rnd = random.Random(2)
    vocab = {"en": "the and of house river stone with water".split(), "de": "der und das haus fluss stein mit wasser".split()}
    rows = [(i, " ".join(rnd.choices(vocab[k := ("en", "de")[i % 2]], k=30)) + (" idiot" if i % 5 == 0 else ""), k, "s") for i in range(400)]
    docs = spark.createDataFrame([*rows, (999, None, "en", None)], "doc_id long, text string, lang string, source string")
    r = {x.doc_id: x for x in language_id.identify(docs, languages=("de", "en")).collect()}
    assert all(r[i].language == lang for i, _, lang, _ in rows) and not r[999].kept
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    s = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [x for x in s if x.held_out and x.doc_id != 999]
    assert len(s) == 401 and sum(x.predicted == int(x.doc_id % 5 == 0) for x in held) >= 0.95 * len(held)


CLEAN = "Is and retitioning ouen the of, nterti thorreou ndernt. Is ndble whst the by for and threea. Ores the oredat the, anntly re.\nErtion on the it is onenerth edonre ontiatth edes erat as on oransh of shat erre rely thha eresinger. Attireheerstsh nd lytionat edhain of hetian a estiin ndeawhst. Theastou with erhesh. Oforlyhe the atedtion hablees thouou on of. Thlyatat of. Onthanen of ortionou orndhe. Thesrewh onwhtien."


PROSE = {
    "en": "The old bridge over the river was closed last winter because the stones had begun to move, and the town decided to repair it before the spring floods arrived. Workers came from the neighbouring villages, and for several months the square in front of the church was full of carts, ropes and timber. When the work was finished, the mayor gave a short speech and everybody walked across together.",
    "de": "Die alte Brücke über den Fluss wurde im letzten Winter gesperrt, weil sich die Steine bewegt hatten, und die Stadt beschloss, sie vor dem Hochwasser im Frühling zu reparieren. Arbeiter kamen aus den benachbarten Dörfern, und einige Monate lang war der Platz vor der Kirche voller Wagen, Seile und Balken. Als die Arbeit beendet war, hielt der Bürgermeister eine kurze Rede.",
    "fr": "Le vieux pont sur la rivière a été fermé l'hiver dernier parce que les pierres avaient commencé à bouger, et la ville a décidé de le réparer avant les crues du printemps. Des ouvriers sont venus des villages voisins, et pendant plusieurs mois la place devant l'église était pleine de charrettes, de cordes et de poutres. Quand le travail fut terminé, le maire prononça un bref discours.",
    "es": "El viejo puente sobre el río fue cerrado el invierno pasado porque las piedras habían empezado a moverse, y el pueblo decidió repararlo antes de las crecidas de la primavera. Llegaron obreros de los pueblos vecinos, y durante varios meses la plaza delante de la iglesia estuvo llena de carros, cuerdas y maderas. Cuando terminó el trabajo, el alcalde pronunció un breve discurso.",
}


def test_bands_reject(spark):
    """Without labels: prose of four languages, and the text of the tables, pass; encodings and few words in turn don't."""
    rnd = random.Random(7)
    base64 = " ".join("".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=76)) for _ in range(40))
    few = " ".join(rnd.choices("the of and".split(), k=300))
    rows = [(0, CLEAN, "en"), (1, base64, "en"), (2, few, "en"), (3, base64, "de"), (4, few, None)]
    rows += [(10 + i, t, x) for i, (t, x) in enumerate([(t, x) for k, t in PROSE.items() for x in (k, None)])]
    r = {x.doc_id: x for x in fertility_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(x.base_failed for x in r.values())
    assert [r[i].kept for i in range(5)] == [True, False, False, False, False] and all(r[10 + i].kept for i in range(8))


def test_bands_fitted_to_labels(spark):
    """Fitted to one half of the labels of the tables, judged on the other: junk goes, good rows and ordinary prose stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    bands = fertility_rules.fit_bands(docs, labels.where(half == 0))
    assert set(bands) == {"en", "de", "fr", "es"} | set(fertility_rules.DEFAULTS) and len(set(bands.values())) == len(bands)
    known = docs.join(labels.where(half == 1), "doc_id").select("doc_id", "text", "lang", "quality")
    rows = fertility_rules.judge(known, bands=bands).where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in rows}
    assert share[1] > 0.98 and share[0] < 0.05
    prose = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(PROSE.items())], "doc_id long, text string, lang string")
    assert all(r.kept for r in fertility_rules.judge(prose, bands=bands).collect())
    dump = spark.createDataFrame([(i, " ".join(f"{w}$$$ %%%" for w in t.split()), k) for i, (k, t) in enumerate(PROSE.items())], "doc_id long, text string, lang string")
    assert not any(r.kept for r in fertility_rules.judge(dump, bands=bands).collect())
    assert fertility_rules.fit_bands(docs.limit(0), labels) == fertility_rules.fit_bands(docs, labels.limit(0)) == fertility_rules.DEFAULTS


def test_fitted_limits(spark, monkeypatch):
    """Quantiles of the good rows that pass the base rules, entropy around a curve; held against NumPy."""
    made = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit("xx").alias("lang"))
    labels = made.select("doc_id", F.lit(1).alias("quality"))
    b = fertility_rules.fit_bands(made, labels)["xx"]
    rows = [r for r in fertility_rules.judge(made).collect() if not r.base_failed]
    x = np.clip(np.log2([r.n_tokens for r in rows]), np.log2(20), b.span[1])
    bits = np.array([r.token_entropy for r in rows]) - np.polyval(np.polyfit(x, [r.token_entropy for r in rows], 2), x)
    low = lambda v: (lambda a, m: a - fertility_rules.MARGIN * (m - a))(*np.quantile(v, [fertility_rules.TAIL, 0.5], method="inverted_cdf"))
    assert b.chars_low == pytest.approx(low([r.chars_per_token for r in rows]), abs=1e-6)
    assert b.second_low == pytest.approx(low([r.second_chars_per_token for r in rows]), abs=1e-6) and b.entropy_low == pytest.approx(low(bits), abs=1e-3)


def test_toxic_scores_keep_their_scale(spark, monkeypatch):
    rnd = random.Random(4)
    vocab = "the and of house river stone with water bridge garden".split()

    def text(toxic):
        return " ".join(rnd.choices(vocab, k=20) + ["idiot"] * (rnd.random() < (0.7 if toxic else 0.15)))

    rows = [(i, text(i % 10 == 0) + f" t{i}", int(i % 10 == 0)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    mean = []
    for cap in (6000, 100):  # 100 of some 900 ordinary rows of the curve, and of some 100 toxic ones
        monkeypatch.setattr(toxicity, "CURVE_ROWS", cap)
        s = toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", "toxic"))).toPandas()
        mean.append(s.score.mean())
    assert mean[0] == pytest.approx(0.1, abs=0.03) and mean[1] == pytest.approx(mean[0], abs=0.04)


def plain_evidence(rows):
    """Kneser-Ney differences of words and pairs, in plain Python; rows: (text, toxic), texts distinct."""
    n = {}
    for text, k in rows:
        words = text.split()
        for pair in set(zip([None, *words], words)):
            n.setdefault(pair, [0, 0])[k] += 1
    some, every = {}, {}
    for (a, b), c in n.items():
        p, s = some.setdefault(b, [0, 0]), every.setdefault(a, [0, 0, 0])
        for k in (0, 1):
            p[k] += c[k] > 0
            s[k] += max(c[k] - 1, 0)
        s[2] += sum(c)
    shared = {b: sum(1 for x in n if x[1] == b) for b in some}
    left = [sum(max(p[k] - 1, 0) for p in some.values()) for k in (0, 1)]
    w = 1 - sum(left) / sum(map(sum, some.values()))
    total = len(n) + toxicity.SHARED_MORE * len(some)
    p = {b: [(1 - w) * max(c[k] - 1, 0) / left[k] + w * (shared[b] + toxicity.SHARED_MORE) / total for k in (0, 1)] for b, c in some.items()}
    alone, more = {b: math.log(x[1] / x[0]) for b, x in p.items()}, {}
    for (a, b), c in n.items():
        m0, m1, seen = every[a]
        if m0 and m1:
            back = 1 - (m0 + m1) / seen
            q = [(1 - back) * max(c[k] - 1, 0) / (m0, m1)[k] + back * p[b][k] for k in (0, 1)]
            more[a, b] = max(-toxicity.CONTEXT_MOST, min(toxicity.CONTEXT_MOST, math.log(q[1] / q[0]) - alone[b]))
    return alone, more


def test_toxic_counts_take_all_rows_and_both_ways_agree(spark, monkeypatch):
    rnd = random.Random(9)
    vocab = "the and of house river stone with water bridge garden".split()
    rows = [(i, " ".join(rnd.choices(vocab, k=12) + (["you", rnd.choice(["idiot", "fool"])] if i % 4 == 0 else ["you", "friend"]) + [f"t{i % 70}"]), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, None, None), (900, "", 0), rows[5]], "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    got = {r["key"]: r["d"] for r in model.evidence.collect()}
    counted = {t: k for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 < 2}
    alone, more = plain_evidence([(t, k) for t, k in counted.items() if t])

    def keys(words):
        return [int(k) for k in toxicity._keys(toxicity._hashes(" ".join(words))).view(np.int64)]

    for b, d in alone.items():
        assert got.get(keys([b])[0], 0) == pytest.approx(d, abs=1e-5)
    for (a, b), d in more.items():
        assert got.get(keys([b])[1] if a is None else keys([a, b])[3], 0) == pytest.approx(d, abs=1e-5)
    assert len(got) <= len(alone) + len(more)
    by_broadcast = toxicity.score(docs, model).orderBy("doc_id").collect()
    monkeypatch.setattr(toxicity, "MODEL_ENTRIES", 0)
    assert toxicity.score(docs, model).orderBy("doc_id").collect() == by_broadcast and len(by_broadcast) == 603
    assert by_broadcast[0].score == next(r.score for r in by_broadcast if r.doc_id == 900)  # null and empty: no evidence


def test_bands_of_all_labelled_rows(spark, monkeypatch):
    """Whatever their number, all good labelled rows count; texts measured once give the same as measured twice."""
    monkeypatch.setattr(fertility_rules, "LABELLED_ROWS", 50, raising=False)  # a bound of earlier versions
    made = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit("xx").alias("lang"))
    labels = made.select("doc_id", F.lit(1).alias("quality"))
    bands = fertility_rules.fit_bands(made, labels)
    assert "xx" in bands
    twice, once = fertility_rules.judge(made, bands=bands), fertility_rules.judge_fitted(made, labels)
    assert once.columns == twice.columns and sorted(once.collect()) == sorted(twice.collect())
    assert fertility_rules.kept(made, labels).count() == twice.where("kept").count() < made.count()
