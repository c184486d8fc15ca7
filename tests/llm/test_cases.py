"""Each operator on empty tables, clashing names, nulls, ties, repeated rows and very long texts; stages and pipeline."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hushtext.llm import _common, bpe, fertility_rules, language_id, media_chunks, mixing, ngram_join, quality_resample, sharding, token_files, toxicity
from hushtext.llm._common import fresh_path, stored

RND = random.Random(11)
VOCAB = {"en": "the of and ther shat oran house river stone with water bridge".split(), "de": "der und das haus fluss stein mit wasser licht winter".split()}
LONG = " ".join(f"{RND.choice(VOCAB['en'])}{RND.randrange(500)}" for _ in range(140_000))
CLASHING = ["language", "kept", "size", "mix_source", "times", "target", "n_words", "score", "node", "hash", "part", "shard", "key", "n_bytes", "class_id"]


def _text(lang, n=30):
    return " ".join(RND.choices(VOCAB[lang], k=n))


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, _text(("en", "de")[i % 2]) + (" idiot" if i % 5 == 0 else ""), ("en", "de")[i % 2], f"s{i % 3}") for i in range(200)]
    rows += [(None, "null id", "en", "s0"), (None, "other null id", None, None), (500, None, "en", "s0"), (501, "", None, "s1"), (7, rows[7][1], "de", "s1"), (7, rows[7][1], "de", "s1"), (502, rows[7][1], "de", "s2"), (503, LONG, "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for i, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.concat(F.lit(f"own{i} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    return stored(docs, "docs"), labels


def _through_files(module, docs, finish):
    path = fresh_path(docs.sparkSession, "files")
    module.write(docs, path)
    return finish(module.read(docs.sparkSession, path))


OPERATORS = {
    "bpe": lambda d, x: bpe.round_trip_digests(d),
    "language": lambda d, x: language_id.identify(d, languages=("de", "en")),
    "tokens": lambda d, x: _through_files(token_files, d, token_files.checksums),
    "shards": lambda d, x: sharding.assign(d, 2000)[0],
    "quality": lambda d, x: quality_resample.resample(d, x),
    "toxicity": lambda d, x: toxicity.score(d, toxicity.fit(d, x)),
    "fertility": lambda d, x: fertility_rules.judge(d),
    "media": lambda d, x: _through_files(media_chunks, d, media_chunks.digests),
    "mixing": lambda d, x: mixing.take(d),
    "join": lambda d, x: ngram_join.join(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(tables, name):
    docs, labels = tables
    found = [r.asDict() for r in OPERATORS[name](docs, labels).collect()]
    assert Counter(r["doc_id"] for r in found) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    same = [tuple(v for k, v in r.items() if k not in ("start",)) for r in found if r["doc_id"] == 7 and (name != "mixing" or r["text"])]
    assert len(set(map(str, same))) == 1  # repeated rows fare alike
    assert OPERATORS[name](docs.limit(0), labels).count() == 0
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [x for x, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns_of_documents(spark, tables, stage):
    docs, _ = tables
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, None)
    assert out.columns == docs.columns
    known = Counter(docs.select("doc_id", *CLASHING).collect())
    got = Counter(out.select("doc_id", *CLASHING).collect())
    assert set(got) <= set(known) and all(r.size is None or r.size.startswith("own2") for r in got)


def test_pipeline_against_plain_python(spark, tmp_path):
    """The stages' decisions by plain code over each stage's own input; tokens by the library."""
    prose = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and n_chars between 400 and 3000").orderBy("doc_id").limit(30)
    texts = [r.text for r in prose.collect()]
    texts += [texts[0], texts[0] + " more", "1 2 3 !!", "too short", "a b c d e f g h i j " * 10]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))  # too few to fit bands
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, str(tmp_path)), "stage")
        seen.append([r.asDict() for r in now.collect()])
    by_language, by_rules, by_join, mixed, tokens = seen
    assert set(range(31)) <= {r["doc_id"] for r in by_language} <= set(range(len(texts))) - {32}
    m = fertility_rules.Fertility(*map(public_tokenizers.path, (fertility_rules.DEFAULT_VOCABULARY, fertility_rules.SECOND_VOCABULARY)))
    names = [x.split()[0] for x in fertility_rules.METRICS.split(", ")]

    def passes(text, b=fertility_rules.DEFAULTS["latin"]):
        x = dict(zip(names, m.measure(text)))
        if x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"]:
            return False
        return b.chars_low <= x["chars_per_token"] <= b.chars_high and x["byte_share"] <= b.bytes_high and b.entropy_low <= x["token_entropy"] <= b.entropy_high and b.second_low <= x["second_chars_per_token"] <= b.second_high

    assert {r["doc_id"] for r in by_rules} == {r["doc_id"] for r in by_language if passes(r["text"])} and by_rules

    def grams(t):
        w = re.findall(r"\w+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    gone = {b["doc_id"] for a, b in itertools.permutations(by_rules, 2) if a["doc_id"] < b["doc_id"] and len(grams(a["text"]) & grams(b["text"])) >= 0.8 * len(grams(a["text"]) | grams(b["text"]))}
    assert {r["doc_id"] for r in by_join} == {r["doc_id"] for r in by_rules} - gone
    sizes, took = Counter(), Counter()
    for r in by_join:
        sizes[r["source"]] += len(r["text"].split())
    for r in mixed:
        took[r["source"]] += len(r["text"].split())
    goal = mixing.quotas(sizes, mixing.cycle_weights(list(sizes)))
    longest = max(len(r["text"].split()) for r in by_join)
    assert all(abs(took[s] - goal[s]) <= longest for s in goal) and max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    library = Tokenizer.from_file(public_tokenizers.path(bpe.DEFAULT_VOCABULARY))
    text = {i: t for i, t, *_ in rows}
    assert Counter(r["doc_id"] for r in tokens) == Counter(r["doc_id"] for r in mixed)
    for r in tokens:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert Counter(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(str, spark.createDataFrame(tokens, now.schema).collect()))


def _odd_texts(n):
    spans = [(32, 127), (160, 0x250), (0x250, 0x3000), (0x3000, 0xD7FF), (0xE000, 0xFFFF), (0x10000, 0x1FFFF)]
    return ["".join(chr(RND.randrange(*RND.choice(spans[: 1 + i % 6]))) for _ in range(80)) for i in range(n)]


def test_encoders_against_the_library_on_whole_tables(spark):
    """All documents of sf0.01, and texts of any characters that Unicode has assigned."""
    import unicodedata

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["".join(c for c in t if unicodedata.category(c) != "Cn") for t in _odd_texts(1500)] + [" " * 300_000 + "x", "a" * 20_000]
    for module, make in ((bpe, bpe.WordBpe), (token_files, token_files.ByteBpe)):
        path = public_tokenizers.path(module.DEFAULT_VOCABULARY)
        mine, library = make(path), Tokenizer.from_file(path)
        for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert mine.encode(t).tolist() == e.ids


def test_memo_generations():
    from hushtext.llm._common import Generations

    asked = []
    memo = Generations(lambda keys: asked.extend(keys) or [k.encode() for k in keys], 1000)
    for i in range(200):
        known = memo.learn({"usual", f"rare{i}"})
        assert known["usual"] == b"usual" and known[f"rare{i}"] == f"rare{i}".encode() and len(known) < 20
    assert asked.count("usual") == 1


def test_resampling_against_plain_python(spark):
    rows = [(i, _text("en", RND.randrange(1, 60)) if i % 3 else "junk zx qv " * RND.randrange(1, 9)) for i in range(120)] + [(200, ""), (201, None), (202, "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    raw, target = np.zeros(1 << quality_resample.BUCKET_BITS), np.zeros(1 << quality_resample.BUCKET_BITS)
    for i, t in rows:
        np.add.at(raw, b := quality_resample.buckets(t or ""), 1)
        if i < 60 and i % 3:
            np.add.at(target, b, 1)
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    key = {}
    for i, t in rows:
        if len(b := quality_resample.buckets(t or "")):
            u = (int(hashlib.md5(f"quality|{i}".encode()).hexdigest()[:15], 16) + 0.5) / float(1 << 60)
            key[i] = ratio[b].sum() - math.log(-math.log(u))
    chosen = set(sorted(key, key=key.get)[-int(len(rows) * 0.5) :])
    got = quality_resample.resample(docs, labels, keep=0.5).collect()
    assert {r.doc_id for r in got if r.selected} == chosen and len(got) == len(rows)
    assert all(r.log_weight == pytest.approx(ratio[quality_resample.buckets(t or "")].sum(), rel=1e-3, abs=1e-3) for r in got for i, t in rows if i == r.doc_id and i in key)


def _cheapest(patterns, targets, costs):
    """All ways to send words in small patterns: (-words, cost) of the best."""
    links = [(p, s) for p, (_, sources) in patterns.items() for s in sources]
    best = (0, 0)
    for amounts in itertools.product(*[range(min(patterns[p][0] * len(costs), targets[s]) + 1) for p, s in links]):
        into, out = Counter(), Counter()
        for (p, s), n in zip(links, amounts):
            out[p] += n
            into[s] += n
        if all(into[s] <= targets[s] for s in targets) and all(out[p] <= patterns[p][0] * len(costs) for p in patterns):
            cost = sum(costs[i // size] for p, (size, _) in patterns.items() for i in range(out[p]))
            best = min(best, (-sum(amounts), cost))
    return best


def test_flow_against_brute_force():
    for _ in range(25):
        patterns = {f"p{i}": (RND.randrange(1, 4), RND.sample("abc", RND.randrange(1, 3))) for i in range(3)}
        targets = {s: RND.randrange(0, 7) for s in "abc"}
        costs = (0, 1, 3)
        sent = mixing.flow({p: mixing.Pattern.of(*x) for p, x in patterns.items()}, targets, costs)
        into, out = Counter(), Counter()
        for (p, s), n in sent.items():
            assert s in patterns[p][1] and n >= 0
            out[p] += n
            into[s] += n
        assert all(into[s] <= targets[s] for s in targets)
        cost = sum(costs[i // size] for p, (size, _) in patterns.items() for i in range(out[p]))
        assert (-sum(sent.values()), cost) == _cheapest(patterns, targets, costs)


def test_mix_of_overlapping_sources(spark):
    """Documents that several sources hold: the mix is as large and costs as much as the best flow."""
    sets = [["a"], ["b"], ["a", "b"], ["b", "c"], [], None]
    rows = [(i, _text("en", RND.randrange(5, 30)), sets[i % 6]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.take(docs, weights={"a": 5, "b": 1, "c": 1}).collect()
    size, taken = Counter(), Counter()
    for r in got:
        k = tuple(r.source or ())
        size[k] += r["size"]
        taken[k] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    assert taken[()] == 0
    patterns = {k: (n, list(k)) for k, n in size.items() if k}
    routed = {k: mixing.Pattern.of(*x) for k, x in patterns.items()}
    held = Counter()
    for k, (n, sources) in patterns.items():
        for s in sources:
            held[s] += n
    scale = (sum(size.values())) / sum(held.values())
    goal = mixing.quotas({s: n * scale for s, n in held.items()}, {"a": 5, "b": 1, "c": 1})
    sent = Counter()
    for (k, _), n in mixing.flow(routed, goal).items():
        sent[k] += n
    # several flows can be as good: the words and the cost of repetition agree, but for one document a pattern
    cost = lambda words: sum(max(0, min(words[k], (i + 1) * n) - i * n) * c for k, (n, _) in patterns.items() for i, c in enumerate((0, 1, 3)))
    assert abs(sum(taken.values()) - sum(sent.values())) <= 30 * len(patterns) and abs(cost(taken) - cost(sent)) <= 3 * 30 * len(patterns)


def test_flow_of_many_patterns():
    """As many rounds as costs: time grows with the patterns. All quotas that can be filled are."""
    import time

    rnd = random.Random(2)
    sources = [f"s{i}" for i in range(20)]
    patterns = {}
    for i in range(20_000):
        mine = sources[i : i + 1] if i < 20 else rnd.sample(sources, rnd.randrange(2, 8))
        words = rnd.randrange(100_000, 200_000) if i < 20 else rnd.randrange(20, 400)
        rooms = {s: 3 * words * rnd.randrange(1, 4) for s in mine}
        patterns[str(i)] = mixing.Pattern(words, rooms, sum(rooms.values()))
    held = {s: sum(p.rooms.get(s, 0) for p in patterns.values()) / 3 for s in sources}
    goal = mixing.quotas(held, mixing.cycle_weights(sources))
    start = time.time()
    sent = mixing.flow(patterns, goal)
    assert time.time() - start < 60
    into = Counter()
    for (p, s), n in sent.items():
        assert 0 <= n <= patterns[p].rooms[s]
        into[s] += n
    assert all(into[s] == round(goal[s]) for s in sources)


def test_levels():
    assert mixing.levels(10, 25) == [(10, 0), (10, 1), (5, 3)] and mixing.levels(10, 30) == [(10, 0), (10, 1), (10, 3)]
    for words, most in ((7, 7 * 3 * 20_000), (1, 10**9), (5, 5)):
        found = mixing.levels(words, most)
        assert sum(n for n, _ in found) == most and len(found) < 40
        assert all(a < b for (_, a), (_, b) in itertools.pairwise(found))  # convex


@pytest.mark.parametrize("spread", [False, True])
def test_mix_of_copies_in_several_sources(spark, monkeypatch, spread):
    """Each source takes its own rows up to its quota; what is repeated costs least over the distinct texts."""
    if spread:
        for name, value in (("BROADCAST_ROWS", 0), ("HOT_ROWS", 3)):
            monkeypatch.setattr(_common, name, value)
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices(VOCAB["en"], k=10)) + f" t{i}" for i in range(60)]
    rows = [(i, texts[i], "a") for i in range(20)] + [(100 + i, texts[20 + i], "b") for i in range(20)]
    rows += [(200 + i, texts[40 + i % 20], "ab"[i // 20]) for i in range(40)]  # 20 texts stand in both
    rows += [(300 + i, texts[0], "c") for i in range(40)] + [(400, "", "a"), (401, "", "c"), (402, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.take(docs, weights={"a": 2, "b": 1, "c": 1, None: 1}).collect()
    sizes, taken, target, times = Counter(), Counter(), {}, Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        times[r.text] += r.times
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sum(len((t or "").split()) for _, t, s in rows if s == r.source)
    assert all(abs(taken[s] - target[s]) <= 11 * 3 for s in target) and target["a"] > sizes["a"]
    # texts that stand in both sources aren't taken more often than those of one, but for one document a pattern
    shared = sum(times[t] for t in texts[40:]) / 20
    alone = (sum(times[t] for t in texts[1:20]) + sum(times[t] for t in texts[20:40])) / 39
    assert shared <= alone + 1
    assert Counter(mixing.take(docs.repartition(3), weights={"a": 2, "b": 1, "c": 1, None: 1}).collect()) == Counter(got)  # reruns agree


def test_pages(spark):
    """Markup, address and text agree, or the text alone tells; markup speaks for a page whose text says little."""
    rows = []
    for i in range(300):
        lang = ("de", "en")[i % 2]
        rows.append((i, f"https://h{i % 7}.{lang}/x", f"<html lang='{lang}-XX'><script>var der = 1;</script><p>{_text(lang)}</p></html>"))
    rows += [(900, "https://new.de/", f"<html lang='de'><p>{_text('en')}</p></html>"), (901, None, f"<p>{_text('de')}</p>"), (902, "https://h0.de/", None), (903, "https://h1.en/", "<html lang='en'><p>a</p></html>")]
    got = {r.page_id: r for r in language_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), languages=("de", "en")).collect()}
    assert all(got[i].language == ("de", "en")[i % 2] and got[i].kept for i in range(300))
    assert got[900].text_language == "en" and got[901].language == "de" and got[902].language == "und" and got[903].language == "en"


def test_lost_packs_are_an_error(spark):
    rnd = random.Random(5)
    shared = "".join(rnd.choices("abcdefgh", k=40_000))
    docs = spark.createDataFrame([(i, f"{i} {shared}") for i in range(6)], "doc_id long, text string")
    path, lost = fresh_path(spark, "media"), fresh_path(spark, "media")
    media_chunks.write(docs, path)
    packs = spark.read.parquet(f"{path}/packs")
    packs.where("doc_id != 0").write.parquet(f"{lost}/packs")  # the owner of what all share
    spark.read.parquet(f"{path}/shared").write.parquet(f"{lost}/shared")
    assert media_chunks.read(spark, lost).count() == 5
    with pytest.raises(Exception, match="doesn't match its digest"):
        media_chunks.digests(media_chunks.read(spark, lost)).collect()


def test_media_digests_against_plain_python(spark):
    texts = ["", "x" * 5000, "short", _text("en", 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import zlib

    for r in _through_files(media_chunks, docs, media_chunks.digests).collect():
        payload, n = media_chunks.payload_of(texts[r.doc_id])
        samples = np.frombuffer(payload, np.uint8).astype(float)
        mean, spread, _ = r.feature.split(":")
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(payload), zlib.crc32(payload[-32:])) and len(payload) % 576 == 0
        assert float(mean) == pytest.approx(samples.mean(), abs=1e-3) and float(spread) == pytest.approx(samples.std(), abs=1e-3)
        chunks = media_chunks.cut(payload)
        form = media_chunks.stored_form(chunks, [hashlib.sha256(c).digest() for c in chunks])
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())


def test_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2000)
    base = [RND.choice(VOCAB["en"]) + str(RND.randrange(300)) for _ in range(150)]
    rows = [(i, " ".join([*base[:i], "new", *base[i + 1 :]])) for i in range(24)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    grams = {i: set(ngram_join.shingles(t, 5).tolist()) for i, t in rows}
    links = {i: sum(i != j and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) for j in grams) for i in grams}
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (0, links[i]) for i in grams}


def test_one_row_of_each_class_stays(spark):
    """Whatever ids repeat or lack: rows are told apart by doc_id and text."""
    a, b, c = (_text("en", 40) + f" {x}" for x in "abc")
    rows = [(1, a, "x"), (7, a + " more", "x"), (7, b, "x"), (9, c, "x"), (9, c, "x"), (None, "d " + b[::-1], "x"), (None, "d " + b[::-1], "y"), (None, "e " + c[::-1], "x"), (11, "e " + c[::-1], "x"), (12, "", "x"), (12, "", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string")
    got = ngram_join.first_of_each(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert kept == Counter([(1, a), (7, b), (9, c), (None, rows[5][1]), (None, rows[7][1]), (12, ""), (12, ""), (None, None)])
    assert got.count() == len(rows) - 4 and ngram_join.first_of_each(docs.limit(0)).count() == 0


def test_many_null_ids_are_read_once(spark, monkeypatch):
    """Sets are fetched by doc_id and text: as many texts as rows at most."""
    rows = [(None, _text("en", 12) + f" z{i // 2} " + _text("en", 3)) for i in range(60)]
    rows = [(None, rows[i // 2][1] + ("" if i % 2 else " tail")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    read = []
    monkeypatch.setattr(ngram_join, "_sets", lambda docs, wanted, n, sets=ngram_join._sets: (read.append(ngram_join._told_apart(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("print") == F.col("its_print"))).count()), sets(docs, wanted, n))[1])
    assert ngram_join.join(docs).count() == 60 and read[0] <= 60


def test_toxic_slopes_are_not_negative():
    rnd = np.random.default_rng(1)
    x = np.column_stack([np.ones(500), rnd.normal(size=(500, 3))])
    y = (x[:, 1] - x[:, 2] + rnd.normal(size=500) > 0).astype(float)
    w = toxicity._fit_curve(x, y, np.ones(500))
    assert w[1] > 0 and w[2] == 0 and w[3] >= 0 and 0 <= toxicity.DISCOUNT <= 1


def test_page_text_is_that_of_the_patterns_and_linear():
    """What the usual regular expressions give, but in time that grows with the page alone."""
    import time

    def declared(html):
        m = re.search(r"(?ai)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", html)
        return m.group(1).lower() if m else None

    def text(html):
        bare = re.sub(r"(?ais)<(script|style)\b.*?</\1\s*>", " ", html)
        return re.sub(r"(?a)&#?\w+;", " ", re.sub(r"(?s)<!--.*?-->|<[^>]*>", " ", bare))

    pieces = ["<script>", "</script>", "</SCRIPT >", "<style x='>'>", "</style>", "<!--", "-->", "<p>", "</p", ">", "<", "a b", " lang=de", " LANG = 'fr-FR'", "<html", "<HTML x", "&amp;", "&#39;", "&", "<scripted>", "\n", "ü", '"', "<!-->"]
    for _ in range(4000):
        html = "".join(RND.choices(pieces, k=RND.randrange(14)))
        assert language_id.text_in(html) == text(html) and language_id.declared_in(html) == declared(html), html
    start = time.time()
    for piece in ("<!--", "<script", "<style></script>", "<", "<html ", "<html lang", "</script ", "&a", "<html> lang=", "<!--<script>x</style>"):
        language_id.text_in(piece * 100_000)
        language_id.declared_in(piece * 100_000)
    assert time.time() - start < 30
