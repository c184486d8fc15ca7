"""Filter audit, periodic runs and top-k search against brute force, on odd tables too."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushtext.llm import _common, filter_audit, periodic_runs, vector_search

RND = random.Random(23)
LONG = " ".join(f"w{RND.randrange(3000)}" for _ in range(150_000))


def _docs():
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(RND.sample(words, RND.randrange(150, 300)) * RND.choice([1, 1, 3])) + RND.choice(["", " a|b", " ABC" * 60]), f"s{i % 3}") for i in range(90)]
    rows += [(100 + i, rows[i % 7][1], RND.choice(["s0", None, ""])) for i in range(40)]
    rows += [(None, rows[3][1], "s1"), (None, "no id", None), (200, None, "s2"), (201, "", "s2"), (202, "", None), (5, rows[5][1], "s2"), (5, rows[5][1], "s2"), (203, LONG, "s0"), (204, "ÄÖ É" * 80, "s1"), (205, "A" * 3 + "é" * 147, "s1")]
    return rows


def _labels():
    return [(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(3, 1, 0), (4, None, 1), (None, 1, 1), (200, 1, 1)]


def _failures(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield {x for x, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), i is not None and first[t] < i)) if bad}


@pytest.mark.parametrize("spread", [False, True])
def test_filter_audit_against_brute_force(spark, monkeypatch, spread):
    if spread:
        for module, name, value in ((_common, "BROADCAST_ROWS", 0), (_common, "HOT_ROWS", 3), (filter_audit, "CHUNK_ROWS", 5)):
            monkeypatch.setattr(module, name, value)
    rows, labels = _docs(), _labels()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({x: F.lit("own") for x in ("part", "hash", "good", "fails", "A", "kept")}).repartition(5)
    got = {(r.part, r.filter_order, r.step): r.asDict() for r in filter_audit.interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    failed = list(_failures(rows))
    assert len(got) == 4 * 120 * 5
    shapley = Counter()
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, failed) if (s or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                r = got[part, order, step]
                assert (r["kept"], r["removed"], r["unique_fails"]) == (len(left), len(gone), sum(f == {x} for _, f in mine))
                assert r["redundant"] == sum(x in f for _, f in mine) - len(gone)
                assert (r["good_lost"], r["toxic_lost"]) == (sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                shapley[part, x] += len(gone)
    assert all(r["shapley"] == shapley[p, o[s - 1]] for (p, o, s), r in got.items())


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(docs, labels).count() == 0


def test_bitmaps_take_any_filters(spark):
    rows = [(f"p{i % 70}" if i % 11 else None, i % 3 == 0, i % 5 == 0 if i % 4 else None, i % 2 == 0) for i in range(3000)]
    index = filter_audit.bitmaps(spark.createDataFrame(rows, "part string, x boolean, y boolean, z boolean"), ["x", "y", "z"])
    counts = {(r.part, r.passed): r for r in filter_audit.prefix_counts(index, ["x", "y"], ["z"]).collect()}
    for part in {r[0] for r in rows}:
        for s in range(4):
            left = [z for p, x, y, z in rows if p == part and not (s & 1 and x) and not (s & 2 and y)]
            assert (counts[part, s].n_all, counts[part, s].n_z) == (len(left), sum(left))
        assert counts[part, 3].alone_0 == sum(p == part and x and not y for p, x, y, _ in rows)
        assert counts[part, 3].alone_1 == sum(p == part and bool(y) and not x for p, x, y, _ in rows)


def _runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(24, 3 * q) and not any(words[i : j + q - d] == words[i + d : j + q] for d in range(1, q)):
                    out.append((i, j + q - i, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _periodic():
    kinds, n = RND.choice([1, 2, 3, 5, 50]), RND.randrange(160)
    words = [b"%d" % RND.randrange(kinds) for _ in range(n)]
    for _ in range(RND.randrange(4)):
        at, q, m = RND.randrange(len(words) + 1), RND.randrange(1, 30), RND.randrange(120)
        unit = [b"%d" % RND.randrange(max(kinds, 2)) for _ in range(q)]
        words[at:at] = (unit * (m // q + 1))[:m]
    if RND.random() < 0.2:
        x, y = [b"a"], [b"a", b"b"]
        for _ in range(RND.randrange(9)):
            x, y = y, y + x
        words += y
    return words


@pytest.mark.parametrize("block", [2, 2048])
def test_runs_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "BLOCK", block)
    found = 0
    for _ in range(600):
        words = _periodic()
        expected = _runs(words)
        found += len(expected)
        assert periodic_runs.document_runs(words) == expected
    assert found > 300


def test_runs_of_long_texts():
    assert periodic_runs.document_runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    unit = [b"%d" % RND.randrange(10**6) for _ in range(20_000)]
    assert periodic_runs.document_runs([b"x", *(unit * 4), b"y"]) == [(1, 80_000, 20_000)]
    assert periodic_runs.document_runs([b"%d" % i for i in range(100_000)]) == []


def test_periodic_runs_of_documents(spark):
    rows = [(i, b" ".join(_periodic()).decode()) for i in range(300)] + [(None, "a " * 50), (1000, None), (1001, ""), (1002, " \x0b \n"), (1003, LONG), (7, "b c " * 20), (7, "b c " * 20), (1004, "é ü " * 30 + "x\xa0y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_runs", F.lit("own"))
    got = periodic_runs.find(docs).collect()
    assert len(got) == len(rows)
    expected = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = _runs(words) if n < 10_000 else periodic_runs.document_runs([w.encode() for w in words])
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert Counter(map(tuple, got)) == Counter(expected)
    assert periodic_runs.find(docs.limit(0)).count() == 0


def _whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(64 * x) for x in v]


@pytest.mark.parametrize("small", [False, True])
def test_top_k_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("SIDE_BYTES", 800), ("FAN", 2), ("MERGED_QUERIES", 3), ("LEAST_ROWS", 4), ("SCORES", 7)):
            monkeypatch.setattr(vector_search, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 5) / 2.0).tolist()) for i in range(150)] + [(i, [0.5, -0.25, 1.0, 0.0, 0.0]) for i in range(200, 260)]
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0, 0.0]), (340, [math.nan] * 5), (341, [math.inf, 0.0, 0.0, 0.0, 0.0]), (360, []), (361, []), (380, [1.0, 2.0]), (381, [3.0, 4.0]), (400, [1e6, -1e6, 3e5, 1e-9, 7.0])]
    rows += [(420, [1e30, 1.0, 0.0, 0.0, 0.0]), (None, [5.0, 5.0, 5.0, 5.0, 5.0]), (None, [1.0] * 5), (20, rows[20][1]), (20, rows[20][1]), (-40, [1.0] * 5), (431, [1.0] * 7)]
    df = spark.createDataFrame([(i, v, "own") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    got = vector_search.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()
    vectors = [(i, _whole(v)) for i, v in rows]
    expected, top = [], 2**63 - 1
    for at, (q, u) in enumerate(vectors):
        if u is not None and q is not None and q % 20 == 0:
            scores = sorted((-max(-top, min(top, sum(a * b for a, b in zip(u, v)))), i is None, i or 0, i) for j, (i, v) in enumerate(vectors) if j != at and v is not None and len(v) == len(u))
            expected += [(q, rank, i, -s) for rank, (s, _, _, i) in enumerate(scores[:20], 1)]
    assert Counter(map(tuple, got)) == Counter(expected)
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
