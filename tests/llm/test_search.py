"""Lexical search, the filter audit and exact top-k search against brute force, with odd rows and forced hash collisions."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from biblioflow.llm import audit, lexical, registry, topk
from tests.conftest import rows_of

SCHEMA = "doc_id long, text string, lang string, n long, term string, terms string, part string, row string, item string, key string"


def frame(spark, rows, items=False):
    name = "item_id long, text string, m string, rank string, least string" if items else SCHEMA
    width = name.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], name)


# 11


def cut(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, items, k):
    rows = [(i, cut(t)) for i, t in docs]
    rows = [(i, t) for i, t in rows if t]
    N, L, out = len(rows), sum(len(t) for _, t in rows), []
    for item, text in dict.fromkeys(items):
        found = []
        for i, t in rows:
            score, m = 0, 100 - 90 + 90 * len(t) * N // L
            for q in set(cut(text)):
                df, tf = sum(q in x for _, x in rows), t.count(q)
                w = math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1)))
                score += w * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("seed", range(3))
def test_lexical_search(spark, seed):
    rng = random.Random(seed)
    letters = ["the", "The", "a", "é", "漢字", "x1", "Z"] + [f"w{k}" for k in range(40)]
    text = lambda n: "".join(rng.choice(letters) + rng.choice([" ", "-", ".\n", "_"]) for _ in range(n))
    docs = [(k, text(rng.choice([1, 3, 10, 60]))) for k in range(120)]
    docs += [(200 + k, docs[5][1]) for k in range(40)]  # ties beyond k
    docs += [(7, text(5)), (7, docs[7][1]), (None, docs[5][1]), (300, None), (301, ""), (302, " -- "), (303, "w1 " * 50_000)]
    items = [(k, text(n)) for k, n in enumerate([1, 2, 5, 12, 40])] + [(9, docs[5][1]), (9, "w3"), (9, "w3"), (None, "w4 w5"), (10, ""), (11, None), (12, "unseen"), (13, "W1 unseen é")]
    got = [tuple(r) for r in lexical.search(frame(spark, docs).repartition(5), frame(spark, items, True), 10).collect()]
    assert sorted(got, key=key) == sorted(brute_search(docs, items, 10), key=key)
    assert lexical.search(frame(spark, docs).limit(0), frame(spark, items, True)).count() == 0
    assert lexical.search(frame(spark, docs), frame(spark, items, True).limit(0)).count() == 0


# 12


def brute_audit(docs, labels):
    order = sorted((i for i, _, _ in docs if i is not None))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    facts = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t)}
        facts.append((lang or "", fails | {"E": i is not None and least[t] < i}, i in good, i in toxic))
    assert order
    out, shapley = {}, {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for o in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, x in enumerate(o):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
                alone = sum(f[1][x] and sum(f[1].values()) == 1 for f in own)
                out[part, o, k + 1] = (len(left), len(gone), sum(f[1][x] for f in own) - len(gone), alone, sum(f[2] for f in gone), sum(f[3] for f in gone))
    return {(part, o, k): (*v, shapley[part, o[k - 1]]) for (part, o, k), v in out.items()}


@pytest.mark.parametrize("collide", [False, True])
def test_filter_audit(spark, collide):
    rng = random.Random(3)
    words = lambda n, of: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    texts = [words(n, of) + tail for n in (3, 250) for of in (5, 10**6) for tail in ("", " ABCDEFGHIJKLMNOP" * 30, " #", " | Q")]
    texts += ["a" * 64 + "b", "a" * 64 + "c", "x " * 20_000 + "y", "x " * 20_000 + "z", "", None, "é漢 \t\x0b𝒳"]
    docs = [(k, rng.choice(texts), rng.choice(["en", "fr", "", None])) for k in range(150)]
    docs += [(None, texts[0], "en"), (None, texts[0], "de"), (400, texts[1], "de"), (400, texts[1], "de"), (400, texts[2], "de"), (-1, texts[1], "de")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(100)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    digest = (lambda c: F.lit(7).cast("long")) if collide else F.xxhash64
    counts = audit.mask_counts(audit.masks(frame(spark, docs).repartition(4), digest=digest), given)
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in audit.report(counts).collect()}
    assert got == brute_audit(docs, labels)
    none = frame(spark, docs).limit(0)
    assert audit.report(audit.mask_counts(audit.masks(none), given)).count() == 0


# 13


def brute_top(rows, every, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        found = {}
        for i, v in ok:
            for j, own in ok:
                if j == q != i:
                    found[i] = max(found.get(i, -(1 << 70)), sum(a * b for a, b in zip(own, v)))
        best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(best)]
    return out


@pytest.mark.parametrize("unit", [topk.UNIT, 300])
def test_exact_topk(spark, monkeypatch, unit):
    monkeypatch.setattr(topk, "UNIT", unit)
    rng = np.random.default_rng(1)
    rows = [(int(k), [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for k in range(150)]
    rows += [(1000 + k, [0.5] * 8) for k in range(30)] + [(50, [0.25] * 8), (50, [-3.0] * 8), (60, [9.0] * 8), (60, [9.0] * 8)]  # ties, ids of several rows
    rows += [(-50, [1e6] * 8), (300, [0.0, 0.0, 2.0]), (301, []), (350, None), (351, [None, 1.0]), (352, [math.nan]), (400, [math.inf]), (None, [1.0] * 8)]
    given = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], "vec_id long, embedding array<double>, w string, lane string, group string").repartition(3)
    got = [tuple(r) for r in topk.search(topk.weights(given), F.pmod("vec_id", F.lit(50)) == 0, 5).collect()]
    assert sorted(got) == brute_top(rows, 50, 5)
    assert topk.search(topk.weights(given.limit(0)), F.lit(True)).count() == 0
    assert topk.search(topk.weights(given.where("vec_id = 50")), F.lit(True)).count() == 0


def test_best_takes_ties_by_place():
    scores = np.array([3, 9, 9, 1, 9, 3], np.int64)
    assert topk.best(np.arange(6), scores, 2).tolist() == [1, 2] and topk.best(np.arange(6), scores, 4).tolist() == [1, 2, 4, 0]
    wide = topk.accumulate(np.array([[1 << 40]]), np.array([[1 << 20]]))
    assert wide.tolist() == [[1 << 60]] and pa.array(wide[0]).type == pa.int64()


def test_oracles_of_searches(spark, sf_dir, duck):
    for name in ("op11_lexical_search", "op12_filter_audit", "op13_exact_topk"):
        assert rows_of(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(registry.ORACLE_SQL[name]).df())
