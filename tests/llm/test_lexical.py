"""Ranked lexical search against plain integers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from verispark.llm import lexical
from verispark.llm.files import Stages

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall(text.translate(LOWER)) if text else []


def brute(docs, items, top=50):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    counts = [Counter(b) for _, b in bags]
    dfs = Counter(t for c in counts for t in c)
    wanted = {}
    for i, t in items:
        if t is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in wanted.items():
        scored = []
        for (doc, bag), count in zip(bags, counts, strict=True):
            m = 50 + (50 * len(bag) * n_docs) // max(n_terms, 1)
            score = 0
            for t in ts:
                tf, df = count[t], dfs[t]
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10 ** 9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(i, k + 1, None if absent else doc, -s) for k, (s, absent, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, terms string").repartition(5)
    q = spark.createDataFrame([(i, t, 7.0) for i, t in items], "item_id long, text string, score double")
    out = lexical.rank_documents(d, q, Stages(spark, "t"), **how)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in out.collect()], key=str)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    pool = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)] + ["École", "ÉCOLE", "x_y", "Zeta", "zeta", "a1b2", "naïve"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(n)]
    docs += [(500, None), (501, ""), (502, " \x00-\t:@[`{\x7f"), (None, "w1 w2 zeta"), (503, "w1 " * 4000), (504, "Same words here"), (504, "Same words here"), (400, "same WORDS here")]
    docs += [(1000 - i, "tied document about zeta") for i in range(130)]
    items = [(1, "zeta"), (2, "w1 w2 w3 w1"), (3, None), (4, ""), (5, "nothing-matches"), (6, "same words"), (6, "ZETA!"), (None, "École naïve"), (7, " ".join(pool)), (1, "zeta")]
    return docs, items


def test_odd_rows(spark):
    docs, items = corpus()
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert [r[2] for r in sorted(r for r in got if r[0] == 1)][:3] != [1000, 999, 998]
    assert run(spark, docs, items, top=3) == brute(docs, items, 3)


def test_small_tiles_and_blocks(spark, monkeypatch):
    docs, items = corpus(2)
    rng = random.Random(4)
    items += [(100 + k, " ".join(f"w{rng.randrange(60)}" for _ in range(30))) for k in range(90)]
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 4000)
    assert len(lexical._blocks(spark.createDataFrame(items, "item_id long, text string"))) > 1
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("top", [1, 7])
def test_ranker_prunes_ties_safely(top):
    rng = np.random.default_rng(top)
    weights = np.array([5, 3, 3], np.int64)
    tool = lexical.Ranker([(9, [0, 1]), (8, [1, 2])], weights, 50, 500, top, 50)
    seen = []
    for _ in range(30):
        n = 700
        ids, counts = rng.permutation(10_000)[:n], rng.integers(1, 3, n)
        tool.add(ids, np.zeros(n, bool), np.full(n, 10), np.arange(n + 1), rng.integers(0, 3, n), counts)
        tool.prune()
        seen.append(ids)
    item, score, absent, ids = tool.prune()
    assert len(item) == 2 * top and (np.diff(item) >= 0).all()
    # The best scores are common, so ids decide: the smallest of those that reach the best score.
    assert (np.diff(ids[item == 0]) >= 0).all() and len(set(score[item == 0])) == 1


def test_tiles_keep_sums_exact():
    weights = np.full(5000, 40_000, np.int64)
    parts = lexical.Ranker.cut(np.arange(5000), weights)
    assert [len(p) for p in parts] == [2048, 2048, 904]
    heavy = lexical.Ranker.cut(np.arange(10), np.full(10, (lexical.EXACT >> 21), np.int64))
    assert all(int(len(p)) * (lexical.EXACT >> 21) * lexical.TOP_IMPACT < lexical.EXACT for p in heavy) and sum(map(len, heavy)) == 10
    # A length that leaves 64 bits on the way is computed in whole numbers all the same.
    big = lexical.impacts(np.array([1, 2]), np.array([10 ** 9, 1]), 10 ** 12, 10 ** 15, 50)
    m = [50 + 50 * n * 10 ** 12 // 10 ** 15 for n in (10 ** 9, 1)]
    assert list(big) == [10 ** 9 // (1000 + 20 * m[0]), 2 * 10 ** 9 // (2000 + 20 * m[1])]


def test_empty_tables(spark):
    assert run(spark, [(1, "a b")], [(1, None)]) == [] and run(spark, [(1, None)], [(1, "a")]) == []
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(none, items, Stages(spark, "t")).count() == 0
    assert lexical.rank_documents(items.withColumnRenamed("item_id", "doc_id"), items.limit(0), Stages(spark, "t")).count() == 0
