"""Benchmark passages against brute force over all windows."""

import random

import numpy as np
import pytest

from verispark.llm import decontaminate as dc

ITEMS = [(k, " ".join(f"v{random.Random(100 * k + j).randrange(300)}" for j in range(n))) for k, n in enumerate((6, 12, 20, 35, 35, 55, 4))]


def slow_distance(item, words):
    """Sellers' recurrence, cell by cell."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def brute(rows, items):
    out = {}
    for doc, text in rows:
        words = dc.words_of(text)
        for item_id, body in items:
            item = dc.words_of(body)
            if len(item) >= 5 and words:
                d = slow_distance(item, words)
                if d <= int(0.2 * len(item) + 1e-9):
                    out[(doc, item_id)] = min(d, out.get((doc, item_id), 99))
    return out


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = f"z{rng.randrange(99)}"
        elif kind == 1:
            words.insert(at, f"v{rng.randrange(300)}")
        else:
            del words[at]
    return words


def documents():
    rng, rows = random.Random(1), []
    filler = lambda n: [f"v{rng.randrange(300)}" if rng.random() < 0.4 else f"u{rng.randrange(999)}" for _ in range(n)]
    for i in range(300):
        item = dc.words_of(ITEMS[i % 6][1])
        words = filler(rng.randrange(0, 60)) + edited(rng, item, rng.randrange(0, 1 + int(0.2 * len(item)))) + filler(rng.randrange(0, 60))
        rows.append((i, " ".join(words)))
    return rows


def test_recall_against_brute_force():
    rows = documents()
    want = brute(rows, ITEMS)
    tool = dc.Matcher(ITEMS, 0.8, 0.95, 5)
    got = {(doc, m[0]): m[1] for (doc, _), ms in zip(rows, tool.matches([t for _, t in rows]), strict=True) for m in ms}
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    share = len(got) / len(want)
    exact = np.mean([got[k] == want[k] for k in got])
    assert share >= 0.9 and exact >= 0.95, (share, exact)


@pytest.mark.parametrize(("words", "trials"), [(20, 40), (55, 40), (150, 40), (400, 30), (1000, 20)])
def test_recall_at_the_limit_for_every_length(words, trials):
    rng = random.Random(words)
    item = [f"v{rng.randrange(2000)}" for _ in range(words)]
    tool = dc.Matcher([(1, " ".join(item))], 0.8, 0.95, 1)
    filler = lambda: [f"v{rng.randrange(2000)}" for _ in range(rng.randrange(40, 90))]
    texts = [" ".join(filler() + edited(rng, item, int(0.2 * words)) + filler()) for _ in range(trials)]
    assert np.mean([bool(m) for m in tool.matches(texts)]) >= 0.9


def test_short_items_are_found_as_they_are():
    tool = dc.Matcher([(1, "one"), (2, "Two three"), (3, "a b c d"), (4, ""), (5, "!?")], 0.8, 0.95, 1)
    got = [[m[0] for m in ms] for ms in tool.matches(["so one, two", "two; THREE", "a b c", "x a b c d", None, "two x three"])]
    assert got == [[1], [2], [], [3], [], []]


def test_edit_end():
    rng = random.Random(2)
    for _ in range(50):
        item, text = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], [rng.randrange(4) for _ in range(rng.randrange(0, 20))]
        assert dc.edit_end(np.array(item), np.array(text, int))[0] == slow_distance(item, text)


def frames(spark):
    docs = spark.createDataFrame([(1, ITEMS[3][1].upper().replace(" ", "\n, ")), (2, None), (3, ""), (None, "before " + ITEMS[1][1]), (4, "clean words only"),
                                  (4, "clean words only"), (5, ITEMS[6][1]), (6, "v1 " * 50_000)], "doc_id long, text string").selectExpr("*", "1 item_id", "'x' words")
    items = spark.createDataFrame([*ITEMS, (90, None), (None, "five words without an id"), (3, ITEMS[3][1])], "item_id long, text string")
    return docs, items


def test_odd_rows(spark, monkeypatch):
    docs, items = frames(spark)
    want = [(1, 3, 0, 35), (None, 1, 0, 12)]
    for size in (1 << 20, 300):  # one block, and several
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        benchmark = dc.Benchmark(items, min_words=5)
        assert (len(benchmark.blocks) > 1) == (size == 300)
        assert sorted([tuple(r)[:4] for r in dc.find_passages(docs, benchmark).collect()], key=str) == want
        kept = dc.without_passages(docs, "text", benchmark)
        assert kept.columns == docs.columns and sorted([r.doc_id for r in kept.collect()]) == [2, 3, 4, 4, 5, 6]
    assert dc.find_passages(docs, dc.Benchmark(items.limit(0))).count() == 0
    assert dc.find_passages(docs.limit(0), dc.Benchmark(items)).count() == 0


def test_op5_query(spark, sf):
    from verispark.llm.queries import op5
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    tool = dc.Matcher(items, 0.8, 0.95, 5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    # Exact copies of items are all there, and nothing that is not similar.
    exact = {(d, i) for d, t in rows for i, b in items if t and " ".join(dc.words_of(b)) in " ".join(dc.words_of(t))}
    got = {(r.doc_id, r.item_id): r for r in op5(spark, sf).collect()}
    assert exact <= set(got) and len(tool.items) == len(items)
    texts = dict(rows)
    for (d, i), r in got.items():
        assert slow_distance(dc.words_of(dict(items)[i]), dc.words_of(texts[d])) <= r.distance <= 0.2 * r.item_words
