"""Substring removal and the FM-index against brute force."""

import hashlib
import random

import numpy as np
import pytest

from verispark.llm import substring
from verispark.llm.files import Stages
from verispark.llm.fm_index import FMIndex, WaveletMatrix


def brute(rows, width=13):
    first = {}
    for i, text in rows:
        w = (text or "").encode().split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, 1 << 62), -(1 << 63) if i is None else i)
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < (-(1 << 63) if i is None else i):
                gone.update(range(k, k + width))
        kept = b" ".join([x for k, x in enumerate(w) if k not in gone])
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, partitions=3):
    frame = spark.createDataFrame([(i, t, "p", 7) for i, t in rows], "doc_id long, text string, places string, rest int")
    cut = substring.remove_repeats(frame, "doc_id", "text", Stages(spark, "t"), partitions)
    assert cut.columns == ["doc_id", "text", "places", "rest", "n_words", "n_removed"]
    got = cut.collect()
    assert all(r.places == "p" and r.rest == 7 for r in got)
    return sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got], key=str)


def test_equal_windows_of_a_crowd_are_combined(spark, monkeypatch):
    rng = random.Random(9)
    hot = " ".join(f"hot{k}" for k in range(30))
    rows = [(i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(20)) + f" {hot} " + " ".join(f"w{rng.randrange(10_000)}" for _ in range(20))) for i in range(80)]
    seen, search = [], substring._search

    def watched(pieces, partitions):
        seen.append(max([r["count"] for r in pieces.groupBy("key").count().collect()], default=0))
        return search(pieces, partitions)

    monkeypatch.setattr(substring, "CROWD", 20)
    monkeypatch.setattr(substring, "_search", watched)
    assert run(spark, rows) == brute(rows)
    assert max(seen) <= 20


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    for n_symbols in (1, 2, 7, 300):
        seq = rng.integers(0, n_symbols, 500)
        matrix = WaveletMatrix(seq, n_symbols)
        symbols, at = rng.integers(0, n_symbols, 400), rng.integers(0, 501, 400)
        assert matrix.rank(symbols, at).tolist() == [int((seq[:a] == s).sum()) for s, a in zip(symbols, at, strict=True)]


@pytest.mark.parametrize("width", [3, 8, 13])
def test_matching_finds_every_window(width):
    rng = np.random.default_rng(width)
    lengths = rng.integers(width, 40, 30)
    symbols = rng.integers(1, 4, int(lengths.sum()))
    index = FMIndex(symbols, lengths, width)
    texts = np.split(symbols, np.cumsum(lengths)[:-1])
    occurs = {}
    for t in texts:
        for k in range(len(t) - width + 1):
            occurs[tuple(t[k:k + width])] = occurs.get(tuple(t[k:k + width]), 0) + 1
    other = rng.integers(0, 4, (20, 50))
    for at in (0, 5, 30):
        other[3, at:at + min(width, 20)] = texts[0][:min(width, 20)]
    query = other.ravel()
    number, offset, group = index.matching(np.arange(20) * 50, np.full(20, 50), query)
    sizes = np.diff(np.append(index.group_start, len(index.text)))
    got = {(int(q), int(o)): int(sizes[g]) for q, o, g in zip(number, offset, group, strict=True)}
    want = {(q, k): occurs[tuple(other[q, k:k + width])] for q in range(20) for k in range(50 - width + 1) if tuple(other[q, k:k + width]) in occurs}
    assert got == want and len(number) == len(got)


def corpus():
    rng = random.Random(4)
    word = lambda n: f"w{rng.randrange(n)}"
    passages = [" ".join(word(500) for _ in range(rng.randrange(10, 80))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(word(400) for _ in range(rng.randrange(1, 60))))
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    base = " ".join(word(90) for _ in range(200))
    rows += [(200 + i, base) for i in range(20)]
    rows += [(300 + i, " ".join(w if rng.random() > 0.02 else "x" for w in base.split())) for i in range(20)]
    rows += [(400, None), (401, ""), (402, "same " * 300), (403, "same " * 13), (404, "same " * 12), (405, "a b " * 100), (None, passages[0]), (None, base),
             (5, passages[1] + " tail"), (5, "other text " + passages[1]), (5, "other text " + passages[1]), (406, "é x y " * 20), (407, "é x y " * 20)]
    return rows


def test_removal(spark, monkeypatch):
    rows = corpus()
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(400, None), (401, "")]) == brute([(400, None), (401, "")])
    assert run(spark, []) == []


def test_word_hashes():
    texts = [b"", b" a  bb\tccc\n", "é x\x85y \x1cz".encode(), b"longer-than-eight longer-than-eighT longer-than-eight", b"a", b"   ", b"x" * 1000 + b" " + b"x" * 999]
    got = substring.word_hashes(texts)
    assert [len(g) for g in got] == [len(t.split()) for t in texts]
    known = {}
    for t, g in zip(texts, got, strict=True):
        for w, h in zip(t.split(), g.tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known) and substring.word_hashes([]) == []


def test_small_shards_and_slices(monkeypatch):
    rng = np.random.default_rng(1)
    words = [b"w%d" % k for k in rng.integers(0, 30, 400)]
    hashes, = substring.word_hashes([b" ".join(words)])
    anchor, segment, first, n, own = substring.segments([hashes])
    assert n.sum() == 400 - 12 and (first[1:] == first[:-1] + n[:-1]).all() and n.max() <= 9
    # Together, alone and after others, a document has the same segments; slices only cut some.
    many = substring.segments([hashes[:5], hashes[:200], hashes, hashes[:13], hashes[50:90]])
    assert [m[many[4] == 2].tolist() for m in many[:4]] == [x.tolist() for x in (anchor, segment, first, n)]
    assert [int(many[3][many[4] == k].sum()) for k in range(5)] == [0, 188, 388, 1, 28]
    monkeypatch.setattr(substring, "SLICE", 64)
    sliced = substring.segments([hashes])
    assert sliced[3].sum() == 388 and set(sliced[0]) >= set(anchor)
    pieces = [b" ".join(words[f:f + k + 12]) for f, k in zip(first, n, strict=True)]
    values, begins = substring.search_shard(pieces, np.arange(len(pieces)))
    found = np.split(values, begins[1:-1])
    seen = {}
    for d, p in enumerate(pieces):
        w = p.split()
        for k in range(len(w) - 12):
            seen.setdefault(tuple(w[k:k + 13]), d)
    assert [f.tolist() for f in found] == [[seen[tuple(p.split()[k:k + 13])] for k in range(len(p.split()) - 12)] for p in pieces]


def test_crowded_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring, "CROWD", 1)
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_op2_query(spark, sf):
    from verispark.llm.queries import op2
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op2(spark, sf).collect()], key=str) == brute(rows)
