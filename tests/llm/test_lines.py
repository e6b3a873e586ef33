"""Line dedup against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from verispark.llm import line_dedup
from verispark.llm.files import Stages

BLANKS = " \t\n\x0b\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    """(id, text) -> rows (id, n_lines, n_dropped, kept text)."""
    holders = {}
    key = lambda line: line.strip(BLANKS).translate(UPPER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            at = holders[key(line)]
            if len(key(line)) < min_chars or len(at) < min_docs or i == max(at, key=lambda x: (x is not None, x or 0)):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, partitions=4, **limits):
    frame = spark.createDataFrame([(i, t, "x", 1, 2, True) for i, t in rows],
                                  "doc_id long, text string, body string, word int, n_lines int, keep boolean")
    bitmaps = line_dedup.keep_bitmaps(frame, "doc_id", "text", Stages(spark, "t"), partitions, **limits)
    out = line_dedup.apply_bitmaps(frame, "doc_id", "text", bitmaps)
    assert out.columns == ["doc_id", "text", "body", "word", "keep", "n_lines", "n_dropped"]
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()], key=str), bitmaps


def odd_rows():
    shared, other = "A line that several documents share", "éééé üüüü ßßßß 🙂🙂🙂🙂 x"
    long_text = "\n".join(f"line number {i} of a long document" if i % 7 else shared for i in range(5000))
    rows = [(1, shared), (2, f"  {shared.upper()}\t\nunique to the second document"), (3, f"{shared}\n{shared}\x0b\n\n"), (4, None), (5, ""), (6, "\n\n"),
            (7, long_text), (8, other + "\nshort"), (9, other.upper()), (10, other), (11, " " + shared), (12, "short\n" * 100),
            (None, shared), (None, other), (8, other + "\nshort"), (9, "different text of the same id\n" + other), (13, "x" * 20), (14, "x" * 20), (15, "X" * 20),
            (16, "y" * 19), (17, "y" * 19), (18, "y" * 19), (19, "twenty code points!!!"), (19, "twenty code points!!!"), (20, "twenty code points!!!")]
    return rows


def test_odd_rows(spark):
    got, bitmaps = run(spark, odd_rows())
    assert got == brute(odd_rows())
    # Only words that drop a line are stored.
    row = bitmaps.filter("id = 7").first()
    assert row is None or all(w.bits != -1 for w in row.keep)
    assert run(spark, odd_rows(), partitions=1)[0] == brute(odd_rows())
    assert run(spark, odd_rows(), partitions=3, min_chars=1, min_docs=2)[0] == brute(odd_rows(), 1, 2)


def test_a_key_with_a_third_of_all_lines_is_spread(spark):
    rng = random.Random(5)
    pool = [f"common passage number {i} of them" for i in range(30)]
    rows = [(i, "\n".join(["the very same line in each document"] * rng.choice([1, 1, 3]) + [rng.choice(pool) for _ in range(rng.randrange(3))] + [f"own line of document {i}"]))
            for i in range(600)]
    rng.shuffle(rows)
    got, bitmaps = run(spark, rows, partitions=16)
    assert got == brute(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frequent = {r.h1: r.spread for r in line_dedup._frequent(line_dedup._long_lines(frame, "doc_id", "text", 20), 16).collect()}
    hot = spark.range(1).select(F.xxhash64(F.lit("the very same line in each document"))).first()[0]
    assert frequent[hot] > 8


def test_words_and_gaps(spark):
    rows = [(i, "\n".join("shared by all three of them" if j in (0, 63, 64, 700) else f"{i} own line number {j} here" for j in range(701))) for i in range(3)]
    got, bitmaps = run(spark, rows)
    assert got == brute(rows)
    assert [w.word for w in bitmaps.filter("id = 0").first().keep] == [0, 1, 10]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    bitmaps = line_dedup.keep_bitmaps(frame, "doc_id", "text", Stages(spark, "t"), 4)
    assert bitmaps.count() == 0 and line_dedup.apply_bitmaps(frame, "doc_id", "text", bitmaps).count() == 0


@pytest.mark.parametrize("partitions", [4])
def test_plan_is_native_and_shuffles_lines_once(spark, sf, partitions):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bitmaps = line_dedup.keep_bitmaps(docs, "doc_id", "text", Stages(spark, "t"), partitions)
    plan = line_dedup.apply_bitmaps(docs, "doc_id", "text", bitmaps)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_op13_query(spark, sf):
    from verispark.llm.queries import op13
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)]
    assert sorted([tuple(r) for r in op13(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()], key=str) == sorted(want, key=str)
