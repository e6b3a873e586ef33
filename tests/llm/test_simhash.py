"""SimHash groups and components against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from verispark.llm import simhash
from verispark.llm.components import connected_components
from verispark.llm.files import Stages


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_reachable(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(rows):
    prints = {}
    for i, t in rows:
        prints.setdefault(slow_fingerprint(t), []).append(i)
    keys = np.array(list(prints), np.uint64)
    linked = []
    for k, v in enumerate(keys):
        near = np.flatnonzero(np.bitwise_count(keys[k + 1:] ^ v) <= 3) + k + 1
        linked += [(k, int(j)) for j in near]
    group = smallest_reachable(range(len(keys)), linked)
    least = {}
    for k, key in enumerate(keys):
        ids = [i for i in prints[int(key)] if i is not None]
        least[group[k]] = min([*ids, *([least[group[k]]] if least.get(group[k]) is not None else [])], default=None)
    return sorted([(i, f"{int(key):016x}", least[group[k]]) for k, key in enumerate(keys) for i in prints[int(key)]], key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_golay_tables():
    unit, leader, table = simhash._tables()
    assert sorted({int(x).bit_count() for x in leader}) == [0, 1, 2, 3] and set((table >= 0).sum(axis=1)) == {1, 6}
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    other = words ^ np.where(rng.random(3000) < 0.2, 0, 1 << rng.integers(0, 23, 3000))
    assert (simhash.near_indices(words) == simhash.nearest_index(other)[:, None]).any(axis=1).all()


def test_links_find_every_pair_within_three_bits(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(150)]
    prints = set(base)
    for v in base:
        for flips in (1, 2, 3, 3, 3, 4):
            w = v
            for b in rng.sample(range(64), flips):
                w ^= 1 << b
            prints.add(w)
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()} == want


def test_groups_of_odd_rows(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(300))
    rows = [(3, None), (4, ""), (5, " \t\n"), (6, text), (7, text.upper()), (8, text + " tail"), (8, text), (None, text), (None, "lonely words here now"), (9, "One"),
            (10, "one two"), (11, "É é word"), (12, "É é word x"), (13, text * 300)]
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, fp int, id string")
    assert got(simhash.groups(frame, "doc_id", "text", Stages(spark, "t"))) == brute(rows)
    assert simhash.groups(frame.limit(0), "doc_id", "text", Stages(spark, "t")).count() == 0


def test_op7_query(spark, sf):
    from verispark.llm.queries import op7
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op7(spark, sf)) == brute(rows)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    linked = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + j) for j in range(1, 40)] + [(200, 200), (201, 202), (202, 201)]
    order = list(range(300, 340))
    rng.shuffle(order)
    linked += list(zip(order, order[1:], strict=False))
    frame = spark.createDataFrame([*linked, (None, 5), (7, None)], "a long, b long")
    linked = [p for p in linked if p[0] != p[1]]
    want = smallest_reachable({x for p in linked for x in p}, linked)
    assert {r.node: r.component for r in connected_components(frame, Stages(spark, "t")).collect()} == want
    assert connected_components(frame.filter(F.lit(False)), Stages(spark, "t")).count() == 0
