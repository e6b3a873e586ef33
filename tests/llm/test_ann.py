"""Vector groups against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verispark.llm import ann_graph as ag
from verispark.llm.files import Stages


def brute(rows, threshold=0.93):
    good = [k for k, (i, v, y) in enumerate(rows) if i is not None and y is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    parent = {k: k for k in range(len(rows))}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    n = [0] * len(rows)
    unit = {k: np.array(rows[k][1], np.float32).astype(float) / np.linalg.norm(np.array(rows[k][1], np.float32).astype(float)) for k in good}
    for p, a in enumerate(good):
        for b in good[p + 1:]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and unit[a] @ unit[b] >= threshold:
                n[a], n[b] = n[a] + 1, n[b] + 1
                parent[root(a)] = root(b)
    least = {}
    for k in good:
        least[root(k)] = min(least.get(root(k), 1 << 60), rows[k][0])
    out = []
    for k, r in enumerate(rows):
        c = least.get(root(k), r[0])
        out.append((r[0], n[k], c, r[0] == c and r[0] is not None))
    return sorted(out, key=str)


def made(n=900, groups=12, hot=200):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for _ in range(n):
        rows.append((i, rng.normal(size=16), int(rng.integers(0, 3))))
        i += 1
    for _ in range(groups):
        c, y = rng.normal(size=16), int(rng.integers(0, 3))
        for _ in range(int(rng.integers(2, 9))):
            rows.append((i, c + rng.normal(size=16) * 0.2, y))
            i += 1
    c = rng.normal(size=16)
    for _ in range(hot):
        rows.append((i, c + rng.normal(size=16) * 0.1, 1))
        i += 1
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    rows += [(5000, rows[0][1], rows[0][2]), (5000, rows[0][1], rows[0][2]), (5001, rows[0][1], None), (5002, None, 1), (5003, [0.0] * 16, 1), (5004, [], 1),
             (5005, [None] * 16, 1), (5006, [float("nan")] + [1.0] * 15, 1), (5007, [float("inf")] + [1.0] * 15, 1), (None, rows[0][1], rows[0][2]), (5008, [1.0, 2.0], 1),
             (5009, [2.0, 4.0], 1), (5010, [-0.0, 1.0], 2), (5011, [0.0, 1.0], 2)]
    return rows


def got(spark, rows):
    frame = spark.createDataFrame([(i, v, y, 1, "s") for i, v, y in rows], "vec_id long, embedding array<float>, label int, node int, shard string")
    return sorted([tuple(r) for r in ag.link_groups(frame, Stages(spark, "t")).collect()], key=str)


def test_small(spark):
    rows = made(300, 6, 40)
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_many_shards_and_parts(spark, monkeypatch):
    monkeypatch.setattr(ag, "CAPACITY", 120)
    monkeypatch.setattr(ag, "LEVELS", 2)
    rows = made()
    want, have = brute(rows), got(spark, rows)
    assert [r[0] for r in have] == [r[0] for r in want]
    assert all(h[1] <= w[1] for h, w in zip(have, want, strict=True))
    assert sum(h[1] for h in have) >= 0.95 * sum(w[1] for w in want)
    assert np.mean([h[2] == w[2] for h, w in zip(have, want, strict=True)]) > 0.98


def test_range_search_finds_a_dense_ball():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(400, 16)), rng.normal(size=16) * 3 + rng.normal(size=(150, 16)) * 0.3])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = [v[v >= 0] for v in ag.pruned_neighbours(x)]
    who, what, cos = ag.range_search(x, links, 0, x, 0.93)
    there = np.argwhere(x @ x.T >= 0.93)
    assert (cos >= 0.93).all() and len(set(zip(who.tolist(), what.tolist(), strict=True))) == len(who) >= 0.97 * len(there)


def crowd_and_pairs(crowd=200, pairs=50, single=400, width=64):
    """Vectors and the group of each: a crowd of distinct near copies beside many small groups and single rows."""
    rng = np.random.default_rng(7)
    x, group = [rng.normal(size=width) for _ in range(single)], list(range(single))
    for g in range(pairs):
        c = rng.normal(size=width)
        for _ in range(2 + g % 3):
            x.append(c + rng.normal(size=width) * 0.1)
            group.append(single + g)
    c = rng.normal(size=width)
    for _ in range(crowd):
        x.append(c + rng.normal(size=width) * 0.1)
        group.append(single + pairs)
    return np.array(x), np.array(group)


def recall_by_group(n_links, group, there):
    return {int(g): n_links[group == g].sum() / there[group == g].sum() for g in np.unique(group) if there[group == g].sum()}


def test_search_leaves_a_crowd():
    x, group = crowd_and_pairs()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    starts = ag.start_rows(x)
    seeds = np.column_stack([np.broadcast_to(starts, (len(x), len(starts))), np.arange(len(x))])
    who, _, _ = ag.range_search(x, ag.joined_neighbours(x), seeds, x, 0.93)
    recall = recall_by_group(np.bincount(who, minlength=len(x)) - 1, group, (x @ x.T >= 0.93).sum(axis=1) - 1)
    assert len(recall) == 51 and min(recall.values()) == 1
    # Two crowds that no edge joins are one graph all the same.
    two = np.concatenate([x[group == 450], -x[group == 450]])
    links = ag.joined_neighbours(two)
    assert len(set(ag._components(len(two), np.repeat(np.arange(len(two)), [len(v) for v in links]), np.concatenate(links)).tolist())) == 1


def test_crowd_beside_small_groups(spark):
    x, _ = crowd_and_pairs()
    rows = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(x)]
    assert got(spark, rows) == brute(rows)


def test_audit_weighs_every_node_and_size_alike():
    # A crowd of 200 found whole, 20 pairs lost: 0.999 of all links.
    audit = pd.DataFrame({"home": [1] * 220 + [2] * 5, "there": [199] * 200 + [1] * 20 + [3] * 5, "recall": [1.0] * 200 + [0.0] * 20 + [1.0] * 5})
    assert ag.short_homes(audit, 0.97) == [1]
    assert ag.short_homes(audit[audit["recall"] > 0], 0.97) == ag.short_homes(audit[:0], 0.97) == []


def test_what_the_search_misses_in_a_shard_is_found():
    x, _ = crowd_and_pairs(150, 40, 100, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    who, what = ag.whole_range(x, [np.zeros(0, np.int64)] * len(x), 0, x, 0.93)
    assert sorted(zip(who.tolist(), what.tolist(), strict=True)) == [tuple(p) for p in np.argwhere(x @ x.T >= 0.93).tolist()]


def test_links_come_from_the_graph_and_an_empty_one_is_noticed(monkeypatch):
    x, _ = crowd_and_pairs(150, 40, 100, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = [tuple(p) for p in np.argwhere(x @ x.T >= 0.93).tolist()]
    graph = ag.joined_neighbours(x)
    seeds = np.column_stack([np.tile(ag.start_rows(x), (len(x), 1)), np.arange(len(x))])
    who, what, _ = ag.range_search(x, graph, seeds, x, 0.93)
    assert ag.range_recall(x, x, 0.93, who, what) >= ag.SHARD_RECALL
    empty = [np.zeros(0, np.int64)] * len(x)
    who, what, _ = ag.range_search(x, empty, seeds, x, 0.93)
    assert ag.range_recall(x, x, 0.93, who, what) < 0.9
    # The product answers only where the graph falls short.
    monkeypatch.setattr(ag, "SHARD_RECALL", 0.0)
    who, what = ag.whole_range(x, graph, seeds, x, 0.93)
    assert len(set(zip(who.tolist(), what.tolist(), strict=True)) & set(want)) >= 0.995 * len(want)
    who, what = ag.whole_range(x, empty, seeds, x, 0.93)
    assert len(set(zip(who.tolist(), what.tolist(), strict=True)) & set(want)) < 0.9 * len(want)


def test_labels_that_fall_short_are_searched_whole(spark, monkeypatch):
    x, _ = crowd_and_pairs(150, 40, 100, 16)
    rows = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(x)]
    monkeypatch.setattr(ag, "CAPACITY", 120)
    monkeypatch.setattr(ag, "MOST_OVERLAP", 2)
    monkeypatch.setattr(ag, "_split", lambda members, stages, overlap: members.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(8))))
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_op1_query(spark, folder):
    from verispark.llm.queries import op1
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted([tuple(r) for r in op1(spark, folder).collect()], key=str) == brute(rows)
