"""Near-duplicate vectors by range search on a robust-pruned flat graph.

Equal vectors are one node.  The nodes of a label are cut into overlapping clusters until a cluster
holds at most ``capacity`` nodes; one that stays larger is dealt out into parts, which are searched by
blocks of its nodes.  Each shard builds a graph of pruned neighbours with reverse edges
and edges between its components, adjacency lists of a
node are united over its shards, and every node is searched for in its shards: greedily from
medoids, itself and its neighbours, then on to all that can be reached without leaving the range by more than a margin.  Cosines of
what is met are taken in double precision.  Each shard measures the recall of its search on a sample; one that falls short
is answered by the product of its blocks.  A pair that meets in several shards counts in the first of them, so shards return counts and
spanning edges, never pairs.  Links between clusters can be lost: recall is measured per node and by
size of group on samples against all vectors, the overlap is widened while a label falls short, and
one that still does is searched whole by blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .files import Stages

CAPACITY, OVERLAP, LEVELS, CLUSTERS = 1500, 2, 6, 64
DEGREE, CANDIDATES, ALPHA, BEAM, MARGIN, STARTS = 16, 48, 1.2, 24, 0.06, 8
#: Rows of a shard that its clusters are fitted to, rows clustered by one task, queries of the audit.
FIT_ROWS, ASSIGN_ROWS, AUDIT_ROWS = 4000, 20_000, 400
#: Queries of a shard whose recall is measured, and the recall below which a shard is answered by its product.
RECALL_ROWS, SHARD_RECALL = 96, 0.995
#: Clusters of a node at most, before labels that fall short are searched whole.
MOST_OVERLAP = 8


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors of unit length in double precision, one row each."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from rows far apart in the sample."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def pruned_neighbours(x: np.ndarray) -> np.ndarray:
    """Adjacency of a shard: of each row's nearest rows those that no kept neighbour is much closer to; -1 pads."""
    n = len(x)
    out = np.full((n, DEGREE), -1, np.int64)
    m = min(CANDIDATES, n - 1)
    if m <= 0:
        return out
    for a in range(0, n, 500):
        sims = x[a:a + 500] @ x.T
        rows = np.arange(len(sims))
        sims[rows, rows + a] = -2
        near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        order = np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, axis=1)))
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bid,bjd->bij", x[near], x[near])))
        alive, degree = np.ones(near.shape, bool), np.zeros(len(near), np.int64)
        for c in range(m):
            take = alive[:, c] & (degree < DEGREE)
            out[a + rows[take], degree[take]] = near[take, c]
            degree += take
            # A later candidate goes if this neighbour is closer to it, by the factor, than the row itself is.
            alive &= ~(take[:, None] & (ALPHA * between[:, c, :] <= gap))
    return out


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each row reaches over the edges a, b."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def joined_neighbours(x: np.ndarray) -> list[np.ndarray]:
    """Pruned neighbours with the reverse of every edge, and an edge from each component to the nearest row outside, until there is one."""
    n = len(x)
    near = pruned_neighbours(x)
    a, k = np.nonzero(near >= 0)
    b = near[a, k]
    while n > 1:
        label = _components(n, a, b)
        roots = np.unique(label)
        if len(roots) == 1:
            break
        best, other = np.full(n, -3.0), np.zeros(n, np.int64)
        for i in range(0, n, 500):
            sims = x[i:i + 500] @ x.T
            sims[label[i:i + 500][:, None] == label[None, :]] = -3
            other[i:i + 500], best[i:i + 500] = sims.argmax(axis=1), sims.max(axis=1)
        order = np.lexsort((-best, label))
        first = order[np.concatenate([[True], label[order][1:] != label[order][:-1]])]
        a, b = np.concatenate([a, first]), np.concatenate([b, other[first]])
    edges = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n))) if n else []


def start_rows(x: np.ndarray) -> np.ndarray:
    """Rows nearest to the mean and to centres far apart."""
    mean = int((x @ x.mean(axis=0)).argmax())
    return np.unique(np.append((fit_clusters(x, STARTS, 3) @ x.T).argmax(axis=1), mean))


def in_range(x: np.ndarray, queries: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Query number and row of all pairs whose cosine is at least ``low``, by blocks of the full product."""
    found = [np.nonzero(queries[a:a + 256] @ x.T >= low) for a in range(0, len(queries), 256)]
    return (np.concatenate([i + 256 * k for k, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])) if found else (np.zeros(0, np.int64),) * 2


def range_search(x: np.ndarray, links: list[np.ndarray], start: int | np.ndarray, queries: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, row and cosine of all rows met whose cosine is at least ``low``, for queries of unit length.

    ``start`` is one row for all, or rows of each query, padded by -1.
    """
    n, width = len(x), max([len(v) for v in links], default=1) or 1
    seeds = np.full((len(queries), 1), start, np.int64) if np.ndim(start) == 0 else start
    table = np.full((n, width), -1, np.int64)
    for i, v in enumerate(links):
        table[i, :len(v)] = v
    # A row that is near to very many has as many edges, so the ball is spread over lists without padding.
    degree = np.array([len(v) for v in links], np.int64)
    begin, flat = np.cumsum(degree) - degree, np.concatenate([*links, np.zeros(0, np.int64)]).astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), 256):
        q = queries[a:a + 256]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        own = seeds[a:a + 256]
        i, j = np.nonzero(own >= 0)
        pair = np.unique(i * n + own[i, j])
        who, what = pair // n, pair % n
        seen[who, what] = True
        cos = np.einsum("ij,ij->i", q[who], x[what])
        met = [(who, what, cos)]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        ids, scores = np.full((len(q), max(BEAM, own.shape[1])), -1, np.int64), np.full((len(q), max(BEAM, own.shape[1])), -3.0)
        ids[who, place], scores[who, place] = what, cos
        top = np.argpartition(-scores, BEAM - 1, axis=1)[:, :BEAM]
        beam, score = np.take_along_axis(ids, top, axis=1), np.take_along_axis(scores, top, axis=1)
        done = np.zeros((len(q), BEAM), bool)
        live = rows
        while len(live):
            open_ = np.where(done[live] | (beam[live] < 0), -3.0, score[live])
            best = open_.argmax(axis=1)
            go = open_[np.arange(len(live)), best] > -2.5
            live, best = live[go], best[go]
            if not len(live):
                break
            done[live, best] = True
            near = table[beam[live, best]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            i, j = np.nonzero(fresh)
            who, what = live[i], near[i, j]
            seen[who, what] = True
            cos = np.einsum("ij,ij->i", q[who], x[what])
            met.append((who, what, cos))
            more, more_score = np.full(near.shape, -1, np.int64), np.full(near.shape, -3.0)
            more[i, j], more_score[i, j] = what, cos
            all_ids, all_scores = np.concatenate([beam[live], more], axis=1), np.concatenate([score[live], more_score], axis=1)
            all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
            top = np.argpartition(-all_scores, BEAM - 1, axis=1)[:, :BEAM]
            beam[live], score[live] = np.take_along_axis(all_ids, top, axis=1), np.take_along_axis(all_scores, top, axis=1)
            done[live] = np.take_along_axis(all_done, top, axis=1)
        who, what, cos = (np.concatenate(c) for c in zip(*met, strict=True))
        inside = cos >= low - MARGIN
        front = who[inside], what[inside]
        kept = [(who[inside], what[inside], cos[inside])]
        while len(front[0]):
            new = np.zeros((len(q), n), bool)
            for b in range(0, len(front[0]), 20_000):
                who, row = front[0][b:b + 20_000], front[1][b:b + 20_000]
                many = degree[row]
                edge = np.arange(int(many.sum())) + np.repeat(begin[row] - np.cumsum(many) + many, many)
                new[np.repeat(who, many), flat[edge]] = True
            who, what = np.nonzero(new & ~seen)
            seen[who, what] = True
            cos = np.concatenate([np.einsum("ij,ij->i", q[who[b:b + 50_000]], x[what[b:b + 50_000]]) for b in range(0, len(who), 50_000)]) if len(who) else np.zeros(0)
            inside = cos >= low - MARGIN
            front = who[inside], what[inside]
            kept.append((who[inside], what[inside], cos[inside]))
        who, what, cos = (np.concatenate(c) for c in zip(*kept, strict=True))
        good = cos >= low
        found.append((who[good] + a, what[good], cos[good]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def range_recall(x: np.ndarray, queries: np.ndarray, low: float, who: np.ndarray, what: np.ndarray) -> float:
    """Mean share of the rows in range that a search met, over a sample of the queries by their order and of those that met any.

    The sample is bounded and compared with the product; without a row in range the recall is 1.
    """
    asked = np.unique(np.linspace(0, len(queries) - 1, min(RECALL_ROWS, len(queries))).astype(np.int64))
    met = np.unique(who)
    drawn = np.union1d(asked, met[np.linspace(0, len(met) - 1, min(RECALL_ROWS, len(met))).astype(np.int64)]) if len(met) else asked
    there = np.bincount(in_range(x, queries[drawn], low)[0], minlength=len(drawn))
    found = np.bincount(who, minlength=len(queries))[drawn]
    some = there > 0
    return float(np.minimum(found[some] / there[some], 1.0).mean()) if some.any() else 1.0


def whole_range(x: np.ndarray, links: list[np.ndarray], start: int | np.ndarray, queries: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Query number and row of all rows in range that the search of the graph meets.

    A shard whose measured recall is below ``SHARD_RECALL`` is answered by the product of its blocks instead: a graph that fails is not
    hidden and loses nothing.
    """
    who, what, _ = range_search(x, links, start, queries, low)
    return (who, what) if range_recall(x, queries, low, who, what) >= SHARD_RECALL else in_range(x, queries, low)


def _split(members: DataFrame, stages: Stages, overlap: int) -> DataFrame:
    """Cut shards above the capacity into clusters, each node to its nearest ``overlap``, until none is above it or the levels are used up."""
    for _ in range(LEVELS):
        sizes = members.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > CAPACITY)
        large = stages.put(sizes, "large")
        if large.isEmpty():
            break
        joined = members.join(large, "shard")
        sample = joined.filter(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1_000_000)) < F.lit(1_000_000.0 * FIT_ROWS) / F.col("n"))

        def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            from verispark.llm.ann_graph import CAPACITY, CLUSTERS, fit_clusters, unit_rows

            rows = rows.sort_values("node")
            k = int(min(CLUSTERS, max(2, -(-3 * int(rows["n"].iloc[0]) // CAPACITY))))
            centres = fit_clusters(unit_rows(rows["vector"]), k)
            return pd.DataFrame({"shard": key[0], "cluster": range(len(centres)), "centre": list(centres)})

        centres = stages.put(sample.select("shard", "node", "vector", "n").groupBy("shard").applyInPandas(fit, "shard long, cluster int, centre array<double>"), "centres")
        parts = F.ceil(F.col("n") / ASSIGN_ROWS).cast("int")
        salted = joined.withColumn("salt", F.pmod(F.xxhash64("node"), parts)).drop("n")
        spread = centres.join(large, "shard").select("shard", "cluster", "centre", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("salt"))

        def assign(key: tuple, rows: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
            from verispark.llm.ann_graph import unit_rows

            if not len(rows) or not len(centre):
                return pd.DataFrame({"node": [], "n_copies": [], "vector": [], "from_shard": [], "cluster": []}).astype({"node": "int64", "n_copies": "int64", "from_shard": "int64", "cluster": "int32"})
            centre = centre.sort_values("cluster")
            sims = unit_rows(rows["vector"]) @ np.stack(centre["centre"].to_numpy()).T
            top = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
            out = rows.loc[rows.index.repeat(top.shape[1]), ["node", "n_copies", "vector"]].assign(from_shard=key[0])
            return out.assign(cluster=centre["cluster"].to_numpy()[top.ravel()])

        cut = salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(assign, "node long, n_copies long, vector array<float>, from_shard long, cluster int")
        cut = cut.select(F.xxhash64("from_shard", "cluster").alias("shard"), "node", "n_copies", "vector")
        members = stages.put(members.join(large, "shard", "left_anti").unionByName(cut), "members")
    return members


def _shards(members: DataFrame, stages: Stages) -> DataFrame:
    """Members with all shards of their node, and the part of a shard above the capacity that they fall into."""
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") / CAPACITY).cast("int").alias("parts"))
    lists = members.groupBy("node").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
    with_all = members.join(sizes, "shard").join(lists, "node").withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    return stages.put(with_all, "shards")


def _graph(shards: DataFrame, stages: Stages) -> DataFrame:
    """node and its neighbours, united over the shards in which it has any."""
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        from verispark.llm.ann_graph import joined_neighbours, unit_rows

        rows = rows.sort_values("node")
        ids = rows["node"].to_numpy()
        near = joined_neighbours(unit_rows(rows["vector"]))
        return pd.DataFrame({"node": ids, "near": [ids[v] for v in near]})

    lists = shards.select("shard", "part", "node", "vector").groupBy("shard", "part").applyInPandas(build, "node long, near array<long>")
    return stages.put(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of sorted shard lists, padded by the largest integer, the smallest shard in both."""
    most = np.iinfo(np.int64).max
    out = np.full(len(a), most)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            out = np.where((a[:, i] == b[:, j]) & (a[:, i] != most), np.minimum(out, a[:, i]), out)
    return out


def _padded(lists: pd.Series) -> np.ndarray:
    width = max([len(v) for v in lists], default=1)
    out = np.full((len(lists), width), np.iinfo(np.int64).max)
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def _search(shards: DataFrame, graph: DataFrame, threshold: float, stages: Stages) -> DataFrame:
    """Per query of a shard: node, linked (copies of the nodes it is linked with there) and other (a node of its local component)."""
    rows = shards.join(graph, "node")
    blocks = F.sequence(F.lit(0), F.col("parts") - 1)
    graph_rows = rows.select("shard", "part", F.explode(blocks).alias("block"), "node", "n_copies", "vector", "shards", "near", F.lit(False).alias("asks"))
    query_rows = rows.select("shard", F.explode(blocks).alias("part"), F.col("part").alias("block"), "node", "n_copies", "vector", "shards",
                             "near", F.lit(True).alias("asks"))

    def search(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        from verispark.llm.ann_graph import DEGREE, _first_common, _padded, start_rows, unit_rows, whole_range

        empty = pd.DataFrame({"node": np.zeros(0, np.int64), "linked": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        here, asked = both[~both["asks"]].sort_values("node"), both[both["asks"]].sort_values("node")
        if not len(here) or not len(asked):
            return empty
        ids, x = here["node"].to_numpy(), unit_rows(here["vector"])

        def places(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            owner = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
            flat = np.concatenate([np.asarray(v, np.int64) for v in lists])
            at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            good = ids[at] == flat
            return owner[good], at[good]

        owner, at = places(here["near"])
        links = np.split(at, np.searchsorted(owner, np.arange(1, len(ids))))
        names, q = asked["node"].to_numpy(), unit_rows(asked["vector"])
        # From medoids, from the query where it is a row itself, and from neighbours of its own.
        medoids = start_rows(x)
        seeds = np.full((len(q), len(medoids) + 1 + DEGREE), -1, np.int64)
        seeds[:, :len(medoids)] = medoids
        own = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
        seeds[:, len(medoids)] = np.where(ids[own] == names, own, -1)
        owner, at = places(asked["near"])
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        few = place < DEGREE
        seeds[owner[few], len(medoids) + 1 + place[few]] = at[few]
        who, what = whole_range(x, links, seeds, q, threshold)
        good = ids[what] != names[who]
        who, what = who[good], what[good]
        owner = _first_common(_padded(asked["shards"])[who], _padded(here["shards"])[what])
        mine = owner == key[0]
        linked = np.bincount(who[mine], here["n_copies"].to_numpy()[what[mine]], len(names)).astype(np.int64)
        # Spanning edges: repeated minima over the links, with one edge to the root of each node.
        label = {int(v): int(v) for v in np.concatenate([ids, names])}

        def root(v: int) -> int:
            while label[v] != v:
                label[v] = label[label[v]]
                v = label[v]
            return v

        for a, b in zip(names[who].tolist(), ids[what].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                label[max(a, b)] = min(a, b)
        out = pd.DataFrame({"node": names, "linked": linked, "other": [root(int(v)) for v in names]})
        # Nodes of the graph that link to nodes of the block belong to the same components.
        rest = [(int(v), 0, root(int(v))) for v in np.unique(ids[what]) if root(int(v)) != int(v)]
        return pd.concat([out, pd.DataFrame(rest, columns=["node", "linked", "other"]).astype("int64")]) if rest else out

    both = graph_rows.unionByName(query_rows)
    return stages.put(both.groupBy("shard", "part", "block").applyInPandas(search, "node long, linked long, other long"), "searched")


def audit_recall(nodes: DataFrame, linked: DataFrame, threshold: float) -> pd.DataFrame:
    """home, there (links there are) and recall of audited nodes that have links, each compared with all vectors of its label.

    Drawn by hash are at most ``AUDIT_ROWS`` of all nodes and as many for each size (power of four) of the groups found.
    """
    size = F.floor(F.log2(F.coalesce("linked", F.lit(0)) + 1) / 2).cast("int")
    known = nodes.join(linked, "node", "left").select("node", "home", "vector", size.alias("size"))
    order = F.xxhash64("node", F.lit(11))
    picks = [known.orderBy(order).limit(AUDIT_ROWS).collect()]
    for row in known.filter("size > 0").select("size").distinct().orderBy("size").collect():
        picks.append(known.filter(F.col("size") == row.size).orderBy(order).limit(AUDIT_ROWS).collect())
    drawn = list({r.node: r for rows in picks for r in rows}.values())
    none = pd.DataFrame({"home": np.zeros(0, np.int64), "there": np.zeros(0, np.int64), "recall": np.zeros(0)})
    if not drawn:
        return none
    homes, names = np.array([r.home for r in drawn]), np.array([r.node for r in drawn])
    vectors = [np.asarray(r.vector, np.float64) for r in drawn]

    def count(batches):
        for rows in batches:
            for home, part in rows.groupby("home"):
                mine = np.flatnonzero(homes == home)
                if len(mine):
                    x, q = unit_rows(part["vector"]), unit_rows(pd.Series([vectors[k] for k in mine]))
                    close = (q @ x.T >= threshold) & (names[mine][:, None] != part["node"].to_numpy()[None, :])
                    yield pd.DataFrame({"node": names[mine], "home": home, "there": close @ part["n_copies"].to_numpy()}).astype("int64")

    there = nodes.select("node", "home", "n_copies", "vector").mapInPandas(count, "node long, home long, there long").groupBy("node", "home").agg(F.sum("there").alias("there"))
    rows = there.filter("there > 0").join(linked, "node", "left").select("home", "there", (F.least(F.coalesce("linked", F.lit(0)), "there") / F.col("there")).alias("recall")).collect()
    return pd.DataFrame([tuple(r) for r in rows], columns=list(none.columns)) if rows else none


def short_homes(audit: pd.DataFrame, target: float) -> list[int]:
    """Labels whose mean recall per audited node, over all or over those of one group size, is below the target."""
    size = (np.log2(audit["there"].to_numpy(np.float64) + 1) // 2).astype(int)
    by_size = audit.groupby(["home", size])["recall"].mean().groupby(level=0).min()
    worst = np.minimum(audit.groupby("home")["recall"].mean(), by_size)
    return [int(h) for h in worst.index[worst < target]]


def link_groups(df: DataFrame, stages: Stages, threshold: float = 0.93, target: float = 0.97) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``df`` (vec_id, embedding, label).

    Rows link when their labels are equal and the cosine is at least ``threshold``.  A row whose vector is null, empty, zero or
    has null or non-finite components, whose label or whose id is null links with nothing and is its own component;
    vectors of different length do not link.  Equal rows are vectors of their own that link with each other; other columns are ignored,
    whatever their names; an empty table has no rows.
    """
    vector = F.col("embedding").cast("array<float>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.col("label").cast("string").alias("label"))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("home", F.xxhash64("label", F.size("vector")))
    # Adding zero makes one zero of both.
    rows = stages.put(rows.withColumn("node", F.when(F.col("usable"), F.xxhash64("label", F.transform("vector", lambda x: x + F.lit(0.0).cast("float"))))), "rows")
    nodes = stages.put(rows.filter("usable").groupBy("node", "home").agg(F.count("*").alias("n_copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")), "nodes")
    members = nodes.select(F.col("home").alias("shard"), "node", "n_copies", "vector")
    # A label that is one shard is whole; only the others can lose links, those between clusters.
    sizes = stages.put(nodes.groupBy("home").agg(F.count("*").alias("n")).filter(F.col("n") > CAPACITY).select("home"), "cut_labels")
    at_risk = stages.put(nodes.join(sizes, "home", "left_semi"), "at_risk")

    def searched(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        shards = _shards(members, stages)
        found = _search(shards, _graph(shards, stages), threshold, stages)
        return found, stages.put(found.groupBy("node").agg(F.sum("linked").alias("linked")), "linked")

    overlap = OVERLAP
    while True:
        found, linked = searched(_split(members, stages, overlap))
        short = short_homes(audit_recall(at_risk, linked, threshold), target)
        if not short or overlap >= MOST_OVERLAP:
            break
        overlap *= 2
    if short:
        # Labels that fall short at the last widening as well are searched whole, every part against every other.
        left = stages.put(nodes.filter(F.col("home").isin(short)).select("node"), "short")
        whole, whole_linked = searched(members.filter(F.col("shard").isin(short)))
        found = found.join(left, "node", "left_anti").unionByName(whole)
        linked = linked.join(left, "node", "left_anti").unionByName(whole_linked)
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), stages).withColumnRenamed("component", "root")
    placed = nodes.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(smallest, "root").join(linked, "node", "left").select("node", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    out = rows.join(stages.put(known, "known"), "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
