"""Ranked lexical search as blocked dense products.

The items' terms are a compact vocabulary.  One pass over the documents counts terms and keeps, per document,
its length and the numbers of the vocabulary's terms.  A second pass multiplies tiles: weights of a
few dozen items over their own terms times the impacts of a few hundred documents on these terms, both
float64 matrices of integers.  A tile of terms is cut where a sum could reach 2 ** 53, so every partial
sum is exact in whatever order the product adds; tiles are added up as 64-bit integers.  Each task keeps the
best documents per item, a document at the bar included while ids may still decide, and the best of all tasks are
ranked once more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import Stages

#: Bytes of item text searched together; a larger set of items takes more passes over the documents.
BLOCK_BYTES = 1 << 20
#: Items and terms of a tile of weights, documents of a tile of impacts.
ITEM_TILE, TERM_TILE, DOC_TILE = 64, 2048, 512
#: No impact reaches this: 10^9 tf over more than 1000 tf.
TOP_IMPACT, EXACT = 1_000_000, 1 << 53
_UNDER_80 = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(0x80))
_TABLE = _UNDER_80 + bytes(range(0x80, 0x100))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII, as UTF-8; only A-Z are lower-cased."""
    return text.encode().translate(_TABLE).split() if text else []


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, counts: the length of each row's text in terms and what it has of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.lexical import terms_of

        get = vocabulary.get
        for batch in batches:
            sizes, terms, counts, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                found = Counter(map(get, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms += found.keys()
                counts += found.values()
                ends.append(len(terms))
            cut = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(cut, pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<bigint>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int, slope: int) -> np.ndarray:
    """The integer impact of each count in a document of so many terms; whole numbers throughout."""
    if len(sizes) and slope * int(sizes.max()) * n_docs >= 1 << 63:
        sizes = sizes.astype(object)
    length = (100 - slope + slope * sizes * n_docs // max(n_terms, 1)).astype(np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 20 * length)


class Ranker:
    """Weights of a block of items in tiles, and the best documents met so far."""

    def __init__(self, items: list[tuple[int | None, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, top: int, slope: int) -> None:
        self.ids, self.n_docs, self.n_terms, self.top, self.slope = [i for i, _ in items], n_docs, n_terms, top, slope
        self.tiles: list[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]] = []
        for a in range(0, len(items), ITEM_TILE):
            rows = items[a:a + ITEM_TILE]
            known = np.unique(np.array([t for _, ts in rows for t in ts], np.int64))
            parts = []
            for terms in self.cut(known, weights):
                columns = np.full(len(weights), -1, np.int32)
                columns[terms] = np.arange(len(terms))
                matrix = np.zeros((len(rows), len(terms)))
                for k, (_, own) in enumerate(rows):
                    at = columns[np.array(own, np.int64)]
                    matrix[k, at[at >= 0]] = 1
                parts.append((columns, matrix * weights[terms]))
            self.tiles.append((a, len(rows), parts))
        self.bar = np.ones(len(items), np.int64)
        self.clear()

    @staticmethod
    def cut(terms: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Tiles of terms whose weights times the greatest impact stay below 2 ** 53 in sum."""
        out, start, bound = [], 0, 0
        for k, t in enumerate(terms):
            most = int(weights[t]) * TOP_IMPACT
            if k > start and (bound + most >= EXACT or k - start == TERM_TILE):
                out.append(terms[start:k])
                start, bound = k, 0
            bound += most
        return [*out, terms[start:]] if start < len(terms) else out

    def clear(self) -> None:
        self.held, self.size = [], 0

    def add(self, ids: np.ndarray, absent: np.ndarray, sizes: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Score documents: ids with a mask of null ones, lengths, and rows of terms and counts that end at ``ends``."""
        for a in range(0, len(ids), DOC_TILE):
            b = min(a + DOC_TILE, len(ids))
            part = slice(ends[a], ends[b])
            doc = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
            impact = impacts(counts[part], sizes[a:b][doc], self.n_docs, self.n_terms, self.slope).astype(np.float64)
            for first, rows, parts in self.tiles:
                scores = np.zeros((rows, b - a), np.int64)
                for columns, matrix in parts:
                    at = columns[terms[part]]
                    here = at >= 0
                    tile = np.zeros((matrix.shape[1], b - a))
                    tile[at[here], doc[here]] = impact[here]
                    scores += (matrix @ tile).astype(np.int64)
                item, place = np.nonzero(scores >= self.bar[first:first + rows, None])
                if len(item):
                    self.held.append((item + first, scores[item, place], absent[a + place], ids[a + place]))
                    self.size += len(item)
            if self.size > 8 * self.top * len(self.ids) + 100_000:
                self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        """The best so far per item: higher scores first, then smaller ids, null ids last."""
        if not self.held:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        item, score, absent, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, absent, -score, item))
        item, score, absent, ids = item[order], score[order], absent[order], ids[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.top - 1
        self.bar[item[last]] = score[last]
        good = rank < self.top
        best = item[good], score[good], absent[good], ids[good]
        self.held, self.size = [best], int(good.sum())
        return best


def _blocks(items: DataFrame) -> list[DataFrame]:
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    return [rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) for b in range(n)]


def rank_documents(docs: DataFrame, items: DataFrame, stages: Stages, top: int = 50, slope: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` rows of ``docs`` (doc_id, text) with the highest scores above 0 for each item (item_id, text).

    With N documents that have terms, L terms in all and df documents with a term, its weight is floor(1000 ln((2N + 2) / (2df + 1)));
    a document of n terms has the length 100 - slope + (slope n N) div L = m and scores the sum of weight times
    (10^9 tf) div (1000 tf + 20 m) over the item's distinct terms.  Equal scores are ranked by ascending doc_id, null ids last.
    Rows are documents, so repeated rows take a rank each; an item is an id with the terms of all its rows, a null id included;
    null and empty texts have no terms; other columns are ignored; without documents or items there are no rows.
    """
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None
    for block in _blocks(items):
        own: dict[int | None, set[bytes]] = {}
        for r in block.collect():  # of about BLOCK_BYTES
            own.setdefault(r.item_id, set()).update(terms_of(r.text))
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*own.values())))}
        counted = stages.put(count_terms(rows, vocabulary), "counted")
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        met = {r.term: r.n for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
        weights = np.array([term_weight(n_docs, met.get(k, 0)) for k in range(len(vocabulary))], np.int64)
        made = ([(i, sorted(vocabulary[t] for t in ts)) for i, ts in sorted(own.items(), key=str)], weights, n_docs, n_terms, top, slope)

        def run(batches: Iterator[pa.RecordBatch], made: tuple = made) -> Iterator[pa.RecordBatch]:
            from verispark.llm.lexical import Ranker

            tool = Ranker(*made)
            for batch in batches:
                id_column, sizes, terms, counts = batch.columns
                tool.add(np.asarray(id_column.fill_null(0)), np.asarray(id_column.is_null()), np.asarray(sizes),
                         np.asarray(terms.offsets) - terms.offsets[0].as_py(), np.asarray(terms.flatten()), np.asarray(counts.flatten()))
            item, score, absent, ids = tool.prune()
            yield pa.RecordBatch.from_arrays(
                [pa.array([tool.ids[k] for k in item], pa.int64()), pa.array(ids, pa.int64(), mask=absent), pa.array(score, pa.int64())],
                names=["item_id", "doc_id", "score"])

        part = counted.filter(F.size("terms") > 0).mapInArrow(run, "item_id long, doc_id long, score long")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
