"""Benchmark passages in documents by CGK embedding, bit sampling and exact edit verification.

Texts are words.  A passage within ``e`` edits of an item of ``n`` words keeps at least n - q + 1 - qe of
its runs of q words.  Places with fewer runs of items of that length are passed over, which loses nothing;
at all others stands a window of that length.  The CGK embedding walks through a window: it writes the current
word and moves on or stays as a random bit of word and step says, so sequences a small edit
distance apart mostly write equal symbols.  Each of some walks samples a few of these symbols; windows and
items with an equal sample are verified by their edit distance.  Long passages write fewer equal symbols, so how many are
sampled in how many walks follows from the target recall: for every length the cheapest of ``PLANS`` is
taken that finds that share of trial passages, items with random edits up to the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"\w+").findall
#: Bytes of item text that go to the executors at once; a larger benchmark takes more passes over the documents.
BLOCK_BYTES = 4 << 20
#: Symbols and walks by rising cost, the trials of a length, and starts on either side of a trial's own.
PLANS = ((3, 40), (3, 80), (2, 40), (2, 80), (2, 160), (2, 320), (1, 320), (1, 640))
TRIALS, SHIFT = 40, 3
#: A walk falls back into step after a shift that is small beside its length, so long windows stand this many times closer than their length only.
STARTS_PER_LENGTH = 128
_STEP, _WORD, _WALK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Words of the texts that are searched together, and windows that are embedded together.
WORDS_AT_ONCE, WINDOWS_AT_ONCE = 1_000_000, 10_000


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def edit_end(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between the item and any stretch of the text, and where the leftmost such stretch ends."""
    ramp = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for symbol in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != symbol))
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


class Matcher:
    """The items of one block, prepared for matching."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float, min_words: int, chosen: dict[int, tuple[int, int]] | None = None) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        for item_id, text in items:
            words = words_of(text)
            if len(words) >= max(min_words, 1):
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
                self.items.append((item_id, ids, int((1 - similarity) * len(words) + 1e-9)))
        self.by_length: dict[int, list[int]] = {}
        for k, (_, ids, _) in enumerate(self.items):
            self.by_length.setdefault(len(ids), []).append(k)
        self.edits = {n: self.items[numbers[0]][2] for n, numbers in self.by_length.items()}
        self.gap = max([n + 2 * e for n, e in self.edits.items()], default=1)
        self.base = len(self.vocabulary) + 1
        pairs = [ids[:-1] * self.base + ids[1:] for _, ids, _ in self.items]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        triples = [np.searchsorted(self.pairs, p[:-1]) * self.base + ids[2:] for p, (_, ids, _) in zip(pairs, self.items, strict=True)]
        self.triples = np.unique(np.concatenate([np.zeros(0, np.int64), *triples]))
        # For each length the longest runs of which some must be left, how many, and which runs its items have.
        self.runs: dict[int, tuple[int, int, np.ndarray]] = {}
        for n, numbers in self.by_length.items():
            q = next(q for q in (3, 2, 1) if n - q + 1 - q * self.edits[n] > 0)
            own = np.zeros((self.base, len(self.pairs), len(self.triples))[q - 1], bool)
            for k in numbers:
                own[(self.items[k][1], np.searchsorted(self.pairs, pairs[k]), np.searchsorted(self.triples, triples[k]))[q - 1]] = True
            self.runs[n] = (q, n - q + 1 - q * self.edits[n], own)
        #: Symbols and walks of each length, and the steps that each walk samples.
        self.chosen = dict(chosen) if chosen is not None else {n: self._choose(n, recall) for n in self.by_length}
        self.plans = {n: self._plan(n, *self.chosen[n]) for n in self.by_length}
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n, numbers in self.by_length.items():
            keys = self.keys(np.concatenate([self.items[k][1] for k in numbers]), np.arange(len(numbers)) * n, n)
            self.tables[n] = []
            for row in keys:
                order = np.argsort(row, kind="stable")
                self.tables[n].append((row[order], np.array(numbers)[order]))

    @staticmethod
    def _plan(n: int, samples: int, walks: int) -> np.ndarray:
        """The steps that each walk samples, within its expected length."""
        rng = np.random.default_rng(n)
        return np.array([np.sort(rng.choice(2 * n, min(samples, 2 * n), replace=False)) for _ in range(walks)])

    def _choose(self, n: int, recall: float) -> tuple[int, int]:
        """The first of ``PLANS`` that finds enough of the trial passages of this length, the last if none does."""
        if not self.edits[n]:
            return 3, 1  # equal windows write equal symbols
        rng, own, windows, begins, stride = np.random.default_rng(n + 1), self.by_length[n], [], [], max(1, n // STARTS_PER_LENGTH)
        size = 0
        for k in range(TRIALS):
            words = list(self.items[own[k % len(own)]][1])
            for _ in range(self.edits[n]):
                at, kind = int(rng.integers(len(words) + 1)), int(rng.integers(3))
                if kind == 0 or at == len(words):
                    words.insert(at, int(rng.integers(1, self.base)))
                elif kind == 1:
                    words[at] = int(rng.integers(1, self.base))
                else:
                    del words[at]
            around = SHIFT * stride
            padded = np.r_[rng.integers(1, self.base, around), words, rng.integers(1, self.base, self.edits[n] + around + stride)]
            begins.append(size + np.arange(2 * SHIFT + 1) * stride + int(rng.integers(stride)))
            windows.append(padded)
            size += len(padded)
        ids, starts = np.concatenate(windows), np.concatenate(begins)
        items = np.concatenate([self.items[own[k % len(own)]][1] for k in range(TRIALS)])
        for plan in PLANS:
            steps = self._plan(n, *plan)
            met = self.keys(ids, starts, n, steps).reshape(len(steps), TRIALS, -1) == self.keys(items, np.arange(TRIALS) * n, n, steps)[:, :, None]
            # Half of the misses allowed: a few trials say little about the last hundredths.
            if met.any(axis=(0, 2)).mean() >= (1 + recall) / 2:
                return plan
        return PLANS[-1]

    def keys(self, ids: np.ndarray, starts: np.ndarray, n: int, steps: np.ndarray | None = None) -> np.ndarray:
        """One key per walk and window of ``n`` words; past the end of a window the walk writes zeros."""
        steps = self.plans[n] if steps is None else steps
        out = np.zeros((len(steps), len(starts)), np.uint64)
        padded, walks = np.append(ids, 0), np.arange(len(steps), dtype=np.uint64)[:, None] * _WALK
        sampled = [np.flatnonzero((steps == step).any(axis=1)) for step in range(int(steps.max(initial=-1)) + 1)]
        for a in range(0, len(starts), WINDOWS_AT_ONCE):
            begin, key = starts[None, a:a + WINDOWS_AT_ONCE], out[:, a:a + WINDOWS_AT_ONCE]
            at = np.zeros(key.shape, np.int64)
            for step, rows in enumerate(sampled):
                symbol = np.where(at < n, padded[np.minimum(begin + at, len(ids))], 0).astype(np.uint64)
                if len(rows):
                    mixed = (key[rows] ^ symbol[rows] + np.uint64(step)) * _STEP
                    key[rows] = mixed ^ mixed >> np.uint64(31)
                bit = (symbol * _WORD ^ walks ^ np.uint64(step * int(_STEP) & (1 << 64) - 1)) * _STEP
                at += (bit >> np.uint64(41) & np.uint64(1)).astype(np.int64)
        return out

    def candidates(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of item and window start that share a sample."""
        size = len(ids)
        ids = np.append(ids, np.zeros(self.gap, np.int64))
        one = np.flatnonzero(ids)
        two, pair = self._runs(one, ids[one] * self.base + ids[one + 1], self.pairs)
        ranks = np.full(size + 2, -1, np.int64)
        ranks[two] = pair
        both = two[ranks[two + 1] >= 0]
        three, triple = self._runs(both, ranks[both] * self.base + ids[both + 2], self.triples)
        hits = ((one, ids[one]), (two, pair), (three, triple))
        found: set[tuple[int, int]] = set()
        for n in self.by_length:
            q, needed, own = self.runs[n]
            place, rank = hits[q - 1]
            place = place[own[rank]]
            # Starts from which n + e words hold ``needed`` runs: between the first and last of as many runs that lie close enough.
            if len(place) < needed:
                continue
            low, high = np.maximum(place[needed - 1:] + q - n - self.edits[n], 0), place[:len(place) - needed + 1]
            low, high = low[low <= high], high[low <= high]
            counts = high - low + 1
            here = np.unique(np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
            if not len(here):
                continue
            # The first start of each stretch, and every so many words.
            here = here[(here % max(1, n // STARTS_PER_LENGTH) == 0) | np.r_[True, np.diff(here) > 1]]
            for row, (table, order) in zip(self.keys(ids, here, n), self.tables[n], strict=True):
                low, high = np.searchsorted(table, row, "left"), np.searchsorted(table, row, "right")
                for w in np.flatnonzero(high > low):
                    found.update((int(k), int(here[w])) for k in order[low[w]:high[w]])
        return found

    @staticmethod
    def _runs(place: np.ndarray, value: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places whose value is known, and its rank."""
        if not len(known):
            return place[:0], place[:0]
        rank = np.minimum(np.searchsorted(known, value), len(known) - 1)
        good = known[rank] == value
        return place[good], rank[good]

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text item_id, edit distance, words of the item and last word of the passage: the best passage per item id, within the similarity."""
        out: list[list[tuple[int, int, int, int]]] = []
        held: list[np.ndarray] = []
        size = 0
        get = self.vocabulary.get
        for text in texts:
            words = words_of(text) if self.items else []
            held.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
            size += len(words)
            if size > WORDS_AT_ONCE:
                out += self._matches(held)
                held, size = [], 0
        return out + self._matches(held)

    def _matches(self, held: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        gap = np.zeros(self.gap, np.int64)
        ids = np.concatenate([np.zeros(1, np.int64), *[x for one in held for x in (one, gap)]])
        begins = 1 + np.concatenate([[0], np.cumsum([len(one) + self.gap for one in held])])
        best: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in held]
        checked: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, start in sorted(self.candidates(ids)) if self.items else []:
            item_id, item, most = self.items[k]
            d = int(np.searchsorted(begins, start, "right")) - 1
            if d < 0:
                continue
            first, last = int(begins[d]), int(begins[d]) + len(held[d])
            a, b = max(first, start - 2 * most), min(last, start + len(item) + 2 * most)
            # A stretch that an earlier candidate of the item covers has been searched.
            if any(x <= max(first, start - most) and min(last, start + len(item) + most) <= y for x, y in checked.get((d, k), [])):
                continue
            checked.setdefault((d, k), []).append((a, b))
            distance, end = edit_end(item, ids[a:b])
            row = (distance, a + end - first, item_id, len(item))
            if distance <= most and (item_id not in best[d] or row < best[d][item_id]):
                best[d][item_id] = row
        return [[(item_id, x, n, end) for item_id, (x, end, _, n) in sorted(one.items(), key=str)] for one in best]


class Benchmark:
    """Items (item_id, text) in blocks of bounded size; the parameters are those of the search."""

    def __init__(self, items: DataFrame, similarity: float = 0.8, recall: float = 0.95, min_words: int = 1) -> None:
        self.settings = (similarity, recall, min_words)
        rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = int(size // BLOCK_BYTES) + 1
        part = F.pmod(F.xxhash64("text"), F.lit(n))
        self.blocks = [rows.filter(part == b) for b in range(n)]

    def matcher(self, block: DataFrame) -> tuple:
        """Arguments of the matcher of a block: its texts, of about ``BLOCK_BYTES``, and the plans chosen for their lengths."""
        rows = sorted([(r.item_id, r.text) for r in block.collect()], key=str)
        return rows, *self.settings, Matcher(rows, *self.settings).chosen


def find_passages(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    """doc_id, item_id, distance, item_words, last_word: the items found in each row of ``docs`` (doc_id, text), its best passage each.

    Words are runs of letters, digits and underscores in lower case; an item is found where some stretch of words is within
    (1 - similarity) times its words of edit distance, so items of fewer than five words as they are.  Items of fewer than ``min_words``
    words, items without words and null texts are found nowhere; texts of any length are searched whole; equal rows give equal results; null ids pass through; other columns are ignored.
    """
    out = None
    for block in benchmark.blocks:
        made = benchmark.matcher(block)

        def run(batches: Iterator[pa.RecordBatch], made: tuple = made) -> Iterator[pa.RecordBatch]:
            from verispark.llm.decontaminate import Matcher

            tool = Matcher(*made)
            for batch in batches:
                each = tool.matches(batch.column(1).to_pylist())
                found = [(doc, *m) for doc, ms in zip(batch.column(0).to_pylist(), each, strict=True) for m in ms]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "distance", "item_words", "last_word"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            run, "doc_id long, item_id long, distance long, item_words long, last_word long")
        out = part if out is None else out.unionByName(part)
    return out


def without_passages(df: DataFrame, text_column: str, benchmark: Benchmark) -> DataFrame:
    """The rows of ``df`` in which no item is found, as they are."""
    for block in benchmark.blocks:
        made, place = benchmark.matcher(block), df.columns.index(text_column)

        def run(batches: Iterator[pa.RecordBatch], made: tuple = made, place: int = place) -> Iterator[pa.RecordBatch]:
            from verispark.llm.decontaminate import Matcher

            tool = Matcher(*made)
            for batch in batches:
                yield batch.filter(pa.array([not m for m in tool.matches(batch.column(place).to_pylist())], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
