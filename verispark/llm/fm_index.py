"""An FM-index over integer texts: Burrows-Wheeler transform in a wavelet matrix of packed bits.

Numpy throughout; searches go over many patterns at once.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit row for each bit of a symbol, with counts before each 64-bit word."""

    def __init__(self, sequence: np.ndarray, n_symbols: int) -> None:
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bits = (sequence >> level & 1).astype(bool)
            raw = np.packbits(bits, bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(raw)] = raw
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.rows.append((words, before, len(bits) - int(bits.sum())))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])
        self.start = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (words, before, zeros) in enumerate(self.rows):
            one = (symbols >> self.depth - 1 - k & 1).astype(bool)
            low = at & 63
            ones = before[at >> 6] + np.bitwise_count(words[at >> 6] & ((np.uint64(1) << low.astype(np.uint64)) - np.uint64(1)))
            at = np.where(one, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._descend(symbols, at) - self.start[symbols]


class FMIndex:
    """Index of texts of positive symbols; ``pieces`` are the lengths of the texts that ``symbols`` holds one after another.

    Every text ends in a terminator of its own, so no match crosses texts.  ``group`` numbers the
    suffixes, in their order, by their first ``width`` symbols; ``group_start`` has the first suffix of each.
    """

    def __init__(self, symbols: np.ndarray, pieces: np.ndarray, width: int) -> None:
        ends = np.cumsum(pieces + 1) - 1
        n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = symbols
        self.text, self.ends, self.width = text, ends, width
        rank = np.where(inside, text + len(ends), 0)
        rank[ends] = np.arange(len(ends))
        # Prefix doubling: the rank of a suffix by its first 3, 6, 12, ... symbols; three fit one key at the start.
        bits = int(n + text.max(initial=0)).bit_length()
        step = 3 if bits <= 21 and width >= 3 else 1
        key = rank
        for k in range(1, step):
            later = np.zeros(n, np.int64)
            later[:n - k] = rank[k:]
            key = key << bits | later
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            if step <= width:
                short, short_step = rank, step
            if rank[order[-1]] == n - 1 and 2 * short_step >= width:
                break
            second = np.zeros(n, np.int64)
            second[:max(0, n - step)] = rank[step:] + 1
            key = rank * (n + 1) + second
            step *= 2
        self.order = order
        # Two ranks by ``short_step`` symbols tell whether the first ``width`` symbols are equal.
        later = np.minimum(order + width - short_step, n - 1)
        change = (short[order[1:]] != short[order[:-1]]) | (short[later[1:]] != short[later[:-1]])
        self.group = np.concatenate([[0], np.cumsum(change)])
        self.group_start = np.flatnonzero(np.concatenate([[True], change]))
        n_symbols = int(text.max(initial=0)) + 1
        counts = np.bincount(text, minlength=n_symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.wavelet = WaveletMatrix(text[order - 1], n_symbols)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffix ranges of the patterns with a symbol put before each."""
        return self.first[symbols] + self.wavelet.rank(symbols, low), self.first[symbols] + self.wavelet.rank(symbols, high)

    def matching(self, starts: np.ndarray, lengths: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the windows of ``width`` symbols of the queries occur: query number, window offset, group.

        A query is ``query[start:start + length]`` with symbols of the index, 0 for one it does not have.
        Queries are read from their ends; the match is extended by one symbol at a time and, once it is
        longer than ``width``, widened to all suffixes that share its first ``width`` symbols, which is
        the matching statistic bounded by the threshold.  Windows that do not occur are left out.
        """
        n = len(self.text)
        low, high, matched = np.zeros(len(starts), np.int64), np.full(len(starts), n), np.zeros(len(starts), np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bounds = np.append(self.group_start, n)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero(lengths >= back)
            symbol = query[starts[live] + lengths[live] - back]
            new_low, new_high = self.extend(symbol, low[live], high[live])
            lost = (new_low >= new_high) | (symbol == 0)
            if lost.any():
                # What was matched ends here; a shorter match of this symbol and its right neighbours is sought anew.
                redo = np.flatnonzero(lost)
                new_low[redo], new_high[redo], found = self._longest(starts[live[redo]] + lengths[live[redo]] - back, np.minimum(matched[live[redo]], self.width - 1), query)
                length = matched[live] + 1
                length[redo] = found
            else:
                length = matched[live] + 1
            full = np.flatnonzero(length >= self.width)
            if len(full):
                number = self.group[new_low[full]]
                new_low[full], new_high[full] = bounds[number], bounds[number + 1]
                length[full] = self.width
                out.append((live[full], lengths[live[full]] - back, number))
            low[live], high[live], matched[live] = new_low, new_high, length
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))

    def _longest(self, at: np.ndarray, most: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest match that starts at each place with at most ``most`` symbols: range and length, by backward search of ever shorter patterns."""
        n = len(self.text)
        low, high, length = np.zeros(len(at), np.int64), np.full(len(at), n), np.zeros(len(at), np.int64)
        open_, want = np.arange(len(at)), most.copy()
        while len(open_):
            a, b, good = np.zeros(len(open_), np.int64), np.full(len(open_), n), np.ones(len(open_), bool)
            for k in range(int(want[open_].max()) - 1, -1, -1):
                use = np.flatnonzero((want[open_] > k) & good)
                symbol = query[at[open_[use]] + k]
                x, y = self.extend(symbol, a[use], b[use])
                a[use], b[use] = x, y
                good[use] = (x < y) & (symbol > 0)
            done = open_[good]
            low[done], high[done], length[done] = a[good], b[good], want[done]
            open_ = open_[~good]
            want[open_] -= 1
        return low, high, length
