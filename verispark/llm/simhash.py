"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  Fingerprints that differ in three
bits or fewer differ in at most one bit on at least two segments.  The Golay code is perfect: each
23-bit word has exactly one codeword within three bits, and for words at distance one the codeword of
the one lies within four bits of the other.  A word has one or six codewords within four bits.  So
one side gives the codeword indices of its segments, the other those of all codewords within four
bits, in pairs of segments; joining on a pair finds every link, and the distance is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .files import Stages

#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text with A-Z in lower case; 0 for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = [0, *(ends[:n - 1] + 1).tolist()]
    stops = ends[min(width, len(words)) - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, SHINGLES_AT_ONCE):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[a:a + SHINGLES_AT_ONCE], stops[a:a + SHINGLES_AT_ONCE], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id and fp (the fingerprint as a signed long), one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.simhash import fingerprint

        for batch in batches:
            made = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["id", "fp"])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of 23-bit words by 12-bit halves, the coset leader by remainder, and up to six error patterns of weight four or less."""
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << bit - 11
        return word

    unit = np.array([remainder(1 << b) for b in range(23)])
    leader, near = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    from itertools import combinations
    for weight in range(5):
        for bits in combinations(range(23), weight):
            pattern, s = sum(1 << b for b in bits), int(np.bitwise_xor.reduce(unit[list(bits)])) if bits else 0
            if weight < 4:
                leader[s] = pattern
            near[s].append(pattern)
    table = np.full((2048, 6), -1, np.int64)
    for s, patterns in enumerate(near):
        table[s, :len(patterns)] = patterns
    return unit, leader, table


def _remainders(words: np.ndarray) -> np.ndarray:
    unit, out = _tables()[0], np.zeros(len(words), np.int64)
    for bit in range(23):
        out ^= np.where(words >> bit & 1, unit[bit], 0)
    return out


def nearest_index(words: np.ndarray) -> np.ndarray:
    """Index of the one codeword within three bits."""
    return (words ^ _tables()[1][_remainders(words)]) >> 11


def near_indices(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within four bits, six columns, -1 where there is one only."""
    patterns = _tables()[2][_remainders(words)]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> 11)


def _keyed(prints: DataFrame, many: bool) -> DataFrame:
    """Rows of key and fp: three for a fingerprint, or one for each pair of codewords near two of its segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.simhash import SEGMENTS, near_indices, nearest_index

        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(values), 4096):
                fp = values[a:a + 4096].astype(np.int64)
                index = [near_indices(w) if many else nearest_index(w)[:, None]
                         for w in ((fp.view(np.uint64) >> np.uint64(s)).astype(np.int64) & (1 << n) - 1 for s, n in SEGMENTS)]
                keys, owners = [], []
                for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                    left, right = index[i][:, :, None], index[j][:, None, :]
                    there = (left >= 0) & (right >= 0)
                    keys.append((pair << 24 | left << 12 | right)[there])
                    owners.append(np.broadcast_to(fp[:, None, None], there.shape)[there])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.concatenate(owners))], names=["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key int, fp long")


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """a < b: distinct fingerprints (column fp) that differ in ``distance`` bits, at most three, or fewer."""
    if not 0 <= distance <= 3:
        raise ValueError("two clean segments are certain for three differing bits at most")
    one, many = _keyed(prints, False).withColumnRenamed("fp", "other"), _keyed(prints, True)
    close = (F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)
    return one.hint("merge").join(many, "key").filter(close).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def groups(df: DataFrame, id_column: str, text_column: str, stages: Stages, distance: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable by links).

    Rows with one fingerprint are one node, however many they are.  Null and empty texts have the
    fingerprint zero and are linked like any other; a null id is nobody's smallest id unless its group
    has no other; repeated ids are rows of their own; an empty table gives no rows.
    """
    rows = stages.put(fingerprints(df, id_column, text_column), "fingerprints")
    nodes = stages.put(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    found = connected_components(links(nodes, distance), stages).withColumnRenamed("node", "fp")
    linked = nodes.join(found, "fp")
    smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    of_linked = linked.join(smallest, "component").select("fp", "smallest")
    known = stages.put(nodes.join(of_linked, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id")), "known")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(known, "fp").select(F.col("id").alias(id_column), digits.alias("fingerprint"), "component_id")


def first_of_groups(df: DataFrame, id_column: str, text_column: str, stages: Stages, distance: int = 3) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their group, as they are.

    Rows that share an id are one document and stay or go together; a row without id stays only if no row of its group has one.
    """
    grouped = groups(df, id_column, text_column, stages, distance)
    name = "stay" + "_" * max([len(c) for c in df.columns])
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)))
    stay = stages.put(grouped.filter(F.col(id_column).eqNullSafe(F.col("component_id"))).select(key.alias(name)).distinct(), "stay")
    stages.release()
    return df.join(stay, key == F.col(name), "left_semi")
