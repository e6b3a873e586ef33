"""A deterministic integer mixer that any SQL engine can reproduce.

Resampling must give the same draws on a retried task and must be checkable
against an independent engine, so draws come from arithmetic on (draw, block)
rather than from a generator with state.  The mixer is a power permutation of
the residues modulo a Mersenne prime; an affine mixer would leave the starts of
one draw on a lattice and bias every interval.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647


def with_mix(df: DataFrame, draw: Column, item: Column, seed: int, name: str) -> DataFrame:
    """Add a pseudo-random residue in [0, PRIME) for a pair of counters.

    The steps are separate columns: each is used several times by the next, and
    one nested expression would repeat its parts exponentially.
    """
    steps = df.withColumn("_m", (draw.cast("bigint") * 7919 + item.cast("bigint") * 104729
                                 + F.lit(int(seed)).cast("bigint")) % PRIME)
    for last in (False, True):
        steps = steps.withColumn("_sq", F.col("_m") * F.col("_m") % PRIME)
        steps = steps.withColumn("_q", F.col("_sq") * F.col("_sq") % PRIME * F.col("_m") % PRIME)
        steps = steps.withColumn("_m", F.col("_q") if last else (F.col("_q") * 48271 + 11) % PRIME)
    return steps.withColumn(name, F.col("_m")).drop("_m", "_sq", "_q")


def mixed_array(draws: np.ndarray, items: np.ndarray, seed: int) -> np.ndarray:
    """The residues of ``with_mix`` for every draw (rows) and item (columns)."""
    m = (draws.astype(np.int64)[:, None] * 7919 + items.astype(np.int64)[None, :] * 104729 + seed) % PRIME
    for last in (False, True):
        square = m * m % PRIME
        fifth = square * square % PRIME * m % PRIME
        m = fifth if last else (fifth * 48271 + 11) % PRIME
    return m


def unmixed(residues: np.ndarray) -> np.ndarray:
    """What ``mixed_array`` mixes, ``(draw * 7919 + item * 104729 + seed) % PRIME``, from its residues: each step is a permutation."""
    def fifth_root(x: np.ndarray) -> np.ndarray:
        root = np.ones_like(x)
        for bit in bin(pow(5, -1, PRIME - 1))[2:]:
            root = root * root % PRIME
            if bit == "1":
                root = root * x % PRIME
        return root

    return fifth_root((fifth_root(residues.astype(np.int64)) - 11) * pow(48271, -1, PRIME) % PRIME)
