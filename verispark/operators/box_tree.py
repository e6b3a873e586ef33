"""Nearest neighbours by branch and bound over two trees of tight boxes.

Items are sorted along a space-filling curve and every ``FANOUT`` neighbours in that order become a
node with the tight box around them, level by level up to one root.  Empty space has no nodes, so the trees are as
deep as the logarithm of their items, however far apart or crowded these are.  The search goes down both trees at once, a level a
join: a pair of nodes stays while the least distance of its boxes does not exceed the best bound of the point's node,
the smallest of the farthest distances to a reference box.  All points of a node share that work.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .contracts import attach_row
from .order_stats import TASK_ROWS
from .resample import unit_ordinals

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
#: Bits of the curve along each axis; places that agree in all of them follow one another by their coordinates.
CURVE_BITS = 18
#: Levels that one job goes down before its pairs are written.
LAZY_LEVELS = 4
#: Distances that differ by less are told apart only at the end, so that ties are seen.
SLACK = 1e-12


@dataclass(frozen=True)
class Tree:
    """``items`` with their ordinal ``node`` and boxes ``lo_*``, ``hi_*``; ``levels`` is the height of the root."""

    items: DataFrame
    axes: tuple[str, ...]
    levels: int

    def level(self, height: int) -> DataFrame:
        """node and box of every node at a height."""
        boxes = [f"{side}_{a}" for side in ("lo", "hi") for a in self.axes]
        if height == 0:
            return self.items.select("node", *boxes)
        up = F.shiftright("node", FANOUT_BITS * height).alias("node")
        return self.items.groupBy(up).agg(*[(F.min if c[:2] == "lo" else F.max)(c).alias(c) for c in boxes])


def _curve(places: Sequence[Column]) -> Column:
    """Bits of whole numbers, taken from each axis in turn."""
    out = F.lit(0).cast("long")
    for bit in range(CURVE_BITS):
        for k, place in enumerate(places):
            out = out + F.shiftleft(F.shiftright(place, bit).bitwiseAND(1), len(places) * bit + k)
    return out


def build(items: DataFrame, axes: Sequence[str], span: tuple[float, float] | None = None, most: int | None = None) -> Tree:
    """A tree over items with finite ``lo_*`` and ``hi_*`` per axis; equal rows are one item.

    ``span`` bounds all coordinates and ``most`` the number of items, where they are known.
    """
    axes = tuple(axes)
    if span is None:
        items = cut_lineage(items)
        spans = items.agg(*[F.min(f"lo_{a}").alias(f"_from_{a}") for a in axes], *[F.max(f"hi_{a}").alias(f"_to_{a}") for a in axes])
        spanned = attach_row(items, spans)
    else:
        spanned = items.withColumns({f"_{end}_{a}": F.lit(float(v)) for a in axes for end, v in zip(("from", "to"), span, strict=True)})

    # Dividing before adding and subtracting keeps the largest doubles finite.
    def place(a: str) -> Column:
        low, high = F.col(f"_from_{a}") / 4, F.col(f"_to_{a}") / 4
        share = F.try_divide(F.col(f"lo_{a}") / 8 + F.col(f"hi_{a}") / 8 - low, high - low)
        return F.floor(F.coalesce(share, F.lit(0.0)) * ((1 << CURVE_BITS) - 1)).cast("long")

    key = F.struct(_curve([place(a) for a in axes]).alias("curve"), *[F.col(c) for c in items.columns])
    keyed = spanned.select(key.alias("_key")).distinct()
    if most is None or most > TASK_ROWS:
        keyed = cut_lineage(keyed)
        most = keyed.count()
    # Written once: nodes are numbered by computed keys.
    numbered = unit_ordinals(keyed, [], "_key") if most > TASK_ROWS else keyed.withColumn("unit_idx", F.row_number().over(Window.orderBy("_key")) - 1)
    placed = cut_lineage(numbered.select(F.col("unit_idx").cast("long").alias("node"), *[F.col(f"_key.`{c}`").alias(c) for c in items.columns]))
    n = placed.count()
    levels = 0
    while FANOUT ** levels < n:
        levels += 1
    return Tree(placed, axes, levels)


def _gap(axes: Sequence[str]) -> Column:
    """Least distance of two boxes."""
    parts = [F.greatest(F.lit(0.0), F.col(f"r_lo_{a}") - F.col(f"p_hi_{a}"), F.col(f"p_lo_{a}") - F.col(f"r_hi_{a}")) for a in axes]
    return F.sqrt(sum((x * x for x in parts[1:]), parts[0] * parts[0]))


def _reach(axes: Sequence[str]) -> Column:
    """Greatest distance of two boxes: no point of the one is farther from anything in the other."""
    parts = [F.greatest(F.col(f"r_hi_{a}") - F.col(f"p_lo_{a}"), F.col(f"p_hi_{a}") - F.col(f"r_lo_{a}")) for a in axes]
    return F.sqrt(sum((x * x for x in parts[1:]), parts[0] * parts[0]))


def candidates(points: Tree, reference: Tree) -> DataFrame:
    """p_node and r_node: every point's item with the reference items that may be nearest to it; empty if either tree is."""
    def side(tree: Tree, height: int, steps: int, name: str) -> DataFrame:
        # Above its root a tree has the one node 0.
        table = tree.level(min(height, tree.levels))
        return table.select(F.shiftright("node", FANOUT_BITS * steps).alias(f"{name}_up"), F.col("node").alias(f"{name}_node"),
                            *[F.col(f"{s}_{a}").alias(f"{name}_{s}_{a}") for s in ("lo", "hi") for a in tree.axes])

    pairs, height, lazy = None, max(points.levels, reference.levels), 0
    while pairs is None or height:
        # The first step goes down two levels from the roots, to a bounded number of nodes.
        steps = min(height, 1 if pairs is not None else 2)
        height -= steps
        below = [side(points, height, steps, "p"), side(reference, height, steps, "r")]
        if pairs is None:
            met = below[0].join(below[1], F.col("p_up") == F.col("r_up"))
        else:
            met = pairs.select(F.col("p_node").alias("p_up"), F.col("r_node").alias("r_up")).join(below[0], "p_up").join(below[1], "r_up")
        best = F.min(_reach(points.axes)).over(Window.partitionBy("p_node"))
        pairs = met.withColumn("_best", best).where(_gap(points.axes) <= F.col("_best") * (1 + 1e-9) + SLACK).select("p_node", "r_node")
        lazy += 1
        if lazy == LAZY_LEVELS and height:
            pairs, lazy = cut_lineage(pairs), 0
    return pairs
