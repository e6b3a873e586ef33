"""Bootstrap draws as joins.

A circular-block draw is a sum of arcs, so the daily table is first turned into
arc sums (one row per possible start) and a draw joins ``ceil(n/width)`` arcs
instead of ``n`` days.  Spatial draws are integer weights per unit.  Every draw
is arithmetic on counters (see ``functions.mixing``): retried tasks repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mixing import mixed_array, with_mix
from ..session import cut_lineage
from .contracts import attach_row
from .order_stats import fits_a_task, ranked_within, weighted_correlation

# Values of the lookup side that may be broadcast, rows times columns; beyond it both sides are shuffled.
BROADCAST_VALUES = 4_000_000


def day_ordinals(daily: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    """Add ``day_idx`` (0-based over the distinct days of a group) and ``n_days``.

    The windows run over a calendar, a few ten thousand rows per group at most.
    """
    calendar = daily.select(*by, day).distinct()
    numbered = (calendar.withColumn("day_idx", F.row_number().over(Window.partitionBy(*by).orderBy(day)) - 1)
                .withColumn("n_days", F.count(F.lit(1)).over(Window.partitionBy(*by))))
    return daily.join(numbered, [*by, day])


def block_starts(sizes: DataFrame, by: Sequence[str], draws: int, width: int, seed: int,
                 n: str = "n_days") -> DataFrame:
    """One row per (group, draw, block): circular start and number of days taken.

    The last block is cut so that a draw holds exactly ``n`` days.
    """
    blocks = F.ceil(F.col(n) / width).cast("int")
    per_draw = sizes.select(*by, F.col(n).cast("int").alias("_n"), blocks.alias("_blocks"),
                            F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    # A draw fans out into many blocks.  A stated partition count keeps adaptive execution
    # from folding the few draw rows into one task, and the draws stay put until they are summed.
    spread = per_draw.repartition(sizes.sparkSession.sparkContext.defaultParallelism, "draw")
    per_block = spread.select(*by, "draw", "_n", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    mixed = with_mix(per_block, F.col("draw"), F.col("_block"), seed, "_mix")
    return mixed.select(
        *by, "draw", F.col("_n").alias("n"), (F.col("_mix") % F.col("_n")).cast("int").alias("start"),
        F.least(F.lit(width), F.col("_n") - F.col("_block") * width).alias("take"))


def _lookup(starts: DataFrame, table: DataFrame, keys: Sequence[str], bound: int) -> DataFrame:
    """Join draws with the sums they pick.

    The exploded draws look tiny to the planner, which would broadcast the wrong
    side.  The lookup side is broadcast while its proven bound allows, which
    leaves the draws where they are; otherwise both sides are shuffled.
    """
    if bound * len(table.columns) <= BROADCAST_VALUES:
        return starts.join(F.broadcast(table), list(keys))
    return starts.hint("merge").join(table, list(keys))


def arc_sums(daily: DataFrame, by: Sequence[str], measures: Sequence[str], width: int) -> DataFrame:
    """Sum and count of each measure over every arc of ``width`` days and of the cut last block.

    ``daily`` carries ``day_idx`` and ``n_days``.  Each day is scattered into the
    arcs that contain it and summed with map-side combining; a day that a group
    lacks adds nothing to sum or count.
    """
    n = F.col("n_days").cast("int")
    rest = (n - (F.ceil(n / width) - 1) * width).cast("int")
    offset = F.col("_o")
    scattered = daily.select(*by, *[F.col(f"`{m}`") for m in measures], n.alias("_n"), rest.alias("_rest"),
                             F.col("day_idx").cast("int").alias("_d"),
                             F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_o"))
    lengths = F.array_distinct(F.array(F.least(F.lit(width), F.col("_n")), F.col("_rest")))
    placed = scattered.select(
        *by, *[F.col(f"`{m}`") for m in measures], F.pmod(F.col("_d") - offset, F.col("_n")).alias("start"),
        F.explode(F.filter(lengths, lambda length: offset < length)).alias("take"))
    return placed.groupBy(*by, "start", "take").agg(*[
        a for m in measures for a in (F.sum(f"`{m}`").alias(f"{m}__s"), F.count(f"`{m}`").alias(f"{m}__n"))])


def block_bootstrap(daily: DataFrame, by: Sequence[str], day: str, measures: Sequence[str], draws: int,
                    width: int, seed: int) -> DataFrame:
    """Mean of every measure per (group, draw) under a paired circular-block bootstrap.

    All measures share the draw, so models and references stay paired.  The
    daily table is materialised first: the cases behind it are read once.
    """
    daily = cut_lineage(daily.select(*by, day, *measures))
    bound = 2 * daily.count()
    indexed = day_ordinals(daily, by, day)
    sizes = indexed.groupBy(*by).agg(F.max("n_days").alias("n_days"))
    arcs = arc_sums(indexed, by, measures, width)
    picked = _lookup(block_starts(sizes, by, draws, width, seed), arcs, [*by, "start", "take"], bound)
    return picked.groupBy(*by, "draw").agg(*[
        F.try_divide(F.sum(f"`{m}__s`"), F.sum(f"`{m}__n`")).alias(m) for m in measures])


def day_weights(sizes: DataFrame, by: Sequence[str], draws: int, width: int, seed: int) -> DataFrame:
    """How often each day enters each draw: the weight form of the same bootstrap."""
    starts = block_starts(sizes, by, draws, width, seed)
    days = starts.select(*by, "draw", "start", "n", F.explode(F.sequence(F.lit(0), F.col("take") - 1)).alias("_o"))
    return (days.groupBy(*by, "draw", F.pmod(F.col("start") + F.col("_o"), F.col("n")).alias("day_idx"))
            .agg(F.count(F.lit(1)).alias("k")))


def unit_weights(sizes: DataFrame, by: Sequence[str], draws: int, seed: int, n: str = "n_units") -> DataFrame:
    """Draw ``n`` of ``n`` units with replacement; one row per unit that was drawn, with its multiplicity."""
    items = block_starts(sizes, by, draws, 1, seed, n)
    return items.groupBy(*by, "draw", F.col("start").alias("unit_idx")).agg(F.count(F.lit(1)).alias("k"))


def unit_ordinals(units: DataFrame, by: Sequence[str], unit: str, limit: int | None = None) -> DataFrame:
    """``unit_idx`` (0-based, in order of the unit) and ``n_units`` for the distinct units of a group.

    A small inventory is numbered by a window.  A larger one is range-partitioned
    and numbered inside its partitions, which are then offset by the sizes of
    those before them.
    """
    by = list(by)
    distinct = units.select(*by, unit).distinct()
    if fits_a_task(distinct, by, limit):
        return (distinct.withColumn("unit_idx", F.row_number().over(Window.partitionBy(*by).orderBy(unit)) - 1)
                .withColumn("n_units", F.count(F.lit(1)).over(Window.partitionBy(*by))))
    ranged = distinct.repartitionByRange(*by, unit).sortWithinPartitions(*by, unit)
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    # Written once: the partition of a row must not change between the two uses below.
    placed = cut_lineage(ranged.select(*by, unit, F.spark_partition_id().alias("_part"), inside.alias("_inside")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.withColumn("_offset", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).drop("_size")
    numbered = placed.join(offsets, "_part").withColumn("_all", F.col("_offset") + F.col("_inside"))
    groups = numbered.groupBy(*by).agg(F.min("_all").alias("_first"), F.count(F.lit(1)).alias("n_units"))
    joined = numbered.join(groups, by) if by else attach_row(numbered, groups)
    return joined.select(*by, unit, (F.col("_all") - F.col("_first")).cast("int").alias("unit_idx"), "n_units")


def day_counts(first: int, last: int, n: int, width: int, seed: int) -> np.ndarray:
    """How often each of ``n`` days is in draws ``first`` to ``last`` - 1 (rows): the circular blocks of ``block_starts``, laid on by differences."""
    items = np.arange(-(-n // width))
    starts = mixed_array(np.arange(first, last), items, seed) % n
    ends = starts + np.minimum(width, n - items * width)
    rows = np.arange(last - first)[:, None] * (2 * n + 1)
    size = (last - first) * (2 * n + 1)
    change = np.bincount((rows + starts).ravel(), minlength=size) - np.bincount((rows + ends).ravel(), minlength=size)
    twice = np.cumsum(change.reshape(last - first, 2 * n + 1), axis=1)
    return (twice[:, :n] + twice[:, n:2 * n]).astype(float)


def drawn_sums(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the columns of ``values`` over the days of each draw, infinite and NaN values as addition has them."""
    finite = np.isfinite(values)
    if finite.all():
        return counts @ values
    out = counts @ np.where(finite, values, 0.0)
    odd = np.flatnonzero(~finite.all(axis=0))
    part = values[:, odd]
    up, down, neither = (counts @ flags.astype(float) > 0 for flags in (part == np.inf, part == -np.inf, np.isnan(part)))
    out[:, odd] = np.where(neither | (up & down), np.nan, np.where(up, np.inf, np.where(down, -np.inf, out[:, odd])))
    return out


def _calendar_arrays(daily: DataFrame, units: Sequence[str], day: str, measures: Sequence[str], calendar: DataFrame) -> DataFrame:
    """units, n_days, at (day numbers) and per measure arrays of sums and counts: one row per unit, as long as the calendar."""
    # One calendar is as short as the array of a single unit.
    indexed = daily.join(F.broadcast(day_ordinals(calendar, [], day)), day)
    # Rows go to their unit once and stay for both steps.  A stated partition count keeps adaptive execution from folding
    # the few rows of units into one task.
    dealt = indexed.repartition(4 * daily.sparkSession.sparkContext.defaultParallelism, *units)
    sums = dealt.groupBy(*units, "day_idx").agg(
        F.max("n_days").alias("n_days"), *[a for k, m in enumerate(measures) for a in (F.sum(F.col(f"`{m}`").cast("double")).alias(f"s{k}"), F.count(f"`{m}`").cast("double").alias(f"c{k}"))])
    row = F.struct("day_idx", *[f"{x}{k}" for k in range(len(measures)) for x in "sc"])
    packed = sums.groupBy(*units).agg(F.max("n_days").cast("int").alias("n_days"), F.collect_list(row).alias("_days"))
    return packed.select(*units, "n_days", F.col("_days.day_idx").cast("array<int>").alias("at"),
                         *[F.transform(F.col(f"_days.{x}{k}"), lambda v: F.coalesce(v, F.lit(0.0))).alias(f"{x}{k}") for k in range(len(measures)) for x in "sc"])


#: Draws whose sums are made and sent on together, and values of the units that meet them at once.
DRAW_BLOCK, UNIT_VALUES = 125, 4_000_000


def unit_sums(daily: DataFrame, units: Sequence[str], day: str, measures: Sequence[str], draws: int, width: int, seed: int,
              calendar: DataFrame | None = None) -> DataFrame:
    """draw, units and, per measure, ``m__s`` and ``m__n``: sum and count over the drawn days when all units share one drawn calendar.

    A unit's days are one array as long as the calendar.  Draws are arithmetic on counters, so each task makes the
    day counts of a block of draws itself and multiplies them with the days of its units: nothing is shuffled per draw.
    """
    units, names = list(units), [f"{m}__{x}" for m in measures for x in "sn"]
    packed = _calendar_arrays(daily, units, day, measures, calendar if calendar is not None else daily.select(day).distinct())
    types = {f.name: f.dataType.simpleString() for f in packed.select(*units).schema}
    columns = [f"{x}{k}" for k in range(len(measures)) for x in "sc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            n = whole.column("n_days")[0].as_py()
            step = max(1, UNIT_VALUES // (n * len(columns)))
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                many = batch.num_rows
                sizes = np.asarray(batch.column("at").value_lengths())
                unit, at = np.repeat(np.arange(many), sizes), np.asarray(batch.column("at").flatten())
                days = np.zeros((n, many, len(columns)))
                for c, name in enumerate(columns):
                    days[at, unit, c] = np.asarray(batch.column(name).flatten())
                for first in range(0, draws, DRAW_BLOCK):
                    last = min(first + DRAW_BLOCK, draws)
                    sums = drawn_sums(day_counts(first, last, n, width, seed), days.reshape(n, -1)).reshape(last - first, many, len(columns))
                    keys = [batch.column(u).take(pa.array(np.tile(np.arange(many), last - first))) for u in units]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(first, last, dtype=np.int32), many)), *keys,
                                                      *[pa.array(sums[:, :, c].ravel()) for c in range(len(columns))]], names=["draw", *units, *names])

    return packed.mapInArrow(run, ", ".join(["draw int", *[f"`{u}` {types[u]}" for u in units], *[f"`{c}` double" for c in names]]))


def nested_bootstrap(daily: DataFrame, day: str, unit: str, weight: str, measures: Sequence[str], draws: int,
                     width: int, seed_time: int, seed_space: int) -> DataFrame:
    """Days in circular blocks and spatial units with replacement, jointly.

    Only days on which every unit reports take part.  A unit counts with its own
    ``weight`` times the number of times it was drawn.
    """
    daily = cut_lineage(daily.select(day, unit, weight, *measures))
    n_units = daily.select(F.count_distinct(unit).alias("n")).head().n
    full = daily.groupBy(day).agg(F.count_distinct(unit).alias("_u")).where(F.col("_u") == n_units).select(day)
    complete = daily.join(full, day, "left_semi")
    temporal = unit_sums(complete, [unit, weight], day, measures, draws, width, seed_time)
    numbered = unit_ordinals(daily, [], unit)
    space = unit_weights(numbered.groupBy().agg(F.max("n_units").alias("n_units")), [], draws, seed_space)
    drawn = space.join(numbered.select("unit_idx", unit), "unit_idx").select("draw", unit, "k")
    both = temporal.join(drawn, ["draw", unit])
    factor = F.col("k") * F.col(weight)
    return both.groupBy("draw").agg(*[
        F.try_divide(F.sum(factor * F.col(f"`{m}__s`")), F.sum(factor * F.col(f"`{m}__n`"))).alias(m)
        for m in measures])


def unit_means(daily: DataFrame, units: Sequence[str], day: str, measures: Sequence[str], draws: int, width: int,
               seed: int) -> DataFrame:
    """Mean of every measure per (draw, unit) when all units share one drawn calendar; a draw without a day of the unit is left out."""
    sums = unit_sums(daily, units, day, measures, draws, width, seed)
    some = F.lit(False)
    for m in measures:
        some = some | (F.col(f"`{m}__n`") > 0)
    return sums.where(some).select("draw", *units, *[F.try_divide(F.col(f"`{m}__s`"), F.col(f"`{m}__n`")).alias(m) for m in measures])


def cell_day_bootstrap(daily: DataFrame, by: Sequence[str], cell: str, day: str, measures: Sequence[str],
                       draws: int, width: int, seed_time: int, seed_space: int) -> DataFrame:
    """Joint draw of cells and day blocks: days average inside a cell, drawn cells count equally.

    Calendar and cell inventory are shared by all groups, so models stay paired.
    """
    means = unit_means(daily, [*by, cell], day, measures, draws, width, seed_time)
    numbered = unit_ordinals(daily, [], cell)
    space = unit_weights(numbered.groupBy().agg(F.max("n_units").alias("n_units")), [], draws, seed_space)
    drawn = space.join(numbered.select("unit_idx", cell), "unit_idx").select("draw", cell, "k")
    both = means.join(drawn, ["draw", cell])
    return both.groupBy("draw", *by).agg(*[
        F.try_divide(F.sum(F.col("k") * F.col(f"`{m}`")),
                     F.sum(F.when(F.col(f"`{m}`").isNotNull(), F.col("k")))).alias(m) for m in measures])


def average_rank_columns(values: np.ndarray) -> np.ndarray:
    """Average ranks down each column."""
    n = len(values)
    order = np.argsort(values, axis=0, kind="stable")
    ordered = np.take_along_axis(values, order, axis=0)
    starts = np.ones(values.shape, bool)
    starts[1:] = ordered[1:] != ordered[:-1]
    place = np.arange(n)[:, None]
    first = np.maximum.accumulate(np.where(starts, place, 0), axis=0)
    ends = np.ones(values.shape, bool)
    ends[:-1] = starts[1:]
    last = np.minimum.accumulate(np.where(ends, place, n)[::-1], axis=0)[::-1]
    out = np.empty(values.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, axis=0)
    return out


def tied_ranks(weights: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Average ranks of units that count ``weights`` (draws by units) times, along their fixed order with the numbers of tied groups."""
    along = weights[:, order]
    firsts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    totals = np.add.reduceat(along, firsts, axis=1)
    ranks = np.cumsum(totals, axis=1) - (totals - 1) / 2
    out = np.empty(weights.shape)
    out[:, order] = ranks[:, group]
    return out


def _correlations(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted correlation of each row, NaN without spread."""
    n = weights.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_x, mean_y = (weights * x).sum(axis=1) / n, (weights * y).sum(axis=1) / n
        cx, cy = x - mean_x[:, None], y - mean_y[:, None]
        spread = np.sqrt((weights * cx * cx).sum(axis=1) * (weights * cy * cy).sum(axis=1)) / n
        return np.where(spread > 1e-12, (weights * cx * cy).sum(axis=1) / n / spread, np.nan)


#: Values of a block of draws by units in one task, and of the draws by units that it holds as matrices at once.
MATRIX_VALUES, RANK_VALUES = 8_000_000, 500_000


def _draw_blocks(draws: int, n_units: int) -> int:
    """Draws that one task takes: a share of the draws, fewer where there are many units."""
    return max(1, min(DRAW_BLOCK, MATRIX_VALUES // max(n_units, 1)))


def weighted_spearman_draws(units: DataFrame, by: Sequence[str], block: str, x: str, y: str, draws: int,
                            seed: int) -> DataFrame:
    """Rank correlation per (group, draw) when whole blocks of units are drawn with replacement.

    A unit drawn k times enters as weight k, ranks included, so nothing is copied.  The order of the units is the same in all draws:
    they are sorted once, and a draw's tied ranks are cumulative weights along that order.  A task takes a block of draws
    and the units of one group and holds a few draws at a time, so that neither the blocks nor its matrices grow with the
    units; groups beyond ``MATRIX_VALUES`` units are ranked by windows instead.
    """
    by, units = list(by), cut_lineage(units.select(*by, block, x, y))
    numbered = unit_ordinals(units, by, block)
    present = units.join(numbered, [*by, block]).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    largest = units.groupBy(*by).count().agg(F.max("count")).head()[0] or 0
    if largest > MATRIX_VALUES:
        return _weighted_spearman_windows(units, numbered, by, block, x, y, draws, seed)
    step = min(draws, DRAW_BLOCK)
    spread = present.select(*by, F.col("unit_idx").cast("int").alias("unit_idx"), F.col("n_units").cast("int").alias("n_units"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
                            F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(step))).alias("_first"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in present.select(*by).schema)

    def run(table: pa.Table) -> pa.Table:
        first, n = table.column("_first")[0].as_py(), table.column("n_units")[0].as_py()
        last, unit = min(first + step, draws), table.column("unit_idx").to_numpy()
        orders = []
        for name in ("x", "y"):
            values = table.column(name).to_numpy()
            order = np.argsort(values, kind="stable")
            along = values[order]
            # NaN is one value, above all others, as in a sort of rows.
            differs = (along[1:] != along[:-1]) & ~(np.isnan(along[1:]) & np.isnan(along[:-1]))
            orders.append((order, np.r_[0, np.cumsum(differs)]))
        found, many = [], max(1, RANK_VALUES // max(n, len(unit)))
        for low in range(first, last, many):
            drawn = mixed_array(np.arange(low, min(low + many, last)), np.arange(n), seed) % n
            weights = np.stack([np.bincount(row, minlength=n) for row in drawn])[:, unit].astype(float)
            rho = _correlations(*[tied_ranks(weights, *o) for o in orders], weights)
            found.append((rho, weights.sum(axis=1) > 0))
        rho, some = (np.concatenate(part) for part in zip(*found, strict=True))  # a draw of blocks without a pair has no row
        keys = [table.column(c).combine_chunks().take(pa.array(np.zeros(int(some.sum()), np.int32))) for c in by]
        return pa.table([*keys, pa.array(np.arange(first, last, dtype=np.int32)[some]), pa.array(rho[some], mask=np.isnan(rho[some]))], names=[*by, "draw", "rho"])

    dealt = spread.repartition(units.sparkSession.sparkContext.defaultParallelism, *by, "_first")
    return dealt.groupBy(*by, "_first").applyInArrow(run, ", ".join(filter(None, [types, "draw int", "rho double"])))


def _weighted_spearman_windows(units: DataFrame, numbered: DataFrame, by: list[str], block: str, x: str, y: str, draws: int, seed: int) -> DataFrame:
    weights = unit_weights(numbered.groupBy(*by).agg(F.max("n_units").alias("n_units")), by, draws, seed)
    drawn = (weights.join(numbered.select(*by, block, "unit_idx"), [*by, "unit_idx"])
             .join(units, [*by, block]).where(F.col(x).isNotNull() & F.col(y).isNotNull()))
    ranked = ranked_within(drawn, [*by, "draw"], x, "_rx", "k")
    ranked = ranked_within(ranked, [*by, "draw"], y, "_ry", "k")
    return ranked.groupBy(*by, "draw").agg(weighted_correlation(F.col("_rx"), F.col("_ry"), F.col("k")).alias("rho"))


def drawn_day_spearman(daily: DataFrame, unit: str, day: str, measures: Sequence[str], target: Column, covariates: dict[str, Column],
                       draws: int, width: int, seed: int) -> DataFrame:
    """draw, covariate, rho: rank correlation over units of ``target`` with each covariate, all recomputed under each draw of day blocks.

    ``target`` and ``covariates`` are expressions of the measures' means.  A unit without a value in a draw leaves that correlation.
    Units travel packed, a block of draws each; a task ranks one block, column by column, nothing is sorted or spilled on the way.
    """
    means = unit_means(daily, [unit], day, measures, draws, width, seed)
    names = list(covariates)
    columns = ["_t", *[f"_c{k}" for k in range(len(names))]]
    values = means.select("draw", target.cast("double").alias("_t"), *[c.cast("double").alias(f"_c{k}") for k, c in enumerate(covariates.values())])
    n_units = daily.select(F.count_distinct(unit)).head()[0]
    step = _draw_blocks(draws, n_units * len(columns))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draw = np.asarray(batch.column("draw"))
            order = np.argsort(draw, kind="stable")
            draw, rows = draw[order], np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])[:, order]
            blocks, firsts = np.unique(draw // step, return_index=True)
            spans = [*zip(firsts, [*firsts[1:], len(draw)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([draw[a:b].tobytes() for a, b in spans], pa.binary()),
                                              pa.array([rows[:, a:b].tobytes() for a, b in spans], pa.binary())], names=["_block", "_draws", "_rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws_in, rows_in = [], []
        for batch in batches:
            draws_in += [np.frombuffer(v, np.int32) for v in batch.column("_draws").to_pylist()]
            rows_in += [np.frombuffer(v).reshape(len(columns), -1) for v in batch.column("_rows").to_pylist()]
        if not draws_in:
            return
        draw, (t, *others) = np.concatenate(draws_in), np.concatenate(rows_in, axis=1)
        del draws_in, rows_in
        order = np.argsort(draw, kind="stable")
        ids, firsts = np.unique(draw[order], return_index=True)
        t = t[order]
        out: dict[str, list] = {"draw": [], "covariate": [], "rho": []}
        for name, other in zip(names, others, strict=True):
            c = other[order]
            for i, a, b in zip(ids, firsts, [*firsts[1:], len(draw)], strict=True):
                good = ~(np.isnan(t[a:b]) | np.isnan(c[a:b]))
                x, y = (average_rank_columns(v[a:b][good][:, None])[:, 0][None] for v in (t, c))
                rho = _correlations(x, y, np.ones(x.shape))[0] if x.size else np.nan
                out["draw"].append(int(i))
                out["covariate"].append(name)
                out["rho"].append(None if np.isnan(rho) else float(rho))
        yield pa.RecordBatch.from_arrays([pa.array(out["draw"], pa.int32()), pa.array(out["covariate"], pa.string()), pa.array(out["rho"], pa.float64())], names=["draw", "covariate", "rho"])

    # A partition is one block of draws, so that its rows need no sort; they travel packed, not one by one.
    packed = values.mapInArrow(pack, "_block int, _draws binary, _rows binary")
    return packed.repartitionById(-(-draws // step), F.col("_block")).mapInArrow(run, "draw int, covariate string, rho double")


def interval(value: str | Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Aggregates: percentile interval over the draws of a group (a bounded number)."""
    tail = (1 - confidence) / 2
    column = F.col(value) if isinstance(value, str) else value
    return F.percentile(column, F.lit(tail)), F.percentile(column, F.lit(1 - tail))


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows on which a condition holds."""
    return F.avg(condition.cast("double"))


def sup_t_band(draws: DataFrame, point: DataFrame, by: Sequence[str], dims: Sequence[str], value: str,
               confidence: float = 0.95) -> DataFrame:
    """Simultaneous band: the quantile of the largest studentised deviation of each draw.

    ``draws`` has one row per (by, dims, draw); ``point`` one per (by, dims) with ``point``.
    """
    keys = [*by, *dims]
    spread = draws.groupBy(*keys).agg(F.stddev_samp(value).alias("se"))
    centred = point.join(spread, keys)
    # A dimension without spread cannot be studentised and stays out of the maximum.
    deviation = F.abs((F.col(value) - F.col("point")) / F.when(F.col("se") > 0, F.col("se")))
    largest = draws.join(centred, keys).groupBy(*by, "draw").agg(F.max(deviation).alias("_m"))
    critical = largest.groupBy(*by).agg(F.percentile("_m", F.lit(confidence)).alias("critical"))
    banded = centred.join(critical, list(by)) if by else attach_row(centred, critical)
    return (banded.withColumn("band_low", F.col("point") - F.col("critical") * F.col("se"))
            .withColumn("band_high", F.col("point") + F.col("critical") * F.col("se")))
