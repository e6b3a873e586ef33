"""Rankings and contrasts of models, and what a change of reference does to them."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import attach_row
from .resample import interval, share


def draws_long(draws: DataFrame, by: Sequence[str], references: Sequence[str], models: Sequence[str]) -> DataFrame:
    """``reference__model`` columns as rows (by, draw, reference, model, ord, score)."""
    cells = [F.struct(F.lit(r).alias("reference"), F.lit(m).alias("model"), F.lit(i).alias("ord"),
                      F.col(f"`{r}__{m}`").alias("score"))
             for r in references for i, m in enumerate(models)]
    return draws.select(*by, "draw", F.inline(F.array(*cells)))


def best_of(models: Sequence[str], reference: str) -> Column:
    """Winner among ``reference__model`` columns of one row; ties go to the first listed model."""
    entries = [F.struct(F.col(f"`{reference}__{m}`").alias("s"), F.lit(i).alias("i"), F.lit(m).alias("m"))
               for i, m in enumerate(models)]
    return F.array_min(F.filter(F.array(*entries), lambda e: e["s"].isNotNull()))["m"]


def score_summary(draws: DataFrame, by: Sequence[str], references: Sequence[str], models: Sequence[str],
                  confidence: float = 0.95) -> DataFrame:
    """Interval and winner frequency of every (reference, model) over the draws."""
    low, high = interval("score", confidence)
    winners = F.struct(*[best_of(models, r).alias(r) for r in references])
    rows = [F.struct(F.lit(r).alias("reference"), F.lit(m).alias("model"),
                     F.col(f"`{r}__{m}`").alias("score"), F.col(f"_w.`{r}`").alias("winner"))
            for r in references for m in models]
    return (draws.withColumn("_w", winners).select(*by, "draw", F.inline(F.array(*rows)))
            .groupBy(*by, "reference", "model")
            .agg(low.alias("ci_low"), high.alias("ci_high"), F.avg("score").alias("draw_mean"),
                 share(F.col("winner") == F.col("model")).alias("winner_probability")))


def pairwise(draws: DataFrame, by: Sequence[str], references: Sequence[str], models: Sequence[str],
             confidence: float = 0.95) -> DataFrame:
    """Interval of every model difference and how often the first one wins."""
    rows = [F.struct(F.lit(r).alias("reference"), F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                     (F.col(f"`{r}__{a}`") - F.col(f"`{r}__{b}`")).alias("delta"))
            for r in references for a, b in itertools.combinations(models, 2)]
    low, high = interval("delta", confidence)
    return (draws.select(*by, "draw", F.inline(F.array(*rows)))
            .groupBy(*by, "reference", "model_a", "model_b")
            .agg(F.avg("delta").alias("delta_mean"), low.alias("ci_low"), high.alias("ci_high"),
                 share(F.col("delta") < 0).alias("p_a_beats_b")))


def reference_effect(draws: DataFrame, by: Sequence[str], base: str, other: str, models: Sequence[str],
                     confidence: float = 0.95) -> DataFrame:
    """How each model difference moves when the verifying reference changes from ``base`` to ``other``.

    The effect is the mean over draws; the two differences are reported beside
    it, with the frequency of a positive effect and of a reversed order.
    """
    rows = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                     (F.col(f"`{base}__{a}`") - F.col(f"`{base}__{b}`")).alias("d_base"),
                     (F.col(f"`{other}__{a}`") - F.col(f"`{other}__{b}`")).alias("d_other"))
            for a, b in itertools.combinations(models, 2)]
    effect = F.col("d_other") - F.col("d_base")
    low, high = interval(effect, confidence)
    return (draws.select(*by, "draw", F.inline(F.array(*rows)))
            .groupBy(*by, "model_a", "model_b")
            .agg(F.avg("d_base").alias("base_delta"), F.avg("d_other").alias("other_delta"),
                 F.avg(effect).alias("effect"), low.alias("effect_low"), high.alias("effect_high"),
                 share(effect > 0).alias("p_effect_gt_zero"),
                 share(F.col("d_base") * F.col("d_other") < 0).alias("p_order_reverses")))


def winners_differ(draws: DataFrame, by: Sequence[str], base: str, other: str, models: Sequence[str]) -> DataFrame:
    """Winner of the mean draw under each reference and how often the draw winners differ."""
    differ = share(best_of(models, base) != best_of(models, other)).alias("p_winners_differ")
    means = [F.avg(f"`{r}__{m}`").alias(f"{r}__{m}") for r in (base, other) for m in models]
    summary = draws.groupBy(*by).agg(differ, *means)
    return summary.select(*by, best_of(models, base).alias("base_winner"),
                          best_of(models, other).alias("other_winner"), "p_winners_differ")


def pair_gaps(scores: DataFrame, by: Sequence[str], models: Sequence[str], name: str = "model",
              value: str = "score") -> DataFrame:
    """Every model pair of a (by, model, score) table, ordered by the declared list."""
    wide = scores.groupBy(*by).pivot(name, list(models)).agg(F.first(value))
    rows = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                     (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("gap"))
            for a, b in itertools.combinations(models, 2)]
    return wide.select(*by, F.inline(F.array(*rows)))


def pair_reversals(name: str, first: str, second: str) -> tuple[Column, Column]:
    """Aggregates: pairs that two scores order differently, and all pairs; the group is a handful of models."""
    models = F.collect_list(F.struct(F.col(name).alias("n"), F.col(first).alias("a"), F.col(second).alias("b")))

    def flips(x: Column) -> Column:
        return F.size(F.filter(models, lambda y: (y["n"] > x["n"]) & (
            F.signum(x["a"] - y["a"]) != F.signum(x["b"] - y["b"]))))

    count = F.size(models)
    return (F.aggregate(models, F.lit(0), lambda total, x: total + flips(x)).cast("bigint"),
            (count * (count - 1) / 2).cast("bigint"))


def scorecard(curves: DataFrame, by: Sequence[str], support: str, models: Sequence[str], name: str = "model",
              score: str = "score") -> DataFrame:
    """Ranking at each support against the ranking at support zero.

    Inversions count pairs whose order flips; the rank correlation compares the
    scores with those at support zero.
    """
    wide = curves.groupBy(*by, support).pivot(name, list(models)).agg(F.first(score))
    base = wide.where(F.col(support) == 0).select(*by, *[F.col(f"`{m}`").alias(f"{m}__0") for m in models])
    both = wide.join(base, list(by))

    def ordered(suffix: str) -> Column:
        return F.array_sort(F.array(*[F.struct(F.col(f"`{m}{suffix}`").alias("s"), F.lit(m).alias("m"))
                                      for m in models]))

    def rank(m: str, suffix: str) -> Column:
        mine = F.col(f"`{m}{suffix}`")
        others = [F.col(f"`{o}{suffix}`") for o in models if o != m]
        return 1 + sum(((o < mine).cast("double") + (o == mine).cast("double") / 2 for o in others), F.lit(0.0))

    pairs = list(itertools.combinations(models, 2))
    flips = sum((((F.col(f"`{a}`") - F.col(f"`{b}`")) * (F.col(f"`{a}__0`") - F.col(f"`{b}__0`")) < 0).cast("bigint")
                 for a, b in pairs), F.lit(0).cast("bigint"))
    middle = (len(models) + 1) / 2
    dot = sum(((rank(m, "") - middle) * (rank(m, "__0") - middle) for m in models), F.lit(0.0))
    norm = F.sqrt(sum(((rank(m, "") - middle) ** 2 for m in models), F.lit(0.0))
                  * sum(((rank(m, "__0") - middle) ** 2 for m in models), F.lit(0.0)))
    here, there = ordered(""), ordered("__0")
    return both.select(
        *by, support,
        F.array_join(F.transform(here, lambda e: e["m"]), "|").alias("ranking"),
        here[0]["m"].alias("winner"), here[0]["s"].alias("winner_score"), here[1]["s"].alias("runner_up_score"),
        (here[1]["s"] - here[0]["s"]).alias("winner_margin"),
        F.when(norm > 0, dot / norm).alias("spearman_vs_point"),
        flips.alias("inversions_vs_point"), F.lit(len(pairs)).cast("bigint").alias("possible_pairs"),
        (here[0]["m"] != there[0]["m"]).alias("winner_changed"))


def optimum(curves: DataFrame, by: Sequence[str], sigma: str, score: str, digits: int = 12) -> DataFrame:
    """The sigma of the lowest score; scores equal to ``digits`` places fall to the smaller sigma."""
    best = F.min_by(F.col(sigma), F.struct(F.round(score, digits), F.col(sigma)))
    return curves.groupBy(*by).agg(best.alias("optimal_sigma"), F.min(score).alias("optimal_score"))


def sign_inventory(specs: DataFrame, design: str, effect: str, low: str, high: str) -> DataFrame:
    """Per design: specifications, negative effects, intervals without zero; plus a TOTAL row."""
    usable = specs.where(F.col(effect).isNotNull())
    clear = (F.col(low) > 0) | (F.col(high) < 0)
    return (usable.rollup(design)
            .agg(F.count(F.lit(1)).alias("n_specifications"),
                 F.count_if(F.col(effect) < 0).alias("n_effect_negative"),
                 F.count_if(clear).alias("n_ci_excludes_zero"))
            .withColumn(design, F.coalesce(F.col(design), F.lit("TOTAL"))))


def sign_test(n_positive: Column, n: Column) -> Column:
    """One-sided sign test: P(at least ``n_positive`` of ``n``) under fair coins."""
    def choose(total: Column, k: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0),
                           lambda acc, i: F.when(i <= k, acc * (total - k + i) / i).otherwise(acc))
    tail = F.aggregate(F.sequence(n_positive, n), F.lit(0.0), lambda acc, k: acc + choose(n, k))
    return tail / F.pow(F.lit(2.0), n)


def leave_one_out_days(cases: DataFrame, unit: str, day: str, measures: Sequence[str]) -> DataFrame:
    """Day-weighted mean of each measure with one unit held out, for every unit, in one pass.

    Uses sums: a day's mean without the unit is (day sum - unit sum) / (day count
    - unit count).  Days the unit did not touch keep their mean, so only the
    unit's own days are visited; the data are never copied per held-out unit.
    """
    sums = [a for m in measures for a in (F.sum(f"`{m}`").alias(f"{m}__s"), F.count(f"`{m}`").alias(f"{m}__n"))]
    unit_day = cases.groupBy(unit, day).agg(*sums)
    per_day = unit_day.groupBy(day).agg(*[F.sum(f"`{m}__{k}`").alias(f"{m}__d{k}") for m in measures for k in "sn"])
    day_means = per_day.select(*[F.try_divide(f"{m}__ds", f"{m}__dn").alias(m) for m in measures])
    whole = day_means.agg(*[
        a for m in measures for a in (F.sum(f"`{m}`").alias(f"{m}__ts"), F.count(f"`{m}`").alias(f"{m}__tn"))])
    changes = []
    for m in measures:
        before = F.try_divide(F.col(f"`{m}__ds`"), F.col(f"`{m}__dn`"))
        after = F.try_divide(F.col(f"`{m}__ds`") - F.col(f"`{m}__s`"), F.col(f"`{m}__dn`") - F.col(f"`{m}__n`"))
        changes += [F.sum(F.coalesce(after, F.lit(0.0)) - F.coalesce(before, F.lit(0.0))).alias(f"{m}__cs"),
                    F.sum(after.isNotNull().cast("int") - before.isNotNull().cast("int")).alias(f"{m}__cn")]
    moved = unit_day.join(per_day, day).groupBy(unit).agg(*changes)
    return attach_row(moved, whole).select(F.col(unit).alias("held_out"), *[
        F.try_divide(F.col(f"`{m}__ts`") + F.col(f"`{m}__cs`"), F.col(f"`{m}__tn`") + F.col(f"`{m}__cn`")).alias(m)
        for m in measures])
