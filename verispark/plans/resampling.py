"""Scores, bootstrap draws and what they say about models and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, strata
from ..functions.calendar import season
from ..operators import contrast, panel, resample, score
from ..operators.contracts import attach_row
from ..session import cut_lineage
from . import domain as d
from .registry import big, query, r, rounded

DRAWS, SEED = 2000, 20260101
PAIRS = [f"{ref}__{m}" for ref in d.REFERENCES for m in d.MODELS]


def daily_errors(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    cases = d.common_panel(spark, sf).select(*extra, "valid_day", *panel.error_columns(d.MODELS, d.REFERENCES))
    return cases.groupBy(*extra, "valid_day").agg(*[F.avg(c).alias(c) for c in PAIRS])


DAILY_SQL = d.PANEL_SQL + """,
daily AS (SELECT valid_day, row_number() OVER (ORDER BY valid_day) - 1 AS day_idx,
    """ + ", ".join(f"avg(abs({m}-{ref})) AS {ref}__{m}" for ref in d.REFERENCES for m in d.MODELS) + """
  FROM common GROUP BY valid_day)"""


def draws_sql(width: int, seed: int = SEED, draws: int = DRAWS) -> str:
    n = "(SELECT count(*) FROM daily)"
    return DAILY_SQL + ",\n" + d.starts_sql(n, draws, width, seed) + """,
draws AS (SELECT draw, """ + ", ".join(f"avg({c}) AS {c}" for c in PAIRS) + """
  FROM idx JOIN daily USING (day_idx) GROUP BY draw)"""


def draws(spark: SparkSession, sf: str, width: int, seed: int = SEED) -> DataFrame:
    return resample.block_bootstrap(daily_errors(spark, sf), [], "valid_day", PAIRS, DRAWS, width, seed)


EFFECT_SQL = """
SELECT p.a AS model_a, p.b AS model_b, round(avg(db), 6) AS base_delta, round(avg(dq), 6) AS other_delta,
       round(avg(dq-db), 6) AS effect, round(quantile_cont(dq-db, 0.025), 6) AS effect_low,
       round(quantile_cont(dq-db, 0.975), 6) AS effect_high, round(avg(CASE WHEN dq-db > 0 THEN 1.0 ELSE 0.0 END), 6) AS p_effect_gt_zero,
       round(avg(CASE WHEN dq*db < 0 THEN 1.0 ELSE 0.0 END), 6) AS p_order_reverses
FROM (SELECT 'alpha' AS a, 'beta' AS b, {g}__alpha-{g}__beta AS db, {p}__alpha-{p}__beta AS dq FROM draws
      UNION ALL SELECT 'alpha', 'gamma', {g}__alpha-{g}__gamma, {p}__alpha-{p}__gamma FROM draws
      UNION ALL SELECT 'beta', 'gamma', {g}__beta-{g}__gamma, {p}__beta-{p}__gamma FROM draws) p
GROUP BY p.a, p.b""".format(g="ref_grid", p="ref_point")
EFFECT_COLUMNS = ("base_delta", "other_delta", "effect", "effect_low", "effect_high", "p_effect_gt_zero", "p_order_reverses")


@query("flagship_reference_effect", "WITH " + draws_sql(7) + EFFECT_SQL)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Does the order of two models change when only the verifying reference changes?"""
    effects = contrast.reference_effect(draws(spark, sf, 7), [], "ref_grid", "ref_point", d.MODELS)
    return rounded(effects, *EFFECT_COLUMNS)


SCORE_ROWS_SQL = "(VALUES " + ", ".join(
    f"('{ref}', '{m}', {i})" for ref in d.REFERENCES for i, m in enumerate(d.MODELS)) + ") t(reference, model, ord)"


def _stack_sql(source: str, columns: str = "") -> str:
    """``reference__model`` columns of ``source`` as rows."""
    lead = f"{columns}, " if columns else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{ref}' AS reference, '{m}' AS model, {i} AS ord, {ref}__{m} AS score FROM {source}"
        for ref in d.REFERENCES for i, m in enumerate(d.MODELS))


@query("score_table", "WITH " + DAILY_SQL + """,
point AS (SELECT count(*) AS n_days, """ + ", ".join(f"avg({c}) AS {c}" for c in PAIRS) + """ FROM daily),
cases AS (SELECT count(*) AS n_cases, """ + ", ".join(
    f"avg(abs({m}-{ref})) AS {ref}__{m}" for ref in d.REFERENCES for m in d.MODELS) + """ FROM common),
a AS (""" + _stack_sql("point", "n_days") + "), b AS (" + _stack_sql("cases", "n_cases") + """)
SELECT reference, model, b.n_cases, a.n_days, round(a.score, 6) AS mae_day_weighted, round(b.score, 6) AS mae_case_weighted,
       rank() OVER (PARTITION BY reference ORDER BY a.score) AS mae_rank
FROM a JOIN b USING (reference, model)""")
def score_table(spark: SparkSession, sf: str) -> DataFrame:
    """Day- and case-weighted scores with ranks: one pass over the cases."""
    cells = [F.struct(F.lit(ref).alias("reference"), F.lit(m).alias("model"), F.col(m).alias("forecast"), F.col(ref).alias("target"))
             for ref in d.REFERENCES for m in d.MODELS]
    long = d.common_panel(spark, sf).select("valid_day", F.inline(F.array(*cells)))
    daily = score.daily_components(long, ["reference", "model"], "valid_day", "forecast", "target")
    table = score.day_weighted(daily, ["reference", "model"])
    return table.select("reference", "model", F.col("n_cases").cast("bigint").alias("n_cases"), "n_days",
                        r("mae").alias("mae_day_weighted"), r("mae_case_weighted").alias("mae_case_weighted"),
                        score.min_rank(["reference"], "mae").alias("mae_rank"))


METRIC_LONG_SQL = d.LONG_SQL + """,
e AS (SELECT 'ref_point' AS reference, model, valid_day, forecast-ref_point AS err FROM long
      UNION ALL SELECT 'ref_grid', model, valid_day, forecast-ref_grid FROM long),
dm AS (SELECT reference, model, valid_day, avg(abs(err)) AS a, avg(err*err) AS s, avg(err) AS b, count(*) AS n
       FROM e GROUP BY ALL)"""


def _metric_long(spark: SparkSession, sf: str) -> DataFrame:
    both = F.array(*[F.struct(F.lit(ref).alias("reference"), F.col(ref).alias("target")) for ref in d.REFERENCES])
    return d.long_panel(spark, sf).select("model", "valid_day", "network", "forecast", F.inline(both))


@query("metric_flavours", "WITH " + METRIC_LONG_SQL + """,
g AS (SELECT reference, model, sum(n) AS n_cases, avg(a) AS mae, avg(s) AS mse, avg(b) AS bias,
             avg(sqrt(s)) AS rdm, sqrt(sum(s*n)/sum(n)) AS rc FROM dm GROUP BY ALL)
SELECT reference, model, CAST(n_cases AS BIGINT) AS n_cases, round(mae, 6) AS mae, round(sqrt(mse), 6) AS rmse_day_weighted,
       round(rdm, 6) AS rmse_daily_mean, round(rc, 6) AS rmse_cases, round(bias, 6) AS bias,
       round(sqrt(greatest(mse-bias*bias, 0)), 6) AS centred_rmse FROM g""")
def metric_flavours(spark: SparkSession, sf: str) -> DataFrame:
    """Three RMSE definitions that must not be confused, with bias and centred RMSE."""
    daily = score.daily_components(_metric_long(spark, sf), ["reference", "model"], "valid_day", "forecast", "target")
    table = score.day_weighted(daily, ["reference", "model"])
    names = ("mae", "rmse_day_weighted", "rmse_daily_mean", "rmse_cases", "bias", "centred_rmse")
    return rounded(big(table.select("reference", "model", "n_cases", *names), "n_cases"), *names)


@query("metric_daily_median", "WITH " + METRIC_LONG_SQL + """,
dd AS (SELECT reference, model, valid_day, quantile_cont(abs(err), 0.5) AS medae FROM e GROUP BY ALL)
SELECT reference, model, count(*) AS n_days, round(avg(medae), 6) AS medae FROM dd GROUP BY ALL""")
def metric_daily_median(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over days of the daily median absolute error."""
    daily = score.daily_median_error(_metric_long(spark, sf), ["reference", "model"], "valid_day", "forecast", "target")
    return daily.groupBy("reference", "model").agg(F.count(F.lit(1)).alias("n_days"), r(F.avg("medae")).alias("medae"))


@query("mse_decomposition", "WITH " + METRIC_LONG_SQL + """
SELECT reference, model, round(avg(s), 6) AS mse, round(avg(b), 6) AS bias, round(avg(b)*avg(b), 6) AS bias_squared,
       round(greatest(avg(s)-avg(b)*avg(b), 0), 6) AS centred_mse FROM dm GROUP BY ALL""")
def mse_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    daily = score.daily_components(_metric_long(spark, sf), ["reference", "model"], "valid_day", "forecast", "target")
    names = ("mse", "bias", "bias_squared", "centred_mse")
    return rounded(score.day_weighted(daily, ["reference", "model"]).select("reference", "model", *names), *names)


def _summary_sql(width: int) -> str:
    return "WITH " + draws_sql(width) + ",\ns AS (" + _stack_sql("draws", "draw") + """),
w AS (SELECT draw, reference, arg_min(model, score) AS winner FROM s GROUP BY ALL)
SELECT reference, model, round(quantile_cont(score, 0.025), 6) AS ci_low, round(quantile_cont(score, 0.975), 6) AS ci_high,
       round(avg(score), 6) AS draw_mean, round(avg(CASE WHEN winner = model THEN 1.0 ELSE 0.0 END), 6) AS winner_probability
FROM s JOIN w USING (draw, reference) GROUP BY reference, model"""


def _summary(spark: SparkSession, sf: str, width: int) -> DataFrame:
    table = contrast.score_summary(draws(spark, sf, width), [], d.REFERENCES, d.MODELS)
    return rounded(table, "ci_low", "ci_high", "draw_mean", "winner_probability")


@query("boot_iid_days", _summary_sql(1))
def boot_iid_days(spark: SparkSession, sf: str) -> DataFrame:
    """Independent days: blocks of one day."""
    return _summary(spark, sf, 1)


@query("boot_block_days", _summary_sql(5))
def boot_block_days(spark: SparkSession, sf: str) -> DataFrame:
    """Circular moving blocks of five days; the last block of a draw is cut."""
    return _summary(spark, sf, 5)


@query("boot_day_weights", "WITH " + DAILY_SQL + ",\n" + d.starts_sql("(SELECT count(*) FROM daily)", 2000, 7, SEED) + """,
k AS (SELECT draw, day_idx, count(*) AS k FROM idx GROUP BY ALL)
SELECT draw, count(*) AS distinct_days, CAST(sum(k) AS BIGINT) AS total_days, max(k) AS largest,
       round(sum(k*ref_point__alpha)/sum(k), 6) AS score
FROM k JOIN daily USING (day_idx) GROUP BY draw""")
def boot_day_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The weight form of a block draw: how often each day counts."""
    daily = resample.day_ordinals(daily_errors(spark, sf), [], "valid_day")
    sizes = daily.groupBy().agg(F.max("n_days").alias("n_days"))
    weights = resample.day_weights(sizes, [], 2000, 7, SEED)
    return weights.join(daily, "day_idx").groupBy("draw").agg(
        F.count(F.lit(1)).alias("distinct_days"), F.sum("k").alias("total_days"), F.max("k").alias("largest"),
        r(F.sum(F.col("k") * F.col("ref_point__alpha")) / F.sum("k")).alias("score")).withColumn("draw", F.col("draw").cast("bigint"))


@query("pairwise_contrasts", "WITH " + draws_sql(7) + """,
p AS (""" + " UNION ALL ".join(
    f"SELECT '{ref}' AS reference, '{a}' AS model_a, '{b}' AS model_b, {ref}__{a}-{ref}__{b} AS delta FROM draws"
    for ref in d.REFERENCES for a, b in (("alpha", "beta"), ("alpha", "gamma"), ("beta", "gamma"))) + """)
SELECT reference, model_a, model_b, round(avg(delta), 6) AS delta_mean, round(quantile_cont(delta, 0.025), 6) AS ci_low,
       round(quantile_cont(delta, 0.975), 6) AS ci_high, round(avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0.0 END), 6) AS p_a_beats_b
FROM p GROUP BY ALL""")
def pairwise_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    table = contrast.pairwise(draws(spark, sf, 7), [], d.REFERENCES, d.MODELS)
    return rounded(table, "delta_mean", "ci_low", "ci_high", "p_a_beats_b")


@query("winners_differ", "WITH " + draws_sql(3) + ",\ns AS (" + _stack_sql("draws", "draw") + """),
w AS (SELECT draw, reference, arg_min(model, score) AS winner FROM s GROUP BY ALL),
m AS (SELECT reference, model, avg(score) AS mean FROM s GROUP BY ALL),
b AS (SELECT reference, arg_min(model, mean) AS best FROM m GROUP BY reference)
SELECT (SELECT best FROM b WHERE reference = 'ref_grid') AS base_winner,
       (SELECT best FROM b WHERE reference = 'ref_point') AS other_winner,
       round(avg(CASE WHEN a.winner <> c.winner THEN 1.0 ELSE 0.0 END), 6) AS p_winners_differ
FROM w a JOIN w c USING (draw) WHERE a.reference = 'ref_grid' AND c.reference = 'ref_point'""")
def winners_differ(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(contrast.winners_differ(draws(spark, sf, 3), [], "ref_grid", "ref_point", d.MODELS), "p_winners_differ")


# Strata: the same operator with one more grouping key.
STRATUM_DAILY_SQL = d.PANEL_SQL + """,
strata AS (SELECT *, CASE WHEN month(valid_time) IN (12,1,2) THEN 'DJF' WHEN month(valid_time) IN (3,4,5) THEN 'MAM'
                          WHEN month(valid_time) IN (6,7,8) THEN 'JJA' ELSE 'SON' END AS season FROM common),
daily AS (SELECT season, valid_day, row_number() OVER (PARTITION BY season ORDER BY valid_day) - 1 AS day_idx,
                 count(*) OVER (PARTITION BY season) AS n_days,
    """ + ", ".join(f"avg(abs({m}-{ref})) AS {ref}__{m}" for ref in d.REFERENCES for m in d.MODELS) + """
  FROM strata GROUP BY season, valid_day)"""


@query("seasonal_scores", "WITH " + STRATUM_DAILY_SQL + """,
p AS (SELECT season, count(*) AS n_days, """ + ", ".join(f"avg({c}) AS {c}" for c in PAIRS) + """ FROM daily GROUP BY season),
s AS (""" + _stack_sql("p", "season, n_days") + """)
SELECT season, reference, model, n_days, round(score, 6) AS mae,
       rank() OVER (PARTITION BY season, reference ORDER BY score) AS mae_rank FROM s""")
def seasonal_scores(spark: SparkSession, sf: str) -> DataFrame:
    cases = d.common_panel(spark, sf).withColumn("season", season(F.col("valid_time")))
    daily = cases.select("season", "valid_day", *panel.error_columns(d.MODELS, d.REFERENCES)).groupBy(
        "season", "valid_day").agg(*[F.avg(c).alias(c) for c in PAIRS])
    means = daily.groupBy("season").agg(F.count(F.lit(1)).alias("n_days"), *[F.avg(c).alias(c) for c in PAIRS])
    long = contrast.draws_long(means.withColumn("draw", F.lit(0)), ["season", "n_days"], d.REFERENCES, d.MODELS)
    return long.select("season", "reference", "model", "n_days", r("score").alias("mae"),
                       score.min_rank(["season", "reference"], "score").alias("mae_rank"))


def _effect_sql(tables: str, draws: int, width: int, seed: int, tail: str = "SELECT * FROM effects") -> str:
    """Reference effect of one pair inside each stratum of ``dd`` (stratum, valid_day, dp, dg), which ``tables`` define."""
    p = 2147483647

    def pow5(x: str) -> str:
        return f"(((({x})*({x}) % {p}) * (({x})*({x}) % {p}) % {p}) * ({x}) % {p})"

    return "WITH " + tables + f""",
daily AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY valid_day) - 1 AS day_idx FROM dd),
sizes AS (SELECT stratum, count(*) AS n FROM daily GROUP BY stratum),
x AS (SELECT stratum, n, d.range AS draw, b.range AS block, (d.range*7919 + b.range*104729 + {seed}) % {p} AS x
      FROM sizes, range(0, {draws}) d, range(0, (SELECT CAST(ceil(max(n)/{width}.0) AS BIGINT) FROM sizes)) b WHERE b.range*{width} < n),
y AS (SELECT *, ({pow5('x')}*48271 + 11) % {p} AS y FROM x),
idx AS (SELECT stratum, draw, ({pow5('y')} % n + o.range) % n AS day_idx FROM y, range(0, {width}) o WHERE block*{width} + o.range < n),
dr AS (SELECT stratum, draw, avg(dp) AS dp, avg(dg) AS dg FROM idx JOIN daily USING (stratum, day_idx) GROUP BY ALL),
effects AS (SELECT stratum, round(avg(dp-dg), 6) AS effect, round(quantile_cont(dp-dg, 0.025), 6) AS effect_low,
       round(quantile_cont(dp-dg, 0.975), 6) AS effect_high, round(avg(CASE WHEN dp*dg < 0 THEN 1.0 ELSE 0.0 END), 6) AS p_order_reverses
FROM dr GROUP BY stratum)
{tail}"""


def _stratum_effect_sql(stratum: str, draws: int, width: int, seed: int, source: str = "common", tables: str = "") -> str:
    return _effect_sql(d.PANEL_SQL + tables + f""",
dd AS (SELECT {stratum} AS stratum, valid_day, avg(abs(beta-ref_point)-abs(gamma-ref_point)) AS dp, avg(abs(beta-ref_grid)-abs(gamma-ref_grid)) AS dg
       FROM {source} GROUP BY ALL)""", draws, width, seed)


def _gaps() -> dict[str, Column]:
    return {ref: F.abs(F.col("beta") - F.col(ref)) - F.abs(F.col("gamma") - F.col(ref)) for ref in d.REFERENCES}


def effect_of_daily(daily: DataFrame, draws_n: int, width: int, seed: int) -> DataFrame:
    """Effect with interval and reversal share of every stratum of daily means dp and dg."""
    drawn = resample.block_bootstrap(daily, ["stratum"], "valid_day", ["dp", "dg"], draws_n, width, seed)
    effect = F.col("dp") - F.col("dg")
    low, high = resample.interval(effect)
    return drawn.groupBy("stratum").agg(
        r(F.avg(effect)).alias("effect"), r(low).alias("effect_low"), r(high).alias("effect_high"),
        r(resample.share(F.col("dp") * F.col("dg") < 0)).alias("p_order_reverses"))


def stratum_effect(cases: DataFrame, stratum: str, draws_n: int, width: int, seed: int) -> DataFrame:
    gap = _gaps()
    daily = (cases.select(F.col(stratum).alias("stratum"), "valid_day", gap["ref_point"].alias("dp"), gap["ref_grid"].alias("dg"))
             .groupBy("stratum", "valid_day").agg(F.avg("dp").alias("dp"), F.avg("dg").alias("dg")))
    return effect_of_daily(daily, draws_n, width, seed)


@query("stratum_effects_by_network", _stratum_effect_sql("network", 2000, 7, SEED + 1))
def stratum_effects_by_network(spark: SparkSession, sf: str) -> DataFrame:
    """Every stratum has its own calendar, so its own number of blocks and cut block."""
    return stratum_effect(d.common_panel(spark, sf), "network", 2000, 7, SEED + 1)


@query("stratum_effects_by_lead", _stratum_effect_sql("lead_h", 2000, 3, SEED + 2))
def stratum_effects_by_lead(spark: SparkSession, sf: str) -> DataFrame:
    return stratum_effect(d.common_panel(spark, sf), "lead_h", 2000, 3, SEED + 2)


ALTITUDE_SQL = """CASE WHEN altitude_m IS NULL THEN 'unknown' WHEN altitude_m < 500 THEN 'lowland' WHEN altitude_m < 3000 THEN 'upland' ELSE 'mountain' END"""


@query("stratum_effects_by_altitude", _stratum_effect_sql(ALTITUDE_SQL, 2000, 7, SEED + 6, "placed", ", " + d.STATIONS_SQL + """,
placed AS (SELECT c.*, s.altitude_m FROM common c JOIN stations s USING (station_id))"""))
def stratum_effects_by_altitude(spark: SparkSession, sf: str) -> DataFrame:
    where = d.stations(spark, sf).select("station_id", strata.altitude_stratum(F.col("altitude_m"), (500.0, 3000.0)).alias("band"))
    return stratum_effect(d.common_panel(spark, sf).join(where, "station_id"), "band", 2000, 7, SEED + 6)


@query("stratum_effects_by_belt", _stratum_effect_sql(
    "CASE WHEN latitude < -23.5 THEN 'south_extratropics' WHEN latitude > 23.5 THEN 'north_extratropics' ELSE 'tropics' END",
    2000, 7, SEED + 7, "placed", ", " + d.STATIONS_SQL + """,
placed AS (SELECT c.*, s.latitude FROM common c JOIN stations s USING (station_id))"""))
def stratum_effects_by_belt(spark: SparkSession, sf: str) -> DataFrame:
    where = d.stations(spark, sf).select("station_id", strata.latitude_belt(F.col("latitude")).alias("belt"))
    return stratum_effect(d.common_panel(spark, sf).join(where, "station_id"), "belt", 2000, 7, SEED + 7)


@query("leave_one_region_out", _effect_sql(d.PANEL_SQL + ", " + d.STATIONS_SQL + """,
u AS (SELECT region, valid_day, count(*) AS n, sum(abs(beta-ref_point)-abs(gamma-ref_point)) AS sp, sum(abs(beta-ref_grid)-abs(gamma-ref_grid)) AS sg
      FROM common JOIN stations USING (station_id) GROUP BY ALL),
f AS (SELECT 'all' AS stratum, * FROM u UNION ALL SELECT 'only_' || region, * FROM u
      UNION ALL SELECT 'without_' || k.region, u.* FROM u, (SELECT DISTINCT region FROM u) k WHERE u.region <> k.region),
dd AS (SELECT stratum, valid_day, sum(sp)/sum(n) AS dp, sum(sg)/sum(n) AS dg FROM f GROUP BY ALL)""", 2000, 7, SEED + 8, """
SELECT e.stratum AS fold, e.effect, e.effect_low, e.effect_high, e.p_order_reverses, round(e.effect - a.effect, 6) AS shift, sign(e.effect) = sign(a.effect) AS same_sign
FROM effects e, effects a WHERE a.stratum = 'all'"""))
def leave_one_region_out(spark: SparkSession, sf: str) -> DataFrame:
    """Effect without each region and within each alone, bootstrapped per fold, and its shift against all stations.

    A fold's daily sums are those of all regions minus the region's, so no case is copied.
    """
    gap, regions = _gaps(), d.stations(spark, sf).select("station_id", "region")
    own = (d.common_panel(spark, sf).join(regions, "station_id").groupBy("region", "valid_day")
           .agg(F.count(F.lit(1)).alias("n"), F.sum(gap["ref_point"]).alias("sp"), F.sum(gap["ref_grid"]).alias("sg")))
    own = cut_lineage(own)
    total = own.groupBy("valid_day").agg(*[F.sum(c).alias(c) for c in ("n", "sp", "sg")])
    present = own.agg(F.collect_set("region").alias("regions"))
    label = F.col("region").cast("string")
    whole = total.select(F.lit("all").alias("stratum"), "valid_day", "n", "sp", "sg")
    only = own.select(F.concat(F.lit("only_"), label).alias("stratum"), "valid_day", "n", "sp", "sg")
    # A fold has a row for every day, also for days on which its region has no case.
    days = attach_row(total, present).select("valid_day", "n", "sp", "sg", F.explode("regions").alias("region"))
    mine = own.select("region", "valid_day", *[F.col(c).alias(f"_{c}") for c in ("n", "sp", "sg")])
    rest = days.join(mine, ["region", "valid_day"], "left").select(
        F.concat(F.lit("without_"), label).alias("stratum"), "valid_day", *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("n", "sp", "sg")])
    folds = whole.unionByName(only).unionByName(rest).where("n > 0").select(
        "stratum", "valid_day", (F.col("sp") / F.col("n")).alias("dp"), (F.col("sg") / F.col("n")).alias("dg"))
    effects = cut_lineage(effect_of_daily(folds, 2000, 7, SEED + 8))
    every = effects.where("stratum = 'all'").select(F.col("effect").alias("_all"))
    return attach_row(effects, every).select(
        F.col("stratum").alias("fold"), "effect", "effect_low", "effect_high", "p_order_reverses", r(F.col("effect") - F.col("_all")).alias("shift"),
        (F.signum("effect") == F.signum("_all")).alias("same_sign"))


# Nested bootstrap: spatial blocks are latitude bands of the stations, weighted by their stations.
NESTED_SQL = "WITH " + d.STATIONS_SQL + ", " + d.PANEL_SQL + """,
placed AS (SELECT c.*, CAST(floor(s.latitude/90) AS BIGINT) || '_' || CAST(floor(s.longitude/180) AS BIGINT) AS block
           FROM common c JOIN stations s USING (station_id)),
weights AS (SELECT block, CAST(count(DISTINCT station_id) AS DOUBLE) AS w FROM placed GROUP BY block),
ranked AS (SELECT block, w, row_number() OVER (ORDER BY block) - 1 AS unit_idx FROM weights),
days AS (SELECT valid_day AS day, block, avg(abs(beta-ref_point)) AS pb, avg(abs(gamma-ref_point)) AS pg,
           avg(abs(beta-ref_grid)) AS gb, avg(abs(gamma-ref_grid)) AS gg FROM placed GROUP BY ALL),
full_days AS (SELECT day FROM days GROUP BY day HAVING count(DISTINCT block) = (SELECT count(*) FROM weights)),
numbered AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS day_idx FROM full_days),
""" + d.starts_sql("(SELECT count(*) FROM numbered)", 2000, 3, SEED + 3, "t") + ",\n" + d.starts_sql(
    "(SELECT count(*) FROM ranked)", 2000, 1, SEED + 4, "u") + """,
dr AS (SELECT t.draw, sum(r.w*m.pb)/sum(r.w) AS pb, sum(r.w*m.pg)/sum(r.w) AS pg, sum(r.w*m.gb)/sum(r.w) AS gb, sum(r.w*m.gg)/sum(r.w) AS gg
       FROM t JOIN numbered n ON t.day_idx = n.day_idx JOIN u ON t.draw = u.draw JOIN ranked r ON u.day_idx = r.unit_idx
       JOIN days m ON m.day = n.day AND m.block = r.block GROUP BY t.draw)
SELECT (SELECT count(*) FROM ranked) AS n_blocks, (SELECT count(*) FROM numbered) AS n_complete,
       round(avg((pb-pg)-(gb-gg)), 6) AS effect, round(quantile_cont((pb-pg)-(gb-gg), 0.025), 6) AS effect_low,
       round(quantile_cont((pb-pg)-(gb-gg), 0.975), 6) AS effect_high,
       round(avg(CASE WHEN (pb-pg)*(gb-gg) < 0 THEN 1.0 ELSE 0.0 END), 6) AS p_order_reverses FROM dr"""


@query("boot_nested_space_time", NESTED_SQL)
def boot_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Time blocks and spatial clusters drawn jointly; only complete periods, clusters weighted by stations."""
    where = d.stations(spark, sf).select("station_id", geo_block().alias("block"))
    placed = d.common_panel(spark, sf).join(where, "station_id").withColumn("day", F.col("valid_day"))
    weights = placed.groupBy("block").agg(F.count_distinct("station_id").cast("double").alias("w"))
    errors = {f"{ref[4]}{m[0]}": F.avg(F.abs(F.col(m) - F.col(ref))) for ref in d.REFERENCES for m in ("beta", "gamma")}
    daily = placed.groupBy("day", "block").agg(*[e.alias(n) for n, e in errors.items()]).join(weights, "block")
    names = list(errors)
    drawn = resample.nested_bootstrap(daily, "day", "block", "w", names, 2000, 3, SEED + 3, SEED + 4)
    point, grid = F.col("pb") - F.col("pg"), F.col("gb") - F.col("gg")
    low, high = resample.interval(point - grid)
    blocks = daily.agg(F.count_distinct("block").alias("n_blocks"))
    complete = (attach_row(daily.groupBy("day").agg(F.count_distinct("block").alias("n")), blocks).where("n = n_blocks")
                .agg(F.max("n_blocks").alias("n_blocks"), F.count(F.lit(1)).alias("n_complete")))
    summary = drawn.agg(r(F.avg(point - grid)).alias("effect"), r(low).alias("effect_low"), r(high).alias("effect_high"),
                        r(resample.share(point * grid < 0)).alias("p_order_reverses"))
    return attach_row(complete, summary)


def geo_block():
    return F.concat_ws("_", F.floor(F.col("latitude") / 90).cast("string"), F.floor(F.col("longitude") / 180).cast("string"))


@query("sup_t_band", "WITH " + draws_sql(7) + """,
c AS (""" + " UNION ALL ".join(
    f"SELECT draw, '{ref}' AS reference, '{a}' AS model_a, '{b}' AS model_b, {ref}__{a}-{ref}__{b} AS delta FROM draws"
    for ref in d.REFERENCES for a, b in (("alpha", "beta"), ("alpha", "gamma"), ("beta", "gamma"))) + """),
point AS (""" + " UNION ALL ".join(
    f"SELECT '{ref}' AS reference, '{a}' AS model_a, '{b}' AS model_b, avg({ref}__{a})-avg({ref}__{b}) AS point FROM daily"
    for ref in d.REFERENCES for a, b in (("alpha", "beta"), ("alpha", "gamma"), ("beta", "gamma"))) + """),
se AS (SELECT reference, model_a, model_b, stddev_samp(delta) AS se FROM c GROUP BY ALL),
mx AS (SELECT draw, max(abs((delta-point)/se)) AS m FROM c JOIN point USING (reference, model_a, model_b)
       JOIN se USING (reference, model_a, model_b) GROUP BY draw),
q AS (SELECT quantile_cont(m, 0.95) AS critical FROM mx)
SELECT reference, model_a, model_b, round(point, 6) AS point, round(se, 6) AS se, round(critical, 6) AS critical,
       round(point-critical*se, 6) AS band_low, round(point+critical*se, 6) AS band_high
FROM point JOIN se USING (reference, model_a, model_b), q""")
def sup_t(spark: SparkSession, sf: str) -> DataFrame:
    """Simultaneous band over all model contrasts under both references."""
    drawn = draws(spark, sf, 7)
    keys = ("reference", "model_a", "model_b")
    pairs = (("alpha", "beta"), ("alpha", "gamma"), ("beta", "gamma"))

    def stacked(df: DataFrame, value: str, *lead: str) -> DataFrame:
        return df.select(*lead, F.inline(F.array(*[
            F.struct(F.lit(ref).alias("reference"), F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                     (F.col(f"{ref}__{a}") - F.col(f"{ref}__{b}")).alias(value)) for ref in d.REFERENCES for a, b in pairs])))

    point = daily_errors(spark, sf).agg(*[F.avg(c).alias(c) for c in PAIRS])
    band = resample.sup_t_band(stacked(drawn, "delta", "draw"), stacked(point, "point"), [], keys, "delta")
    names = ("point", "se", "critical", "band_low", "band_high")
    return rounded(band.select(*keys, *names), *names)


# Leave one station out, by sums instead of copies.
LOO_SQL = "WITH " + d.PANEL_SQL + """,
held AS (SELECT DISTINCT {unit} AS held_out FROM common),
dl AS (SELECT held_out, valid_day, """ + ", ".join(
    f"avg(abs({m}-{ref})) AS {ref}__{m}" for ref in d.REFERENCES for m in d.MODELS) + """
  FROM held JOIN common ON common.{unit} <> held.held_out GROUP BY held_out, valid_day)
SELECT held_out, """ + ", ".join(f"round(avg({c}), 6) AS {c}" for c in PAIRS) + " FROM dl GROUP BY held_out"


def _leave_out(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    cases = d.common_panel(spark, sf).select(unit, "valid_day", *panel.error_columns(d.MODELS, d.REFERENCES))
    return rounded(contrast.leave_one_out_days(cases, unit, "valid_day", PAIRS), *PAIRS)


@query("leave_one_station_out", LOO_SQL.format(unit="station_id"))
def leave_one_station_out(spark: SparkSession, sf: str) -> DataFrame:
    return _leave_out(spark, sf, "station_id")


@query("leave_one_network_out", LOO_SQL.format(unit="network"))
def leave_one_network_out(spark: SparkSession, sf: str) -> DataFrame:
    return _leave_out(spark, sf, "network")


LOO_WINNERS_SQL = LOO_SQL.format(unit="station_id").rsplit("SELECT held_out", 1)[0] + """
, m AS (SELECT held_out, """ + ", ".join(f"avg({c}) AS {c}" for c in PAIRS) + """ FROM dl GROUP BY held_out),
s AS (""" + _stack_sql("m", "held_out") + """),
rk AS (SELECT held_out, reference, model, rank() OVER (PARTITION BY held_out, reference ORDER BY score) AS rk FROM s)
SELECT reference, CAST(count(*) FILTER (WHERE rk = 1 AND model = 'alpha') AS BIGINT) AS alpha_wins,
       CAST(count(*) FILTER (WHERE rk = 1 AND model = 'beta') AS BIGINT) AS beta_wins,
       CAST(count(*) FILTER (WHERE rk = 1 AND model = 'gamma') AS BIGINT) AS gamma_wins,
       CAST(max(rk) FILTER (WHERE model = 'alpha') AS BIGINT) AS worst_alpha_rank FROM rk GROUP BY reference"""


@query("leave_one_out_winner_counts", LOO_WINNERS_SQL)
def leave_one_out_winner_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-table of winners over all held-out stations; missing combinations count zero."""
    cases = d.common_panel(spark, sf).select("station_id", "valid_day", *panel.error_columns(d.MODELS, d.REFERENCES))
    held = contrast.leave_one_out_days(cases, "station_id", "valid_day", PAIRS).withColumnRenamed("held_out", "draw")
    long = contrast.draws_long(held, [], d.REFERENCES, d.MODELS).withColumn("rk", F.rank().over(
        Window.partitionBy("draw", "reference").orderBy("score")))
    wins = (long.where("rk = 1").groupBy("reference").pivot("model", list(d.MODELS)).count().na.fill(0)
            .select("reference", *[F.col(m).alias(f"{m}_wins") for m in d.MODELS]))
    worst = long.where("model = 'alpha'").groupBy("reference").agg(F.max("rk").cast("bigint").alias("worst_alpha_rank"))
    return wins.join(worst, "reference")
