"""Where and when the reference matters: effects against covariates, regimes, hours and extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, strata
from ..operators import contrast, order_stats, panel, regression, resample, score
from ..operators.contracts import attach_row
from ..session import cut_lineage
from . import domain as d
from .registry import big, day_text, query, r, rounded
from .resampling import DAILY_SQL, PAIRS, SEED, daily_errors

STATION_DAY_SQL = d.PANEL_SQL + """,
sd AS (SELECT station_id, valid_day,
         avg((abs(beta-ref_point)-abs(gamma-ref_point)) - (abs(beta-ref_grid)-abs(gamma-ref_grid))) AS effect,
         avg(ref_point) AS obs, avg(ref_point*ref_point) AS obs2, avg(ref_grid-ref_point) AS diff, avg(pow(ref_grid-ref_point, 2)) AS diff2
       FROM common GROUP BY ALL),
st AS (SELECT station_id, avg(effect) AS effect, avg(obs) AS mean_obs, sqrt(greatest(avg(obs2)-pow(avg(obs), 2), 0)) AS sd_obs,
              avg(diff) AS bias, sqrt(avg(diff2)) AS rmse, count(*) AS n_days FROM sd GROUP BY station_id)"""


def effect_column(base: str = "ref_grid", other: str = "ref_point") -> Column:
    def gap(ref: str) -> Column:
        return F.abs(F.col("beta") - F.col(ref)) - F.abs(F.col("gamma") - F.col(ref))
    return gap(other) - gap(base)


def station_days(spark: SparkSession, sf: str) -> DataFrame:
    diff = F.col("ref_grid") - F.col("ref_point")
    return d.common_panel(spark, sf).groupBy("station_id", "valid_day").agg(
        F.avg(effect_column()).alias("effect"), F.avg("ref_point").alias("obs"), F.avg(F.col("ref_point") * F.col("ref_point")).alias("obs2"),
        F.avg(diff).alias("diff"), F.avg(diff * diff).alias("diff2"))


def covariates(obs: Column, obs2: Column, diff: Column, diff2: Column) -> dict[str, Column]:
    return {"mean_obs": obs, "sd_obs": F.sqrt(F.greatest(obs2 - obs * obs, F.lit(0.0))), "bias": diff, "rmse": F.sqrt(diff2)}


def station_table(spark: SparkSession, sf: str) -> DataFrame:
    means = station_days(spark, sf).groupBy("station_id").agg(
        *[F.avg(c).alias(c) for c in ("effect", "obs", "obs2", "diff", "diff2")], F.count(F.lit(1)).alias("n_days"))
    derived = covariates(*[F.col(c) for c in ("obs", "obs2", "diff", "diff2")])
    return means.select("station_id", "effect", "n_days", *[c.alias(n) for n, c in derived.items()])


@query("drivers_station_table", "WITH " + STATION_DAY_SQL + """
SELECT station_id, n_days, round(effect, 6) AS effect, round(mean_obs, 6) AS mean_obs, round(sd_obs, 6) AS sd_obs, round(bias, 6) AS bias, round(rmse, 6) AS rmse FROM st""")
def drivers_station_table(spark: SparkSession, sf: str) -> DataFrame:
    """Reference effect of every station beside its covariates."""
    return rounded(station_table(spark, sf), "effect", "mean_obs", "sd_obs", "bias", "rmse")


def _rank_sql(source: str, x: str, y: str, part: str = "") -> str:
    by = f"PARTITION BY {part} " if part else ""
    also = f"{part}, " if part else ""
    return (f"(SELECT *, rank() OVER ({by}ORDER BY {x}) + (count(*) OVER (PARTITION BY {also}{x})-1)/2.0 AS rx, "
            f"rank() OVER ({by}ORDER BY {y}) + (count(*) OVER (PARTITION BY {also}{y})-1)/2.0 AS ry FROM {source})")


@query("drivers_spearman", "WITH " + STATION_DAY_SQL + """,
c AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS covariate, effect, {c} AS v FROM st" for c in ("mean_obs", "sd_obs", "bias", "rmse")) + """)
SELECT covariate, round(corr(rx, ry), 6) AS spearman, count(*) AS n_stations FROM """ + _rank_sql("c", "effect", "v", "covariate") + " GROUP BY covariate")
def drivers_spearman(spark: SparkSession, sf: str) -> DataFrame:
    long = panel.to_long(station_table(spark, sf).drop("n_days"), ["mean_obs", "sd_obs", "bias", "rmse"], "covariate", "v")
    out = order_stats.spearman(long, ["covariate"], "effect", "v")
    return rounded(out.withColumnRenamed("n_pairs", "n_stations"), "spearman")


def _unit_draw_sql(n: str, draws: int, seed: int, name: str = "u") -> str:
    return d.starts_sql(n, draws, 1, seed, name)


def _weighted_rank_sql(source: str, x: str, y: str) -> str:
    """Ranks over copies: the oracle really repeats the drawn units."""
    return (f"(SELECT draw, rank() OVER (PARTITION BY draw ORDER BY {x}) + (count(*) OVER (PARTITION BY draw, {x})-1)/2.0 AS rx, "
            f"rank() OVER (PARTITION BY draw ORDER BY {y}) + (count(*) OVER (PARTITION BY draw, {y})-1)/2.0 AS ry FROM {source})")


@query("boot_station_spearman", "WITH " + STATION_DAY_SQL + """,
un AS (SELECT *, row_number() OVER (ORDER BY station_id) - 1 AS unit_idx FROM st),
""" + _unit_draw_sql("(SELECT count(*) FROM st)", 2000, SEED + 11) + """,
dr AS (SELECT u.draw, un.effect, un.bias FROM u JOIN un ON un.unit_idx = u.day_idx),
rho AS (SELECT draw, corr(rx, ry) AS rho FROM """ + _weighted_rank_sql("dr", "effect", "bias") + """ GROUP BY draw)
SELECT count(*) AS n_draws, round(avg(rho), 6) AS mean, round(quantile_cont(rho, 0.025), 6) AS ci_low, round(quantile_cont(rho, 0.975), 6) AS ci_high FROM rho""")
def boot_station_spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Stations drawn with replacement; a station drawn k times weighs k, ranks included."""
    units = station_table(spark, sf).select("station_id", "effect", "bias")
    rho = resample.weighted_spearman_draws(units, [], "station_id", "effect", "bias", 2000, SEED + 11)
    low, high = resample.interval("rho")
    return rho.agg(F.count("rho").alias("n_draws"), r(F.avg("rho")).alias("mean"), r(low).alias("ci_low"), r(high).alias("ci_high"))


PANEL_DAYS_SQL = STATION_DAY_SQL.replace("FROM common GROUP BY ALL", ", avg(ref_point) FILTER (WHERE lead_h = 48) AS obs_b, avg(ref_point) FILTER (WHERE lead_h = 24) AS obs_a FROM common GROUP BY ALL", 1)


@query("boot_day_spearman", "WITH " + PANEL_DAYS_SQL + """,
cal AS (SELECT valid_day, row_number() OVER (ORDER BY valid_day) - 1 AS day_idx FROM (SELECT DISTINCT valid_day FROM sd)),
""" + d.starts_sql("(SELECT count(*) FROM cal)", 2000, 7, SEED + 12) + """,
kd AS (SELECT draw, valid_day, count(*) AS k FROM idx JOIN cal USING (day_idx) GROUP BY ALL),
dr AS (SELECT draw, station_id, sum(k*effect)/sum(k) AS effect, sum(k*obs)/sum(k) AS mean_obs, sqrt(greatest(sum(k*obs2)/sum(k)-pow(sum(k*obs)/sum(k), 2), 0)) AS sd_obs,
         sum(k*diff)/sum(k) AS bias, sqrt(sum(k*diff2)/sum(k)) AS rmse,
         sum(k*obs_b)/sum(k) FILTER (WHERE obs_b IS NOT NULL) - sum(k*obs_a)/sum(k) FILTER (WHERE obs_a IS NOT NULL) AS lead_contrast
       FROM kd JOIN sd USING (valid_day) GROUP BY ALL),
cv AS (SELECT draw, m.covariate, effect, m.v FROM dr, LATERAL (VALUES ('mean_obs', mean_obs), ('sd_obs', sd_obs), ('bias', bias), ('rmse', rmse), ('lead_contrast', lead_contrast)) m(covariate, v)
       WHERE m.v IS NOT NULL),
rk AS (SELECT draw, covariate, rank() OVER (PARTITION BY draw, covariate ORDER BY effect) AS rx, rank() OVER (PARTITION BY draw, covariate ORDER BY v) AS ry FROM cv),
rho AS (SELECT draw, covariate, corr(rx, ry) AS rho FROM rk GROUP BY ALL)
SELECT covariate, count(rho) AS n_draws, round(avg(rho), 4) AS mean, round(quantile_cont(rho, 0.025), 4) AS ci_low, round(quantile_cont(rho, 0.975), 4) AS ci_high,
       round(avg(CASE WHEN rho > 0 THEN 1.0 ELSE 0.0 END), 4) AS p_gt_zero FROM rho GROUP BY covariate""")
def boot_day_spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Effects and every covariate of every station, the contrast of two leads among them, recomputed under each draw of day blocks."""
    diff, obs = F.col("ref_grid") - F.col("ref_point"), F.col("ref_point")
    days = d.common_panel(spark, sf).groupBy("station_id", "valid_day").agg(
        F.avg(effect_column()).alias("effect"), F.avg(obs).alias("obs"), F.avg(obs * obs).alias("obs2"), F.avg(diff).alias("diff"), F.avg(diff * diff).alias("diff2"),
        F.avg(F.when(F.col("lead_h") == 48, obs)).alias("obs_b"), F.avg(F.when(F.col("lead_h") == 24, obs)).alias("obs_a"))
    measures = ["effect", "obs", "obs2", "diff", "diff2", "obs_b", "obs_a"]
    wanted = {**covariates(*[F.col(c) for c in ("obs", "obs2", "diff", "diff2")]), "lead_contrast": F.col("obs_b") - F.col("obs_a")}
    rho = resample.drawn_day_spearman(cut_lineage(days), "station_id", "valid_day", measures, F.col("effect"), wanted, 2000, 7, SEED + 12)
    low, high = resample.interval("rho")
    return rho.groupBy("covariate").agg(F.count("rho").alias("n_draws"), r(F.avg("rho"), 4).alias("mean"), r(low, 4).alias("ci_low"), r(high, 4).alias("ci_high"),
                                        r(resample.share(F.col("rho") > 0), 4).alias("p_gt_zero"))


BLOCKS_SQL = "WITH " + STATION_DAY_SQL + ", " + d.STATIONS_SQL + """,
ce AS (SELECT st.*, abs(s.altitude_m) AS mismatch, CAST(floor((s.latitude+90)/30) AS BIGINT) || '_' || CAST(floor(((s.longitude+180) % 360)/30) AS BIGINT) AS block FROM st JOIN stations s USING (station_id)),
bl AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS unit_idx FROM (SELECT DISTINCT block FROM ce)),
""" + _unit_draw_sql("(SELECT count(*) FROM bl)", 2000, SEED + 13) + """,
dr AS (SELECT u.draw, ce.* FROM u JOIN bl ON bl.unit_idx = u.day_idx JOIN ce USING (block))"""


def cell_effects(spark: SparkSession, sf: str) -> DataFrame:
    where = d.stations(spark, sf).select("station_id", F.abs("altitude_m").alias("mismatch"),
                                         geo.offset_block(F.col("latitude"), F.col("longitude"), 30.0).alias("block"))
    return station_table(spark, sf).join(where, "station_id")


@query("boot_spatial_blocks_spearman", BLOCKS_SQL + """,
rho AS (SELECT draw, corr(rx, ry) AS rho FROM """ + _weighted_rank_sql("dr", "mismatch", "effect") + """ GROUP BY draw),
p AS (SELECT corr(rx, ry) AS rho FROM """ + _rank_sql("ce", "mismatch", "effect") + """)
SELECT round((SELECT rho FROM p), 6) AS spearman, round(median(rho), 6) AS bootstrap_median, round(quantile_cont(rho, 0.025), 6) AS ci_low,
       round(quantile_cont(rho, 0.975), 6) AS ci_high, (SELECT rho FROM p) < 0 AS predicted_sign_passed FROM rho""")
def boot_spatial_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation with whole spatial blocks drawn with replacement."""
    cells = cell_effects(spark, sf)
    rho = resample.weighted_spearman_draws(cells.select("block", "mismatch", "effect"), [], "block", "mismatch", "effect", 2000, SEED + 13)
    low, high = resample.interval("rho")
    drawn = rho.agg(F.percentile("rho", F.lit(0.5)).alias("m"), low.alias("lo"), high.alias("hi"))
    point = order_stats.spearman(cells, [], "mismatch", "effect")
    return attach_row(point, drawn).select(r("spearman").alias("spearman"), r("m").alias("bootstrap_median"), r("lo").alias("ci_low"), r("hi").alias("ci_high"),
                                          (F.col("spearman") < 0).alias("predicted_sign_passed"))


@query("quartile_contrast", BLOCKS_SQL + """,
e AS (SELECT quantile_cont(mismatch, 0.25) AS q1, quantile_cont(mismatch, 0.75) AS q3 FROM ce),
c AS (SELECT draw, avg(CASE WHEN mismatch > q3 THEN effect END) - avg(CASE WHEN mismatch <= q1 THEN effect END) AS c FROM dr, e GROUP BY draw)
SELECT (SELECT round(avg(CASE WHEN mismatch > q3 THEN effect END) - avg(CASE WHEN mismatch <= q1 THEN effect END), 6) FROM ce, e) AS q4_minus_q1,
       (SELECT count(*) FROM ce, e WHERE mismatch <= q1) AS q1_cells, (SELECT count(*) FROM ce, e WHERE mismatch > q3) AS q4_cells,
       round(median(c), 6) AS bootstrap_median, round(quantile_cont(c, 0.025), 6) AS ci_low, round(quantile_cont(c, 0.975), 6) AS ci_high FROM c""")
def quartile_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """Upper minus lower quartile of a covariate; edges come from the whole sample and stay fixed over draws."""
    cells = order_stats.quantile_bins(cut_lineage(cell_effects(spark, sf)), [], "mismatch", 4, "bin")
    low, high = F.when(F.col("bin") == 1, F.col("effect")), F.when(F.col("bin") == 4, F.col("effect"))
    per_block = cells.groupBy("block").agg(F.sum(low).alias("sl"), F.count(low).alias("nl"), F.sum(high).alias("sh"), F.count(high).alias("nh"))
    numbered = resample.unit_ordinals(per_block, [], "block")
    draws = resample.unit_weights(numbered.groupBy().agg(F.max("n_units").alias("n_units")), [], 2000, SEED + 13)
    drawn = draws.join(numbered.select("unit_idx", "block"), "unit_idx").join(per_block, "block")
    k = F.col("k")
    contrast_draws = drawn.groupBy("draw").agg((F.try_divide(F.sum(k * F.col("sh")), F.sum(k * F.col("nh")))
                                                - F.try_divide(F.sum(k * F.col("sl")), F.sum(k * F.col("nl")))).alias("c"))
    lo, hi = resample.interval("c")
    summary = contrast_draws.agg(r(F.percentile("c", F.lit(0.5))).alias("bootstrap_median"), r(lo).alias("ci_low"), r(hi).alias("ci_high"))
    point = per_block.agg(r(F.sum("sh") / F.sum("nh") - F.sum("sl") / F.sum("nl")).alias("q4_minus_q1"), F.sum("nl").alias("q1_cells"), F.sum("nh").alias("q4_cells"))
    return attach_row(point, summary)


# Regressions over model variants (model x network): advantage of the grid against a spread predictor.
VARIANT_SQL = d.LONG_SQL + """,
md AS (SELECT network, valid_day, avg(ref_grid) AS mean_ref FROM common GROUP BY ALL),
vr AS (SELECT model || '_' || network AS variant, model AS family, network AS cohort, avg(abs(forecast-ref_grid)) - avg(abs(forecast-ref_point)) AS advantage,
              avg(abs(forecast-mean_ref)) AS roughness, avg(abs(forecast-ref_grid)) AS e_grid, avg(abs(forecast-ref_point)) AS e_point
       FROM long JOIN md USING (network, valid_day) GROUP BY ALL)"""


def variants(spark: SparkSession, sf: str) -> DataFrame:
    long = d.long_panel(spark, sf)
    level = d.common_panel(spark, sf).groupBy("network", "valid_day").agg(F.avg("ref_grid").alias("mean_ref"))
    e_grid, e_point = F.avg(F.abs(F.col("forecast") - F.col("ref_grid"))), F.avg(F.abs(F.col("forecast") - F.col("ref_point")))
    return long.join(level, ["network", "valid_day"]).groupBy(
        F.concat_ws("_", "model", "network").alias("variant"), F.col("model").alias("family"), F.col("network").alias("cohort")).agg(
        (e_grid - e_point).alias("advantage"), F.avg(F.abs(F.col("forecast") - F.col("mean_ref"))).alias("roughness"),
        e_grid.alias("e_grid"), e_point.alias("e_point"))


@query("slope_by_cohort", "WITH " + VARIANT_SQL + """
SELECT cohort, CASE WHEN count(*) >= 2 AND max(roughness) > min(roughness) THEN round(regr_slope(advantage, roughness), 6) END AS slope, round(regr_r2(advantage, roughness), 6) AS r2, count(*) AS n FROM vr GROUP BY cohort""")
def slope_by_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return variants(spark, sf).groupBy("cohort").agg(r(regression.guarded_slope("advantage", "roughness")).alias("slope"),
                                                     r(F.regr_r2("advantage", "roughness")).alias("r2"), F.count(F.lit(1)).alias("n"))


@query("slope_leave_one_out", "WITH " + VARIANT_SQL + """
SELECT h.variant AS excluded, count(*) AS n_remaining, round(regr_slope(v.advantage, v.roughness), 6) AS slope, (SELECT count(*) FROM vr) >= 4 AS informative
FROM vr h JOIN vr v ON v.variant <> h.variant GROUP BY h.variant""")
def slope_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    """Slope without each variant, from sums minus its own terms."""
    return rounded(regression.leave_one_out_slopes(variants(spark, sf), [], "variant", "roughness", "advantage"), "slope")


@query("family_reduction", "WITH " + VARIANT_SQL + """,
c AS (SELECT cohort, avg(advantage) AS ma, avg(roughness) AS mr FROM vr GROUP BY cohort HAVING count(DISTINCT variant) >= 2)
SELECT family, round(avg(advantage-ma), 6) AS advantage, round(avg(roughness-mr), 6) AS roughness FROM vr JOIN c USING (cohort) GROUP BY family""")
def family_reduction(spark: SparkSession, sf: str) -> DataFrame:
    """Centre within comparable cohorts, then average duplicate families."""
    return rounded(regression.reduce_families(variants(spark, sf), "cohort", "family", "variant", ["advantage", "roughness"]), "advantage", "roughness")


@query("rank_comparison", "WITH " + VARIANT_SQL + """,
p AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE sign(a.e_grid-b.e_grid) <> sign(a.e_point-b.e_point)) AS rev FROM vr a JOIN vr b ON a.variant < b.variant)
SELECT round((SELECT corr(rx, ry) FROM """ + _rank_sql("vr", "e_grid", "e_point") + """), 6) AS spearman, (SELECT rev FROM p) AS pairwise_reversals, (SELECT pairs FROM p) AS possible_pairs,
       (SELECT string_agg(variant, '|' ORDER BY e_grid, variant) FROM vr) AS grid_order, (SELECT string_agg(variant, '|' ORDER BY e_point, variant) FROM vr) AS point_order""")
def rank_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two rankings of the same variants: correlation, reversed pairs and orders (variants are a handful)."""
    table = variants(spark, sf)
    rho = order_stats.spearman(table, [], "e_grid", "e_point")
    reversed_pairs, pairs = contrast.pair_reversals("variant", "e_grid", "e_point")
    orders = table.agg(reversed_pairs.alias("pairwise_reversals"), pairs.alias("possible_pairs"),
                       score.ordering("variant", "e_grid").alias("grid_order"), score.ordering("variant", "e_point").alias("point_order"))
    return attach_row(rho, orders).select(r("spearman").alias("spearman"), "pairwise_reversals", "possible_pairs", "grid_order", "point_order")


@query("standardised_regression", "WITH " + STATION_DAY_SQL + """,
k AS (SELECT corr(effect, bias) AS a, corr(effect, sd_obs) AS b, corr(bias, sd_obs) AS c, count(*) AS n FROM st),
s AS (SELECT *, (a-b*c)/(1-c*c) AS b1, (b-a*c)/(1-c*c) AS b2 FROM k)
SELECT 'bias' AS covariate, round(b1, 6) AS standardised_beta, round(b1*a+b2*b, 6) AS r_squared, n AS n_rows FROM s UNION ALL SELECT 'sd_obs', round(b2, 6), round(b1*a+b2*b, 6), n FROM s""")
def standardised_regression(spark: SparkSession, sf: str) -> DataFrame:
    out = regression.standardised_regression(station_table(spark, sf), [], "effect", ["bias", "sd_obs"])
    return rounded(out, "standardised_beta", "r_squared")


@query("boot_cell_day_slope", "WITH " + d.LONG_SQL + """,
ce AS (SELECT s_suppkey AS station_id, s_nationkey AS cell FROM supplier),
cd AS (SELECT model, cell, valid_day AS day, avg(abs(forecast-ref_grid)) AS eg, avg(abs(forecast-ref_point)) AS ep, avg(abs(forecast-30)) AS ro FROM long JOIN ce USING (station_id) GROUP BY ALL),
cal AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS day_idx FROM (SELECT DISTINCT day FROM cd)),
cu AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS unit_idx FROM (SELECT DISTINCT cell FROM cd)),
""" + d.starts_sql("(SELECT count(*) FROM cal)", 2000, 3, SEED + 21, "t") + ",\n" + d.starts_sql("(SELECT count(*) FROM cu)", 2000, 1, SEED + 22, "u") + """,
kt AS (SELECT draw, day, count(*) AS k FROM t JOIN cal USING (day_idx) GROUP BY ALL),
bc AS (SELECT draw, model, cell, sum(k*eg)/sum(k) AS eg, sum(k*ep)/sum(k) AS ep, sum(k*ro)/sum(k) AS ro FROM kt JOIN cd USING (day) GROUP BY ALL),
dm AS (SELECT bc.draw, model, avg(eg) AS eg, avg(ep) AS ep, avg(ro) AS ro FROM u JOIN cu ON cu.unit_idx = u.day_idx JOIN bc ON bc.cell = cu.cell AND bc.draw = u.draw GROUP BY ALL),
sl AS (SELECT draw, regr_slope(eg-ep, ro) AS s FROM dm GROUP BY draw)
SELECT count(s) AS finite_draws, round(avg(s), 5) AS mean, round(quantile_cont(s, 0.025), 5) AS ci_low, round(quantile_cont(s, 0.975), 5) AS ci_high, round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END), 6) AS p_slope_gt_zero FROM sl""")
def boot_cell_day_slope(spark: SparkSession, sf: str) -> DataFrame:
    """Slope of advantage on roughness under joint draws of cells and day blocks."""
    cells = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("station_id"), F.col("s_nationkey").alias("cell"))
    f = F.col("forecast")
    daily = d.long_panel(spark, sf).join(cells, "station_id").groupBy("model", "cell", F.col("valid_day").alias("day")).agg(
        F.avg(F.abs(f - F.col("ref_grid"))).alias("eg"), F.avg(F.abs(f - F.col("ref_point"))).alias("ep"), F.avg(F.abs(f - 30)).alias("ro"))
    drawn = resample.cell_day_bootstrap(daily, ["model"], "cell", "day", ["eg", "ep", "ro"], 2000, 3, SEED + 21, SEED + 22)
    slopes = drawn.withColumn("b", F.col("eg") - F.col("ep")).groupBy("draw").agg(regression.guarded_slope("b", "ro").alias("s"))
    low, high = resample.interval("s")
    return slopes.agg(F.count("s").alias("finite_draws"), r(F.avg("s"), 5).alias("mean"), r(low, 5).alias("ci_low"), r(high, 5).alias("ci_high"), r(resample.share(F.col("s") > 0)).alias("p_slope_gt_zero"))


@query("belt_sensitivity", "WITH " + STATION_DAY_SQL + ", " + d.STATIONS_SQL + """
SELECT CASE WHEN latitude < -23.5 THEN 'south_extratropics' WHEN latitude > 23.5 THEN 'north_extratropics' ELSE 'tropics' END AS belt,
       count(*) AS n_stations, CAST(sum(n_days) AS BIGINT) AS station_days, round(avg(effect), 6) AS effect, round(regr_slope(effect, bias), 6) AS slope FROM st JOIN stations USING (station_id) GROUP BY belt""")
def belt_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    placed = station_table(spark, sf).join(d.stations(spark, sf).select("station_id", "latitude"), "station_id")
    return placed.groupBy(strata.latitude_belt(F.col("latitude")).alias("belt")).agg(
        F.count(F.lit(1)).alias("n_stations"), F.sum("n_days").alias("station_days"), r(F.avg("effect")).alias("effect"), r(regression.guarded_slope("effect", "bias")).alias("slope"))


@query("regime_quartiles", "WITH " + d.PANEL_SQL + """,
dd AS (SELECT valid_day, avg(ref_point) AS regime, avg((abs(beta-ref_point)-abs(gamma-ref_point)) - (abs(beta-ref_grid)-abs(gamma-ref_grid))) AS effect FROM common GROUP BY ALL),
e AS (SELECT quantile_cont(regime, [0.25, 0.5, 0.75]) AS q FROM dd),
b AS (SELECT dd.*, 1 + (regime > q[1])::INT + (regime > q[2])::INT + (regime > q[3])::INT AS quartile FROM dd, e)
SELECT quartile, count(*) AS n_days, round(min(regime), 6) AS lowest, round(max(regime), 6) AS highest, round(avg(effect), 6) AS effect FROM b GROUP BY quartile""")
def regime_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    """Days split by the quartile of their regime."""
    days = d.common_panel(spark, sf).groupBy("valid_day").agg(F.avg("ref_point").alias("regime"), F.avg(effect_column()).alias("effect"))
    binned = order_stats.quantile_bins(cut_lineage(days), [], "regime", 4, "quartile")
    return binned.groupBy("quartile").agg(F.count(F.lit(1)).alias("n_days"), r(F.min("regime")).alias("lowest"), r(F.max("regime")).alias("highest"), r(F.avg("effect")).alias("effect"))


@query("regime_spatial_spread", "WITH " + d.PANEL_SQL + """,
s AS (SELECT valid_day, station_id, avg(ref_point) AS m FROM common GROUP BY ALL), v AS (SELECT valid_day, stddev_samp(m) AS sd FROM s GROUP BY ALL)
SELECT strftime(valid_day, '%Y-%m-%d') AS day, round(sd, 6) AS spatial_sd FROM v""")
def regime_spatial_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of the station means of each day; a single station has none."""
    means = d.common_panel(spark, sf).groupBy("valid_day", "station_id").agg(F.avg("ref_point").alias("m"))
    return means.groupBy("valid_day").agg(F.stddev_samp("m").alias("sd")).select(day_text("valid_day").alias("day"), r("sd").alias("spatial_sd"))


_P = 2147483647


def _pow5(x: str) -> str:
    return f"(((({x})*({x}) % {_P}) * (({x})*({x}) % {_P}) % {_P}) * ({x}) % {_P})"


# Hours and extremes on the report series.
HALF_SQL = d.REPORTS_SQL + """,
h AS (SELECT event_type, CAST(valid_time AS DATE) AS day, CASE WHEN hour(valid_time) < 12 THEN 0 ELSE 12 END AS valid_hour, avg(value) AS v FROM reports GROUP BY ALL),
e AS (SELECT x.event_type || '-' || y.event_type AS pair, day, valid_hour, (abs(x.v-5)-abs(y.v-5)) - (abs(x.v-4)-abs(y.v-4)) AS effect
      FROM h x JOIN h y USING (day, valid_hour) WHERE x.event_type < y.event_type AND x.v IS NOT NULL AND y.v IS NOT NULL)"""


def half_day_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Effect of every pair of report types in each half of a day: all types side by side, pairs without a join."""
    halves = d.reports(spark, sf).groupBy(F.to_date("valid_time").alias("day"), F.when(F.hour("valid_time") < 12, 0).otherwise(12).alias("valid_hour")).pivot(
        "event_type", list(d.EVENT_TYPES)).agg(F.avg("value"))

    def effect(x: str, y: str) -> Column:
        a, b = F.col(x), F.col(y)
        return (F.abs(a - 5) - F.abs(b - 5)) - (F.abs(a - 4) - F.abs(b - 4))

    pairs = [F.struct(F.lit(f"{x}-{y}").alias("pair"), effect(x, y).alias("effect")) for i, x in enumerate(d.EVENT_TYPES) for y in d.EVENT_TYPES[i + 1:]]
    return halves.select("day", "valid_hour", F.inline(F.array(*pairs))).where(F.col("effect").isNotNull())


@query("diurnal_contrast", "WITH " + HALF_SQL + """,
p AS (SELECT x.pair, x.day, x.effect AS e0, y.effect AS e12, y.effect - x.effect AS diff FROM e x JOIN e y USING (pair, day) WHERE x.valid_hour = 0 AND y.valid_hour = 12),
sz AS (SELECT pair, count(*) AS n FROM p GROUP BY pair),
nm AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY day) - 1 AS day_idx FROM p),
x AS (SELECT pair, n, d.range AS draw, b.range AS block, (d.range*7919 + b.range*104729 + {seed}) % {p} AS x FROM sz, range(0, 2000) d, range(0, (SELECT CAST(ceil(max(n)/3.0) AS BIGINT) FROM sz)) b WHERE b.range*3 < n),
y AS (SELECT *, ({px}*48271 + 11) % {p} AS y FROM x),
ix AS (SELECT pair, draw, ({py} % n + o.range) % n AS day_idx FROM y, range(0, 3) o WHERE block*3 + o.range < n),
dr AS (SELECT pair, draw, avg(diff) AS c FROM ix JOIN nm USING (pair, day_idx) GROUP BY ALL),
pt AS (SELECT pair, count(*) AS n_paired_days, round(avg(e0), 6) AS effect_00, round(avg(e12), 6) AS effect_12 FROM p GROUP BY pair)
SELECT pair, any_value(n_paired_days) AS n_paired_days, any_value(effect_00) AS effect_00, any_value(effect_12) AS effect_12,
       round(avg(c), 6) AS contrast, round(quantile_cont(c, 0.025), 6) AS ci_low, round(quantile_cont(c, 0.975), 6) AS ci_high, round(avg(CASE WHEN c < 0 THEN 1.0 ELSE 0.0 END), 6) AS p_lt_zero
FROM dr JOIN pt USING (pair) GROUP BY pair""".format(seed=SEED + 31, p=2147483647, px=_pow5("x"), py=_pow5("y")))
def diurnal_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """Effect of every pair at one half of the day minus the other, paired on the calendar day."""
    paired = half_day_effects(spark, sf).groupBy("pair", "day").pivot("valid_hour", [0, 12]).agg(F.first("effect")).na.drop()
    paired = cut_lineage(paired.select("pair", "day", F.col("0").alias("e0"), F.col("12").alias("e12"), (F.col("12") - F.col("0")).alias("diff")))
    drawn = resample.block_bootstrap(paired, ["pair"], "day", ["diff"], 2000, 3, SEED + 31)
    low, high = resample.interval("diff")
    summary = drawn.groupBy("pair").agg(r(F.avg("diff")).alias("contrast"), r(low).alias("ci_low"), r(high).alias("ci_high"), r(resample.share(F.col("diff") < 0)).alias("p_lt_zero"))
    point = paired.groupBy("pair").agg(F.count(F.lit(1)).alias("n_paired_days"), r(F.avg("e0")).alias("effect_00"), r(F.avg("e12")).alias("effect_12"))
    return point.join(summary, "pair")


DEPARTURE_SQL = "WITH " + d.PANEL_SQL + """,
dd AS (SELECT cohort, lead_h, valid_day, avg((abs(beta-ref_point)-abs(gamma-ref_point)) - (abs(beta-ref_grid)-abs(gamma-ref_grid))) AS effect FROM common WHERE lead_h IN (24, 48, 72) GROUP BY ALL),
sz AS (SELECT cohort, lead_h, count(*) AS n FROM dd GROUP BY ALL),
nm AS (SELECT *, row_number() OVER (PARTITION BY cohort, lead_h ORDER BY valid_day) - 1 AS day_idx FROM dd),
x AS (SELECT cohort, lead_h, n, d.range AS draw, b.range AS block, (d.range*7919 + b.range*104729 + {seed}) % {p} AS x FROM sz, range(0, 2000) d, range(0, (SELECT CAST(ceil(max(n)/7.0) AS BIGINT) FROM sz)) b WHERE b.range*7 < n),
y AS (SELECT *, ({px}*48271 + 11) % {p} AS y FROM x),
ix AS (SELECT cohort, lead_h, draw, ({py} % n + o.range) % n AS day_idx FROM y, range(0, 7) o WHERE block*7 + o.range < n),
dr AS (SELECT cohort, lead_h, draw, avg(effect) AS effect FROM ix JOIN nm USING (cohort, lead_h, day_idx) GROUP BY ALL),
dp AS (SELECT cohort, draw, max(effect) FILTER (WHERE lead_h = 48) AS crossed, (max(effect) FILTER (WHERE lead_h = 24) + max(effect) FILTER (WHERE lead_h = 72))/2 AS expected FROM dr GROUP BY ALL)
SELECT cohort, round(avg(crossed), 6) AS crossed_effect, round(avg(expected), 6) AS bracket_expected, round(avg(crossed-expected), 6) AS departure,
       round(quantile_cont(crossed-expected, 0.025), 6) AS ci_low, round(quantile_cont(crossed-expected, 0.975), 6) AS ci_high,
       (SELECT count(DISTINCT sign(m)) = 2 FROM (SELECT avg(crossed-expected) AS m FROM dp GROUP BY cohort)) AS changes_sign FROM dp GROUP BY cohort"""



@query("diurnal_departure", DEPARTURE_SQL.format(seed=SEED + 32, p=_P, px=_pow5("x"), py=_pow5("y")))
def diurnal_departure(spark: SparkSession, sf: str) -> DataFrame:
    """Effect at a middle lead against the mean of the leads around it, draw by draw, per cycle."""
    daily = d.common_panel(spark, sf).where(F.col("lead_h").isin(24, 48, 72)).groupBy("cohort", "lead_h", "valid_day").agg(F.avg(effect_column()).alias("effect"))
    drawn = resample.block_bootstrap(daily, ["cohort", "lead_h"], "valid_day", ["effect"], 2000, 7, SEED + 32)
    by_lead = drawn.groupBy("cohort", "draw").pivot("lead_h", [24, 48, 72]).agg(F.first("effect"))
    parts = by_lead.select("cohort", F.col("48").alias("crossed"), ((F.col("24") + F.col("72")) / 2).alias("expected"))
    gap = F.col("crossed") - F.col("expected")
    low, high = resample.interval(gap)
    table = parts.groupBy("cohort").agg(F.avg("crossed").alias("crossed_effect"), F.avg("expected").alias("bracket_expected"), F.avg(gap).alias("departure"), low.alias("ci_low"), high.alias("ci_high"))
    verdict = table.agg((F.count_distinct(F.signum("departure")) == 2).alias("changes_sign"))
    return rounded(attach_row(table, verdict), "crossed_effect", "bracket_expected", "departure", "ci_low", "ci_high")


EXTREMES_SQL = d.REPORTS_SQL + """,
r2 AS (SELECT station_id, CAST(valid_time AS DATE) AS day, hour(valid_time)//6 AS slot, valid_time, report_id, value FROM reports),
last AS (SELECT station_id, day, slot, arg_max(value, (valid_time, report_id)) AS v FROM r2 GROUP BY ALL),
smp AS (SELECT station_id, day, max(v) AS tmax, min(v) AS tmin, avg(v) AS tmean FROM last GROUP BY ALL HAVING count(DISTINCT slot) = 4),
tru AS (SELECT station_id, day, max(value) AS xmax, min(value) AS xmin, avg(value) AS xmean, count(*) AS n FROM r2 GROUP BY ALL),
j AS (SELECT *, (tmax+tmin)/2 AS tmid, (xmax+xmin)/2 AS xmid FROM smp JOIN tru USING (station_id, day))"""


@query("daily_extremes", "WITH " + EXTREMES_SQL + """
SELECT station_id, strftime(day, '%Y-%m-%d') AS day, round(tmax, 6) AS tmax, round(tmin, 6) AS tmin, round(tmean, 6) AS tmean, round(xmax, 6) AS true_tmax, round(xmin, 6) AS true_tmin, round(xmean, 6) AS true_tmean, n AS reports_per_day FROM j""")
def daily_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Daily extremes from four instants, for complete days only, beside the full record."""
    return rounded(_extremes(spark, sf).select("station_id", day_text("day").alias("day"), "tmax", "tmin", "tmean", F.col("xmax").alias("true_tmax"), F.col("xmin").alias("true_tmin"),
                                               F.col("xmean").alias("true_tmean"), F.col("n").alias("reports_per_day")), "tmax", "tmin", "tmean", "true_tmax", "true_tmin", "true_tmean")


def _extremes(spark: SparkSession, sf: str) -> DataFrame:
    reports = d.reports(spark, sf).withColumn("day", F.to_date("valid_time")).withColumn("slot", F.floor(F.hour("valid_time") / 6))
    instants = reports.groupBy("station_id", "day", "slot").agg(F.max_by("value", F.struct("valid_time", "report_id")).alias("v"))
    sampled = instants.groupBy("station_id", "day").agg(F.max("v").alias("tmax"), F.min("v").alias("tmin"), F.avg("v").alias("tmean"), F.count_distinct("slot").alias("slots")).where("slots = 4")
    whole = reports.groupBy("station_id", "day").agg(F.max("value").alias("xmax"), F.min("value").alias("xmin"), F.avg("value").alias("xmean"), F.count(F.lit(1)).alias("n"))
    return sampled.join(whole, ["station_id", "day"])


@query("daily_sampling_bias", "WITH " + EXTREMES_SQL + " " + " UNION ALL ".join(
    f"SELECT '{q}' AS quantity, round(avg({a}-{b}), 6) AS sampled_minus_true_mean, round(stddev_samp({a}-{b}), 6) AS sampled_minus_true_sd, round(avg(n), 6) AS mean_reports, count(*) AS n_station_days FROM j"
    for q, a, b in (("tmax", "tmax", "xmax"), ("tmin", "tmin", "xmin"), ("tmean", "tmean", "xmean"), ("tmidpoint", "tmid", "xmid"))))
def daily_sampling_bias(spark: SparkSession, sf: str) -> DataFrame:
    both = _extremes(spark, sf)
    mid = ((F.col("tmax") + F.col("tmin")) / 2, (F.col("xmax") + F.col("xmin")) / 2)
    rows = [F.struct(F.lit(n).alias("quantity"), (a - b).alias("gap")) for n, a, b in (
        ("tmax", F.col("tmax"), F.col("xmax")), ("tmin", F.col("tmin"), F.col("xmin")), ("tmean", F.col("tmean"), F.col("xmean")), ("tmidpoint", *mid))]
    return both.select("n", F.inline(F.array(*rows))).groupBy("quantity").agg(
        r(F.avg("gap")).alias("sampled_minus_true_mean"), r(F.stddev_samp("gap")).alias("sampled_minus_true_sd"), r(F.avg("n")).alias("mean_reports"), F.count(F.lit(1)).alias("n_station_days"))


@query("consistency_check", "WITH " + DAILY_SQL + """,
a AS (SELECT avg(ref_point__beta)-avg(ref_point__gamma) - (avg(ref_grid__beta)-avg(ref_grid__gamma)) AS v FROM daily),
b AS (SELECT sum(e*n)/sum(n) AS v FROM (SELECT network, avg(e) AS e, sum(n) AS n FROM (SELECT network, valid_day, avg((abs(beta-ref_point)-abs(gamma-ref_point)) - (abs(beta-ref_grid)-abs(gamma-ref_grid))) AS e, count(*) AS n FROM common GROUP BY ALL) GROUP BY network)),
c AS (SELECT avg((abs(beta-ref_point)-abs(gamma-ref_point)) - (abs(beta-ref_grid)-abs(gamma-ref_grid))) AS v FROM common),
u AS (SELECT v FROM a UNION ALL SELECT v FROM b UNION ALL SELECT v FROM c)
SELECT count(*) AS n_routes, round(max(v)-min(v), 6) AS spread, max(v)-min(v) <= 0.5 AS passed, bool_and(v < 0) AS all_negative FROM u""")
def consistency_check(spark: SparkSession, sf: str) -> DataFrame:
    """The same effect along three routes must agree within a tolerance."""
    cases = d.common_panel(spark, sf)
    by_day = daily_errors(spark, sf).agg(((F.avg("ref_point__beta") - F.avg("ref_point__gamma")) - (F.avg("ref_grid__beta") - F.avg("ref_grid__gamma"))).alias("v"))
    networks = cases.groupBy("network", "valid_day").agg(F.avg(effect_column()).alias("e"), F.count(F.lit(1)).alias("n")).groupBy("network").agg(F.avg("e").alias("e"), F.sum("n").alias("n"))
    routes = by_day.unionByName(networks.agg((F.sum(F.col("e") * F.col("n")) / F.sum("n")).alias("v"))).unionByName(cases.agg(F.avg(effect_column()).alias("v")))
    spread = F.max("v") - F.min("v")
    return routes.agg(F.count(F.lit(1)).alias("n_routes"), r(spread).alias("spread"), (spread <= 0.5).alias("passed"), F.bool_and(F.col("v") < 0).alias("all_negative"))


@query("pair_rule", "WITH " + VARIANT_SQL + """
SELECT a.cohort, a.family AS model_a, b.family AS model_b, round(a.roughness-b.roughness, 6) AS roughness_gap, round(a.advantage-b.advantage, 6) AS advantage_gap,
       (a.roughness > b.roughness) = (a.advantage > b.advantage) AS rougher_favoured FROM vr a JOIN vr b ON a.cohort = b.cohort AND a.family < b.family""")
def pair_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Is the rougher member of a pair the one the reference change favours?"""
    table = variants(spark, sf)
    rough = contrast.pair_gaps(table, ["cohort"], d.MODELS, "family", "roughness").withColumnRenamed("gap", "roughness_gap")
    gain = contrast.pair_gaps(table, ["cohort"], d.MODELS, "family", "advantage").withColumnRenamed("gap", "advantage_gap")
    joined = rough.join(gain, ["cohort", "model_a", "model_b"])
    return rounded(joined.withColumn("rougher_favoured", (F.col("roughness_gap") > 0) == (F.col("advantage_gap") > 0)), "roughness_gap", "advantage_gap")
