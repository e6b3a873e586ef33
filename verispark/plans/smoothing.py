"""Controlled smoothing of forecasts and growing support of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import contrast, resample, score, support
from ..operators.contracts import attach_row
from ..session import cut_lineage
from . import domain as d
from .registry import query, r, rounded
from .resampling import SEED

SIGMAS = (0.0, 400.0, 800.0)
RADII = (0.0, 1500.0, 3000.0)

SERIES_SQL = d.PANEL_SQL + ", " + d.STATIONS_SQL + """,
ser AS (SELECT station_id, valid_day, avg(alpha) AS alpha, avg(beta) AS beta, avg(gamma) AS gamma, avg(ref_point) AS ref_point, avg(ref_grid) AS ref_grid FROM common GROUP BY ALL),
lon AS (SELECT station_id, valid_day, ref_point, ref_grid, m.model, m.forecast FROM ser, LATERAL (VALUES ('alpha', alpha), ('beta', beta), ('gamma', gamma)) m(model, forecast)),
km AS (SELECT a.station_id AS target_id, b.station_id AS source_id, b.latitude AS blat, """ + d.haversine_sql("a", "b") + """ AS km FROM stations a, stations b)"""

BLUR_SQL = SERIES_SQL + """,
kw AS (SELECT target_id, source_id, sigma, exp(-0.5*pow(km/sigma, 2))*greatest(cos(radians(blat)), 0) AS w FROM km, (SELECT unnest([400.0, 800.0]::DOUBLE[]) AS sigma) WHERE km <= 4*sigma),
sm AS (SELECT w.target_id AS station_id, s.valid_day, sigma AS sigma_km, s.model, sum(w*s.forecast)/sum(w) AS value FROM lon s JOIN kw w ON w.source_id = s.station_id GROUP BY ALL),
blur AS (SELECT station_id, valid_day, model, ref_point, ref_grid, 0.0::DOUBLE AS sigma_km, forecast AS value FROM lon
         UNION ALL SELECT l.station_id, l.valid_day, l.model, ref_point, ref_grid, sigma_km, value FROM lon l JOIN sm USING (station_id, valid_day, model))"""


def neighbourhoods(spark: SparkSession, sf: str, wanted: list[tuple[str, support.Weight]], carry: list[str], every_centre: bool = False) -> DataFrame:
    """``support.neighbourhood_means`` of the cases; their values are computed where a day's cases meet."""
    needed = list(dict.fromkeys([*[v for v, _ in wanted], *carry]))
    values = {v: value for v, value in d.panel_values().items() if v in needed}
    return support.neighbourhood_means(d.common_sources(spark, sf, needed), d.stations(spark, sf), ["valid_day"], wanted, carry, every_centre, values=values)


def station_series(spark: SparkSession, sf: str) -> DataFrame:
    """One value per station and day: repeated cases of a day average first."""
    return d.common_panel(spark, sf).groupBy("station_id", "valid_day").agg(*[F.avg(c).alias(c) for c in (*d.MODELS, *d.REFERENCES)])


BLURS = [support.Weight(f"s{s:g}", 4 * s, s, by_area=True) for s in SIGMAS if s > 0]


def smoothed_series(spark: SparkSession, sf: str) -> DataFrame:
    """Station series with every forecast at every width beside it (``model__s400``)."""
    wanted = [(m, blur) for m in d.MODELS for blur in BLURS]
    return neighbourhoods(spark, sf, wanted, [*d.MODELS, *d.REFERENCES])


def blurred(spark: SparkSession, sf: str) -> DataFrame:
    """The same, one row per width; width zero is the forecast itself."""
    rows = F.array(*[F.struct(F.lit(s).alias("sigma_km"), *[F.col(f"{m}__s{s:g}" if s else m).alias(m) for m in d.MODELS]) for s in SIGMAS])
    wide = smoothed_series(spark, sf)
    return wide.select(F.col("centre_id").alias("station_id"), "valid_day", *d.REFERENCES, F.inline(rows))


def _cells(df: DataFrame, *keep: str) -> DataFrame:
    """(model, reference) combinations of the side-by-side columns."""
    combos = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(ref).alias("reference"), F.col(m).alias("forecast"), F.col(ref).alias("target"))
                       for m in d.MODELS for ref in d.REFERENCES])
    return df.select(*keep, F.inline(combos))


CURVE_SQL = BLUR_SQL + """,
er AS (SELECT model, sigma_km, valid_day, 'ref_point' AS reference, value-ref_point AS e FROM blur UNION ALL SELECT model, sigma_km, valid_day, 'ref_grid', value-ref_grid FROM blur),
dc AS (SELECT model, reference, sigma_km, valid_day, avg(abs(e)) AS a, avg(e*e) AS s, avg(e) AS b FROM er GROUP BY ALL),
curve AS (SELECT model, reference, sigma_km, avg(a) AS mae, sqrt(avg(s)) AS rmse, avg(s) AS mse, avg(b) AS bias, greatest(avg(s)-pow(avg(b), 2), 0) AS centred, count(*) AS n_days FROM dc GROUP BY ALL)"""


def curve_days(spark: SparkSession, sf: str) -> DataFrame:
    cells = _cells(blurred(spark, sf), "sigma_km", "valid_day")
    return score.daily_components(cells, ["model", "reference", "sigma_km"], "valid_day", "forecast", "target")


def curves(spark: SparkSession, sf: str) -> DataFrame:
    return score.day_weighted(curve_days(spark, sf), ["model", "reference", "sigma_km"])


@query("smoothing_curves", "WITH " + CURVE_SQL + """
SELECT model, reference, sigma_km, n_days, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(sqrt(centred), 6) AS centred_rmse, round(bias, 6) AS bias FROM curve""")
def smoothing_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every model at every smoothing width against both references."""
    out = curves(spark, sf).select("model", "reference", "sigma_km", "n_days", "mae", F.col("rmse_day_weighted").alias("rmse"), "centred_rmse", "bias")
    return rounded(out, "mae", "rmse", "centred_rmse", "bias")


@query("smoothing_identity", "WITH " + BLUR_SQL + """
SELECT model, count(*) AS n, max(abs(value - forecast)) <= 1e-6 AS identical FROM blur JOIN lon USING (station_id, valid_day, model) WHERE sigma_km = 0 GROUP BY model""")
def smoothing_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Width zero must reproduce the forecast."""
    zero = blurred(spark, sf).where("sigma_km = 0").select("station_id", "valid_day", *[F.col(m).alias(f"z_{m}") for m in d.MODELS])
    both = zero.join(station_series(spark, sf), ["station_id", "valid_day"])
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.abs(F.col(f"z_{m}") - F.col(m)).alias("gap")) for m in d.MODELS])
    return both.select(F.inline(rows)).groupBy("model").agg(F.count(F.lit(1)).alias("n"), (F.max("gap") <= 1e-6).alias("identical"))


@query("smoothing_optimum", "WITH " + CURVE_SQL + """
SELECT model, reference, arg_min(sigma_km, (round(rmse, 12), sigma_km)) AS optimal_sigma, round(min(rmse), 6) AS optimal_score FROM curve GROUP BY ALL""")
def smoothing_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """The width of the lowest score; ties go to the smaller width."""
    best = contrast.optimum(curves(spark, sf), ["model", "reference"], "sigma_km", "rmse_day_weighted")
    return rounded(best, "optimal_score")


@query("smoothing_changes", "WITH " + CURVE_SQL + """,
wd AS (SELECT model, reference, valid_day, max(a) FILTER (WHERE sigma_km = 0) AS a0, max(a) FILTER (WHERE sigma_km = 400) AS a1, max(a) FILTER (WHERE sigma_km = 800) AS a2 FROM dc GROUP BY ALL),
cal AS (SELECT valid_day, row_number() OVER (ORDER BY valid_day) - 1 AS day_idx FROM (SELECT DISTINCT valid_day FROM wd)),
""" + d.starts_sql("(SELECT count(*) FROM cal)", 2000, 7, SEED + 41) + """,
dr AS (SELECT draw, model, reference, avg(a0) AS a0, avg(a1) AS a1, avg(a2) AS a2 FROM idx JOIN cal USING (day_idx) JOIN wd USING (valid_day) GROUP BY ALL),
lg AS (SELECT model, reference, 400.0::DOUBLE AS sigma_km, a1-a0 AS x FROM dr UNION ALL SELECT model, reference, 800.0, a2-a0 FROM dr)
SELECT model, reference, sigma_km, round(avg(x), 6) AS change, round(quantile_cont(x, 0.025), 6) AS ci_low, round(quantile_cont(x, 0.975), 6) AS ci_high,
       round(avg(CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END), 6) AS p_smoothing_improves FROM lg GROUP BY ALL""")
def smoothing_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Paired change of the score when a forecast is smoothed, with block-bootstrap intervals."""
    wide = curve_days(spark, sf).groupBy("model", "reference", "valid_day").pivot("sigma_km", list(SIGMAS)).agg(F.first("absolute"))
    wide = cut_lineage(wide.toDF("model", "reference", "valid_day", "a0", "a1", "a2"))
    drawn = resample.unit_means(wide, ["model", "reference"], "valid_day", ["a0", "a1", "a2"], 2000, 7, SEED + 41)
    rows = F.array(*[F.struct(F.lit(s).alias("sigma_km"), (F.col(c) - F.col("a0")).alias("x")) for s, c in ((400.0, "a1"), (800.0, "a2"))])
    low, high = resample.interval("x")
    return drawn.select("model", "reference", F.inline(rows)).groupBy("model", "reference", "sigma_km").agg(
        r(F.avg("x")).alias("change"), r(low).alias("ci_low"), r(high).alias("ci_high"), r(resample.share(F.col("x") < 0)).alias("p_smoothing_improves"))


@query("smoothing_decisions", "WITH " + CURVE_SQL + """,
o AS (SELECT model, reference, arg_min(sigma_km, (round(rmse, 12), sigma_km)) AS s FROM curve GROUP BY ALL),
b AS (SELECT model, reference, rmse AS r0, pow(bias, 2) AS b0, centred AS c0 FROM curve WHERE sigma_km = 0),
sd AS (SELECT p.model, bool_and((p.rmse-bp.r0)*(g.rmse-bg.r0) > 0) AS same FROM curve p JOIN curve g ON g.model = p.model AND g.sigma_km = p.sigma_km AND p.reference = 'ref_point' AND g.reference = 'ref_grid'
       JOIN b bp ON bp.model = p.model AND bp.reference = 'ref_point' JOIN b bg ON bg.model = p.model AND bg.reference = 'ref_grid' WHERE p.sigma_km > 0 GROUP BY p.model),
atb AS (SELECT c.model, pow(c.bias, 2)-b.b0 AS dbias, c.centred-b.c0 AS dcent FROM curve c JOIN o ON o.model = c.model AND o.reference = c.reference AND o.s = c.sigma_km JOIN b ON b.model = c.model AND b.reference = c.reference WHERE c.reference = 'ref_grid')
SELECT og.model, og.s AS grid_optimal_sigma, op.s AS point_optimal_sigma, og.s > 0 AND op.s = 0 AS opposite_optima, sd.same AS same_direction_everywhere, round(atb.dbias, 6) AS bias_squared_change,
       round(atb.dcent, 6) AS centred_mse_change, atb.dcent < atb.dbias AS variance_dominates,
       (SELECT count(*) FROM o x JOIN o y USING (model) WHERE x.reference = 'ref_grid' AND y.reference = 'ref_point' AND x.s > 0 AND y.s = 0) >= 2 AS gate_passed
FROM o og JOIN o op USING (model) JOIN sd USING (model) JOIN atb USING (model) WHERE og.reference = 'ref_grid' AND op.reference = 'ref_point'""")
def smoothing_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Opposite optima, same-direction violations, dominance of the variance part, and the two-of-three gate."""
    curve = cut_lineage(curves(spark, sf).select("model", "reference", "sigma_km", F.col("rmse_day_weighted").alias("rmse"), "bias_squared", "centred_mse"))
    best = contrast.optimum(curve, ["model", "reference"], "sigma_km", "rmse")
    optima = best.groupBy("model").pivot("reference", list(d.REFERENCES)).agg(F.first("optimal_sigma")).select(
        "model", F.col("ref_grid").alias("grid_optimal_sigma"), F.col("ref_point").alias("point_optimal_sigma"))
    base = curve.where("sigma_km = 0").select("model", "reference", F.col("rmse").alias("r0"), F.col("bias_squared").alias("b0"), F.col("centred_mse").alias("c0"))
    change = curve.join(base, ["model", "reference"]).withColumn("dr", F.col("rmse") - F.col("r0"))
    both = change.where("sigma_km > 0").groupBy("model", "sigma_km").pivot("reference", list(d.REFERENCES)).agg(F.first("dr"))
    same = both.groupBy("model").agg(F.bool_and(F.col("ref_point") * F.col("ref_grid") > 0).alias("same_direction_everywhere"))
    at_best = change.where("reference = 'ref_grid'").join(best.where("reference = 'ref_grid'").select("model", F.col("optimal_sigma").alias("sigma_km")), ["model", "sigma_km"])
    split = at_best.select("model", (F.col("bias_squared") - F.col("b0")).alias("bias_squared_change"), (F.col("centred_mse") - F.col("c0")).alias("centred_mse_change"))
    table = optima.withColumn("opposite_optima", (F.col("grid_optimal_sigma") > 0) & (F.col("point_optimal_sigma") == 0))
    gate = table.agg((F.count_if("opposite_optima") >= 2).alias("gate_passed"))
    out = attach_row(table, gate).join(same, "model").join(split, "model")
    return rounded(out.withColumn("variance_dominates", F.col("centred_mse_change") < F.col("bias_squared_change")), "bias_squared_change", "centred_mse_change")


# --- support ladder -----------------------------------------------------------------------------------

LADDER_SQL = SERIES_SQL + """,
rd AS (SELECT unnest([0.0, 1500.0, 3000.0]::DOUBLE[]) AS support_km),
wg AS (SELECT k.target_id AS centre_id, k.source_id, support_km, weighting,
              CASE WHEN support_km = 0 THEN CASE WHEN k.target_id = k.source_id THEN 1.0 END WHEN weighting = 'uniform' THEN 1.0 ELSE exp(-0.5*pow(km/(support_km/2), 2)) END::DOUBLE AS w
       FROM km k, rd, (SELECT unnest(['uniform', 'gaussian']) AS weighting) WHERE support_km = 0 AND k.target_id = k.source_id OR support_km > 0 AND km <= support_km),
tg AS (SELECT centre_id, valid_day, weighting, support_km, sum(w*ref_point)/sum(w) AS target FROM wg JOIN ser ON ser.station_id = wg.source_id GROUP BY ALL)"""


LADDER = support.ladder_weights(RADII, ("uniform", "gaussian"))
WEIGHTS = [w.name for w in LADDER]


def ladder_panel(spark: SparkSession, sf: str, carry: list[str], every_centre: bool = False) -> DataFrame:
    return neighbourhoods(spark, sf, [("ref_point", w) for w in LADDER], carry, every_centre)


def _supports(column):
    """(weighting, support_km, ...) rows built from one struct per weight column."""
    return F.array(*[F.struct(F.lit(w).alias("weighting"), F.lit(radius).alias("support_km"), *column(support.weight_name(w, radius)))
                     for w in ("uniform", "gaussian") for radius in RADII])


@query("support_targets", "WITH " + LADDER_SQL + """
SELECT weighting, support_km, count(*) AS n, count(DISTINCT centre_id) AS n_centres, round(avg(target), 6) AS mean_target, round(stddev_pop(target), 6) AS sd_target FROM tg GROUP BY ALL""")
def support_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Observations averaged around each centre at growing support, whether or not the centre reports."""
    panel = ladder_panel(spark, sf, [], every_centre=True)
    # Centres are counted by the bits of words of 64, so that a task sends no row per centre and, other than for long bitmaps, sorts no rows.
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("centre_id", F.lit(64)).cast("int"))
    words = panel.groupBy(F.shiftright("centre_id", 6).alias("_word")).agg(*[
        total.alias(f"{name}__{w}") for w in WEIGHTS for t in [F.col(f"ref_point__{w}")]
        for name, total in (("n", F.count(t)), ("bits", F.bit_or(F.when(t.isNotNull(), bit))), ("mean", F.avg(t)), ("variance", F.var_pop(t)))])
    seen = words.select(F.inline(_supports(lambda w: [
        F.col(f"n__{w}").alias("n"), F.bit_count(f"bits__{w}").alias("n_centres"), F.col(f"mean__{w}").alias("mean"), F.col(f"variance__{w}").alias("variance")]))).where("n > 0")
    rung = Window.partitionBy("weighting", "support_km")
    seen = seen.withColumn("_gap", F.col("mean") - F.sum(F.col("mean") * F.col("n")).over(rung) / F.sum("n").over(rung))
    total = F.sum("n")
    return seen.groupBy("weighting", "support_km").agg(
        total.alias("n"), F.sum("n_centres").alias("n_centres"), r(F.sum(F.col("mean") * F.col("n")) / total).alias("mean_target"),
        r(F.sqrt(F.sum((F.col("variance") + F.col("_gap") * F.col("_gap")) * F.col("n")) / total)).alias("sd_target"))


LOSS_SQL = LADDER_SQL + """,
ls AS (SELECT weighting, support_km, model, t.valid_day, avg(abs(forecast-target)) AS mae, avg(pow(forecast-target, 2)) AS mse FROM tg t JOIN lon l ON l.station_id = t.centre_id AND l.valid_day = t.valid_day GROUP BY ALL),
sc AS (SELECT weighting, support_km, model, avg(mae) AS score FROM ls GROUP BY ALL)"""


def ladder_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Daily loss of each model against each support, one wide row per day."""
    panel = ladder_panel(spark, sf, list(d.MODELS))
    return support.support_losses(panel, "valid_day", d.MODELS, [f"ref_point__{w}" for w in WEIGHTS])


@query("support_scorecard", "WITH " + LOSS_SQL + """,
z AS (SELECT weighting, model, score AS s0 FROM sc WHERE support_km = 0),
p AS (SELECT a.weighting, a.support_km, count(*) FILTER (WHERE (a.score-b.score)*(za.s0-zb.s0) < 0) AS inv, count(*) AS pairs FROM sc a JOIN sc b ON a.weighting = b.weighting AND a.support_km = b.support_km AND a.model < b.model
      JOIN z za ON za.weighting = a.weighting AND za.model = a.model JOIN z zb ON zb.weighting = a.weighting AND zb.model = b.model GROUP BY ALL),
rk AS (SELECT sc.weighting, sc.support_km, sc.model, score, s0, rank() OVER (PARTITION BY sc.weighting, sc.support_km ORDER BY score) AS rx, rank() OVER (PARTITION BY sc.weighting, sc.support_km ORDER BY s0) AS ry,
              row_number() OVER (PARTITION BY sc.weighting, sc.support_km ORDER BY score, sc.model) AS rn FROM sc JOIN z USING (weighting, model)),
g AS (SELECT weighting, support_km, string_agg(model, '|' ORDER BY score, model) AS ranking, max(model) FILTER (WHERE rn = 1) AS winner, max(score) FILTER (WHERE rn = 1) AS s1, max(score) FILTER (WHERE rn = 2) AS s2,
             corr(rx, ry) AS rho, arg_min(model, (s0, model)) AS w0 FROM rk GROUP BY ALL)
SELECT weighting, support_km, ranking, winner, round(s1, 6) AS winner_score, round(s2, 6) AS runner_up_score, round(s2-s1, 6) AS winner_margin, round(rho, 6) AS spearman_vs_point,
       inv AS inversions_vs_point, pairs AS possible_pairs, winner <> w0 AS winner_changed FROM g JOIN p USING (weighting, support_km)""")
def support_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking, winner, margin and inversions at each support against the point ranking."""
    losses = ladder_losses(spark, sf)
    means = losses.agg(*[F.avg(f"`{m}|ref_point__{w}|mae`").alias(f"{m}|{w}") for m in d.MODELS for w in WEIGHTS])
    table = means.select(F.inline(F.flatten(F.array(*[
        _supports(lambda w, m=m: (F.lit(m).alias("model"), F.col(f"`{m}|{w}`").alias("score"))) for m in d.MODELS]))))
    card = contrast.scorecard(table, ["weighting"], "support_km", d.MODELS)
    return rounded(card, "winner_score", "runner_up_score", "winner_margin", "spearman_vs_point")


OPTIMA_SQL = "WITH " + BLUR_SQL + LADDER_SQL[len(SERIES_SQL):] + """,
ls AS (SELECT weighting, support_km, model, sigma_km, t.valid_day, avg(pow(value-target, 2)) AS mse FROM tg t JOIN blur b ON b.station_id = t.centre_id AND b.valid_day = t.valid_day WHERE weighting = 'uniform' GROUP BY ALL),
sc AS (SELECT support_km, model, sigma_km, sqrt(avg(mse)) AS rmse FROM ls GROUP BY ALL),
cal AS (SELECT valid_day, row_number() OVER (ORDER BY valid_day) - 1 AS day_idx FROM (SELECT DISTINCT valid_day FROM ls)),
""" + d.starts_sql("(SELECT count(*) FROM cal)", 2000, 7, SEED + 42) + """,
dr AS (SELECT draw, support_km, model, sigma_km, sqrt(avg(mse)) AS rmse FROM idx JOIN cal USING (day_idx) JOIN ls USING (valid_day) GROUP BY ALL),
bd AS (SELECT draw, support_km, model, arg_min(sigma_km, (round(rmse, 12), sigma_km)) AS s FROM dr GROUP BY ALL)
SELECT support_km, model, (SELECT arg_min(sigma_km, (round(rmse, 12), sigma_km)) FROM sc WHERE sc.support_km = bd.support_km AND sc.model = bd.model) AS optimal_sigma,
       round(avg(s), 6) AS bootstrap_mean, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high, round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END), 6) AS p_gt_zero
FROM bd GROUP BY support_km, model"""


@query("support_optima", OPTIMA_SQL)
def support_optima(spark: SparkSession, sf: str) -> DataFrame:
    """Best smoothing width at each support, and its bootstrap distribution."""
    columns = {(m, sigma): f"{m}__s{sigma:g}" if sigma else m for m in d.MODELS for sigma in SIGMAS}
    ladder = support.ladder_weights(RADII, ("uniform",))
    uniform = [w.name for w in ladder]
    wanted = [*[(m, blur) for m in d.MODELS for blur in BLURS], *[("ref_point", w) for w in ladder]]
    panel = neighbourhoods(spark, sf, wanted, list(d.MODELS))
    losses = support.support_losses(panel, "valid_day", list(columns.values()), [f"ref_point__{w}" for w in uniform])
    names = ["s0", "s1", "s2"]
    wide = losses.select(F.col("valid_day").alias("day"), F.inline(F.array(*[
        F.struct(F.lit(radius).alias("support_km"), F.lit(m).alias("model"),
                 *[F.col(f"`{columns[m, sigma]}|ref_point__{w}|mse`").alias(n) for n, sigma in zip(names, SIGMAS)])
        for radius, w in zip(RADII, uniform) for m in d.MODELS])))

    def best():
        return F.array_min(F.array(*[F.struct(F.round(F.sqrt(c), 12).alias("v"), F.lit(s).alias("s")) for c, s in zip(names, SIGMAS)]))["s"]

    wide = cut_lineage(wide)
    drawn = resample.unit_means(wide, ["support_km", "model"], "day", names, 2000, 7, SEED + 42).withColumn("s", best())
    point = wide.groupBy("support_km", "model").agg(*[F.avg(n).alias(n) for n in names]).select("support_km", "model", best().alias("optimal_sigma"))
    low, high = resample.interval("s")
    summary = drawn.groupBy("support_km", "model").agg(r(F.avg("s")).alias("bootstrap_mean"), r(low).alias("ci_low"), r(high).alias("ci_high"), r(resample.share(F.col("s") > 0)).alias("p_gt_zero"))
    return point.join(summary, ["support_km", "model"])


THIN_SQL = "WITH " + SERIES_SQL + """,
pr AS (SELECT target_id AS centre_id, source_id AS station_id, support_km FROM km, (SELECT unnest([1500.0, 3000.0]::DOUBLE[]) AS support_km) WHERE km <= support_km),
dw AS (SELECT pr.*, d.range AS draw, ((d.range*1000003 + centre_id*613 + CAST(support_km AS BIGINT))*7919 + station_id*104729 + {seed}) % {p} AS x FROM pr, range(0, 60) d),
y AS (SELECT *, ({px}*48271 + 11) % {p} AS y FROM dw),
rk AS (SELECT *, row_number() OVER (PARTITION BY draw, centre_id, support_km ORDER BY {py}, station_id) AS rn FROM y),
kp AS (SELECT * FROM rk WHERE rn <= 3)
SELECT CAST(draw AS BIGINT) AS draw, support_km, count(DISTINCT centre_id) AS n_centres, count(*) AS n_pairs, CAST(sum(station_id) AS BIGINT) AS station_sum, round(avg(ref_point), 6) AS mean_value
FROM kp JOIN ser USING (station_id) GROUP BY draw, support_km"""
_P = 2147483647


def _pow5(x: str) -> str:
    return f"(((({x})*({x}) % {_P}) * (({x})*({x}) % {_P}) % {_P}) * ({x}) % {_P})"


@query("support_thinning", THIN_SQL.format(seed=SEED + 43, p=_P, px=_pow5("x"), py=_pow5("y")))
def support_thinning(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed number of stations per centre and draw, so that support grows but sample size does not."""
    # Sums per station, so that a draw meets stations and not their days.
    totals = station_series(spark, sf).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ref_point").alias("total"))
    stations = d.stations(spark, sf).select("station_id", "latitude", "longitude").join(totals, "station_id", "left")
    drawn = support.thinned_totals(stations, (1500.0, 3000.0), 60, 3, SEED + 43).where("n_pairs > 0")
    return drawn.select("draw", "support_km", "n_centres", "n_pairs", "station_sum", r(F.col("total") / F.col("n_pairs")).alias("mean_value"))
