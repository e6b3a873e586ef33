"""Gridded fields: interpolation, kernels, roughness, circular supports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernel, resample
from . import domain as d
from .registry import query, r, rounded

SIGMAS = (400.0, 800.0)
KERNEL_SQL = d.FIELDS_SQL + ", " + d.GRID_SQL + ", " + d.SITES_IN_GRID_SQL + f""",
pairs AS (SELECT target_id, source_id, g.latitude AS glat, {d.haversine_sql('t', 'g')} AS km FROM sites t, grid g),
raw AS (SELECT target_id, sigma_km, source_id, exp(-0.5*pow(km/sigma_km, 2))*greatest(cos(radians(glat)), 0) AS w
        FROM pairs, (SELECT unnest([400.0, 800.0]::DOUBLE[]) AS sigma_km) WHERE km <= 4*sigma_km),
weights AS (SELECT target_id, sigma_km, source_id, w/sum(w) OVER (PARTITION BY target_id, sigma_km) AS weight FROM raw),
means AS (SELECT label, lat_idx*8+lon_idx AS source_id, avg(value) AS value FROM fields GROUP BY ALL)"""


def weights(spark: SparkSession, sf: str) -> DataFrame:
    return kernel.kernel_weights(d.sites_in_grid(spark, sf), d.grid_points(spark, sf), SIGMAS)


def mean_fields(spark: SparkSession, sf: str) -> DataFrame:
    return d.field_cells(spark, sf).groupBy("label", (F.col("lat_idx") * 8 + F.col("lon_idx")).alias("source_id")).agg(F.avg("value").alias("value"))


@query("kernel_weights", "WITH " + KERNEL_SQL + """
SELECT target_id, sigma_km, CAST(source_id AS BIGINT) AS source_id, round(weight, 9) AS weight FROM weights""")
def kernel_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussian quadrature weights of every station over the grid."""
    return weights(spark, sf).select("target_id", "sigma_km", F.col("source_id").cast("bigint").alias("source_id"), r("weight", 9).alias("weight"))


@query("kernel_diagnostics", "WITH " + KERNEL_SQL + """,
rows_ AS (SELECT sigma_km, target_id, count(*) AS n, sum(weight) AS s FROM weights GROUP BY ALL)
SELECT sigma_km, count(*) AS targets, CAST(sum(n) AS BIGINT) AS nonzero_weights, min(n) AS min_neighbours, median(n) AS median_neighbours,
       max(n) AS max_neighbours, max(abs(s-1)) < 1e-12 AS row_sums_are_one, round(exp(-8.0), 9) AS omitted_mass_bound FROM rows_ GROUP BY sigma_km""")
def kernel_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    out = kernel.kernel_diagnostics(weights(spark, sf))
    return out.select("sigma_km", "targets", "nonzero_weights", "min_neighbours", "median_neighbours", "max_neighbours",
                      (F.col("max_row_sum_error") < 1e-12).alias("row_sums_are_one"), r("omitted_mass_bound", 9).alias("omitted_mass_bound"))


@query("kernel_smoothing", "WITH " + KERNEL_SQL + """
SELECT label, target_id, sigma_km, round(sum(weight*value), 9) AS smoothed, round(sqrt(greatest(sum(weight*value*value) - pow(sum(weight*value), 2), 0)), 9) AS heterogeneity
FROM weights JOIN means USING (source_id) GROUP BY ALL""")
def kernel_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and spread of each field under the kernel: two weighted sums of one join."""
    w = weights(spark, sf)
    fields = mean_fields(spark, sf).withColumn("square", F.col("value") * F.col("value"))
    first = kernel.apply_kernel(w, fields, ["label"], "value")
    second = kernel.apply_kernel(w, fields, ["label"], "square", name="second")
    both = first.join(second, ["label", "target_id", "sigma_km"])
    spread = F.sqrt(F.greatest(F.col("second") - F.col("smoothed") * F.col("smoothed"), F.lit(0.0)))
    return both.select("label", "target_id", "sigma_km", r("smoothed", 9).alias("smoothed"), r(spread, 9).alias("heterogeneity"))


BILINEAR_SQL = d.FIELDS_SQL + ", " + d.TARGETS_SQL + """,
pos AS (SELECT target_id, (latitude-30)/5 AS y, longitude/5 AS x, CAST(least(6, greatest(0, ceil((latitude-30)/5)-1)) AS INTEGER) AS i,
               CAST(least(6, greatest(0, ceil(longitude/5)-1)) AS INTEGER) AS j FROM targets),
bil AS (SELECT f.time_id, f.label, p.target_id,
        sum(value * CASE WHEN lat_idx = i THEN 1-(y-i) WHEN lat_idx = i+1 THEN y-i ELSE 0 END
                  * CASE WHEN lon_idx = j THEN 1-(x-j) WHEN lon_idx = j+1 THEN x-j ELSE 0 END) AS v
        FROM fields f, pos p GROUP BY ALL)"""


@query("field_bilinear", "WITH " + BILINEAR_SQL + " SELECT time_id, target_id, round(v, 9) AS interpolated FROM bil")
def field_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    """Every field at every target: four corners named by arithmetic."""
    out = kernel.bilinear(d.field_cells(spark, sf), d.grid_targets(spark, sf), ["time_id"], "value", 30.0, 5.0, 8, 0.0, 5.0, 8)
    return out.select("time_id", "target_id", r("interpolated", 9).alias("interpolated"))


@query("field_nearest_index", "WITH " + d.SITES_IN_GRID_SQL + """,
a AS (SELECT target_id, i.range AS i, 30+5.0*i.range AS c, round(abs(30+5.0*i.range-latitude), 9) AS g FROM sites, range(0, 8) i),
b AS (SELECT target_id, i.range AS i, 5.0*i.range AS c, round(abs(5.0*i.range-longitude), 9) AS g FROM sites, range(0, 8) i)
SELECT target_id, (SELECT arg_min(i, (g, -c)) FROM a WHERE a.target_id = s.target_id) AS lat_idx, (SELECT arg_min(i, (g, -c)) FROM b WHERE b.target_id = s.target_id) AS lon_idx FROM sites s""")
def field_nearest_index(spark: SparkSession, sf: str) -> DataFrame:
    """Closest grid cell of every station, ties to the higher coordinate."""
    return d.sites_in_grid(spark, sf).select(
        "target_id", kernel.nearest_index(F.col("latitude"), kernel.regular_axis(30.0, 5.0, 8)).cast("bigint").alias("lat_idx"),
        kernel.nearest_index(F.col("longitude"), kernel.regular_axis(0.0, 5.0, 8), circular=True).cast("bigint").alias("lon_idx"))


@query("field_orientation_window", "WITH " + d.FIELDS_SQL + """
SELECT time_id, count(*) AS n_inside, round(sum((7-lat_idx)*value), 6) AS flipped, round(sum(lon_idx*value), 6) AS columns FROM fields
WHERE 30+5.0*lat_idx BETWEEN 35 AND 60 AND 5.0*lon_idx BETWEEN 5 AND 25 GROUP BY time_id""")
def field_orientation_window(spark: SparkSession, sf: str) -> DataFrame:
    """A descending, transposed store brought to (latitude, longitude) order, cut to a domain."""
    cells = d.field_cells(spark, sf)
    stored = cells.select("time_id", "value", F.col("lon_idx").alias("lat_idx"), F.col("lat_idx").alias("lon_idx"))
    upright = kernel.ascending_grid(stored, 8, 8, transposed=True)
    flipped = kernel.ascending_grid(upright, 8, 8, latitude_descends=True)
    lat, lon = 30 + 5.0 * (7 - F.col("lat_idx")), 5.0 * F.col("lon_idx")
    inside = flipped.where(lat.between(35, 60) & lon.between(5, 25))
    return inside.groupBy("time_id").agg(F.count(F.lit(1)).alias("n_inside"), r(F.sum(F.col("lat_idx") * F.col("value"))).alias("flipped"),
                                         r(F.sum(F.col("lon_idx") * F.col("value"))).alias("columns"))


CELL_KM, CELL_KM_LON = 555.0, 400.0
PLANAR_SQL = "WITH " + d.FIELDS_SQL + """,
sg AS (SELECT unnest([300.0, 600.0]::DOUBLE[]) AS sigma_km),
ax AS (SELECT sigma_km, 'lat' AS axis, sigma_km/555.0 AS s FROM sg UNION ALL SELECT sigma_km, 'lon', sigma_km/400.0 FROM sg),
o AS (SELECT sigma_km, axis, s, o.range AS o, exp(-0.5*pow(o.range/s, 2)) AS w FROM ax, range(-12, 13) o WHERE abs(o.range) <= CAST(floor(4*s+0.5) AS BIGINT)),
wn AS (SELECT *, w/sum(w) OVER (PARTITION BY sigma_km, axis) AS wn FROM o),
m AS (SELECT sigma_km, axis, i.range AS i, least(7, greatest(0, i.range+o)) AS k, sum(wn) AS w FROM wn, range(0, 8) i GROUP BY ALL),
half AS (SELECT f.time_id, f.label, m.sigma_km, m.i AS lat_idx, f.lon_idx, sum(m.w*f.value) AS v FROM fields f JOIN m ON m.axis = 'lat' AND m.k = f.lat_idx GROUP BY ALL),
sm AS (SELECT h.time_id, h.label, h.sigma_km, h.lat_idx, m.i AS lon_idx, sum(m.w*h.v) AS v FROM half h JOIN m ON m.axis = 'lon' AND m.sigma_km = h.sigma_km AND m.k = h.lon_idx GROUP BY ALL)"""


@query("field_planar_roughness", PLANAR_SQL + """
SELECT f.time_id, s.sigma_km, round(stddev_pop(f.value - s.v), 9) AS roughness, round(stddev_pop(f.value), 9) AS domain_sd
FROM sm s JOIN fields f ON f.time_id = s.time_id AND f.lat_idx = s.lat_idx AND f.lon_idx = s.lon_idx
WHERE f.lat_idx BETWEEN 2 AND 5 AND f.lon_idx BETWEEN 2 AND 5 GROUP BY ALL""")
def field_planar_roughness(spark: SparkSession, sf: str) -> DataFrame:
    """Residual of a Gaussian filter that is isotropic in kilometres, inside the core of each patch."""
    smooth = kernel.planar_smooth(d.field_rows(spark, sf), "field", 8, 8, (300.0, 600.0), CELL_KM, CELL_KM_LON, ["time_id", "label"])
    return rounded(kernel.patch_structure(smooth, ["time_id"], 8, 8, 2), "roughness", "domain_sd", digits=9)


@query("field_mean_gradient", "WITH " + d.FIELDS_SQL + """,
n AS (SELECT a.time_id, avg(abs(b.value-a.value))/555.0*100 AS g FROM fields a JOIN fields b ON a.time_id = b.time_id AND b.lat_idx = a.lat_idx+1 AND b.lon_idx = a.lon_idx
      WHERE a.lat_idx BETWEEN 2 AND 5 AND a.lon_idx BETWEEN 2 AND 5 GROUP BY 1),
e AS (SELECT a.time_id, avg(abs(b.value-a.value))/400.0*100 AS g FROM fields a JOIN fields b ON a.time_id = b.time_id AND b.lat_idx = a.lat_idx AND b.lon_idx = a.lon_idx+1
      WHERE a.lat_idx BETWEEN 2 AND 5 AND a.lon_idx BETWEEN 2 AND 5 GROUP BY 1)
SELECT time_id, round((n.g+e.g)/2, 9) AS mean_gradient_per_100km FROM n JOIN e USING (time_id)""")
def field_mean_gradient(spark: SparkSession, sf: str) -> DataFrame:
    wide = d.field_rows(spark, sf).withColumn("field", F.transform("field", lambda x: x.cast("double")))
    return rounded(kernel.mean_gradient(wide, "field", ["time_id"], 8, 8, 2, CELL_KM, CELL_KM_LON), "mean_gradient_per_100km", digits=9)


@query("field_roughness_by_cell_day", "WITH " + BILINEAR_SQL + ", " + d.GRID_SQL + f""",
p AS (SELECT target_id, source_id, g.latitude AS glat, {d.haversine_sql('t', 'g')} AS km FROM targets t, grid g),
rw AS (SELECT target_id, source_id, exp(-0.5*pow(km/600.0, 2))*greatest(cos(radians(glat)), 0) AS w FROM p WHERE km <= 2400),
ws AS (SELECT target_id, source_id, w/sum(w) OVER (PARTITION BY target_id) AS weight FROM rw),
sm AS (SELECT time_id, target_id, sum(weight*value) AS s FROM fields f JOIN ws ON ws.source_id = f.lat_idx*8+f.lon_idx GROUP BY ALL)
SELECT label, target_id, count(*) AS n_cycles, round(sqrt(avg(pow(v-s, 2))), 9) AS roughness FROM bil JOIN sm USING (time_id, target_id) GROUP BY ALL""")
def field_roughness_by_cell_day(spark: SparkSession, sf: str) -> DataFrame:
    """Root mean square of value minus smoothed value per model and target."""
    cells, targets = d.field_cells(spark, sf), d.grid_targets(spark, sf)
    raw = kernel.bilinear(cells, targets, ["time_id", "label"], "value", 30.0, 5.0, 8, 0.0, 5.0, 8)
    w = kernel.kernel_weights(targets, d.grid_points(spark, sf), [600.0])
    flat = cells.withColumn("source_id", F.col("lat_idx") * 8 + F.col("lon_idx"))
    smooth = kernel.apply_kernel(w, flat, ["time_id"], "value")
    gap = F.col("interpolated") - F.col("smoothed")
    return raw.join(smooth, ["time_id", "target_id"]).groupBy("label", "target_id").agg(
        F.count(F.lit(1)).alias("n_cycles"), r(F.sqrt(F.avg(gap * gap)), 9).alias("roughness"))


HALF_WIDTHS = (0, 2, 4, 8)
CIRCULAR_SQL = """
ring AS (SELECT vec_id AS time_id, label, CAST(pos-1 AS BIGINT) AS g, CAST(v AS DOUBLE) AS x
         FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
hw AS (SELECT unnest([0, 2, 4, 8]) AS h), wt AS (SELECT unnest(['uniform', 'gaussian']) AS weighting),
ker AS (SELECT weighting, h, o.range AS o, CASE WHEN h = 0 OR weighting = 'uniform' THEN 1.0::DOUBLE ELSE exp(-0.5*pow(o.range/(h/2.0), 2)) END AS w
        FROM hw, wt, range(-8, 9) o WHERE abs(o.range) <= h),
kn AS (SELECT weighting, h, o, w/sum(w) OVER (PARTITION BY weighting, h) AS w FROM ker),
sup AS (SELECT r.time_id, r.label, weighting, h AS half_width, (r.g - o + 64) % 64 AS g, sum(w*x) AS target FROM ring r, kn GROUP BY ALL)"""


def circular(spark: SparkSession, sf: str, weightings: tuple[str, ...] = ("uniform", "gaussian")) -> DataFrame:
    return kernel.circular_support(d.field_rows(spark, sf), "field", ["time_id", "label"], HALF_WIDTHS, weightings)


@query("circular_support", "WITH " + CIRCULAR_SQL + """
SELECT s.label, s.weighting, CAST(s.half_width AS BIGINT) AS half_width, round(avg(target*target), 9) AS second_moment, round(avg(abs(r.x-target)), 9) AS mean_gap
FROM sup s JOIN ring r USING (time_id, g) GROUP BY ALL""")
def circular_support(spark: SparkSession, sf: str) -> DataFrame:
    """Circular averages of every periodic field at growing supports."""
    points = circular(spark, sf).select("label", "weighting", "half_width", F.inline(F.arrays_zip(F.col("field").alias("x"), F.col("target").alias("t"))))
    return points.toDF("label", "weighting", "half_width", "x", "t").groupBy("label", "weighting", F.col("half_width").cast("bigint").alias("half_width")).agg(
        r(F.avg(F.col("t") * F.col("t")), 9).alias("second_moment"), r(F.avg(F.abs(F.col("x") - F.col("t"))), 9).alias("mean_gap"))


DEFICITS, GAINS = (0.0, 0.2, 0.4, 0.6), (0.0, 0.25, 0.5, 1.0)
PHASE_SQL = "WITH " + CIRCULAR_SQL + """,
u AS (SELECT time_id, g, half_width, target FROM sup WHERE weighting = 'uniform'),
pt AS (SELECT r.time_id, r.g, l.target AS large, r.x - l.target AS fine FROM ring r JOIN u l ON l.time_id = r.time_id AND l.g = r.g AND l.half_width = 4),
dg AS (SELECT d.d, g.gain FROM (SELECT unnest([0.0, 0.2, 0.4, 0.6]::DOUBLE[]) AS d) d, (SELECT unnest([0.0, 0.25, 0.5, 1.0]::DOUBLE[]) AS gain) g),
sc AS (SELECT d, gain, u.half_width, sqrt(avg(pow((1-d)*large + gain*fine - u.target, 2))) AS sharp, sqrt(avg(pow(large - u.target, 2))) AS broad
       FROM pt JOIN u USING (time_id, g), dg GROUP BY ALL),
v AS (SELECT avg(large*large) AS vl, avg(fine*fine) AS vf FROM pt),
fl AS (SELECT d, gain, max(sharp) FILTER (WHERE half_width = 0) AS s0, max(broad) FILTER (WHERE half_width = 0) AS b0,
              min(half_width) FILTER (WHERE half_width > 0 AND broad < sharp - 1e-12) AS flip FROM sc GROUP BY ALL)
SELECT d AS deficit, gain, s0 < b0 - 1e-12 AS sharp_wins_at_point, CAST(CASE WHEN s0 < b0 - 1e-12 THEN flip END AS BIGINT) AS flip_support,
       s0 < b0 - 1e-12 AND flip IS NOT NULL AS reversal_observed, d*d*vl < gain*(2-gain)*vf - 1e-15 AS analytic_flip_expected,
       round(s0, 6) AS rmse_sharp_point, round(b0, 6) AS rmse_broad_point FROM fl, v"""


@query("phase_diagram", PHASE_SQL)
def phase_diagram(spark: SparkSession, sf: str) -> DataFrame:
    """When does averaging the target turn a win of fine detail into a loss?

    The squared error is quadratic in the two forecast parameters, so the data
    are read once for six second moments per support and the whole parameter
    grid is algebra on that small table.
    """
    base = circular(spark, sf, ("uniform",))
    large = base.where("half_width = 4").select("time_id", F.col("target").alias("large"))
    zipped = base.join(large, "time_id").select("half_width", F.inline(F.arrays_zip(
        F.col("field").alias("x"), F.col("target").alias("t"), F.col("large").alias("l"))).alias("x", "t", "l"))
    lrg, fine, t = F.col("l"), F.col("x") - F.col("l"), F.col("t")
    terms = {"ll": lrg * lrg, "ff": fine * fine, "tt": t * t, "lf": lrg * fine, "lt": lrg * t, "ft": fine * t}
    moments = zipped.groupBy("half_width").agg(*[F.avg(e).alias(k) for k, e in terms.items()])
    grid = F.array(*[F.struct(F.lit(dd).alias("deficit"), F.lit(g).alias("gain")) for dd in DEFICITS for g in GAINS])
    cells = moments.select("*", F.inline(grid))
    a, g = 1 - F.col("deficit"), F.col("gain")
    sharp = F.sqrt(F.greatest(F.lit(0.0), a * a * F.col("ll") + g * g * F.col("ff") + F.col("tt") + 2 * a * g * F.col("lf")
                              - 2 * a * F.col("lt") - 2 * g * F.col("ft")))
    broad = F.sqrt(F.greatest(F.lit(0.0), F.col("ll") + F.col("tt") - 2 * F.col("lt")))
    scored = cells.withColumn("sharp", sharp).withColumn("broad", broad)
    at_point = F.col("half_width") == 0
    table = scored.groupBy("deficit", "gain").agg(
        F.max(F.when(at_point, F.col("sharp"))).alias("s0"), F.max(F.when(at_point, F.col("broad"))).alias("b0"),
        F.min(F.when(~at_point & (F.col("broad") < F.col("sharp") - 1e-12), F.col("half_width"))).alias("flip"),
        F.max("ll").alias("vl"), F.max("ff").alias("vf"))
    wins = F.col("s0") < F.col("b0") - 1e-12
    return table.select(
        "deficit", "gain", wins.alias("sharp_wins_at_point"), F.when(wins, F.col("flip").cast("bigint")).alias("flip_support"),
        (wins & F.col("flip").isNotNull()).alias("reversal_observed"),
        (F.col("deficit") * F.col("deficit") * F.col("vl") < F.col("gain") * (2 - F.col("gain")) * F.col("vf") - 1e-15).alias("analytic_flip_expected"),
        r("s0").alias("rmse_sharp_point"), r("b0").alias("rmse_broad_point"))


STABILITY_MODELS = {"sharp": (0.3, 1.0), "mid": (0.15, 0.5), "broad": (0.0, 0.0)}
STABILITY_SQL = "WITH " + CIRCULAR_SQL + """,
u AS (SELECT time_id, g, half_width, target FROM sup WHERE weighting = 'gaussian'),
pt AS (SELECT r.time_id, r.g, l.target AS large, r.x - l.target AS fine FROM ring r JOIN u l ON l.time_id = r.time_id AND l.g = r.g AND l.half_width = 4),
mo AS (SELECT * FROM (VALUES ('sharp', 0.3, 1.0), ('mid', 0.15, 0.5), ('broad', 0.0, 0.0)) m(model, d, gain)),
loss AS (SELECT time_id, half_width, model, avg(pow((1-d)*large + gain*fine - u.target, 2)) AS mse FROM pt JOIN u USING (time_id, g), mo GROUP BY ALL),
daily AS (SELECT *, dense_rank() OVER (ORDER BY time_id) - 1 AS day_idx FROM loss),
""" + d.starts_sql("(SELECT count(DISTINCT time_id) FROM daily)", 2000, 5, 77) + """,
dr AS (SELECT draw, half_width, model, avg(mse) AS s FROM idx JOIN daily USING (day_idx) GROUP BY ALL),
wn AS (SELECT draw, half_width, arg_min(model, s) AS winner FROM dr GROUP BY ALL),
pp AS (SELECT half_width, model, avg(mse) AS s FROM daily GROUP BY ALL),
pw AS (SELECT half_width, arg_min(model, s) AS winner, string_agg(model, '|' ORDER BY s) AS ranking FROM pp GROUP BY 1)
SELECT CAST(w.half_width AS BIGINT) AS half_width, p.winner AS point_winner, p.ranking AS point_ranking,
       p.winner <> (SELECT winner FROM pw WHERE half_width = 0) AS winner_changed,
       round(avg(CASE WHEN w.winner <> z.winner THEN 1.0 ELSE 0.0 END), 6) AS p_winner_changed
FROM wn w JOIN wn z ON z.draw = w.draw AND z.half_width = 0 JOIN pw p ON p.half_width = w.half_width GROUP BY ALL"""


@query("support_rank_stability", STABILITY_SQL)
def support_rank_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Does the ranking at the point survive a wider target, and how surely?"""
    from ..operators.contrast import best_of
    base = circular(spark, sf, ("gaussian",))
    large = base.where("half_width = 4").select("time_id", F.col("target").alias("large"))
    cells = base.join(large, "time_id").select("time_id", "half_width", F.inline(F.arrays_zip(
        F.col("field").alias("x"), F.col("target").alias("t"), F.col("large").alias("l"))).alias("x", "t", "l"))
    losses = []
    for h in HALF_WIDTHS:
        for m, (deficit, gain) in STABILITY_MODELS.items():
            error = (1 - deficit) * F.col("l") + gain * (F.col("x") - F.col("l")) - F.col("t")
            losses.append(F.avg(F.when(F.col("half_width") == h, error * error)).alias(f"h{h}__{m}"))
    daily = cells.groupBy("time_id").agg(*losses)
    names = [f"h{h}__{m}" for h in HALF_WIDTHS for m in STABILITY_MODELS]
    drawn = resample.block_bootstrap(daily, [], "time_id", names, 2000, 5, 77)
    models = list(STABILITY_MODELS)
    point = daily.agg(*[F.avg(n).alias(n) for n in names])

    def ranking(h: int):
        return F.array_join(F.transform(F.array_sort(F.array(*[F.struct(F.col(f"h{h}__{m}").alias("s"), F.lit(m).alias("m")) for m in models])), lambda e: e["m"]), "|")

    winners = point.select(F.inline(F.array(*[F.struct(
        F.lit(h).cast("bigint").alias("half_width"), best_of(models, f"h{h}").alias("point_winner"), ranking(h).alias("point_ranking"),
        (best_of(models, f"h{h}") != best_of(models, "h0")).alias("winner_changed")) for h in HALF_WIDTHS])))
    changed = drawn.agg(*[resample.share(best_of(models, f"h{h}") != best_of(models, "h0")).alias(f"p{h}") for h in HALF_WIDTHS])
    shares = changed.select(F.inline(F.array(*[F.struct(F.lit(h).cast("bigint").alias("half_width"), r(f"p{h}").alias("p_winner_changed")) for h in HALF_WIDTHS])))
    return winners.join(shares, "half_width")
