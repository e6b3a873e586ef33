"""Reference effects inside further strata, scores after a height correction, and cells as units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import quality, strata
from ..operators import neighbours, order_stats, panel
from ..session import cut_lineage
from . import domain as d
from .places import BANDS, CELLS_SQL
from .registry import query, r, rounded
from .resampling import SEED, _stratum_effect_sql, stratum_effect

CELL_TABLES = CELLS_SQL.removeprefix("WITH ")
# A coast along a meridian of short segments, in the plane of degrees.
COAST_LONGITUDE, COAST_LIMIT_KM = 10.0, 4000.0


@query("stratum_effects_by_density", _stratum_effect_sql(
    "CASE WHEN n_in_cell >= 2 THEN 'shared_cell' ELSE 'single_station_cell' END", 2000, 7, SEED + 51, "placed", ", " + CELL_TABLES + """,
gn AS (SELECT cell_id, count(*) AS n_in_cell FROM cells GROUP BY cell_id),
placed AS (SELECT c.*, n_in_cell FROM common c JOIN cells USING (station_id) JOIN gn USING (cell_id))"""))
def stratum_effects_by_density(spark: SparkSession, sf: str) -> DataFrame:
    """Stations that share their cell against those that are alone in it."""
    placed = d.stations(spark, sf).select("station_id", BANDS.cell_id(F.col("latitude"), F.col("longitude")).alias("cell_id"))
    sizes = placed.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_in_cell"))
    where = placed.join(sizes, "cell_id").select("station_id", strata.density_stratum(F.col("n_in_cell")).alias("density"))
    return stratum_effect(d.common_panel(spark, sf).join(where, "station_id"), "density", 2000, 7, SEED + 51)


@query("stratum_effects_by_cycle", _stratum_effect_sql(
    "'cycle_' || lpad(CAST((((hour(valid_time) + 6*(station_id % 4) - lead_h) % 24) + 24) % 24 AS VARCHAR), 2, '0')", 2000, 7, SEED + 52))
def stratum_effects_by_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts by the hour of their initialisation: valid hour, shifted by a station's offset, minus the lead."""
    hour = F.hour("valid_time") + 6 * (F.col("station_id") % 4)
    cycle = F.concat(F.lit("cycle_"), F.lpad(cal.cycle_hour(hour, F.col("lead_h")).cast("string"), 2, "0"))
    return stratum_effect(d.common_panel(spark, sf).withColumn("cycle", cycle), "cycle", 2000, 7, SEED + 52)


@query("stratum_effects_by_regime", _stratum_effect_sql("'quartile_' || quartile", 2000, 7, SEED + 53, "placed", """,
rg AS (SELECT valid_day, avg(ref_point) AS regime FROM common GROUP BY ALL),
re AS (SELECT quantile_cont(regime, [0.25, 0.5, 0.75]) AS q FROM rg),
rb AS (SELECT valid_day, 1 + (regime > q[1])::INT + (regime > q[2])::INT + (regime > q[3])::INT AS quartile FROM rg, re),
placed AS (SELECT c.*, quartile FROM common c JOIN rb USING (valid_day))"""))
def stratum_effects_by_regime(spark: SparkSession, sf: str) -> DataFrame:
    """Days by the quartile of their regime; each quartile has its own calendar."""
    cases = d.common_panel(spark, sf)
    days = cut_lineage(cases.groupBy("valid_day").agg(F.avg("ref_point").alias("regime")))
    binned = order_stats.quantile_bins(days, [], "regime", 4, "quartile").select("valid_day", F.concat(F.lit("quartile_"), F.col("quartile").cast("string")).alias("regime_quartile"))
    return stratum_effect(cases.join(binned, "valid_day"), "regime_quartile", 2000, 7, SEED + 53)


@query("stratum_effects_by_coast", _stratum_effect_sql(f"CASE WHEN km <= {COAST_LIMIT_KM} THEN 'coast' ELSE 'interior' END", 2000, 7, SEED + 54, "placed", ", " + d.STATIONS_SQL + f""",
sg AS (SELECT n_nationkey*6.0::DOUBLE - 75 AS y0, (n_nationkey+1)*6.0::DOUBLE - 75 AS y1 FROM nation),
cd AS (SELECT station_id, min(sqrt(pow(longitude-{COAST_LONGITUDE}, 2) + pow(greatest(0, y0-latitude, latitude-y1), 2)))*111.0 AS km FROM stations, sg GROUP BY station_id),
placed AS (SELECT c.*, km FROM common c JOIN cd USING (station_id))"""))
def stratum_effects_by_coast(spark: SparkSession, sf: str) -> DataFrame:
    """Stations near a coast line of many segments against those inland."""
    south = F.col("n_nationkey") * F.lit(6.0) - 75
    metres = 111_000.0
    coast = d.table(spark, sf, "nation").select(F.lit(COAST_LONGITUDE * metres).alias("ax"), (south * metres).alias("ay"), F.lit(COAST_LONGITUDE * metres).alias("bx"), ((south + 6) * metres).alias("by"))
    points = d.stations(spark, sf).select("station_id", (F.col("longitude") * metres).alias("x"), (F.col("latitude") * metres).alias("y"))
    where = neighbours.nearest_segment_km(points, coast, "station_id").select("station_id", strata.coast_stratum(F.col("distance_km"), COAST_LIMIT_KM).alias("coast"))
    return stratum_effect(d.common_panel(spark, sf).join(where, "station_id"), "coast", 2000, 7, SEED + 54)


@query("lapse_rate_rescoring", CELLS_SQL + ", " + d.PANEL_SQL + """,
gz AS (SELECT cell_id, avg(altitude_m) AS grid_z FROM cells GROUP BY cell_id),
m AS (SELECT station_id, altitude_m - grid_z AS dz FROM cells JOIN gz USING (cell_id)),
t AS (SELECT unnest([100.0, 1000.0, 3000.0, 1e9]::DOUBLE[]) AS limit_m),
l AS (SELECT c.station_id, valid_day, k.model, k.f, ref_point, ref_grid, 6.5*dz/1000 AS shift, limit_m
      FROM common c JOIN m USING (station_id) JOIN t ON abs(dz) < limit_m, LATERAL (VALUES ('alpha', alpha), ('beta', beta), ('gamma', gamma)) k(model, f)),
dy AS (SELECT limit_m, model, valid_day, avg(abs(f-ref_point)) AS raw_point, avg(abs(f-shift-ref_point)) AS moved_point, avg(abs(ref_grid-ref_point)) AS raw_reference,
         avg(abs(ref_grid-shift-ref_point)) AS moved_reference, count(*) AS n FROM l GROUP BY ALL)
SELECT limit_m, model, count(*) AS n_days, CAST(sum(n) AS BIGINT) AS n_cases, round(avg(raw_point), 6) AS mae, round(avg(moved_point), 6) AS mae_adjusted, round(avg(raw_reference), 6) AS grid_mae,
  round(avg(moved_reference), 6) AS grid_mae_adjusted, rank() OVER (PARTITION BY limit_m ORDER BY round(avg(raw_point), 9)) AS mae_rank, rank() OVER (PARTITION BY limit_m ORDER BY round(avg(moved_point), 9)) AS mae_rank_adjusted
FROM dy GROUP BY limit_m, model""")
def lapse_rate_rescoring(spark: SparkSession, sf: str) -> DataFrame:
    """Every model and the gridded reference moved to the height of the station by a lapse rate, and scored again under nested limits on the mismatch."""
    from ..operators import score
    placed = d.stations(spark, sf).withColumn("cell_id", BANDS.cell_id(F.col("latitude"), F.col("longitude")))
    heights = placed.groupBy("cell_id").agg(F.avg("altitude_m").alias("grid_z"))
    dz = placed.join(heights, "cell_id").select("station_id", (F.col("altitude_m") - F.col("grid_z")).alias("dz"))
    cases = panel.to_long(d.common_panel(spark, sf).join(dz, "station_id"), d.MODELS, "model", "forecast")
    limits = F.array(*[F.lit(v) for v in (100.0, 1000.0, 3000.0, 1e9)])
    kept = cases.withColumn("limit_m", F.explode(F.filter(limits, lambda v: F.abs("dz") < v)))
    point, grid = F.col("ref_point"), F.col("ref_grid")
    def moved(c: str):
        return quality.lapse_adjusted(F.col(c), 6.5, F.col("dz"))
    daily = kept.groupBy("limit_m", "model", "valid_day").agg(
        F.avg(F.abs(F.col("forecast") - point)).alias("mae"), F.avg(F.abs(moved("forecast") - point)).alias("mae_adjusted"), F.avg(F.abs(grid - point)).alias("grid_mae"),
        F.avg(F.abs(moved("ref_grid") - point)).alias("grid_mae_adjusted"), F.count(F.lit(1)).alias("n"))
    names = ["mae", "mae_adjusted", "grid_mae", "grid_mae_adjusted"]
    means = daily.groupBy("limit_m", "model").agg(F.count(F.lit(1)).alias("n_days"), F.sum("n").alias("n_cases"), *[F.avg(n).alias(n) for n in names])
    ranked = means.withColumns({f"_{n}": F.round(n, 9) for n in names[:2]})
    ranks = [score.min_rank(["limit_m"], f"_{n}").alias(f"{n.replace('mae', 'mae_rank', 1)}") for n in names[:2]]
    return rounded(ranked.select("limit_m", "model", "n_days", "n_cases", *names, *ranks), *names)


@query("cell_representativeness", "WITH " + d.PANEL_SQL + """,
ce AS (SELECT s_suppkey AS station_id, s_nationkey AS cell FROM supplier),
a AS (SELECT cell, valid_day, avg(ref_point) AS obs, avg(ref_grid) AS grid, avg(alpha) AS alpha, avg(beta) AS beta, avg(gamma) AS gamma, count(DISTINCT station_id) AS n
      FROM common JOIN ce USING (station_id) GROUP BY ALL HAVING count(DISTINCT station_id) >= 2),
l AS (SELECT a.*, k.model, k.f FROM a, LATERAL (VALUES ('alpha', alpha), ('beta', beta), ('gamma', gamma)) k(model, f))
SELECT cell, model, count(*) AS n_days, round(avg(abs(f-obs)), 6) AS cell_mae, round(avg(abs(f-grid)), 6) AS grid_mae, round(avg(abs(grid-obs)), 6) AS reference_gap,
  round(avg(abs(f-obs)) - avg(abs(f-grid)), 6) AS effect, CAST(max(n) AS BIGINT) AS most_stations FROM l GROUP BY cell, model""")
def cell_representativeness(spark: SparkSession, sf: str) -> DataFrame:
    """Stations averaged to their cell before every model is scored against them and against the grid value; cells with one station drop out."""
    cells = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("station_id"), F.col("s_nationkey").alias("cell"))
    means = d.common_panel(spark, sf).join(cells, "station_id").groupBy("cell", "valid_day").agg(
        F.avg("ref_point").alias("obs"), F.avg("ref_grid").alias("grid"), *[F.avg(m).alias(m) for m in d.MODELS], F.count_distinct("station_id").alias("n")).where("n >= 2")
    long = panel.to_long(means, d.MODELS, "model", "f")
    f, obs, grid = F.col("f"), F.col("obs"), F.col("grid")
    out = long.groupBy("cell", "model").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg(F.abs(f - obs)).alias("cell_mae"), F.avg(F.abs(f - grid)).alias("grid_mae"), F.avg(F.abs(grid - obs)).alias("reference_gap"),
        (F.avg(F.abs(f - obs)) - F.avg(F.abs(f - grid))).alias("effect"), F.max("n").alias("most_stations"))
    return rounded(out, "cell_mae", "grid_mae", "reference_gap", "effect")
