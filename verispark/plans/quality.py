"""Quality control, coverage and archive audits of the report series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import text
from ..operators import audit, contracts, rolling
from ..session import cut_lineage
from . import domain as d
from .registry import big, query, r, rounded

FLAGS_SQL = "WITH " + d.REPORTS_SQL + """,
flagged AS (SELECT *, regexp_extract(mask, '^\\[\\s*([01])', 1) = '1' AS observed, time_diff = 0 AS exact,
                   value BETWEEN 0.05 AND 20 AS plausible FROM reports)"""


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return (d.reports(spark, sf).withColumn("observed", q.mask_flag(F.col("mask")))
            .withColumn("exact", F.col("time_diff") == 0).withColumn("plausible", q.in_range(F.col("value"), 0.05, 20.0)))



def usable():
    return F.col("observed") & F.col("exact") & F.col("plausible")


VALID_SQL = FLAGS_SQL + """,
valid AS (SELECT report_id, median(value) OVER w AS med, count(value) OVER w AS n FROM flagged
          WHERE observed AND exact AND plausible
          WINDOW w AS (PARTITION BY station_id ORDER BY valid_time, report_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
qc AS (SELECT f.*, v.med, v.n, coalesce(observed AND exact AND plausible AND v.n >= 3 AND abs(value - v.med) <= 4, false) AS qc_valid
       FROM flagged f LEFT JOIN valid v USING (report_id))"""


def checked(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return rolling.rolling_quality(flagged(spark, sf), "station_id", ["valid_time", "report_id"], "value", usable(), mode)


@query("qc_valid_rows", VALID_SQL + """
SELECT report_id, round(med, 6) AS rolling_median, n AS rolling_count, qc_valid FROM qc""")
def qc_valid_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Five usable reports around each usable report."""
    out = checked(spark, sf, "valid_rows")
    return rounded(out.select("report_id", "rolling_median", "rolling_count", "qc_valid"), "rolling_median")


@query("qc_masked_rows", FLAGS_SQL + """,
m AS (SELECT report_id, value, observed AND exact AND plausible AS ok,
             median(CASE WHEN observed AND exact AND plausible THEN value END) OVER w AS med,
             count(CASE WHEN observed AND exact AND plausible THEN value END) OVER w AS n FROM flagged
      WINDOW w AS (PARTITION BY station_id ORDER BY valid_time, report_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT report_id, round(med, 6) AS rolling_median, n AS rolling_count, coalesce(ok AND n >= 3 AND abs(value-med) <= 4, false) AS qc_valid FROM m""")
def qc_masked_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Unusable reports are blanked but keep their place in the window."""
    out = checked(spark, sf, "masked_rows")
    return rounded(out.select("report_id", "rolling_median", "rolling_count", "qc_valid"), "rolling_median")


@query("qc_coverage_counts", VALID_SQL + """
SELECT station_id, count(*) AS n_rows, count(*) FILTER (WHERE observed) AS n_observed,
       count(*) FILTER (WHERE observed AND exact) AS n_exact, count(*) FILTER (WHERE qc_valid) AS n_usable,
       count(*) FILTER (WHERE NOT observed) AS n_rejected_mask, count(*) FILTER (WHERE observed AND NOT exact) AS n_rejected_time,
       count(*) FILTER (WHERE observed AND exact AND NOT plausible) AS n_rejected_range,
       count(*) FILTER (WHERE observed AND exact AND plausible AND NOT qc_valid) AS n_rejected_median
FROM qc GROUP BY station_id""")
def qc_coverage_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Expected and usable reports per station with a counter for every reason of rejection."""
    out = checked(spark, sf, "valid_rows")
    o, e, p, v = (F.col(c) for c in ("observed", "exact", "plausible", "qc_valid"))
    return out.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(o).alias("n_observed"), F.count_if(o & e).alias("n_exact"),
        F.count_if(v).alias("n_usable"), F.count_if(~o).alias("n_rejected_mask"), F.count_if(o & ~e).alias("n_rejected_time"),
        F.count_if(o & e & ~p).alias("n_rejected_range"), F.count_if(o & e & p & ~v).alias("n_rejected_median"))


@query("qc_eligible_observations", VALID_SQL + """,
cov AS (SELECT station_id, count(*) FILTER (WHERE qc_valid) AS n_usable FROM qc GROUP BY station_id)
SELECT station_id, count(*) AS n_observations, round(avg(value), 6) AS mean_value, round(max(value), 6) AS max_value
FROM qc JOIN cov USING (station_id) WHERE n_usable >= 30 AND qc_valid AND hour(valid_time) IN (0, 6, 12, 18)
GROUP BY station_id""")
def qc_eligible_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Stations with enough usable reports, their reports at the cycle hours only."""
    out = cut_lineage(checked(spark, sf, "valid_rows"))
    rich = out.groupBy("station_id").agg(F.count_if("qc_valid").alias("n_usable")).where("n_usable >= 30")
    kept = out.where(F.col("qc_valid") & F.hour("valid_time").isin(0, 6, 12, 18)).join(rich, "station_id", "left_semi")
    return kept.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_observations"), r(F.avg("value")).alias("mean_value"),
                                          r(F.max("value")).alias("max_value"))


@query("findings_station_table", "WITH " + d.INVENTORY_SQL + """,
c AS (SELECT count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS missing,
             count(*) FILTER (WHERE abs(latitude) > 90 OR abs(longitude) > 180) AS outside,
             count(*) FILTER (WHERE abs(latitude) > 90 AND abs(latitude) <= 180) AS swapped,
             count(*) FILTER (WHERE abs(latitude) < 1e-6 AND abs(longitude) < 1e-6) AS origin,
             count(*) FILTER (WHERE altitude_m IS NULL) AS zm, count(*) FILTER (WHERE altitude_m < -430 OR altitude_m > 8850) AS zi,
             count(*) FILTER (WHERE altitude_m = 0) AS zz, count(*) AS n FROM inventory)
SELECT 'coordinates_present' AS "check", CASE WHEN missing > 0 THEN 'fail' ELSE 'pass' END AS severity, missing::DOUBLE AS detail FROM c
UNION ALL SELECT 'coordinates_in_range', CASE WHEN outside > 0 THEN 'fail' ELSE 'pass' END, outside FROM c
UNION ALL SELECT 'coordinates_not_swapped', CASE WHEN swapped > 0 THEN 'fail' ELSE 'pass' END, swapped FROM c
UNION ALL SELECT 'coordinates_not_null_island', CASE WHEN origin > 0 THEN 'warn' ELSE 'pass' END, origin FROM c
UNION ALL SELECT 'elevation_present', CASE WHEN zm > 0 THEN 'fail' ELSE 'pass' END, zm FROM c
UNION ALL SELECT 'elevation_plausible', CASE WHEN zi > 0 THEN 'fail' ELSE 'pass' END, zi FROM c
UNION ALL SELECT 'elevation_not_sentinel_zero', CASE WHEN zz > n*0.02 THEN 'warn' ELSE 'pass' END, zz FROM c""")
def findings_station_table(spark: SparkSession, sf: str) -> DataFrame:
    stations = d.inventory(spark, sf)
    return audit.coordinate_findings(stations).unionByName(audit.elevation_findings(stations))


@query("findings_timestamps", "WITH " + d.REPORTS_SQL + """,
g AS (SELECT station_id, valid_time, count(*) AS n FROM reports GROUP BY ALL),
c AS (SELECT sum(n-1) AS rep, sum(CASE WHEN hour(valid_time) NOT IN (0,6,12,18) THEN n ELSE 0 END) AS odd,
             sum(CASE WHEN month(valid_time) = 2 AND day(valid_time) = 29 THEN n ELSE 0 END) AS leap,
             bool_or(year(valid_time) % 4 = 0 AND (year(valid_time) % 100 <> 0 OR year(valid_time) % 400 = 0)) AS spans FROM g)
SELECT 'timestamps_timezone_declared' AS "check", 'warn' AS severity, 0.0::DOUBLE AS detail
UNION ALL SELECT 'timestamps_unique', CASE WHEN rep > 0 THEN 'fail' ELSE 'pass' END, rep::DOUBLE FROM c
UNION ALL SELECT 'timestamps_expected_hours', CASE WHEN odd > 0 THEN 'fail' ELSE 'pass' END, odd::DOUBLE FROM c
UNION ALL SELECT 'timestamps_leap_day', CASE WHEN leap > 0 OR NOT spans THEN 'pass' ELSE 'warn' END, leap::DOUBLE FROM c""")
def findings_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return audit.timestamp_findings(d.reports(spark, sf), "valid_time", "station_id", (0, 6, 12, 18))


@query("findings_units_summary", "WITH " + d.REPORTS_SQL + """,
m AS (SELECT median(value) AS med FROM reports UNION ALL SELECT median(value + 273.15) FROM reports
      UNION ALL SELECT median(value * 10) + 40 FROM reports),
f AS (SELECT CASE WHEN med IS NULL THEN 'unknown' WHEN med > 150 AND med < 350 THEN 'fail' WHEN med > 40 AND med <= 150 THEN 'fail'
                  ELSE 'pass' END AS severity FROM m)
SELECT count(*) FILTER (WHERE severity = 'pass') AS n_pass, count(*) FILTER (WHERE severity = 'warn') AS n_warn,
       count(*) FILTER (WHERE severity = 'fail') AS n_fail, count(*) FILTER (WHERE severity = 'unknown') AS n_unknown,
       count(*) FILTER (WHERE severity = 'fail') = 0 AS passed FROM f""")
def findings_units_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The unit heuristic on the series as it is, in kelvin and in a warm Fahrenheit-like scale."""
    reports = d.reports(spark, sf)
    series = [reports.select("value"), reports.select((F.col("value") + 273.15).alias("value")),
              reports.select((F.col("value") * 10 + 40).alias("value"))]
    findings = [audit.temperature_unit_finding(s, "value") for s in series]
    return audit.summarise(findings[0].unionByName(findings[1]).unionByName(findings[2]))


@query("conflict_dedup", "WITH " + d.REPORTS_SQL + """,
h AS (SELECT station_id, date_trunc('hour', valid_time) AS hour, report_id, value, event_type, k FROM reports),
g AS (SELECT *, max(value) OVER (PARTITION BY station_id, hour) - min(value) OVER (PARTITION BY station_id, hour) AS spread,
             row_number() OVER (PARTITION BY station_id, hour ORDER BY k, report_id) AS rn FROM h)
SELECT station_id, CAST(hour AS VARCHAR) AS hour, report_id, round(value, 6) AS value FROM g WHERE spread <= 2.0 AND rn = 1""")
def conflict_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of one hour that disagree are dropped; of the others the best ranked stays."""
    hourly = d.reports(spark, sf).select("station_id", F.date_trunc("hour", "valid_time").alias("hour"), "report_id", "value", "k")
    kept = audit.conflict_dedup(hourly, ["station_id", "hour"], "value", 2.0, ["k", "report_id"])
    return kept.select("station_id", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "report_id", r("value").alias("value"))


@query("post_write_audit", "WITH " + d.REPORTS_SQL + """,
g AS (SELECT station_id, date_trunc('hour', valid_time) AS t, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS miss,
             count(*) FILTER (WHERE hour(valid_time) NOT IN (0, 12)) AS hrs, count(*) FILTER (WHERE year(valid_time) <> 2024) AS yrs
      FROM reports GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(sum(miss) AS BIGINT) AS missing_values,
       CAST(sum(hrs) AS BIGINT) AS rows_with_invalid_hour, CAST(sum(yrs) AS BIGINT) AS rows_outside_year,
       strftime(min(t), '%Y-%m-%d %H') AS first_time, strftime(max(t), '%Y-%m-%d %H') AS last_time FROM g""")
def post_write_audit(spark: SparkSession, sf: str) -> DataFrame:
    hourly = d.reports(spark, sf).select("station_id", F.date_trunc("hour", "valid_time").alias("t"), "value")
    out = audit.post_write_audit(hourly, ["station_id", "t"], "t", "value", (0, 12), 2024)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH") for c in ("first_time", "last_time")})


@query("filter_ranges_and_hours", "WITH " + d.REPORTS_SQL + """
SELECT hour(valid_time) AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM reports
WHERE value BETWEEN 1 AND 10 AND hour(valid_time) IN (0, 12) AND valid_time >= TIMESTAMP '2024-01-05' AND valid_time < TIMESTAMP '2024-01-25'
GROUP BY 1""")
def filter_ranges_and_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Range, hour membership and half-open window predicates; the window reaches the scan."""
    t = F.col("valid_time")
    window = (t >= F.lit("2024-01-05").cast("timestamp_ntz")) & (t < F.lit("2024-01-25").cast("timestamp_ntz"))
    kept = d.reports(spark, sf).where(q.in_range(F.col("value"), 1.0, 10.0) & F.hour(t).isin(0, 12) & window)
    return kept.groupBy(F.hour(t).cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))


@query("sentinel_and_masking", "WITH " + d.REPORTS_SQL + """,
s AS (SELECT station_id, value, k, coalesce(k = 0 AND time_diff = 0, false) AS offline FROM reports)
SELECT station_id, count(*) FILTER (WHERE offline) AS n_offline, count(CASE WHEN NOT offline THEN value END) AS n_kept,
       round(avg(CASE WHEN NOT offline THEN value END), 6) AS mean_kept FROM s GROUP BY station_id""")
def sentinel_and_masking(spark: SparkSession, sf: str) -> DataFrame:
    """All-zero channels mean an offline logger; its value is masked, not dropped."""
    marked = d.reports(spark, sf).withColumn("offline", q.all_zero(F.col("k"), F.col("time_diff")))
    kept = q.keep_where(F.col("value"), ~F.col("offline"))
    return marked.groupBy("station_id").agg(F.count_if("offline").alias("n_offline"), F.count(kept).alias("n_kept"),
                                            r(F.avg(kept)).alias("mean_kept"))


@query("duplicate_audit", """
SELECT count(*) AS n_rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_repeats,
       (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n_repeated_keys,
       (SELECT CAST(max(n) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS largest FROM lineitem""")
def duplicate_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Rows minus distinct keys, keys held twice, and the worst key: one pre-aggregated pass."""
    keys = d.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return big(keys.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_repeats"),
                        F.count_if(F.col("n") > 1).alias("n_repeated_keys"), F.max("n").alias("largest")),
               "n_rows", "n_repeats", "n_repeated_keys", "largest")


@query("constancy_check", """
SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1""")
def constancy_check(spark: SparkSession, sf: str) -> DataFrame:
    """Groups in which a value that should be constant varies."""
    return contracts.varying_within(d.table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus")


@query("identifier_cleaning", """
SELECT source, count(*) AS n, count(*) FILTER (WHERE id IS NULL) AS n_empty, count(DISTINCT id) AS n_ids, min(id) AS first_id,
       count(*) FILTER (WHERE lower(trim(lang)) IN ('1','true','yes','y','si','sí')) AS n_true
FROM (SELECT source, lang, CASE WHEN upper(trim(source || ' ' || lang)) IN ('','NA','N/A','NONE','NAN','NULL','-999') THEN NULL
      ELSE replace(upper(trim(source || ' ' || lang)), ' ', '') END AS id FROM documents) GROUP BY source""")
def identifier_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    raw = d.table(spark, sf, "documents").select(
        "source", text.clean_identifier(F.concat_ws(" ", "source", "lang")).alias("id"), text.truthy(F.col("lang")).alias("yes"))
    return raw.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull()).alias("n_empty"), F.count_distinct("id").alias("n_ids"),
        F.min("id").alias("first_id"), F.count_if("yes").alias("n_true"))


@query("qc_tied_times", """
WITH e AS (SELECT user_id, date_trunc('day', ts) AS t, value FROM events),
w AS (SELECT user_id, median(value) OVER p AS m, count(value) OVER p AS n
      FROM e WINDOW p AS (PARTITION BY user_id ORDER BY t, value ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT user_id, count(*) AS n_reports, CAST(sum(n) AS BIGINT) AS n_near, round(sum(m), 6) AS sum_of_medians FROM w GROUP BY user_id""")
def qc_tied_times(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling medians ordered by time alone where many reports share a time: each counts, smaller values first."""
    events = d.table(spark, sf, "events").select("user_id", F.date_trunc("day", "ts").alias("t"), "value")
    rolled = rolling.centred_median(events, "user_id", ["t"], "value", bucket="month")
    return rolled.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_reports"), F.sum("rolling_count").alias("n_near"),
                                         r(F.sum("rolling_median")).alias("sum_of_medians"))
