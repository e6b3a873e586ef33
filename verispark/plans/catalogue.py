"""Relational building blocks: scans, projections, joins, aggregates, windows, set operations, sorts, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import geo
from ..functions import quality as q
from ..functions import strata, text
from ..operators import contracts, contrast, order_stats, panel, score
from ..session import scratch_path
from ..sources import records, reports, tables
from . import domain as d
from .registry import big, day_text, query, r, rounded

# --- scans and sinks ------------------------------------------------------------------------------


@query("scan_pushdown", """
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_discount BETWEEN 0.02 AND 0.08 GROUP BY l_returnflag""")
def scan_pushdown(spark: SparkSession, sf: str) -> DataFrame:
    """Only four columns and the row groups of two years leave the scan."""
    df = tables.read_table(spark, f"{sf}/lineitem.parquet")
    kept = df.where((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
                    & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")) & F.col("l_discount").between(0.02, 0.08))
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 4).alias("quantity"))


@query("scan_hive_partitions", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type""")
def scan_hive_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """A table laid out in folders per type; the predicate prunes folders."""
    path = scratch_path(spark, "events-by-type")
    tables.write_table(d.table(spark, sf, "events").select("event_id", "value", "event_type"), path, partition_by=["event_type"])
    df = tables.read_table(spark, path, base_path=path).where(F.col("event_type").isin("view", "click"))
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))


@query("scan_union_by_name", """
SELECT kind, count(*) AS n, count(balance) AS n_balance, count(segment) AS n_segment, round(sum(balance), 4) AS total FROM (
  SELECT 'supplier' AS kind, s_acctbal AS balance, NULL AS segment FROM supplier
  UNION ALL SELECT 'customer', c_acctbal, c_mktsegment FROM customer) GROUP BY kind""")
def scan_union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose columns differ are read as one relation."""
    left, right = scratch_path(spark, "union-a"), scratch_path(spark, "union-b")
    tables.write_table(d.table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance")), left)
    tables.write_table(d.table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"),
                                                             F.col("c_acctbal").alias("balance")), right)
    df = tables.read_union_by_name(spark, left, right)
    return df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("balance").alias("n_balance"),
                                  F.count("segment").alias("n_segment"), r(F.sum("balance"), 4).alias("total"))


@query("scan_csv_key_from_path", """
SELECT user_id AS station_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY user_id""")
def scan_csv_key_from_path(spark: SparkSession, sf: str) -> DataFrame:
    """One CSV folder per station, the key taken from the path, an explicit schema."""
    path = scratch_path(spark, "station-csv")
    source = d.table(spark, sf, "events").select("event_id", "value", F.col("user_id").alias("station"))
    reports.write_station_csv(source, path, "station")
    df = reports.read_station_csv(spark, path, "event_id bigint, value double", key_pattern=r"station=([^/]+)/")
    return df.groupBy(F.col("station_id").cast("bigint").alias("station_id")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))


@query("scan_sorted_roundtrip", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def scan_sorted_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted ZSTD table, written once and reread; a second call would reuse it."""
    path = scratch_path(spark, "orders-sorted")
    source = d.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    tables.materialise(source, path, sort_by=["o_orderdate", "o_orderkey"])
    back = tables.materialise(source, path)
    return back.groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("scan_views_and_parameters", """
WITH staged AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 1000)
SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM staged JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def scan_views_and_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Relations passed by name into SQL with bound parameters."""
    staged = spark.sql("SELECT o_custkey, o_totalprice FROM {o} WHERE array_contains(:kinds, o_orderpriority) AND o_totalprice > :low",
                       args={"kinds": ["1-URGENT", "2-HIGH"], "low": 1000}, o=d.table(spark, sf, "orders"))
    return spark.sql("SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM {s} JOIN {c} ON o_custkey = c_custkey GROUP BY ALL",
                     s=staged, c=d.table(spark, sf, "customer"))


@query("table_fingerprint", """
SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(sha256(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus), 1, 12)) AS BIGINT)) AS VARCHAR) AS row_hash_sum FROM orders""")
def table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return records.table_fingerprint(d.table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


# --- text archives, on lines rendered from the event table -----------------------------------------


@query("parse_semicolon_reports", """
SELECT user_id AS station_id, region, count(*) AS n, count(value) FILTER (WHERE event_type <> 'error') AS n_values,
       round(sum(CASE WHEN event_type <> 'error' THEN value END), 4) AS total, strftime(max(ts), '%Y-%m-%d %H') AS last_time
FROM (SELECT *, 'R' || user_id AS region FROM events) GROUP BY ALL""")
def parse_semicolon_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Semicolon files with a preamble, decimal commas and bad values, rebuilt line by line."""
    events = d.table(spark, sf, "events")
    shown = F.when(F.col("event_type") == "error", "").otherwise(F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(",")))
    body = events.select(F.col("user_id").cast("string").alias("path"), F.concat_ws(
        ";", F.date_format("ts", "yyyy/MM/dd"), F.date_format("ts", "HHmm 'UTC'"), shown).alias("line"))
    stations = events.select("user_id").distinct()
    head = stations.select(F.col("user_id").cast("string").alias("path"), F.explode(F.array(
        F.concat(F.lit("REGION:;R"), F.col("user_id")), F.concat(F.lit("CODE:;"), F.col("user_id")), F.lit("Day;Hour UTC;VALUE"))).alias("line"))
    lines = body.unionByName(head)
    meta = reports.parse_preamble(lines)
    data = reports.parse_semicolon_reports(lines, 0, 1, 2)
    joined = data.join(meta, "path")
    return joined.groupBy(F.col("path").cast("bigint").alias("station_id"), F.col("preamble")["REGION"].alias("region")).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), r(F.sum("value"), 4).alias("total"),
        F.date_format(F.max("valid_time"), "yyyy-MM-dd HH").alias("last_time"))


@query("parse_badc_reports", """
SELECT user_id AS station_id, event_type AS met_domain_name, count(*) AS n, round(sum(value), 4) AS total, CAST(min(event_id) AS BIGINT) AS first_src
FROM events GROUP BY ALL""")
def parse_badc_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose column order differs; each file's own header row finds the columns."""
    events = d.table(spark, sf, "events")
    odd = F.col("user_id") < 75
    stamp, shown = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.format_string("%.2f", "value")
    path = F.col("user_id").cast("string").alias("path")
    body = events.select(path, F.when(odd, F.concat_ws(",", stamp, "event_id", "event_type", shown))
                         .otherwise(F.concat_ws(",", stamp, shown, "event_type", "event_id")).alias("line"))
    head = events.select("user_id").distinct().select(path, F.explode(F.array(
        F.lit("Conventions,G,BADC-CSV,1"), F.concat(F.lit("native_station_id,G,"), F.col("user_id")), F.lit("data"),
        F.when(odd, "ob_time,src_id,met_domain_name,air_temperature").otherwise("ob_time,air_temperature,met_domain_name,src_id"),
        F.lit("end data"))).alias("line"))
    lines = body.unionByName(head)
    ids = reports.parse_badc_metadata(lines).where("name = 'native_station_id' AND position = 0").select("path", F.col("value").alias("native"))
    data = reports.parse_badc_reports(lines, ["ob_time", "src_id", "met_domain_name", "air_temperature"]).join(ids, "path")
    return data.groupBy(F.col("native").cast("bigint").alias("station_id"), "met_domain_name").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(text.number_or_null(F.col("air_temperature"))), 4).alias("total"),
        F.min(F.col("src_id").cast("bigint")).alias("first_src"))


@query("parse_fixed_stations", "WITH " + d.STATIONS_SQL + """
SELECT lpad(CAST(station_id AS VARCHAR), CAST(greatest(5, length(CAST(station_id AS VARCHAR))) AS INTEGER), '0') AS native_station_id, round(altitude_m, 2) AS altitude_m, round(latitude, 2) AS latitude,
       round(longitude, 2) AS longitude, 'Old ' || network || ' Hill' AS station_name, 'S' || region AS state, '1990-01-15' AS open_date FROM stations""")
def parse_fixed_stations(spark: SparkSession, sf: str) -> DataFrame:
    """Whitespace-aligned station list with blanks inside names, below two header lines."""
    stations = d.stations(spark, sf)
    line = F.concat_ws("   ", geo.padded(F.col("station_id"), 5), F.lit("19900115"), F.lit("20201231"),
                       F.format_string("%.2f", "altitude_m"), F.format_string("%.2f", "latitude"), F.format_string("%.2f", "longitude"),
                       F.concat(F.lit("Old "), "network", F.lit(" Hill")), F.concat(F.lit("S"), "region"))
    lines = stations.select(F.lit("list").alias("path"), line.alias("line")).unionByName(stations.agg(
        F.lit("list").alias("path"), F.concat(F.lit("Stations: "), F.count(F.lit(1)).cast("string")).alias("line")))
    out = reports.parse_fixed_stations(lines)
    return out.select("native_station_id", "altitude_m", "latitude", "longitude", "station_name", "state", day_text("open_date").alias("open_date"))


@query("parse_product_lines", """
SELECT lpad(CAST(user_id AS VARCHAR), CAST(greatest(5, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') AS native_station_id, count(*) AS n, count(*) FILTER (WHERE value > 20) AS n_quality,
       round(avg(value), 6) AS mean, strftime(min(ts), '%Y-%m-%d %H') AS first_time FROM events GROUP BY ALL""")
def parse_product_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Padded semicolon rows with a quality level and hour stamps."""
    lines = d.table(spark, sf, "events").select(F.lit("p").alias("path"), F.concat_ws(
        ";", F.lpad(F.col("user_id").cast("string"), 11, " "), F.date_format("ts", "yyyyMMddHH"),
        F.lpad(F.when(F.col("value") > 20, "3").otherwise("1"), 5, " "), F.format_string("  %.2f", "value"), F.lit("eor")).alias("line"))
    out = reports.parse_product_lines(lines, 0, 1, 2, 3)
    return out.groupBy("native_station_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("qc_level") >= 2).alias("n_quality"), r(F.avg("value")).alias("mean"),
        F.date_format(F.min("valid_time"), "yyyy-MM-dd HH").alias("first_time"))


# --- projections and predicates --------------------------------------------------------------------


@query("proj_errors", "WITH " + d.PANEL_SQL + """
SELECT network, round(avg(abs(alpha-ref_point)), 6) AS mae, round(avg(pow(alpha-ref_grid, 2)), 6) AS mse, round(avg(beta-ref_grid), 6) AS bias,
       round(avg((alpha-32)*5/9+273.15-273.15), 6) AS c, round(avg(beta*1000*0.01), 6) AS hpa, round(avg(gamma/3.6), 6) AS ms,
       round(avg(alpha/9.80665), 6) AS metres, round(avg(sqrt(alpha*alpha+beta*beta)), 6) AS speed FROM common GROUP BY network""")
def proj_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Error shapes and unit conversions in one projection."""
    a, b, c = F.col("alpha"), F.col("beta"), F.col("gamma")
    cases = d.common_panel(spark, sf)
    errors = [cases_col for kind in ("absolute", "squared", "signed") for cases_col in panel.error_columns(("alpha", "beta"), d.REFERENCES, kind)]
    absolute, squared, signed = errors[0], errors[6], errors[11]
    return cases.groupBy("network").agg(
        r(F.avg(absolute)).alias("mae"), r(F.avg(squared)).alias("mse"), r(F.avg(signed)).alias("bias"),
        r(F.avg(q.kelvin_to_celsius((a - 32) * 5 / 9 + 273.15))).alias("c"), r(F.avg(q.pascal_to_hpa(b * 1000))).alias("hpa"),
        r(F.avg(q.kmh_to_ms(c))).alias("ms"), r(F.avg(q.geopotential_to_metres(a))).alias("metres"), r(F.avg(q.wind_speed(a, b))).alias("speed"))


@query("proj_rename_exclude", """
SELECT s_suppkey, s_acctbal AS "sigma_12.5km", n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def proj_rename_exclude(spark: SparkSession, sf: str) -> DataFrame:
    """Everything except named columns, and a name with a dot."""
    joined = d.table(spark, sf, "supplier").join(d.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kept = joined.drop("s_name", "s_nationkey", "n_nationkey", "n_name")
    return kept.withColumnRenamed("s_acctbal", "sigma_12.5km").select("s_suppkey", F.col("`sigma_12.5km`"), "n_regionkey")


@query("complete_cases", "WITH " + d.PANEL_SQL + """
SELECT lead_h, (SELECT count(*) FROM panel p WHERE p.lead_h = c.lead_h) AS n_all, count(*) AS n_complete FROM common c GROUP BY lead_h""")
def complete_cases(spark: SparkSession, sf: str) -> DataFrame:
    wide = d.wide_panel(spark, sf)
    whole = wide.groupBy("lead_h").agg(F.count(F.lit(1)).alias("n_all"))
    kept = panel.complete_cases(wide, [*d.MODELS, *d.REFERENCES]).groupBy("lead_h").agg(F.count(F.lit(1)).alias("n_complete"))
    return whole.join(kept, "lead_h")


@query("in_subquery_sample", """
SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10) GROUP BY l_suppkey""")
def in_subquery_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A deterministic sample of ten stations as a semi-join; the sample is the feature."""
    best = d.table(spark, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select(F.col("s_suppkey").alias("l_suppkey"))
    return d.table(spark, sf, "lineitem").join(best, "l_suppkey", "left_semi").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("scalar_subqueries", """
SELECT (SELECT count(*) FROM events) AS n_rows, (SELECT count(DISTINCT user_id) FROM events) AS n_stations,
       (SELECT strftime(min(ts), '%Y-%m-%d') FROM events) AS first_day, (SELECT round(max(value), 6) FROM events WHERE event_type = 'view') AS max_view""")
def scalar_subqueries(spark: SparkSession, sf: str) -> DataFrame:
    """Several scalars of one relation are one aggregate, not several scans."""
    return d.table(spark, sf, "events").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_stations"), day_text(F.min("ts")).alias("first_day"),
        r(F.max(F.when(F.col("event_type") == "view", F.col("value")))).alias("max_view"))


@query("segment_overlap", """
SELECT year, count(*) AS n_active, count(*) FILTER (WHERE last IS NULL) AS n_open FROM (
  SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first, CASE WHEN max(o_orderdate) < TIMESTAMP '2001-01-01' THEN CAST(max(o_orderdate) AS DATE) END AS last
  FROM orders GROUP BY o_custkey), (SELECT unnest([1996, 1999, 2001]) AS year)
WHERE first <= make_date(year, 12, 31) AND (last IS NULL OR last >= make_date(year, 1, 1)) GROUP BY year""")
def segment_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that touch a year; an open end is a token in the text."""
    spans = d.table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first"), F.max("o_orderdate").alias("m"))
    shown = F.when(F.col("m") < F.lit("2001-01-01").cast("timestamp_ntz"), day_text("m")).otherwise("9999-99-99")
    spans = spans.withColumn("last", cal.open_ended_date(shown))
    flags = F.array(*[F.when(cal.overlaps_year(F.col("first"), F.col("last"), y), F.lit(y)) for y in (1996, 1999, 2001)])
    active = spans.select("last", F.explode(F.array_compact(flags)).alias("year"))
    return active.groupBy("year").agg(F.count(F.lit(1)).alias("n_active"), F.count_if(F.col("last").isNull()).alias("n_open"))


@query("scalar_text", """
SELECT doc_id, length(text) AS n_chars, length(regexp_extract(text, '([A-Za-z]+)', 1)) AS first_word,
       len(string_split(text, ' ')) AS n_words, upper(trim(lang)) AS lang, lpad(CAST(doc_id AS VARCHAR), CAST(greatest(6, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS padded,
       'b' || lpad(CAST(doc_id % 180 AS VARCHAR), CAST(greatest(3, length(CAST(doc_id % 180 AS VARCHAR))) AS INTEGER), '0') || 's' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS code,
       TRY_CAST(replace(source, ',', '.') AS DOUBLE) AS number, regexp_matches(text, '[0-9]{3}') AS has_digits, sha256(text) AS digest,
       concat_ws('|', lang, source) AS joined FROM documents""")
def scalar_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text functions over whole documents."""
    key = F.col("doc_id").cast("string")
    return d.table(spark, sf, "documents").select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"),
        F.length(F.regexp_extract("text", "([A-Za-z]+)", 1)).cast("bigint").alias("first_word"),
        F.size(F.split("text", " ")).cast("bigint").alias("n_words"), F.upper(F.trim("lang")).alias("lang"), geo.padded(key, 6).alias("padded"),
        F.concat(F.lit("b"), geo.padded((F.col("doc_id") % 180), 3), F.lit("s"), geo.padded(key, 4)).alias("code"),
        text.decimal_comma(F.col("source")).alias("number"), F.col("text").rlike("[0-9]{3}").alias("has_digits"), F.sha2("text", 256).alias("digest"),
        F.concat_ws("|", "lang", "source").alias("joined"))


@query("scalar_time", "WITH " + d.REPORTS_SQL + """
SELECT report_id, CAST(hour(valid_time) AS BIGINT) AS h, CAST(minute(valid_time) AS BIGINT) AS mi, CAST(year(valid_time) AS BIGINT) AS y,
       strftime(valid_time, '%Y-%m-%d') AS day, CASE WHEN month(valid_time) IN (12,1,2) THEN 'DJF' WHEN month(valid_time) IN (3,4,5) THEN 'MAM'
       WHEN month(valid_time) IN (6,7,8) THEN 'JJA' ELSE 'SON' END AS season, strftime(valid_time + INTERVAL 36 HOUR, '%Y-%m-%d %H') AS plus_lead,
       strftime(valid_time - INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M') AS window_end, CAST(((hour(valid_time) - 36) % 24 + 24) % 24 AS BIGINT) AS cycle,
       strftime(TIMESTAMP '2000-01-01' + k * INTERVAL 6 HOUR, '%Y-%m-%d %H') AS decoded, round(k*30/60.0, 6) AS lead_hours FROM reports""")
def scalar_time(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("valid_time")
    return d.reports(spark, sf).select(
        "report_id", F.hour(t).cast("bigint").alias("h"), F.minute(t).cast("bigint").alias("mi"), F.year(t).cast("bigint").alias("y"),
        day_text(cal.valid_day(t)).alias("day"), cal.season(t).alias("season"), F.date_format(cal.add_hours(t, F.lit(36)), "yyyy-MM-dd HH").alias("plus_lead"),
        F.date_format(t - F.make_dt_interval(mins=F.lit(10)), "yyyy-MM-dd HH:mm").alias("window_end"),
        cal.cycle_hour(F.hour(t), F.lit(36)).cast("bigint").alias("cycle"),
        F.date_format(cal.decode_offset(F.col("k") * 6, "hours", "2000-01-01 00:00:00"), "yyyy-MM-dd HH").alias("decoded"),
        r(cal.lead_to_hours(F.col("k") * 30, "minutes")).alias("lead_hours"))


@query("scalar_arrays", """
SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total,
       CAST(list_position(embedding, list_min(embedding)) - 1 AS BIGINT) AS argmin, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax,
       round(CAST(list_sort(embedding)[1] AS DOUBLE), 6) AS lowest, round(CAST(list_max(embedding) AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE), 6) AS spread,
       len(list_distinct(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE)*20) AS BIGINT)))) AS n_levels FROM embeddings""")
def scalar_arrays(spark: SparkSession, sf: str) -> DataFrame:
    wide = F.transform("embedding", lambda x: x.cast("double"))
    low, high = F.array_min("embedding"), F.array_max("embedding")
    return d.table(spark, sf, "embeddings").select(
        "vec_id", F.size("embedding").cast("bigint").alias("n"), r(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x)).alias("total"),
        (F.array_position("embedding", low) - 1).alias("argmin"), (F.array_position("embedding", high) - 1).alias("argmax"),
        r(F.sort_array("embedding")[0].cast("double")).alias("lowest"), r(high.cast("double") - low.cast("double")).alias("spread"),
        F.size(F.array_distinct(F.transform(wide, lambda x: F.floor(x * 20)))).cast("bigint").alias("n_levels"))


# --- joins --------------------------------------------------------------------------------------------


@query("join_inner_left", """
SELECT o_orderpriority, count(*) AS n_orders, count(l_orderkey) AS n_lines, count(*) FILTER (WHERE l_orderkey IS NULL) AS n_without
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def join_inner_left(spark: SparkSession, sf: str) -> DataFrame:
    """Left join that keeps orders without a large line, and a covariate lookup."""
    large = d.table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_orderkey").distinct()
    joined = d.table(spark, sf, "orders").join(large, "o_orderkey", "left").join(
        d.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.count("l_orderkey").alias("n_lines"),
                                                 F.count_if(F.col("l_orderkey").isNull()).alias("n_without"))


@query("join_checked", """
SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def join_checked(spark: SparkSession, sf: str) -> DataFrame:
    """many-to-one join whose right key is proven unique first."""
    customers = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = contracts.checked_join(d.table(spark, sf, "orders"), customers, ["o_custkey"], "many_to_one")
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("join_guarded", """
SELECT n_name, count(*) AS n, round(sum(s_acctbal), 4) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def join_guarded(spark: SparkSession, sf: str) -> DataFrame:
    """The same guarantee checked inside the job."""
    names = d.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    joined = contracts.guarded_join(d.table(spark, sf, "supplier"), names, ["s_nationkey"])
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), r(F.sum("s_acctbal"), 4).alias("total"))


@query("join_semi_anti", """
SELECT 'with' AS side, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def join_semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    wanted = d.table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    customers = d.table(spark, sf, "customer")
    sides = [customers.join(wanted, "c_custkey", how).agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))
             for name, how in (("with", "left_semi"), ("without", "left_anti"))]
    return sides[0].unionByName(sides[1])


@query("join_common_cases", """
WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events),
k AS (SELECT user_id, day FROM e GROUP BY ALL HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events))
SELECT user_id, count(*) AS n_days, strftime(min(day), '%Y-%m-%d') AS first_day FROM k GROUP BY user_id""")
def join_common_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Station-days on which every model is present."""
    events = d.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    kept = panel.common_cases(events, ["user_id", "day"], "event_type")
    return kept.groupBy("user_id").agg(F.count_distinct("day").alias("n_days"), day_text(F.min("day")).alias("first_day"))


@query("join_common_support", """
WITH h AS (SELECT user_id % 10 AS cell, CAST(ts AS DATE) AS day, event_type, CASE WHEN avg(value) < 60 THEN avg(value) END AS err, CASE WHEN max(value) > 10 THEN max(value) END AS rough FROM events GROUP BY ALL),
f AS (SELECT * FROM h WHERE err IS NOT NULL AND rough IS NOT NULL), k AS (SELECT cell, day FROM f GROUP BY ALL HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events))
SELECT event_type, count(*) AS n, count(DISTINCT cell) AS n_cells, round(avg(err), 9) AS err, round(avg(rough), 9) AS rough FROM f JOIN k USING (cell, day) GROUP BY ALL""")
def join_common_support(spark: SparkSession, sf: str) -> DataFrame:
    """Cell-days at which every model has every column."""
    value = F.col("value")
    cells = d.table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("cell"), F.to_date("ts").alias("day"), "event_type").agg(F.avg(value).alias("m"), F.max(value).alias("x"))
    cells = cells.select("cell", "day", "event_type", F.when(F.col("m") < 60, F.col("m")).alias("err"), F.when(F.col("x") > 10, F.col("x")).alias("rough"))
    kept = panel.common_support(cells, ["cell", "day"], ["err", "rough"], "event_type")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell").alias("n_cells"), r(F.avg("err"), 9).alias("err"), r(F.avg("rough"), 9).alias("rough"))


@query("join_panel_assembly", """
WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, avg(value) AS v FROM events GROUP BY ALL),
w AS (SELECT user_id, day, """ + ", ".join(f"max(v) FILTER (WHERE event_type = '{m}') AS {m}" for m in d.EVENT_TYPES) + """ FROM h GROUP BY ALL),
o AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS obs FROM events GROUP BY ALL),
s AS (SELECT s_suppkey AS user_id, s_nationkey AS cell, s_acctbal AS altitude_m FROM supplier),
g AS (SELECT cell, CAST(ts AS DATE) AS day, avg(value) AS grid FROM events JOIN s USING (user_id) GROUP BY ALL)
SELECT user_id, strftime(w.day, '%Y-%m-%d') AS day, """ + ", ".join(f"round({m}, 6) AS {m}" for m in d.EVENT_TYPES) + """,
  round(obs, 6) AS obs, s.cell, round(altitude_m, 6) AS altitude_m, round(grid, 6) AS grid
FROM w JOIN o USING (user_id, day) LEFT JOIN s USING (user_id) LEFT JOIN g ON g.cell = s.cell AND g.day = w.day""")
def join_panel_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Wide panel of every model from long parts, beside the observation of the station-day, the station and the mean of its grid cell."""
    events = d.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("d"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    wide = panel.to_wide(events, ["user_id", "d"], "event_type", list(d.EVENT_TYPES), "value")
    observed = events.groupBy("user_id", "d").agg(F.avg("k").alias("obs"))
    stations = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("cell"), F.col("s_acctbal").alias("altitude_m"))
    grid = events.join(stations, "user_id").groupBy("cell", "d").agg(F.avg("value").alias("grid"))
    placed = contracts.checked_join(wide.join(observed, ["user_id", "d"]), stations, ["user_id"], "many_to_one", "left").join(grid, ["cell", "d"], "left")
    shown = [*d.EVENT_TYPES, "obs", "altitude_m", "grid"]
    return rounded(placed.select("user_id", day_text("d").alias("day"), "cell", *shown), *shown)


@query("join_lead_shift", """
WITH f AS (SELECT o_custkey % 10 AS cell, o_orderdate AS init_time, 24*(o_orderkey % 7 + 1) AS lead_h, o_totalprice/1000 AS alpha FROM orders),
o AS (SELECT l_suppkey % 10 AS cell, l_shipdate AS valid_time, avg(l_extendedprice)/1000 AS obs FROM lineitem GROUP BY ALL)
SELECT lead_h, count(*) AS n, round(avg(abs(alpha-obs)), 6) AS mae FROM f JOIN o ON o.cell = f.cell AND o.valid_time = f.init_time + f.lead_h * INTERVAL 1 HOUR GROUP BY lead_h""")
def join_lead_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of one table meet the observations of another at initialisation plus lead: an equi-join on a derived time."""
    forecasts = d.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 10).alias("cell"), F.col("o_orderdate").alias("init_time"), (24 * (F.col("o_orderkey") % 7 + 1)).alias("lead_h"), (F.col("o_totalprice") / 1000).alias("alpha"))
    observed = d.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("cell"), F.col("l_shipdate").alias("valid_time")).agg((F.avg("l_extendedprice") / 1000).alias("obs"))
    joined = panel.with_valid_time(forecasts).join(observed, ["cell", "valid_time"])
    return joined.groupBy("lead_h").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.abs(F.col("alpha") - F.col("obs")))).alias("mae"))


@query("join_shared_times", """
WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders INTERSECT SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'A'
           INTERSECT SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R')
SELECT CAST(year(d) AS BIGINT) AS y, count(*) AS n FROM t GROUP BY 1""")
def join_shared_times(spark: SparkSession, sf: str) -> DataFrame:
    """Days available in every source."""
    lines = d.table(spark, sf, "lineitem")
    axes = [d.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))]
    axes += [lines.where(F.col("l_returnflag") == flag).select(F.to_date("l_shipdate").alias("d")) for flag in ("A", "N", "R")]
    return panel.shared_times(axes, "d").groupBy(F.year("d").cast("bigint").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("join_priority_fallback", "WITH " + d.LONG_SQL + """,
m AS (SELECT s_suppkey AS station_id, 'site' || s_nationkey AS site_id, CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1 END AS network_rank FROM supplier),
k AS (SELECT site_id, l.*, row_number() OVER (PARTITION BY site_id, model, valid_time ORDER BY network_rank, station_id, lead_h, forecast) AS rn FROM long l JOIN m USING (station_id)),
d AS (SELECT * FROM k WHERE rn = 1),
c AS (SELECT site_id, valid_time FROM d GROUP BY ALL HAVING count(DISTINCT model) = 3)
SELECT model, count(*) AS n, count(DISTINCT site_id) AS n_sites, CAST(sum(station_id) AS BIGINT) AS station_sum, round(avg(abs(forecast-ref_grid)), 6) AS mae
FROM d JOIN c USING (site_id, valid_time) GROUP BY model""")
def join_priority_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """One series per site: the best-ranked member that reported, then common cases."""
    members = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("station_id"), F.concat(F.lit("site"), "s_nationkey").alias("site_id"),
                                                    F.when(F.col("s_acctbal") > 5000, 0).otherwise(1).alias("network_rank"))
    # The best row of a site is found by sorting: only what the score reads is sorted.
    series = d.long_panel(spark, sf).select("station_id", "valid_time", "model", "lead_h", "forecast", "ref_grid")
    collapsed = panel.collapse_sites(series, members, priority=("network_rank", "station_id", "lead_h", "forecast"))
    common = panel.common_cases(collapsed, ["site_id", "valid_time"], "model")
    return common.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("site_id").alias("n_sites"), F.sum("station_id").alias("station_sum"),
                                       r(F.avg(F.abs(F.col("forecast") - F.col("ref_grid")))).alias("mae"))


# --- aggregates ---------------------------------------------------------------------------------------


@query("agg_hierarchical", "WITH " + d.LONG_SQL + """,
c AS (SELECT s_suppkey AS station_id, s_nationkey AS cell FROM supplier),
sd AS (SELECT model, cell, station_id, valid_day, avg(abs(forecast-ref_grid)) AS g, avg(abs(forecast-ref_point)) AS p, avg(pow(forecast-ref_grid,2)) AS g2, avg(pow(forecast-ref_point,2)) AS p2
       FROM long JOIN c USING (station_id) GROUP BY ALL),
cd AS (SELECT model, cell, valid_day, avg(g) AS g, avg(p) AS p, avg(g2) AS g2, avg(p2) AS p2 FROM sd GROUP BY ALL),
bc AS (SELECT model, cell, avg(g) AS g, avg(p) AS p, avg(g2) AS g2, avg(p2) AS p2 FROM cd GROUP BY ALL),
w AS (SELECT model, avg(g) AS g, avg(p) AS p, sqrt(avg(g2)) AS rg, sqrt(avg(p2)) AS rp, count(*) AS cells FROM bc GROUP BY model),
u AS (SELECT model, avg(g) AS ug, avg(p) AS up, count(*) AS site_days FROM sd GROUP BY model)
SELECT model, cells, site_days, round(g, 6) AS grid_mae, round(p, 6) AS point_mae, round(rg, 6) AS grid_rmse, round(rp, 6) AS point_rmse,
       round(ug, 6) AS grid_mae_unweighted, round(up, 6) AS point_mae_unweighted, round(g-p, 6) AS grid_advantage FROM w JOIN u USING (model)""")
def agg_hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    """Site-day, cell-day, cell, globe: equal weight at every level, beside the unweighted mean."""
    cells = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("station_id"), F.col("s_nationkey").alias("cell"))
    e_g, e_p = F.col("forecast") - F.col("ref_grid"), F.col("forecast") - F.col("ref_point")
    # A case is sent once, to its cell-day, and becomes a row per model there; both means of a day stay where it is.
    cases = d.common_panel(spark, sf).select("station_id", "valid_day", *d.MODELS, *d.REFERENCES).join(cells, "station_id").repartition("cell", "valid_day")
    errors = panel.to_long(cases, d.MODELS, "model", "forecast").select(
        "model", "cell", "station_id", "valid_day", F.abs(e_g).alias("g"), F.abs(e_p).alias("p"), (e_g * e_g).alias("g2"), (e_p * e_p).alias("p2"))
    values = ["g", "p", "g2", "p2"]
    site_day = score.hierarchical_mean(errors, [["model", "cell", "station_id", "valid_day"]], values)
    # The unweighted mean goes up beside the weighted one as sums over site-days, so that the cases are read once.
    means, sums = [F.avg(v).alias(v) for v in values], [F.sum(c).alias(c) for c in ("ug", "up", "site_days")]
    cell_day = site_day.groupBy("model", "cell", "valid_day").agg(*means, F.sum("g").alias("ug"), F.sum("p").alias("up"), F.count(F.lit(1)).alias("site_days"))
    cell = cell_day.groupBy("model", "cell").agg(*means, *sums)
    weighted = cell.groupBy("model").agg(*means, *sums, F.count(F.lit(1)).alias("n_units"))
    out = weighted.select(
        "model", F.col("n_units").alias("cells"), "site_days", F.col("g").alias("grid_mae"), F.col("p").alias("point_mae"), F.sqrt("g2").alias("grid_rmse"),
        F.sqrt("p2").alias("point_rmse"), (F.col("ug") / F.col("site_days")).alias("grid_mae_unweighted"), (F.col("up") / F.col("site_days")).alias("point_mae_unweighted"), (F.col("g") - F.col("p")).alias("grid_advantage"))
    return rounded(out, "grid_mae", "point_mae", "grid_rmse", "point_rmse", "grid_mae_unweighted", "point_mae_unweighted", "grid_advantage")


@query("agg_counts_filters", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT (user_id, CAST(ts AS DATE))) AS n_user_days,
       count(*) FILTER (WHERE value > 50) AS n_large, count(DISTINCT user_id) FILTER (WHERE value > 50) AS n_large_users,
       round(min(value), 6) AS lowest, round(max(value), 6) AS highest, round(avg(value), 6) AS mean, round(sqrt(avg(value*value)), 6) AS rms,
       bool_and(value >= 0) AS all_positive, bool_or(value > 300) AS any_huge FROM events GROUP BY event_type HAVING count(DISTINCT user_id) > 10""")
def agg_counts_filters(spark: SparkSession, sf: str) -> DataFrame:
    df = d.table(spark, sf, "events").withColumn("user_day", F.struct("user_id", F.to_date("ts")))
    large = F.col("value") > 50
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("user_day").alias("n_user_days"),
        F.count_if(large).alias("n_large"), F.count_distinct(F.when(large, F.col("user_id"))).alias("n_large_users"), r(F.min("value")).alias("lowest"),
        r(F.max("value")).alias("highest"), r(F.avg("value")).alias("mean"), r(F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("rms"),
        F.bool_and(F.col("value") >= 0).alias("all_positive"), F.bool_or(F.col("value") > 300).alias("any_huge")).where("n_users > 10")


@query("agg_spread_quantiles", """
SELECT l_returnflag, l_linestatus, round(stddev_samp(l_extendedprice), 4) AS sd, round(stddev_pop(l_extendedprice), 4) AS sd_pop, round(quantile_cont(l_extendedprice, 0.025), 6) AS q_low,
       round(median(l_extendedprice), 6) AS q_mid, round(quantile_cont(l_extendedprice, 0.975), 6) AS q_high, count(*) AS n FROM lineitem GROUP BY ALL""")
def agg_spread_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles through ranks, so a group may hold any share of the rows."""
    lines = d.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    by = ["l_returnflag", "l_linestatus"]
    spread = lines.groupBy(*by).agg(r(F.stddev_samp("l_extendedprice"), 4).alias("sd"), r(F.stddev_pop("l_extendedprice"), 4).alias("sd_pop"))
    quant = order_stats.grouped_quantiles(lines, by, "l_extendedprice", {"q_low": 0.025, "q_mid": 0.5, "q_high": 0.975}, limit=0)
    return rounded(spread.join(quant, by), "q_low", "q_mid", "q_high").withColumnRenamed("n_values", "n")


@query("agg_weighted", """
WITH w AS (SELECT l_suppkey, sum(l_extendedprice*l_quantity)/sum(l_quantity) AS wm, avg(l_extendedprice) AS m, sum(l_quantity) AS q, count(*) AS n,
            sqrt(sum(l_quantity*l_extendedprice*l_extendedprice)/sum(l_quantity) - pow(sum(l_extendedprice*l_quantity)/sum(l_quantity), 2)) AS ws FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, round(wm, 4) AS weighted_mean, round(m, 4) AS plain_mean, round(ws, 4) AS weighted_sd FROM w""")
def agg_weighted(spark: SparkSession, sf: str) -> DataFrame:
    w, x = F.col("l_quantity"), F.col("l_extendedprice")
    mean = F.sum(w * x) / F.sum(w)
    return d.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        r(mean, 4).alias("weighted_mean"), r(F.avg(x), 4).alias("plain_mean"), r(F.sqrt(F.sum(w * x * x) / F.sum(w) - mean * mean), 4).alias("weighted_sd"))


@query("agg_total_variation", """
WITH s AS (SELECT l_suppkey, sum(l_quantity) AS q, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
t AS (SELECT sum(q) AS tq, sum(n) AS tn FROM s)
SELECT count(*) AS n_units, round(sum(abs(q/tq - n/tn))/2, 9) AS total_variation FROM s, t""")
def agg_total_variation(spark: SparkSession, sf: str) -> DataFrame:
    """Distance between weighting stations by quantity and by count."""
    units = d.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).cast("double").alias("n"))
    total = units.agg(F.sum("q").alias("tq"), F.sum("n").alias("tn"))
    return contracts.attach_row(units, total).agg(F.count(F.lit(1)).alias("n_units"), r(F.sum(F.abs(F.col("q") / F.col("tq") - F.col("n") / F.col("tn"))) / 2, 9).alias("total_variation"))


@query("agg_strings_crosstab", """
SELECT c_mktsegment, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), '|' ORDER BY CAST(c_nationkey AS VARCHAR)) AS nations, count(*) FILTER (WHERE c_acctbal < 0) AS negative,
       count(*) FILTER (WHERE c_acctbal BETWEEN 0 AND 5000) AS middle, count(*) FILTER (WHERE c_acctbal > 5000) AS high FROM customer GROUP BY c_mktsegment""")
def agg_strings_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted set as text (a set of nations is bounded) and a cross-table with zeros."""
    df = d.table(spark, sf, "customer").withColumn("level", F.when(F.col("c_acctbal") < 0, "negative").when(F.col("c_acctbal") <= 5000, "middle").otherwise("high"))
    names = df.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set(F.col("c_nationkey").cast("string"))), "|").alias("nations"))
    table = df.groupBy("c_mktsegment").pivot("level", ["negative", "middle", "high"]).count().na.fill(0)
    return names.join(table, "c_mktsegment")


@query("agg_totals_row", """
SELECT coalesce(o_orderpriority, 'TOTAL') AS design, count(*) AS n_specifications, count(*) FILTER (WHERE o_totalprice - 250000 < 0) AS n_effect_negative,
       count(*) FILTER (WHERE o_totalprice - 260000 > 0 OR o_totalprice - 240000 < 0) AS n_ci_excludes_zero FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def agg_totals_row(spark: SparkSession, sf: str) -> DataFrame:
    """Sign and interval counts per design with a grand total."""
    price = F.col("o_totalprice")
    specs = d.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("design"), (price - 250000).alias("effect"), (price - 260000).alias("low"), (price - 240000).alias("high"))
    return contrast.sign_inventory(specs, "design", "effect", "low", "high")


@query("agg_first_per_key", """
SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, round(arg_min(o_totalprice, (o_orderdate, o_orderkey)), 2) AS first_total,
       arg_min(o_orderpriority, (o_totalprice, o_orderkey)) AS cheapest_priority FROM orders GROUP BY o_custkey""")
def agg_first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """First row per key by a stated order, combined on the map side."""
    orders = d.table(spark, sf, "orders")
    first = contracts.first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    cheap = orders.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("cheapest_priority"))
    return first.select("o_custkey", F.col("o_orderkey").alias("first_order"), r("o_totalprice", 2).alias("first_total")).join(cheap, "o_custkey")


@query("agg_describe", """
SELECT l_returnflag, count(*) AS n_values, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, round(min(l_extendedprice), 4) AS lowest,
       round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(median(l_extendedprice), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, round(max(l_extendedprice), 4) AS highest FROM lineitem GROUP BY ALL""")
def agg_describe(spark: SparkSession, sf: str) -> DataFrame:
    """Count, moments and exact quartiles of a column."""
    lines = d.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"))
    moments = lines.groupBy("l_returnflag").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lowest"), F.max("x").alias("highest"))
    quartiles = order_stats.grouped_quantiles(lines, ["l_returnflag"], "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return rounded(moments.join(quartiles, "l_returnflag"), "mean", "sd", "lowest", "highest", "q25", "q50", "q75", digits=4)


@query("agg_sign_test", """
WITH s AS (SELECT event_type, count(*) FILTER (WHERE m > 35) AS k, count(*) AS n FROM (SELECT event_type, CAST(ts AS DATE) AS day, median(value) AS m FROM events GROUP BY ALL) GROUP BY event_type)
SELECT event_type, k, n, round((SELECT sum(exp(lgamma(n+1.0)-lgamma(i.range+1.0)-lgamma(n-i.range+1.0))) FROM range(k, n+1) i)/pow(2, n), 6) AS p FROM s""")
def agg_sign_test(spark: SparkSession, sf: str) -> DataFrame:
    """One-sided sign test on daily medians."""
    events = d.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    medians = order_stats.grouped_quantiles(events, ["event_type", "day"], "value", {"m": 0.5})
    counts = medians.groupBy("event_type").agg(F.count_if(F.col("m") > 35).alias("k"), F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", r(contrast.sign_test(F.col("k"), F.col("n"))))


# --- windows ------------------------------------------------------------------------------------------


@query("win_ranks", """
WITH s AS (SELECT user_id, event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, rank() OVER w AS min_rank, CAST(rank() OVER (PARTITION BY user_id ORDER BY n) + (count(*) OVER (PARTITION BY user_id, n) - 1)/2.0 AS DOUBLE) AS mean_rank,
       row_number() OVER (PARTITION BY user_id ORDER BY m, event_type) - 1 AS ordinal, round(lead(m) OVER (PARTITION BY user_id ORDER BY m, event_type) - m, 6) AS margin,
       round(m - avg(m) OVER (PARTITION BY user_id), 6) AS centred, count(*) OVER (PARTITION BY user_id) AS n_types FROM s WINDOW w AS (PARTITION BY user_id ORDER BY m)""")
def win_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks, tie-averaged ranks, ordinals, margins and broadcast aggregates over a handful of types per station."""
    s = d.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    station, ordered = Window.partitionBy("user_id"), Window.partitionBy("user_id").orderBy("m", "event_type")
    ranked = order_stats.ranked_within(s, ["user_id"], "n", "mean_rank")
    return ranked.select("user_id", "event_type", F.rank().over(station.orderBy("m")).cast("bigint").alias("min_rank"), F.col("mean_rank").cast("double").alias("mean_rank"),
                         (F.row_number().over(ordered) - 1).cast("bigint").alias("ordinal"), r(F.lead("m").over(ordered) - F.col("m")).alias("margin"),
                         r(F.col("m") - F.avg("m").over(station)).alias("centred"), F.count(F.lit(1)).over(station).alias("n_types"))


@query("win_quantile_bins", """
WITH e AS (SELECT l_returnflag AS f, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem GROUP BY 1),
b AS (SELECT l_returnflag, l_extendedprice, l_quantity, 1 + (l_extendedprice > q[1])::INT + (l_extendedprice > q[2])::INT + (l_extendedprice > q[3])::INT AS bin FROM lineitem JOIN e ON f = l_returnflag)
SELECT l_returnflag, bin, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM b GROUP BY ALL""")
def win_quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Quartile bins by interpolated edges, closed on the right: not equal row counts."""
    lines = d.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    binned = order_stats.quantile_bins(lines, ["l_returnflag"], "l_extendedprice", 4, "bin", limit=0)
    return binned.groupBy("l_returnflag", "bin").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_quantity")).alias("mean"))


@query("win_spearman", """
WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity)-1)/2.0 AS rx,
                  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice)-1)/2.0 AS ry FROM lineitem)
SELECT l_returnflag, round(corr(rx, ry), 6) AS spearman, count(*) AS n_pairs FROM k GROUP BY ALL""")
def win_spearman(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of three very large groups without a group-wide window."""
    lines = d.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(order_stats.spearman(lines, ["l_returnflag"], "l_quantity", "l_extendedprice"), "spearman")


@query("win_monotone", """
WITH m AS (SELECT user_id, date_trunc('week', ts) AS wk, avg(value) AS v FROM events GROUP BY ALL), g AS (SELECT *, v >= lag(v) OVER (PARTITION BY user_id ORDER BY wk) AS up FROM m)
SELECT user_id, coalesce(bool_and(up), true) AS monotone, count(*) AS n_steps FROM g GROUP BY user_id""")
def win_monotone(spark: SparkSession, sf: str) -> DataFrame:
    """Does a series of weekly means never fall?"""
    weekly = d.table(spark, sf, "events").groupBy("user_id", F.date_trunc("week", "ts").alias("wk")).agg(F.avg("value").alias("v"))
    step = F.col("v") >= F.lag("v").over(Window.partitionBy("user_id").orderBy("wk"))
    return weekly.withColumn("up", step).groupBy("user_id").agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("monotone"), F.count(F.lit(1)).alias("n_steps"))


@query("win_day_ordinals", """
SELECT strftime(day, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY day) - 1 AS day_idx, count(*) OVER () AS n_days, (row_number() OVER (ORDER BY day) - 1 + 5) % count(*) OVER () AS shifted
FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)""")
def win_day_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    """Positions on the calendar and a circular shift."""
    from ..operators.resample import day_ordinals
    days = d.table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct()
    numbered = day_ordinals(days, [], "d")
    return numbered.select(day_text("d").alias("day"), F.col("day_idx").cast("bigint").alias("day_idx"), "n_days", F.pmod(F.col("day_idx") + 5, F.col("n_days")).alias("shifted"))


# --- sets, sorts, limits ----------------------------------------------------------------------------


@query("setop_relations", """
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 100), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 100)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'unequal', count(*) FROM (SELECT * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))""")
def setop_relations(spark: SparkSession, sf: str) -> DataFrame:
    events = d.table(spark, sf, "events").where("value > 100")
    a, b = (events.where(F.col("event_type") == kind).select("user_id").distinct() for kind in ("view", "click"))
    parts = {"union": a.union(b).distinct(), "union_all": a.unionByName(b), "intersect": a.intersect(b), "except": a.exceptAll(b),
             "unequal": contracts.same_keys(a, b, ["user_id"])}
    counted = [df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n")) for op, df in parts.items()]
    return tables.union_by_name(counted)


@query("sort_topk", """
SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def sort_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Head of a multi-key order: a top-k, never a full sort."""
    return d.table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_custkey", r("o_totalprice", 2).alias("total"))


@query("sort_first_days", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem)
WHERE day IN (SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem ORDER BY 1 LIMIT 30) GROUP BY day""")
def sort_first_days(spark: SparkSession, sf: str) -> DataFrame:
    """The first thirty days of an archive."""
    days = d.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    first = days.distinct().orderBy("d").limit(30)
    return days.join(first, "d", "left_semi").groupBy(day_text("d").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("sort_ranking_strings", """
WITH s AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type, '|' ORDER BY m, event_type) AS ranking, arg_min(event_type, (m, event_type)) AS winner FROM s GROUP BY user_id""")
def sort_ranking_strings(spark: SparkSession, sf: str) -> DataFrame:
    s = d.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    return s.groupBy("user_id").agg(score.ordering("event_type", "m").alias("ranking"), score.winner("event_type", "m").alias("winner"))


@query("quantiles_with_gaps", """
WITH e AS (SELECT event_type, CASE WHEN event_id % 89 = 0 OR event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN CAST('inf' AS DOUBLE)
                       WHEN event_id % 103 = 0 THEN CAST('-inf' AS DOUBLE) ELSE value END AS v FROM events)
SELECT event_type, count(v) AS n_values, CAST(quantile_disc(v, 0.0) AS VARCHAR) AS smallest, round(quantile_cont(v, 0.25), 6) AS q25,
       round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.9), 6) AS q90, CAST(quantile_disc(v, 1.0) AS VARCHAR) AS largest
FROM e GROUP BY event_type""")
def quantiles_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of values with NULL and NaN, which are missing, and with infinities, which are not."""
    key = F.col("event_id")
    v = (F.when(key % 89 == 0, F.lit(None)).when(key % 97 == 0, F.lit(float("nan"))).when(key % 101 == 0, F.lit(float("inf")))
         .when(key % 103 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))
    events = d.table(spark, sf, "events").select("event_type", v.alias("v"))
    out = order_stats.grouped_quantiles(events, ["event_type"], "v", {"smallest": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "largest": 1.0})

    def shown(c: str):
        return F.when(F.col(c) == float("inf"), "inf").when(F.col(c) == float("-inf"), "-inf").otherwise(F.col(c).cast("string")).alias(c)

    return out.select("event_type", "n_values", shown("smallest"), r("q25").alias("q25"), r("q50").alias("q50"), r("q90").alias("q90"), shown("largest"))
