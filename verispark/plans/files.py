"""Queries over file formats: each writes its files from a table and reads them with the library's own readers."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text
from ..operators import contracts, neighbours, rolling
from ..session import scratch_path
from ..sources import archives, chunks, records, reports, tables
from . import domain as d
from .places import COAST_SQL
from .registry import query, r

FIELD_SQL = """span AS (SELECT date_trunc('day', min(ts)) AS origin FROM events),
cells AS (SELECT date_trunc('hour', ts) AS valid_time, CASE WHEN value >= 50 THEN 24.0 ELSE 0.0 END AS lead_h, CAST(event_id % 3 AS INTEGER) AS lat_idx,
            CAST(user_id % 4 AS INTEGER) AS lon_idx, sum(value) AS value FROM events GROUP BY ALL)"""


def event_store(spark: SparkSession, sf: str) -> tuple[str, dt.datetime]:
    """A chunk store of hourly 3 x 4 planes at two leads, summed from the events; returns its root and origin."""
    events = d.table(spark, sf, "events").withColumn("hour", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600))
    first, last = events.agg(F.min("hour"), F.max("hour")).head()
    start = first // 24 * 24
    cells = events.groupBy((F.col("hour") - start).cast("int").alias("time_idx"), (F.col("value") >= 50).cast("int").alias("lead_idx"),
                           (F.col("event_id") % 3).cast("int").alias("lat_idx"), (F.col("user_id") % 4).cast("int").alias("lon_idx")).agg(F.sum("value").alias("value"))
    root = scratch_path(spark, "events.zarr")
    chunks.write_field(cells, root, "total", dt.datetime.fromtimestamp(start * 3600, dt.timezone.utc).replace(tzinfo=None), last - start + 1, [0.0, 24.0], (3, 4))
    return root, dt.datetime.fromtimestamp(start * 3600, dt.timezone.utc)


@query("scan_chunk_store", "WITH " + FIELD_SQL + """
SELECT lat_idx, lon_idx, count(*) AS n_hours, round(sum(value), 4) AS total, strftime(min(valid_time), '%Y-%m-%d %H') AS first_hour FROM cells, span
WHERE valid_time >= origin + INTERVAL 5 DAY AND valid_time < origin + INTERVAL 204 HOUR AND lead_h = 24 GROUP BY lat_idx, lon_idx""")
def scan_chunk_store(spark: SparkSession, sf: str) -> DataFrame:
    """A window of time at one lead from a chunk store; only its chunks are opened."""
    root, origin = event_store(spark, sf)
    field = chunks.read_field(spark, root, "total")
    window = field.where((F.col("valid_time") >= F.lit(origin + dt.timedelta(days=5))) & (F.col("valid_time") < F.lit(origin + dt.timedelta(hours=204)))
                         & (F.col("lead_h") == 24.0) & ~F.isnan("value"))
    return window.groupBy("lat_idx", "lon_idx").agg(F.count(F.lit(1)).alias("n_hours"), r(F.sum("value"), 4).alias("total"),
                                                    F.date_format(F.min("valid_time"), "yyyy-MM-dd HH").alias("first_hour"))


@query("scan_zip_members", """
SELECT CAST(user_id AS BIGINT) AS station_id, count(*) AS n, count(value) FILTER (WHERE event_type <> 'error') AS n_values,
  round(sum(value) FILTER (WHERE event_type <> 'error'), 4) AS total FROM events GROUP BY user_id""")
def scan_zip_members(spark: SparkSession, sf: str) -> DataFrame:
    """Product files inside one archive per station, beside members that are not wanted; each wanted member is read by its range."""
    events = d.table(spark, sf, "events")
    station = F.lpad(F.col("user_id").cast("string"), 8, "0")
    shown = F.when(F.col("event_type") == "error", "-999").otherwise(F.format_string("%.2f", "value"))
    body = events.select(station.alias("k"), F.lit("produkt_data.txt").alias("m"), F.col("event_id").alias("o"),
                         F.concat_ws(";", F.col("user_id"), F.date_format("ts", "yyyyMMddHH"), F.lit("3"), shown, F.lit("eor")).alias("t"))
    keys = events.select(station.alias("k")).distinct()
    head = keys.select("k", F.lit("produkt_data.txt").alias("m"), F.lit(-1).cast("long").alias("o"), F.lit("STATIONS_ID;MESS_DATUM;QN;TT;eor").alias("t"))
    other = keys.select("k", F.lit("Metadaten_Größe.txt").alias("m"), F.lit(0).cast("long").alias("o"), F.lit("Höhe;Übersicht").alias("t"))
    root = scratch_path(spark, "archives")
    archives.write_zips(body.unionByName(head).unionByName(other), root, "k", "m", "t", "o")
    rows = reports.parse_product_lines(archives.read_zip_lines(spark, f"{root}/*.zip", prefix="produkt_"), 0, 1, 2, 3)
    # Products write -999 where there is no value.
    rows = rows.withColumn("value", F.nullif("value", F.lit(-999.0)))
    return rows.groupBy(F.col("native_station_id").cast("long").alias("station_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), r(F.sum("value"), 4).alias("total"))


@query("coast_distance_geojson", "WITH " + COAST_SQL + """,
pt AS (SELECT station_id, longitude*100000 AS x, latitude*100000 AS y FROM inventory),
u AS (SELECT *, least(1, greatest(0, ((x-ax)*(cx-ax)+(y-ay)*(cy-ay))/(pow(cx-ax,2)+pow(cy-ay,2)))) AS t FROM pt, seg)
SELECT station_id, round(min(sqrt(pow(x-(ax+t*(cx-ax)),2)+pow(y-(ay+t*(cy-ay)),2)))/1000, 4) AS coast_distance_km FROM u GROUP BY station_id""")
def coast_distance_geojson(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every record to a coast that is read from GeoJSON features."""
    nodes = d.grid_targets(spark, sf).select("target_id", F.array("longitude", "latitude").alias("at"))
    ends = nodes.select((F.col("target_id") - 1).alias("target_id"), F.col("at").alias("to"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.array("at", "to").alias("coordinates")).alias("geometry"))
    path = scratch_path(spark, "coast.geojson")
    nodes.join(ends, "target_id").select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))).write.text(path)
    segments = archives.read_geojson_segments(spark, path, -400.0, -400.0, 400.0, 400.0, per_line=True)
    planar = segments.select(*[(F.col(c) * 100000).alias(n) for c, n in (("lon_a", "ax"), ("lat_a", "ay"), ("lon_b", "bx"), ("lat_b", "by"))])
    points = d.inventory(spark, sf).select("station_id", (F.col("longitude") * 100000).alias("x"), (F.col("latitude") * 100000).alias("y"))
    found = neighbours.nearest_segment_km(points, planar, "station_id")
    return found.select("station_id", r("distance_km", 4).alias("coast_distance_km"))


@query("scan_csv_identifiers", """
SELECT lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(8, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS station_id, round(c_acctbal, 2) AS balance, CAST(c_nationkey + 1 AS BIGINT) AS nation_plus_one
FROM customer""")
def scan_csv_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers with leading zeros stay text, the other columns get their types."""
    path = scratch_path(spark, "metadata-csv")
    source = d.table(spark, sf, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), F.greatest(F.lit(8), F.length(F.col("c_custkey").cast("string"))), F.lit("0")).alias("station_id"),
        F.round("c_acctbal", 2).alias("balance"), F.col("c_nationkey").alias("nation"))
    tables.write_csv(source, path, sort_by=["station_id"])
    back = reports.read_metadata_csv(spark, path, ["station_id"])
    return back.select("station_id", F.col("balance").cast("double").alias("balance"), (F.col("nation") + 1).cast("long").alias("nation_plus_one"))


@query("scan_legacy_code_page", """
SELECT 'ESTAÇÃO ' || user_id AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id""")
def scan_legacy_code_page(spark: SparkSession, sf: str) -> DataFrame:
    """Lines in ISO-8859-1 with accents and a decimal comma."""
    events = d.table(spark, sf, "events")
    line = F.concat(F.lit("ESTAÇÃO "), F.col("user_id"), F.lit(";"), F.replace(F.format_string("%.4f", "value"), F.lit("."), F.lit(",")))
    path = scratch_path(spark, "latin1")
    events.select(line).write.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").csv(path)
    lines = reports.read_lines(spark, path, "ISO-8859-1")
    fields = F.split("line", ";")
    return lines.groupBy(F.get(fields, F.lit(0)).alias("name")).agg(F.count(F.lit(1)).alias("n"), r(F.sum(text.decimal_comma(F.get(fields, F.lit(1)))), 4).alias("total"))


@query("sink_csv_sorted", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(min(o_orderkey) AS BIGINT) AS first_key FROM orders GROUP BY ALL""")
def sink_csv_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """A sorted CSV table, written and read with its schema."""
    path = scratch_path(spark, "orders-csv")
    source = d.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"))
    tables.write_csv(source, path, sort_by=["o_orderkey"])
    back = spark.read.schema(source.schema).csv(path, header=True)
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("first_key"))


CONTRACT = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
            "supplier": ["s_suppkey", "s_name", "s_address_absent"], "events": ["event_id", "ts", "user_id", "event_type", "value", "props"]}


@query("table_contracts", "WITH wanted(table_name, column_name) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in CONTRACT.items() for c in cs) + """),
have AS (SELECT table_name, column_name, CASE WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'time' WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'number' END AS family
         FROM information_schema.columns WHERE table_name IN (SELECT table_name FROM wanted)),
size AS (SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'events', count(*) FROM events)
SELECT table_name, column_name, CASE WHEN h.column_name IS NULL THEN 'missing' WHEN w.column_name IS NULL THEN 'unexpected' ELSE 'kept' END AS state, h.family, s.n AS n_rows
FROM wanted w FULL JOIN have h USING (table_name, column_name) JOIN size s USING (table_name)""")
def table_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that tables keep, lack or have beyond their contract, beside their type's family and rows."""
    out = None
    for name, wanted in CONTRACT.items():
        df = d.table(spark, sf, name)
        have = {c: "time" if t.startswith(("timestamp", "date")) else "text" if t == "string" else "number" for c, t in tables.describe(df)}
        try:
            contracts.exact_columns(df, wanted)
            broken = False
        except contracts.ContractError:
            broken = True
        rows = [(c, "kept" if c in have and c in wanted else "missing" if c in wanted else "unexpected", have.get(c)) for c in sorted({*wanted, *have})]
        assert broken == any(s != "kept" for _, s, _ in rows)
        said = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(s).alias("state"), F.lit(f).cast("string").alias("family")) for c, s, f in rows]))
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", said)
        out = part if out is None else out.unionByName(part)
    return out


@query("manifest_differences", """
SELECT o_orderpriority AS part, bool_or(o_orderkey % 997 = 7) AS changed, count(*) AS n_rows FROM orders GROUP BY o_orderpriority""")
def manifest_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Which parts of a table differ from a sealed manifest of their fingerprints after some rows changed."""
    orders = d.table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus")
    after = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 997 == 7, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus")))
    parts = sorted(row[0] for row in orders.select("o_orderpriority").distinct().collect())  # a handful of names

    def prints(df: DataFrame) -> dict:
        return {p: records.table_fingerprint(df.where(F.col("o_orderpriority") == p), ["o_orderkey", "o_orderstatus"]).head().asDict() for p in parts}

    before = prints(orders)
    path = scratch_path(spark, "manifest")
    spark.range(1).select(F.lit(json.dumps(before, default=str))).write.text(path)
    sealed = records.seal(json.loads(spark.read.text(path).head()[0]), parts)
    changed = records.seal_differences(json.loads(json.dumps(prints(after), default=str)), sealed)
    return orders.groupBy(F.col("o_orderpriority").alias("part")).agg(F.count(F.lit(1)).alias("n_rows")).select(
        "part", F.col("part").isin(changed).alias("changed"), "n_rows")


@query("qc_halo_window", """
WITH w AS (SELECT CAST(ts AS DATE) AS day, count(value) OVER o AS n, median(value) OVER o AS m FROM events
           WINDOW o AS (PARTITION BY user_id % 10 ORDER BY ts, value ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT strftime(day, '%Y-%m-%d') AS day, day BETWEEN DATE '2024-01-10' AND DATE '2024-01-14' AS checked, count(*) AS n_reports,
  CAST(sum(n) FILTER (WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-14') AS BIGINT) AS n_neighbours,
  round(sum(m) FILTER (WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-14'), 4) AS medians FROM w GROUP BY w.day""")
def qc_halo_window(spark: SparkSession, sf: str) -> DataFrame:
    """A few days checked anew: their partitions are read with a halo, trimmed, and overwritten alone."""
    first, last = "2024-01-10", "2024-01-14"
    reports_ = d.table(spark, sf, "events").select((F.col("user_id") % 10).alias("series"), "ts", "value", F.to_date("ts").alias("day"))
    source, checked = scratch_path(spark, "reports-by-day"), scratch_path(spark, "checked-by-day")
    tables.write_table(reports_, source, partition_by=["day"])
    blank = reports_.select("series", "ts", "value", F.lit(None).cast("double").alias("rolling_median"), F.lit(None).cast("bigint").alias("rolling_count"), "day")
    tables.write_table(blank, checked, partition_by=["day"])
    around = spark.read.parquet(source).where(cal.day_window(F.col("day"), first, last, 3))
    found = rolling.centred_median(around, "series", ["ts"], "value").where(cal.day_window(F.col("day"), first, last))
    tables.overwrite_partitions(found.select("series", "ts", "value", F.col("rolling_median").cast("double").alias("rolling_median"), F.col("rolling_count").cast("bigint").alias("rolling_count"), "day"), checked, ["day"])
    return spark.read.parquet(checked).groupBy("day").agg(
        F.count(F.lit(1)).alias("n_reports"), F.sum("rolling_count").alias("n_neighbours"), r(F.sum("rolling_median"), 4).alias("medians")).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("n_neighbours").isNotNull().alias("checked"), "n_reports", "n_neighbours", "medians")
