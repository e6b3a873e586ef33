"""The verification domain read off the given tables.

Stations are suppliers, reports are events, forecasts and references are prices
of line items, gridded fields are embeddings and the inventory to deduplicate is
the customer table.  Every ``*_SQL`` constant states the same relation for the
oracle engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import geo

MODELS = ("alpha", "beta", "gamma")
REFERENCES = ("ref_point", "ref_grid")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
GRID_ROWS, GRID_COLUMNS, GRID_LAT0, GRID_LON0, GRID_STEP = 8, 8, 30.0, 0.0, 5.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


STATIONS_SQL = """stations AS (
  SELECT s_suppkey AS station_id, n_name AS network, n_regionkey AS region,
         CAST((s_suppkey*7919) % 18000 AS DOUBLE)/100 - 90 AS latitude,
         CAST((s_suppkey*104729) % 36000 AS DOUBLE)/100 - 180 AS longitude,
         s_acctbal AS altitude_m
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def stations(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("station_id"), F.col("n_name").alias("network"), F.col("n_regionkey").alias("region"),
        ((key * 7919 % 18000).cast("double") / 100 - 90).alias("latitude"),
        ((key * 104729 % 36000).cast("double") / 100 - 180).alias("longitude"),
        F.col("s_acctbal").alias("altitude_m"))


PANEL_SQL = """panel AS (
  SELECT l_suppkey AS station_id, l_shipdate AS valid_time, CAST(l_shipdate AS DATE) AS valid_day,
         l_returnflag AS network, l_linestatus AS cohort, 24*l_linenumber AS lead_h,
         l_extendedprice*(1-l_discount)/1000 AS alpha, l_extendedprice*(1+l_tax)/1000 AS beta,
         CASE WHEN l_tax > 0 THEN (l_extendedprice + p_retailprice*l_quantity)/2000 END AS gamma,
         l_extendedprice/1000 AS ref_point, p_retailprice*l_quantity/1000 AS ref_grid
  FROM lineitem JOIN part ON l_partkey = p_partkey),
common AS (SELECT * FROM panel WHERE gamma IS NOT NULL)"""


def panel_values() -> dict[str, Column]:
    """Forecasts and references of a case, of the columns of ``lineitem`` and ``part``."""
    price, grid = F.col("l_extendedprice"), F.col("p_retailprice") * F.col("l_quantity")
    return {"alpha": price * (1 - F.col("l_discount")) / 1000, "beta": price * (1 + F.col("l_tax")) / 1000,
            "gamma": F.when(F.col("l_tax") > 0, (price + grid) / 2000), "ref_point": price / 1000, "ref_grid": grid / 1000}


#: What each value of a case is made of.
PANEL_SOURCES = {"alpha": ("l_extendedprice", "l_discount"), "beta": ("l_extendedprice", "l_tax"), "gamma": ("l_extendedprice", "l_tax", "l_quantity", "p_retailprice"),
                 "ref_point": ("l_extendedprice",), "ref_grid": ("l_quantity", "p_retailprice")}


def priced(spark: SparkSession, sf: str, items: DataFrame) -> DataFrame:
    return items.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))


def wide_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Three forecasts and two references per case; one forecast is missing where no tax was set."""
    return priced(spark, sf, table(spark, sf, "lineitem")).select(
        F.col("l_suppkey").alias("station_id"), F.col("l_shipdate").alias("valid_time"),
        cal.valid_day(F.col("l_shipdate")).alias("valid_day"), F.col("l_returnflag").alias("network"),
        F.col("l_linestatus").alias("cohort"), (24 * F.col("l_linenumber")).alias("lead_h"),
        *[value.alias(name) for name, value in panel_values().items()])


def common_panel(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.panel import complete_cases
    return complete_cases(wide_panel(spark, sf), [*MODELS, *REFERENCES])


def common_sources(spark: SparkSession, sf: str, values: Sequence[str]) -> DataFrame:
    """Stations and days of ``common_panel`` with what the listed values are made of: a few short numbers instead of long fractions."""
    from ..operators.panel import complete_cases
    # Days and taxed items before the join, which may have to shuffle them.
    items = table(spark, sf, "lineitem").where("l_tax > 0").select(
        "l_partkey", F.col("l_suppkey").alias("station_id"), cal.valid_day(F.col("l_shipdate")).alias("valid_day"), "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    cases = complete_cases(priced(spark, sf, items).withColumns(panel_values()), [*MODELS, *REFERENCES])
    return cases.select("station_id", "valid_day", *dict.fromkeys(c for v in values for c in PANEL_SOURCES[v]))


LONG_SQL = PANEL_SQL + """,
long AS (
  SELECT station_id, valid_time, valid_day, network, cohort, lead_h, ref_point, ref_grid, m.model, m.forecast
  FROM common, LATERAL (VALUES ('alpha', alpha), ('beta', beta), ('gamma', gamma)) m(model, forecast))"""


def long_panel(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.panel import to_long
    return to_long(common_panel(spark, sf), MODELS, "model", "forecast")


REPORTS_SQL = """reports AS (
  SELECT event_id AS report_id, user_id AS station_id, ts AS valid_time, value/10 AS value, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         '[' || CASE WHEN event_type = 'error' THEN '0' ELSE '1' END || ' 1 0]' AS mask,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90 THEN 1.0 ELSE 0.0 END AS time_diff
  FROM events)"""


def reports(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("report_id"), F.col("user_id").alias("station_id"), F.col("ts").alias("valid_time"),
        (F.col("value") / 10).alias("value"), "event_type", k.alias("k"),
        F.concat(F.lit("["), F.when(F.col("event_type") == "error", "0").otherwise("1"), F.lit(" 1 0]")).alias("mask"),
        F.when(k >= 90, 1.0).otherwise(0.0).alias("time_diff"))


INVENTORY_SQL = """inventory AS (
  SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(9, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS station_id, c_mktsegment AS network,
         (c_nationkey - 12)*6.0::DOUBLE + c_acctbal/199999 AS latitude,
         c_nationkey*15.0::DOUBLE - 180.0::DOUBLE + c_acctbal/399983 AS longitude,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal/2 END AS altitude_m
  FROM customer)"""


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of records around 25 places, some without an elevation, one across the dateline."""
    balance, nation = F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), geo.padded(F.col("c_custkey"), 9)).alias("station_id"),
        F.col("c_mktsegment").alias("network"), ((nation - 12) * F.lit(6.0) + balance / 199999).alias("latitude"),
        (nation * F.lit(15.0) - 180.0 + balance / 399983).alias("longitude"),
        F.when(balance >= 0, balance / 2).alias("altitude_m"))


FIELDS_SQL = """fields AS (
  SELECT vec_id AS time_id, label, CAST((pos-1) // 8 AS INTEGER) AS lat_idx, CAST((pos-1) % 8 AS INTEGER) AS lon_idx,
         CAST(v AS DOUBLE) AS value
  FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings))"""


def field_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as an 8 x 8 field of 5-degree cells, in long form."""
    flat = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    return flat.select(F.col("vec_id").alias("time_id"), "label", F.floor(F.col("pos") / 8).cast("int").alias("lat_idx"),
                       (F.col("pos") % 8).alias("lon_idx"), F.col("v").cast("double").alias("value"))


def field_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("time_id"), "label", F.col("embedding").alias("field"))


TARGETS_SQL = """targets AS (
  SELECT n_nationkey AS target_id, n_name AS name, 31 + n_nationkey*1.3::DOUBLE AS latitude,
         1 + ((n_nationkey*7) % 34)*1.0::DOUBLE AS longitude FROM nation)"""


def grid_targets(spark: SparkSession, sf: str) -> DataFrame:
    """One target per nation inside the 8 x 8 domain."""
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        key.alias("target_id"), F.col("n_name").alias("name"), (31 + key * F.lit(1.3)).alias("latitude"),
        (1 + (key * 7 % 34) * F.lit(1.0)).alias("longitude"))


GRID_SQL = """grid AS (
  SELECT DISTINCT lat_idx*8 + lon_idx AS source_id, 30 + 5.0::DOUBLE*lat_idx AS latitude, 5.0::DOUBLE*lon_idx AS longitude
  FROM fields)"""


def grid_points(spark: SparkSession, sf: str) -> DataFrame:
    cells = field_cells(spark, sf).select("lat_idx", "lon_idx").distinct()
    return cells.select((F.col("lat_idx") * GRID_COLUMNS + F.col("lon_idx")).alias("source_id"),
                        (GRID_LAT0 + GRID_STEP * F.col("lat_idx")).alias("latitude"),
                        (GRID_LON0 + GRID_STEP * F.col("lon_idx")).alias("longitude"))


def haversine_sql(a: str, b: str) -> str:
    return (f"2*6371.0088*asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians({b}.latitude-{a}.latitude)/2),2)"
            f" + cos(radians({a}.latitude))*cos(radians({b}.latitude))"
            f"*pow(sin(radians({b}.longitude-{a}.longitude)/2),2)))))")


def starts_sql(n: str, draws: int, width: int, seed: int, name: str = "idx") -> str:
    """CTEs spelling out the day index of every draw, day by day (no arcs)."""
    p = 2147483647

    def pow5(x: str) -> str:
        return f"(((({x})*({x}) % {p}) * (({x})*({x}) % {p}) % {p}) * ({x}) % {p})"

    return f"""{name}_x AS (SELECT d.range AS draw, b.range AS block,
    (d.range*7919 + b.range*104729 + {seed}) % {p} AS x
  FROM range(0, {draws}) d, range(0, (SELECT CAST(ceil({n}/{width}.0) AS BIGINT))) b),
{name}_y AS (SELECT draw, block, ({pow5('x')}*48271 + 11) % {p} AS y FROM {name}_x),
{name} AS (SELECT draw, ({pow5('y')} % {n} + o.range) % {n} AS day_idx
  FROM {name}_y, range(0, {width}) o WHERE block*{width} + o.range < {n})"""


SITES_IN_GRID_SQL = """sites AS (
  SELECT s_suppkey AS target_id, 31 + CAST((s_suppkey*7919) % 18000 AS DOUBLE)/18000*33 AS latitude,
         1 + CAST((s_suppkey*104729) % 36000 AS DOUBLE)/36000*33 AS longitude FROM supplier)"""


def sites_in_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Stations squeezed into the domain of the gridded fields."""
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("target_id"), (31 + (key * 7919 % 18000).cast("double") / 18000 * 33).alias("latitude"),
        (1 + (key * 104729 % 36000).cast("double") / 36000 * 33).alias("longitude"))
