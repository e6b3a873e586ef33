"""Text archives of station reports, parsed line by line.

Every parser works on a frame of lines, so a large file is split over many tasks
and the same code reads files or lines derived from a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import padded
from ..functions.text import decimal_comma, file_stem, number_or_null, timestamp_or_null


def read_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """``path`` and ``line`` of every text line."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    # One column that never splits: the csv reader decodes legacy code pages.
    raw = (spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "")
           .schema("line string").csv(paths))
    return raw.select(F.col("_metadata.file_path").alias("path"), "line")


def write_station_csv(df: DataFrame, path: str, station: str) -> None:
    """One folder per station below ``path``, its rows brought together first: a file per station, not one per station and task.

    Only a station that exceeds a task's share is split.  Tasks put their own files in place, so that the driver does not
    move one folder after the other; the folder must be new and is whole once this returns.
    """
    gathered = df.hint("rebalance", station)
    gathered.write.partitionBy(station).option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(path, header=True)


def read_station_csv(spark: SparkSession, paths: str | Sequence[str], schema: str,
                     key: str = "station_id", key_pattern: str | None = None) -> DataFrame:
    """One CSV per station with an explicit schema; the file name (or a pattern in the path) is the key.

    Folders are searched to their leaves, in parallel: a pattern over many folders is resolved by the driver alone.
    """
    df = spark.read.schema(schema).option("recursiveFileLookup", True).csv(paths, header=True)
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, key_pattern, 1) if key_pattern else file_stem(path)
    return df.withColumn(key, name)


def read_metadata_csv(spark: SparkSession, path: str, id_columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """CSV whose identifier columns stay text (leading zeros survive); the rest is inferred."""
    options = {"header": True, "encoding": encoding}
    inferred = spark.read.options(**options, inferSchema=True).csv(path).schema
    fields = [f"`{f.name}` {'string' if f.name in id_columns else f.dataType.simpleString()}" for f in inferred.fields]
    return spark.read.options(**options).schema(", ".join(fields)).csv(path)


def parse_preamble(lines: DataFrame, key_pattern: str = r"^([^;0-9][^;]*):;(.*?);*$") -> DataFrame:
    """``key:;value`` lines of each file as one map per path."""
    key = F.trim(F.regexp_extract("line", key_pattern, 1))
    value = F.trim(F.regexp_extract("line", key_pattern, 2))
    entries = lines.where(F.col("line").rlike(key_pattern)).select("path", key.alias("k"), value.alias("v"))
    unique = entries.groupBy("path", "k").agg(F.min("v").alias("v"))
    # A preamble has a handful of keys per file.
    return unique.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("preamble"))


def parse_semicolon_reports(lines: DataFrame, date_field: int, time_field: int, value_field: int,
                            time_pattern: str = "yyyy/MM/dd HHmm 'UTC'") -> DataFrame:
    """Data lines of a ``;`` file with decimal commas; header and preamble lines are not dates and drop out."""
    fields = F.split("line", ";")
    # A line that ends early has no time of day: its stamp and value are NULL, the line stays.
    stamp = F.concat_ws(" ", F.trim(F.get(fields, F.lit(date_field))), F.trim(F.get(fields, F.lit(time_field))))
    return (lines.where(F.col("line").rlike(r"^\s*[0-9]{4}[/-][0-9]{2}[/-][0-9]{2}"))
            .select("path", timestamp_or_null(stamp, time_pattern).alias("valid_time"),
                    decimal_comma(F.get(fields, F.lit(value_field))).alias("value")))


def csv_fields(line: Column) -> Column:
    """Fields of a comma-separated line; a quoted field may hold commas and doubled quotes."""
    # A comma outside quotes has an even number of quotes after it.
    parts = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    quoted = lambda x: F.trim(x).rlike('^"(?s:.*)"$')
    bare = lambda x: F.replace(F.regexp_replace(F.trim(x), '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.when(line.contains('"'), F.transform(parts, lambda x: F.when(quoted(x), bare(x)).otherwise(x))).otherwise(F.split(line, ",", -1))


def parse_badc_metadata(lines: DataFrame) -> DataFrame:
    """Global attributes (``name,G,value...``) of each file: path, name, position, value."""
    fields = csv_fields(F.col("line"))
    rows = lines.where((F.size(fields) >= 3) & (F.get(fields, F.lit(1)) == "G"))
    return rows.select("path", fields[0].alias("name"),
                       F.posexplode(F.slice(fields, F.lit(3), F.size(fields) - 2)).alias("position", "value"))


def parse_badc_reports(lines: DataFrame, columns: Sequence[str], first_column: str = "ob_time") -> DataFrame:
    """Data rows of each file, columns found by that file's own header row; ``NA`` is missing."""
    fields = F.transform(csv_fields(F.col("line")), lambda x: F.trim(x))
    # The byte order mark may cling to the first line of a file.
    header = lines.where(F.regexp_replace("line", "^﻿", "").startswith(first_column + ","))
    header = header.groupBy("path").agg(F.min("line").alias("_h"))
    header = header.select("path", F.transform(csv_fields(F.col("_h")), lambda x: F.trim(x)).alias("_names"))
    data = lines.where(F.col("line").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]")).select("path", fields.alias("_f"))
    joined = data.join(header, "path")

    def pick(name: str) -> Column:
        place = F.array_position("_names", name).cast("int")
        text = F.when(place > 0, F.get("_f", place - 1))
        return F.nullif(F.nullif(text, F.lit("NA")), F.lit("")).alias(name)

    return joined.select("path", *[pick(c) for c in columns])


def parse_fixed_stations(lines: DataFrame) -> DataFrame:
    """Whitespace station list: id, opening and closing date, height, latitude, longitude, name words, state.

    The name may hold blanks; header and rule lines do not start with a number.  A station line with
    too few words or with words for numbers stops the job: a lost station would be an incomplete list.
    """
    parts = F.split(F.trim("line"), r"\s+")
    size = F.size(parts)
    station = lines.where(F.trim("line").rlike(r"^[0-9]+\s+[0-9]{8}\s+[0-9]{8}(\s|$)"))
    sound = F.coalesce((size >= 8) & number_or_null(F.get(parts, F.lit(3))).isNotNull() & number_or_null(F.get(parts, F.lit(4))).isNotNull()
                       & number_or_null(F.get(parts, F.lit(5))).isNotNull(), F.lit(False))
    usable = station.where(F.when(sound, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("station line cannot be read: "), F.col("line"))).cast("boolean")))
    return usable.select(
        padded(parts[0].cast("bigint"), 5).alias("native_station_id"),
        F.to_date(F.try_to_timestamp(parts[1], F.lit("yyyyMMdd"))).alias("open_date"),
        F.to_date(F.try_to_timestamp(parts[2], F.lit("yyyyMMdd"))).alias("archive_end_date"),
        number_or_null(parts[3]).alias("altitude_m"), number_or_null(parts[4]).alias("latitude"),
        number_or_null(parts[5]).alias("longitude"),
        F.array_join(F.slice(parts, F.lit(7), size - 7), " ").alias("station_name"),
        F.element_at(parts, -1).alias("state"))


def parse_product_lines(lines: DataFrame, id_field: int, time_field: int, quality_field: int, value_field: int,
                        time_pattern: str = "yyyyMMddHH") -> DataFrame:
    """Semicolon product rows padded with blanks: station number, time, quality level, value."""
    f = F.transform(F.split("line", ";"), lambda x: F.trim(x))
    return lines.where(F.trim("line").rlike(r"^[0-9]+\s*;")).select(
        padded(F.get(f, F.lit(id_field)), 5).alias("native_station_id"),
        F.try_to_timestamp(F.get(f, F.lit(time_field)), F.lit(time_pattern)).cast("timestamp_ntz").alias("valid_time"),
        number_or_null(F.get(f, F.lit(quality_field))).alias("qc_level"),
        number_or_null(F.get(f, F.lit(value_field))).alias("value"))
