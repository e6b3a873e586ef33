"""Columnar tables in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, *paths: str, base_path: str | None = None,
               schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet files, globs or lists; hive-style folders become columns."""
    reader = spark.read
    if base_path:
        reader = reader.option("basePath", base_path)
    if schema:
        reader = reader.schema(schema)
    return reader.parquet(*paths)


def read_union_by_name(spark: SparkSession, *paths: str) -> DataFrame:
    """Files whose columns differ; absent ones are NULL."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks a missing value in the sources; in Spark it would be a value."""
    fixes = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema.fields
             if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fixes) if fixes else df


def write_table(df: DataFrame, path: str, sort_by: Sequence[str] = (), partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> None:
    """ZSTD Parquet; rows are ordered inside files and files cover ascending ranges of ``sort_by``.

    The commit protocol publishes the files of a job together, and the default
    mode refuses to replace an existing table.
    """
    if sort_by:
        df = df.orderBy(*sort_by) if not partition_by else df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that ``df`` has rows of; all others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, sort_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    (df.orderBy(*sort_by) if sort_by else df).write.mode(mode).csv(path, header=True)


def table_exists(spark: SparkSession, path: str) -> bool:
    """A finished table carries the commit marker."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def materialise(df: DataFrame, path: str, force: bool = False, **options) -> DataFrame:
    """Write unless a finished table is there already, then read it back."""
    spark = df.sparkSession
    if force or not table_exists(spark, path):
        write_table(df, path, mode="overwrite", **options)
    return spark.read.parquet(path)


def describe(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
