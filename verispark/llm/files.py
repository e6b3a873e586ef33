"""Files and stage tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession

from verispark.session import scratch_path


def local_path(path: str) -> str | None:
    """The path without its scheme, if this machine's file system serves it."""
    match = re.match(r"file:/*(/.*)$", path)
    if match:
        return match[1]
    return path if path.startswith("/") else None


def open_output(path: str):
    """A binary stream to a new file; folders are made where the store has folders."""
    plain = local_path(path)
    if plain is not None:
        os.makedirs(os.path.dirname(plain), exist_ok=True)
        return open(plain, "wb")
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    return store.open_output_stream(inner)


def open_input(path: str):
    """A seekable binary stream."""
    plain = local_path(path)
    if plain is not None:
        return open(plain, "rb")
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class Stages:
    """Stage tables of one run.

    ``put`` writes a table below the shared folder and reads it back: lineage ends there, and
    a lost executor costs no recomputation of the past.  ``drop`` deletes a table whose
    successor has been written.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.count, self.at = spark, scratch_path(spark, name), 0, {}

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at.pop(id(frame))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let executors delete the shuffle files of finished jobs: Spark does so when the driver's collector has seen that nothing refers to them."""
        for _ in range(2):  # references to a job end with its plan, those to its shuffles one collection later
            gc.collect()
            time.sleep(0.3)
            self.spark._jvm.System.gc()
            time.sleep(0.3)
