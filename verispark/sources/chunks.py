"""Chunk stores (version 2, consolidated metadata) as a Spark data source, and their writing from a table.

The reader plans one partition per chunk of the (time[, lead]) grid.  Filters on ``valid_time`` and ``lead_h`` choose
chunks before any is opened and are applied again to the rows.  A plane is never split, whichever order its axes are stored in.
"""

from __future__ import annotations

import datetime as dt
import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual)

from .archives import decode_chunk
from .store import open_input, write_bytes

FORMAT = "verispark_chunks"
#: Without this setting Spark hands no filters to Python sources.
PUSHDOWN_KEY = "spark.sql.python.filterPushdown.enabled"
_SECONDS = {"days": 86400.0, "day": 86400.0, "hours": 3600.0, "hour": 3600.0, "minutes": 60.0, "minute": 60.0, "seconds": 1.0, "second": 1.0}


@dataclass
class ChunkPartition(InputPartition):
    """One chunk: its place in the grid and the coordinates of its planes."""

    place: tuple[int, ...]
    times: list[float]
    leads: list[float]

    def __init__(self, place: tuple[int, ...], times: list[float], leads: list[float]) -> None:
        super().__init__(place)
        self.place, self.times, self.leads = place, times, leads


def read_bytes(path: str) -> bytes:
    with open_input(path) as stream:
        return stream.read()


def _seconds(value: object) -> float:
    """A time in seconds since 1970, UTC, whatever type a filter brings."""
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=value.tzinfo or dt.timezone.utc).timestamp()
    return float(value)


class Field:
    """Shape, coordinates and codec of one array of a store."""

    def __init__(self, root: str, name: str) -> None:
        self.root, self.name = root.rstrip("/"), name
        self.metadata = json.loads(read_bytes(f"{self.root}/.zmetadata"))["metadata"]
        spec = self.metadata[f"{name}/.zarray"]
        self.shape, self.chunks = tuple(spec["shape"]), tuple(spec["chunks"])
        self.dtype, self.order, self.compressor = np.dtype(spec["dtype"]), spec.get("order", "C"), spec.get("compressor")
        if len(self.shape) not in (3, 4) or self.chunks[-2:] != self.shape[-2:]:
            raise ValueError(f"array {name!r}: one chunk must hold a whole horizontal plane, but chunks {self.chunks} cut shape {self.shape}")
        dims = self.attrs(name).get("_ARRAY_DIMENSIONS", ["time", "lead", "latitude", "longitude"][-len(self.shape):] if len(self.shape) == 4 else ["time", "latitude", "longitude"])
        if sorted(dims[-2:]) != ["latitude", "longitude"]:
            raise ValueError(f"array {name!r}: the last two dimensions are {dims[-2:]}, not latitude and longitude")
        self.swap, self.axes = dims[-2:] == ["longitude", "latitude"], dims[:-2]

    def attrs(self, name: str) -> dict:
        return self.metadata.get(f"{name}/.zattrs", {})

    def coordinate(self, name: str) -> np.ndarray:
        spec = self.metadata[f"{name}/.zarray"]
        size, step = spec["shape"][0], spec["chunks"][0]
        parts = [np.frombuffer(decode_chunk(read_bytes(f"{self.root}/{name}/{k}"), spec.get("compressor")), np.dtype(spec["dtype"]))[:min(step, size - k * step)]
                 for k in range(-(-size // step))]
        return np.concatenate(parts).astype(float) if parts else np.zeros(0)

    def times(self) -> np.ndarray:
        """Seconds since 1970."""
        unit, _, origin = self.attrs(self.axes[0])["units"].partition(" since ")
        start = dt.datetime.fromisoformat(origin.strip())
        return _seconds(start) + self.coordinate(self.axes[0]) * _SECONDS[unit.strip().lower()]

    def leads(self) -> np.ndarray:
        """Hours."""
        unit = self.attrs(self.axes[1])["units"].strip().lower()
        return self.coordinate(self.axes[1]) * _SECONDS[unit] / 3600


class ChunkReader(DataSourceReader):
    def __init__(self, root: str, name: str) -> None:
        self.root, self.name, self.wanted = root, name, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep what bounds time or lead for the choice of chunks; Spark applies every filter to the rows again."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("valid_time",), ("lead_h",)):
                self.wanted.append(f)
            yield f

    def _passes(self, values: np.ndarray, column: str) -> np.ndarray:
        good = np.ones(len(values), bool)
        for f in self.wanted:
            if f.attribute != (column,):
                continue
            many = list(f.value) if isinstance(f, In) else [f.value]
            limits = [_seconds(v) for v in many if v is not None]
            if isinstance(f, (EqualTo, In)):
                good &= np.isin(values, limits)
            elif limits:
                good &= {GreaterThan: values > limits[0], GreaterThanOrEqual: values >= limits[0],
                         LessThan: values < limits[0], LessThanOrEqual: values <= limits[0]}[type(f)]
        return good

    def partitions(self) -> list[InputPartition]:
        field = Field(self.root, self.name)
        times = field.times()
        leads = field.leads() if len(field.axes) == 2 else np.zeros(1)
        keep_time, keep_lead = self._passes(times, "valid_time"), self._passes(leads, "lead_h")
        step = (*field.chunks[:-2], 1)[:2]
        out = []
        for i in range(-(-len(times) // step[0])):
            for j in range(-(-len(leads) // step[1])):
                a, b = slice(i * step[0], (i + 1) * step[0]), slice(j * step[1], (j + 1) * step[1])
                if keep_time[a].any() and keep_lead[b].any():
                    place = (i, j, 0, 0) if len(field.axes) == 2 else (i, 0, 0)
                    out.append(ChunkPartition(place, times[a].tolist(), leads[b].tolist()))
        return out

    def read(self, partition: ChunkPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no chunk was planned
            return
        field = Field(self.root, self.name)
        content = read_bytes(f"{field.root}/{field.name}/{'.'.join(map(str, partition.place))}")
        block = np.frombuffer(decode_chunk(content, field.compressor), field.dtype).reshape(field.chunks, order=field.order)
        good_time, good_lead = (self._passes(np.array(v), c) for v, c in ((partition.times, "valid_time"), (partition.leads, "lead_h")))
        for t, time in enumerate(partition.times):
            for k, lead in enumerate(partition.leads):
                if not (good_time[t] and good_lead[k]):
                    continue
                plane = (block[t, k] if len(field.axes) == 2 else block[t]).astype(float)
                plane = plane.T if field.swap else plane
                lat, lon = np.indices(plane.shape, np.int32)
                stamp = np.full(plane.size, round(time * 1e6), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(stamp).cast(pa.timestamp("us", "UTC")), pa.array(np.full(plane.size, lead)), pa.array(lat.ravel()), pa.array(lon.ravel()), pa.array(plane.ravel())],
                    names=["valid_time", "lead_h", "lat_idx", "lon_idx", "value"])


class ChunkSource(DataSource):
    """``spark.read.format("verispark_chunks").option("array", name).load(root)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "valid_time timestamp, lead_h double, lat_idx int, lon_idx int, value double"

    def reader(self, schema: object) -> ChunkReader:
        return ChunkReader(self.options["path"], self.options["array"])


def read_field(spark: SparkSession, root: str, name: str) -> DataFrame:
    """valid_time, lead_h, lat_idx, lon_idx, value of an array; a chunk that is wanted and absent fails, one that no filter wants is not opened."""
    spark.dataSource.register(ChunkSource)
    spark.conf.set(PUSHDOWN_KEY, "true")
    return spark.read.format(FORMAT).option("array", name).load(root)


def write_field(df: DataFrame, root: str, name: str, origin: dt.datetime, n_times: int, leads: list[float], shape: tuple[int, int], chunk: tuple[int, int] = (24, 1)) -> None:
    """Write hourly planes (time_idx, lead_idx, lat_idx, lon_idx, value) as one array of zlib chunks; a cell without a row is NaN.

    A task writes one chunk at a time, so memory holds a chunk; the coordinates and the metadata are small and come last, from the driver.
    """
    root, full = root.rstrip("/"), (*chunk, *shape)
    placed = df.select(F.floor(F.col("time_idx") / chunk[0]).cast("int").alias("ci"), F.floor(F.col("lead_idx") / chunk[1]).cast("int").alias("cj"),
                       *[F.col(c).cast("int").alias(c) for c in ("time_idx", "lead_idx", "lat_idx", "lon_idx")], F.col("value").cast("double").alias("value"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ci, cj = key[0].as_py(), key[1].as_py()
        block = np.full(full, np.nan)
        at = [table.column(c).to_numpy() for c in ("time_idx", "lead_idx", "lat_idx", "lon_idx")]
        block[at[0] - ci * chunk[0], at[1] - cj * chunk[1], at[2], at[3]] = table.column("value").to_numpy()
        write_bytes(f"{root}/{name}/{ci}.{cj}.0.0", zlib.compress(block.astype("<f8").tobytes(), 1))
        return pa.table({"ci": pa.array([ci], pa.int32()), "cj": pa.array([cj], pa.int32())})

    written = {(r.ci, r.cj) for r in placed.groupBy("ci", "cj").applyInArrow(run, "ci int, cj int").collect()}  # one row per chunk
    empty = zlib.compress(np.full(full, np.nan).astype("<f8").tobytes(), 1)
    for ci in range(-(-n_times // chunk[0])):
        for cj in range(-(-len(leads) // chunk[1])):
            if (ci, cj) not in written:
                write_bytes(f"{root}/{name}/{ci}.{cj}.0.0", empty)

    def axis(values: list[float]) -> dict:
        return {"shape": [len(values)], "chunks": [max(len(values), 1)], "dtype": "<f8", "order": "C", "compressor": None}

    hours = [float(k) for k in range(n_times)]
    for label, values in (("time", hours), ("lead", leads)):
        write_bytes(f"{root}/{label}/0", np.array(values, "<f8").tobytes())
    metadata = {
        f"{name}/.zarray": {"shape": [n_times, len(leads), *shape], "chunks": list(full), "dtype": "<f8", "order": "C", "compressor": {"id": "zlib"}},
        f"{name}/.zattrs": {"_ARRAY_DIMENSIONS": ["time", "lead", "latitude", "longitude"]},
        "time/.zarray": axis(hours), "time/.zattrs": {"units": f"hours since {origin.isoformat(sep=' ')}"}, "lead/.zarray": axis(leads), "lead/.zattrs": {"units": "hours"}}
    write_bytes(f"{root}/.zmetadata", json.dumps({"metadata": metadata}).encode())
