"""Zip members, chunked arrays and GeoJSON."""

from __future__ import annotations

import codecs
import io
import json
import posixpath
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .store import open_input, write_bytes


def safe_member(name: str) -> bool:
    """A member must stay below the folder it is unpacked into."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    return not (clean.startswith(("/", "../")) or clean == ".." or ":" in clean.split("/")[0])


#: Bytes of a member that are inflated at once.
PIECE = 1 << 20
_MEMBERS = "path string, member string, header long, packed long, method int"


def zip_members(spark: SparkSession, paths: str, prefix: str = "", suffix: str = "", single: bool = True) -> DataFrame:
    """path, member, header, packed, method: the matching members of every archive, from its central directory alone.

    An archive with an unsafe name, with an encrypted member, or, if ``single``, without exactly one match fails.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                with open_input(path) as stream, zipfile.ZipFile(stream) as bundle:
                    infos = bundle.infolist()
                unsafe = [i.filename for i in infos if not safe_member(i.filename)]
                if unsafe:
                    raise ValueError(f"unsafe member {unsafe[0]!r} in {path}")
                picked = [i for i in infos if posixpath.basename(i.filename).startswith(prefix) and i.filename.endswith(suffix) and not i.is_dir()]
                if single and len(picked) != 1:
                    raise ValueError(f"{path} holds {len(picked)} members named {prefix}*{suffix}")
                locked = [i.filename for i in picked if i.flag_bits & 1]
                if locked:
                    raise ValueError(f"member {locked[0]!r} in {path} is encrypted")
                yield pd.DataFrame({"path": path, "member": [i.filename for i in picked], "header": [i.header_offset for i in picked],
                                    "packed": [i.compress_size for i in picked], "method": [i.compress_type for i in picked]}).astype({"member": object})

    # Paths and sizes come from the listing; no content is read here.
    scan = spark.read.format("binaryFile").load(paths).select("path")
    return scan.mapInPandas(run, _MEMBERS)


def inflated(stream: io.RawIOBase, header: int, packed: int, method: int) -> Iterator[bytes]:
    """The bytes of a stored or deflated member, piece by piece, from its place in the archive."""
    stream.seek(header)
    fixed = stream.read(30)
    if fixed[:4] != b"PK\x03\x04":
        raise ValueError(f"no member starts at {header}")
    stream.seek(header + 30 + int.from_bytes(fixed[26:28], "little") + int.from_bytes(fixed[28:30], "little"))
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"compression method {method} is not read by range")
    inflate = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
    while packed:
        piece = stream.read(min(PIECE, packed))
        if not piece:
            raise EOFError("archive ends within a member")
        packed -= len(piece)
        while piece:
            yield inflate.decompress(piece, PIECE) if inflate else piece
            piece = inflate.unconsumed_tail if inflate else b""
    if inflate:
        yield inflate.flush()


def read_zip_lines(spark: SparkSession, paths: str, prefix: str = "", suffix: str = "", encoding: str = "latin-1",
                   single: bool = True, batch: int = 50_000) -> DataFrame:
    """path, member and line of the matching members of every archive, one member per task.

    The central directory tells where a member lies; a task reads that range and inflates it as a
    stream, so neither an archive nor a member is held in memory.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                decoder, rest, lines = codecs.getincrementaldecoder(encoding)(), "", []
                with open_input(row.path) as stream:
                    for piece in inflated(stream, row.header, row.packed, row.method):
                        parts = (rest + decoder.decode(piece)).split("\n")
                        rest = parts.pop()
                        lines += parts
                        while len(lines) >= batch:
                            yield pd.DataFrame({"path": row.path, "member": row.member, "line": [x.rstrip("\r") for x in lines[:batch]]})
                            lines = lines[batch:]
                lines += [x for x in [rest + decoder.decode(b"", True)] if x]
                if lines:
                    yield pd.DataFrame({"path": row.path, "member": row.member, "line": [x.rstrip("\r") for x in lines]})

    members = cut_lineage(zip_members(spark, paths, prefix, suffix, single))
    dealt = members.repartition(max(1, min(members.count(), 10 * spark.sparkContext.defaultParallelism)), "path", "header")
    return dealt.mapInPandas(run, "path string, member string, line string")


def write_zips(df: DataFrame, root: str, key: str, member: str, line: str, order: str, encoding: str = "latin-1") -> None:
    """One archive per key below ``root`` with one deflated member per name, its lines in order; a task streams one archive's rows."""
    root = root.rstrip("/")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, bundle, buffer, name, out = None, None, None, None, None

        def close() -> None:
            out.close()
            bundle.close()
            write_bytes(f"{root}/{current}.zip", buffer.getvalue())

        for frame in frames:
            for k, m, text in zip(frame["k"], frame["m"], frame["t"]):
                if k != current:
                    if bundle is not None:
                        close()
                    current, name, buffer = k, None, io.BytesIO()
                    bundle = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
                if m != name:
                    if name is not None:
                        out.close()
                    name, out = m, bundle.open(zipfile.ZipInfo(m), "w")
                out.write(f"{text}\n".encode(encoding))
            yield pd.DataFrame({"n": [len(frame)]})
        if bundle is not None:
            close()

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(member).alias("m"), F.col(line).alias("t"), F.col(order).alias("o"))
    sent = rows.repartition(df.sparkSession.sparkContext.defaultParallelism, "k").sortWithinPartitions("k", "m", "o").select("k", "m", "t")
    sent.mapInPandas(run, "n long").write.format("noop").mode("overwrite").save()


def read_geojson_segments(spark: SparkSession, path: str, west: float, south: float, east: float,
                          north: float, per_line: bool = False) -> DataFrame:
    """Line segments of LineString and MultiLineString features that touch a bounding box.

    A document spread over lines is one record; with ``per_line`` every line is a document of its own, and files are split.
    """
    schema = ("features array<struct<geometry:struct<type:string,coordinates:string>>>")
    raw = spark.read.option("multiLine", not per_line).schema(schema).json(path)
    geometry = raw.select(F.explode("features.geometry").alias("g"))
    single = F.from_json("g.coordinates", "array<array<double>>")
    many = F.from_json("g.coordinates", "array<array<array<double>>>")
    parts = geometry.select(F.explode(F.when(F.col("g.type") == "LineString", F.array(single)).otherwise(many)).alias("p"))
    ends = parts.select(F.inline(F.arrays_zip(
        F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("a", "b"))
    flat = ends.select(F.col("a")[0].alias("lon_a"), F.col("a")[1].alias("lat_a"),
                       F.col("b")[0].alias("lon_b"), F.col("b")[1].alias("lat_b"))
    return flat.where((F.greatest("lon_a", "lon_b") >= west) & (F.least("lon_a", "lon_b") <= east)
                      & (F.greatest("lat_a", "lat_b") >= south) & (F.least("lat_a", "lat_b") <= north))


def decode_chunk(content: bytes, compressor: dict | None) -> bytes:
    """Raw bytes of one chunk; codecs beyond zlib, gzip and zstd need an optional library."""
    if not compressor:
        return content
    codec = compressor["id"]
    if codec in ("zlib", "gzip"):
        return zlib.decompress(content, 47)
    if codec == "zstd":
        import zstandard
        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    try:
        import numcodecs
    except ImportError as error:
        raise ValueError(f"codec {codec!r} needs the optional library numcodecs") from error
    return numcodecs.get_codec(compressor).decode(content)


def store_metadata(spark: SparkSession, root: str) -> dict:
    """Consolidated metadata of a version-2 chunk store: a small document, read on the driver.

    The scan skips names that start with a dot, so the file system is asked directly.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.zmetadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)["metadata"]


def read_coordinate(spark: SparkSession, root: str, name: str, metadata: dict) -> list[float]:
    """A one-dimensional coordinate, its chunks in order: one axis of the grid, so the driver holds no more than that."""
    spec = metadata[f"{name}/.zarray"]
    size, step = spec["shape"][0], spec["chunks"][0]
    chunks = {int(r.path.rsplit("/", 1)[1]): bytes(r.content)
              for r in spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{name}/[0-9]*").select("path", "content").collect()}
    values: list[float] = []
    missing = sorted(set(range((size + step - 1) // step)) - chunks.keys())
    if missing:
        raise FileNotFoundError(f"coordinate {name!r} lacks the chunks {missing}")
    for index in range((size + step - 1) // step):
        raw = np.frombuffer(decode_chunk(chunks[index], spec.get("compressor")), dtype=np.dtype(spec["dtype"]))
        values.extend(float(v) for v in raw[:min(step, size - index * step)])
    return values


def read_chunked_field(spark: SparkSession, root: str, name: str, metadata: dict | None = None) -> DataFrame:
    """A (time[, lead], lat, lon) or static (lat, lon) array as long rows.

    Each chunk file is one row of the scan, so chunks decode in parallel.
    Horizontal dimensions must not be split, and come out as (lat_idx, lon_idx)
    whichever order the store declares.
    """
    metadata = metadata or store_metadata(spark, root)
    spec, attrs = metadata[f"{name}/.zarray"], metadata.get(f"{name}/.zattrs", {})
    shape, chunks = tuple(spec["shape"]), tuple(spec["chunks"])
    if chunks[-2:] != shape[-2:] or len(shape) not in (2, 3, 4):
        raise ValueError(f"array {name!r}: one chunk must hold a whole horizontal plane, but chunks {chunks} cut shape {shape}")
    dims = attrs.get("_ARRAY_DIMENSIONS", ["time", "lead", "latitude", "longitude"][-len(shape):])[-2:]
    if sorted(dims) != ["latitude", "longitude"]:
        raise ValueError(f"array {name!r}: the last two dimensions are {dims}, not latitude and longitude")
    swap, order = dims == ["longitude", "latitude"], spec.get("order", "C")
    dtype, compressor = np.dtype(spec["dtype"]), spec.get("compressor")
    lead_axes = len(shape) - 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                place = [int(p) for p in path.rsplit("/", 1)[1].split(".")]
                block = np.frombuffer(decode_chunk(bytes(content), compressor), dtype=dtype).reshape(chunks, order=order)
                for offset in np.ndindex(*chunks[:lead_axes]):
                    at = [i * c + o for i, c, o in zip(place, chunks, offset)]
                    # Border chunks are padded past the end of the array.
                    if any(a >= s for a, s in zip(at, shape)):
                        continue
                    plane = block[offset].astype(float)
                    plane = plane.T if swap else plane
                    lat, lon = np.indices(plane.shape)
                    yield pd.DataFrame({
                        "time_idx": np.int32(at[0] if lead_axes >= 1 else 0),
                        "lead_idx": np.int32(at[1] if lead_axes == 2 else 0),
                        "lat_idx": lat.ravel().astype("int32"), "lon_idx": lon.ravel().astype("int32"),
                        "value": plane.ravel()})

    scan = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{name}/[0-9]*").select("path", "content")
    # A plane that is absent would be a gap in every later result: names are counted before anything is read.
    wanted = 1
    for s, c in zip(shape, chunks):
        wanted *= -(-s // c)
    inside = F.lit(True)
    parts = F.split(F.element_at(F.split("path", "/"), -1), "\\.")
    for axis, (s, c) in enumerate(zip(shape, chunks)):
        inside = inside & (F.get(parts, F.lit(axis)).cast("int") < -(-s // c))
    there = scan.select("path").where(inside).distinct().count()
    if there != wanted:
        raise FileNotFoundError(f"array {name!r} has {there} of {wanted} chunks")
    return scan.mapInPandas(run, "time_idx int, lead_idx int, lat_idx int, lon_idx int, value double")
