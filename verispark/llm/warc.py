"""WARC archives with a two-level capture index.

Captures are written as gzip members of WARC files, one file per task.  The index sorts captures by
their key, the URL with its host reversed, into compressed blocks of lines; a shard's directory
keeps the first key of each block, and the list of shards the first key of each shard.  A look-up
searches both lists by bisection, reads the blocks by range, and reads the captures by range.
Files are named by task attempt and known only through stage tables, so what a lost attempt left
behind is never read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import Stages, open_input, open_output

#: Captures of one index block, and bytes of an archive that one task reads.
BLOCK_LINES = 256
PART_BYTES = 4 << 20
#: All records carry one date, so that an archive depends on nothing but its pages.
DATE = "2020-01-01T00:00:00Z"
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"


def url_key(url: Column) -> Column:
    """The host's labels in reverse order and lower case, ``)``, then path and query; a fragment is left out.

    A text without scheme is its own key, a null one the empty key.
    """
    text = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(text, _SCHEME + "[^/?#]*", ""), "(?s)#.*$", "")
    host = F.lower(F.regexp_extract(text, _SCHEME + "([^/?#]*)", 1))
    return F.when(text.rlike(_SCHEME), F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), rest)).otherwise(text)


def plan_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest and refers_to: the largest page_id with an equal payload of ``min_bytes`` or more.

    ``refers_to`` is null for responses.  A null html is the empty payload; a null page_id comes before
    all others; rows that share the largest page_id are all responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = (rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest")
              .agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its HTTP message, or a revisit without payload."""
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    content = b"\r\n".join(head) + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {json.dumps(url)}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; the payload of a revisit is None."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    content = rest[:int(fields["Content-Length"])]
    page = fields["WARC-Record-ID"][len("<urn:page:"):-1]
    refers = fields.get("WARC-Refers-To")
    return {"page_id": int(page) if page else None, "url": json.loads(fields["WARC-Target-URI"]), "record_type": fields["WARC-Type"],
            "refers_to": int(refers[len("<urn:page:"):-1]) if refers else None, "digest": fields["WARC-Payload-Digest"][5:],
            "payload": content.partition(b"\r\n\r\n")[2] if refers is None else None}


def write_archive(planned: DataFrame, stages: Stages) -> DataFrame:
    """Write the records; return the captures: key, page_id, line (a JSON list of key, page_id, file, offset, length).

    Equal rows are records of their own; without rows no archive is written.  Files are named by task attempt, so what a lost
    attempt left is in no capture.
    """
    folder = stages.path("warc")
    rows = planned.select("page_id", "url", "payload", "digest", "refers_to", url_key(F.col("url")).alias("key"))
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.warc import record_bytes

        file, stream, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            stream = stream or open_output(file)
            keys, ids, lines = [], [], []
            for page_id, url, payload, digest, refers_to, key in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                member = gzip.compress(record_bytes(page_id, url, payload, digest, refers_to), 6, mtime=0)
                stream.write(member)
                keys.append(key)
                ids.append(page_id)
                lines.append(json.dumps([key, page_id, file, at, len(member)]))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(lines, pa.string())], schema=schema)
        if stream is not None:
            stream.close()

    return stages.put(rows.mapInArrow(run, "key string, page_id long, line string"), "captures")


def write_index(captures: DataFrame, stages: Stages, partitions: int) -> DataFrame:
    """Sort the captures into shards of compressed blocks; return the list of shards: first_key, last_key, file.

    A shard's file holds its blocks; beside it lies its directory, one line per block with the first
    key, the last key, offset and length.  Equal captures keep a line each; without captures there is no shard.
    """
    folder = stages.path("index")
    ordered = captures.repartitionByRange(partitions, "key", "page_id", "line").sortWithinPartitions("key", "page_id", "line").select("key", "line")
    schema = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.warc import BLOCK_LINES

        file, stream, at, directory, waiting = f"{folder}/{uuid.uuid4().hex}", None, 0, [], []

        def flush() -> None:
            nonlocal at
            block = zlib.compress("\n".join([line for _, line in waiting]).encode(), 6)
            stream.write(block)
            directory.append([waiting[0][0], waiting[-1][0], at, len(block)])
            at += len(block)
            waiting.clear()

        for batch in batches:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stream = stream or open_output(f"{file}.blocks")
                waiting.append(pair)
                if len(waiting) == BLOCK_LINES:
                    flush()
        if stream is not None:
            if waiting:
                flush()
            stream.close()
            with open_output(f"{file}.directory") as out:
                out.write("\n".join([json.dumps(entry) for entry in directory]).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[-1][1]]), pa.array([file])], schema=schema)

    return stages.put(ordered.mapInArrow(run, "first_key string, last_key string, file string"), "shards")


def look_up(shards: DataFrame, keys: DataFrame, partitions: int) -> DataFrame:
    """The captures of all given keys (column key): page_id, file, offset, length; unknown keys have none.

    Distinct keys are dealt out in order, so a task meets few shards; the list of shards, one entry per
    task that wrote the index, goes with the function.  A key with very many captures has many blocks,
    and blocks are dealt out anew before they are read.  Repeated keys are asked for once, null keys find nothing; without shards or keys nothing is found.
    """
    listed = sorted([list(r) for r in shards.collect()])
    asked = keys.select("key").distinct().repartitionByRange(partitions, "key").sortWithinPartitions("key")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, directory = None, []
        firsts, lasts = [e[0] for e in listed], [e[1] for e in listed]
        for batch in batches:
            out: list[tuple] = []
            for key in batch.column(0).to_pylist():
                for _, _, file in listed[bisect.bisect_left(lasts, key):bisect.bisect_right(firsts, key)]:
                    if file != last:
                        with open_input(f"{file}.directory") as stream:
                            directory = [json.loads(line) for line in stream.read().decode().split("\n")]
                        heads, tails, last = [e[0] for e in directory], [e[1] for e in directory], file
                    for _, _, offset, length in directory[bisect.bisect_left(tails, key):bisect.bisect_right(heads, key)]:
                        out.append((key, file, offset, length))
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "file", "offset", "length"), r, strict=True)) for r in out], schema=pa.schema(
                [("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    # At most as many keys share a block as it has lines.
    blocks = asked.mapInArrow(find, "key string, file string, offset long, length long").groupBy("file", "offset", "length").agg(F.collect_set("key").alias("keys"))
    # Rows of blocks are tiny and their reads are not: a stated number of tasks is not folded into one.
    blocks = blocks.repartition(partitions, "file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(f"{row['file']}.blocks") as stream:
                    stream.seek(row["offset"])
                    lines = zlib.decompress(stream.read(row["length"])).decode().split("\n")
                wanted = set(row["keys"])
                found = [c for c in map(json.loads, lines) if c[0] in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[1] for c in found], pa.int64()), pa.array([c[2] for c in found], pa.string()),
                     pa.array([c[3] for c in found], pa.int64()), pa.array([c[4] for c in found], pa.int64())],
                    names=["page_id", "file", "offset", "length"])

    return blocks.mapInArrow(read, "page_id long, file string, offset long, length long")


def read_records(captures: DataFrame) -> DataFrame:
    """Read captures by range: page_id, url, record_type, refers_to, digest (of the header), payload (null for revisits).

    Tasks follow from the bytes to read, not from the few bytes of their pointers; a written table of captures is summed at
    little cost.  Equal captures are read once each; an empty table has no records; other columns are ignored.
    """
    part = F.floor(F.col("offset") / PART_BYTES)
    total = captures.agg(F.sum("length")).head()[0] or 0
    near = captures.select("file", "offset", "length", part.alias("part")).repartition(int(total // PART_BYTES) + 1, "file", "part").sortWithinPartitions("file", "offset")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.warc import parse_record

        stream, opened = None, None
        for batch in batches:
            out, size = [], 0
            for file, offset, length in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if file != opened:
                    if stream is not None:
                        stream.close()
                    stream, opened = open_input(file), file
                stream.seek(offset)
                out.append(parse_record(gzip.decompress(stream.read(length))))
                size += len(out[-1]["payload"] or b"")
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if stream is not None:
            stream.close()

    return near.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, digest string, payload binary")


def payload_facts(records: DataFrame, stages: Stages) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, with the facts of a revisit's payload taken from its response.

    What was read is measured once and written; a response that many records revisit is one row of the join.  A revisit
    whose response was not read has no payload facts; without records there are no rows.
    """
    facts = stages.put(records.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"),
                                      F.sha1("payload").alias("sha1")), "facts")
    shape = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = facts.filter("record_type = 'response'").withColumns({"payload_bytes": F.col("bytes"), "payload_digest": F.col("sha1")})
    there = responses.groupBy(F.col("page_id").alias("refers_to"), F.col("sha1").alias("digest")).agg(F.max("bytes").alias("payload_bytes"))
    revisits = facts.filter("record_type = 'revisit'").join(there, ["refers_to", "digest"], "left")
    digest = F.when(F.col("payload_bytes").isNotNull(), F.col("digest"))
    return responses.select(shape).unionByName(revisits.withColumn("payload_digest", digest).select(shape))
