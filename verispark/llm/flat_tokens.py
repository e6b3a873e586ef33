"""Token ids as flat unsigned integer files with 64-bit document offsets.

A shard is two files: ``.bin`` holds the ids of its documents one after another, ``.idx`` a header
and one unsigned 64-bit offset per document and one past the end, counted in ids from the start of
the shard.  Shards follow one another in the order of the id; a shard's base, the number of ids
before it, comes from prefix sums over the shards.  Files are named by task attempt and listed in a
table, so what a lost or repeated attempt left behind is never read.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import Stages, local_path, open_input, open_output
from .pieces import PieceCache

MAGIC = b"FLATTOK1"
#: Documents written or read together.
GROUP_CHARS = 4_000_000
#: Words of which a Python worker keeps the ids, beside those of whole parts.
KNOWN_WORDS = 250_000
# Fixed value: the pattern by which a byte-level pre-tokenizer with use_regex splits a text.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others in order from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(others)}}


class Tokens:
    """The vocabulary as packed unsigned integers, with the cache of a Python worker."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tool.get_vocab_size() <= 1 << 16 else "<u4")
        newline = self._ids(["\n"])[0]
        self.newline = newline[0] if len(newline) == 1 else None
        self.cache = PieceCache(self._pack)
        # Words of plain byte-level models need no pre-tokenizer and go to the model directly.
        made = json.loads(self.tool.to_str())
        splits = made.get("pre_tokenizer") or {}
        self.model = self.tool.model if (
            splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space")
            and not made.get("normalizer") and all(t["special"] for t in made.get("added_tokens", []))) else None
        self.names, self.words = _byte_names(), {}

    def _ids(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tool.encode_batch_fast(parts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        named = word.encode().decode("latin-1").translate(self.names)
        packed = array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in self.model.tokenize(named)])
        if sys.byteorder == "big":
            packed.byteswap()
        self.words[word] = out = packed.tobytes()
        return out

    def _pack(self, parts: list[str]) -> list[bytes]:
        """Packed ids of text parts: word by word where that is known to be the same, else by the whole tokenizer."""
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
        # Classes of characters up to U+024F have been settled long ago; later ones may differ between libraries.
        direct = [self.model is not None and (p.isascii() or max(p) < "\u0250") for p in parts]
        known, word = self.words.get, self._word
        out = [b"".join([known(w) or word(w) for w in _WORDS(p)]) if good else b"" for p, good in zip(parts, direct, strict=True)]
        rest = [i for i, good in enumerate(direct) if not good]
        for i, packed in zip(rest, self._lines([parts[i] for i in rest]), strict=True):
            out[i] = packed
        return out

    def _lines(self, parts: list[str]) -> list[bytes]:
        """Packed ids of text parts by the whole tokenizer.

        A call of the tokenizer costs more than a short part, so parts without a line break go
        through it as lines of one text: a line break before a space or a letter is a token of its own.
        """
        out: list[bytes] = [b""] * len(parts)
        lines = [i for i, p in enumerate(parts) if p[:1] == " " and p[1:2] and "\n" not in p and not p[1:].isspace()
                 and not p[-1].isspace()] if self.newline is not None else []
        if lines:
            ids = np.array(self._ids(["\n".join([parts[i] for i in lines])])[0], self.dtype)
            ends = np.flatnonzero(ids == self.newline)
            assert len(ends) == len(lines) - 1
            raw, size = ids.tobytes(), self.dtype.itemsize
            for i, a, b in zip(lines, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True):
                out[i] = raw[a * size:b * size]
        alone = set(range(len(parts))).difference(lines)
        for i, ids in zip(sorted(alone), self._ids([parts[i] for i in sorted(alone)]), strict=True):
            out[i] = np.array(ids, self.dtype).tobytes()
        return out


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def write_flat(df: DataFrame, id_column: str, text_column: str, path: str, end_id: int, stages: Stages,
               partitions: int) -> DataFrame:
    """Write the ids of all texts in ascending order of the id; return the table of shards.

    Columns: shard (its place in the order), file (without suffix), n_docs, n_tokens, width, base.
    A null or empty text is the end id alone.  A null id sorts first; rows that repeat an id follow
    one another in the order of their texts, so the files do not depend on the partitioning.
    """
    folder = stages.path("flat")
    source = (df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
              # The driver's sample of the ranges holds ids and the first bytes of texts, which sort as the texts do.
              .withColumn("head", F.substring(F.col("text").cast("binary"), 1, 16))
              .repartitionByRange(partitions, "id", "head").select("id", "text").sortWithinPartitions("id", "text"))
    schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from verispark.llm.flat_tokens import MAGIC, grouped, tokens

        tool, shard = tokens(path), TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        end, size = np.array([end_id], tool.dtype).tobytes(), tool.dtype.itemsize
        body, index, n_docs, n_tokens = None, None, 0, 0
        for batch in batches:
            for texts, ids in grouped(batch):
                if body is None:
                    body, index = open_output(f"{name}.bin"), open_output(f"{name}.idx")
                    index.write(MAGIC + struct.pack("<II", size, 0))
                packed = tool.cache.texts(texts)
                lengths = np.array([len(p) // size + 1 for p in packed], np.int64)
                starts = n_tokens + np.concatenate([[0], np.cumsum(lengths)[:-1]])
                index.write(np.stack([ids, starts], axis=1).astype("<i8").tobytes())
                body.write(end.join(packed) + end)
                n_docs, n_tokens = n_docs + len(packed), n_tokens + int(lengths.sum())
        if body is not None:
            index.write(np.array([0, n_tokens], "<i8").tobytes())
            body.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [n_docs], "n_tokens": [n_tokens], "width": [size]}, schema=schema)

    shards = stages.put(source.mapInArrow(run, "shard int, file string, n_docs long, n_tokens long, width int"), "shards")
    # One row per shard: the sums of blocks of shards come first, so that no task needs the rows of all.
    block = F.floor(F.col("shard") / 1024)
    blocks = shards.groupBy(block.alias("block")).agg(F.sum("n_tokens").alias("n"))
    before = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    within = Window.partitionBy("block").orderBy("shard")
    return (shards.withColumn("block", block).join(before, "block")
            .select("shard", "file", "n_docs", "n_tokens", "width",
                    (F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("base")))


def grouped(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and ids of a batch, a bounded number of characters at a time; a null id is the least integer."""
    ids = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    texts = batch.column(1).to_pylist()
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > GROUP_CHARS or i + 1 == len(texts):
            yield texts[start:i + 1], ids[start:i + 1]
            start, size = i + 1, 0


class ShardIds:
    """The ids of a shard by range: memory-mapped where the store is a file system, read range by range elsewhere."""

    def __init__(self, file: str, width: int, n_tokens: int) -> None:
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        plain = local_path(f"{file}.bin")
        self.mapped = np.memmap(plain, self.dtype, "r", shape=(n_tokens,)) if plain is not None else None
        self.stream = None if plain is not None else open_input(f"{file}.bin")

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[span]
        size = self.dtype.itemsize
        self.stream.seek(span.start * size)
        return np.frombuffer(self.stream.read((span.stop - span.start) * size), self.dtype)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


def read_index(file: str) -> np.ndarray:
    """Rows of (document id, offset) and a last row with the number of ids."""
    with open_input(f"{file}.idx") as stream:
        raw = stream.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{file}.idx is no index of this format")
    return np.frombuffer(raw, "<i8", offset=16).reshape(-1, 2)


def read_flat(shards: DataFrame, id_column: str) -> DataFrame:
    """One row per document: id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit, little-endian)."""
    # At least as many tasks as shards: a shard is what one task wrote.
    spread = shards.repartition(max(1, shards.count()), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.flat_tokens import ShardIds, read_index

        for batch in batches:
            for row in batch.to_pylist():
                if row["n_docs"] == 0:
                    continue
                index, ids = read_index(row["file"]), ShardIds(row["file"], row["width"], row["n_tokens"])
                for a in range(0, row["n_docs"], 2000):
                    part = index[a:min(a + 2000, row["n_docs"]) + 1]
                    names, first = part[:-1, 0], int(part[0, 1])
                    held = ids[first:int(part[-1, 1])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(names, mask=names == -(1 << 63)), pa.array(part[:-1, 1] + row["base"]),
                        pa.array(np.diff(part[:, 1])),
                        pa.array([held[s:e].astype("<u4").tobytes() for s, e in zip(part[:-1, 1] - first, part[1:, 1] - first, strict=True)], pa.binary()),
                    ], names=["id", "start", "n_tokens", "ids"])
                ids.close()

    return spread.mapInArrow(run, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_column)
