"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The model is serialised directly: byte b of a piece is the character U+0100 + b, the score of a
piece is its negative rank, normalisation is the identity and no space is added or removed.  BPE in
sentencepiece joins the neighbouring pair with the highest score, leftmost first, which is the pair
with the lowest rank.  Text is cut by the pattern of the vocabulary first; decoding maps ids to
bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceCache

#: Texts tokenized together; it bounds what a Python worker holds beside its Arrow batch.
GROUP_CHARS = 4_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def mapped(token: bytes) -> str:
    """The piece of a token: one character for each byte, none of them a space."""
    return "".join([chr(0x100 + b) for b in token])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model; piece 0 is the unknown piece it must have, piece k the k-th token by rank."""
    order = sorted(ranks, key=ranks.__getitem__)
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    out += [_field(1, _field(1, mapped(t).encode()) + _field(2, float(-ranks[t]))) for t in order]
    # Trainer: BPE, vocabulary size, no special pieces but the unknown one.
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(40, 0)
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    # Normaliser: identity, no dummy prefix, white space left as it is.
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary file, with the cache of a Python worker."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        order = sorted(self.ranks, key=self.ranks.__getitem__)
        self.id_of_piece = [0, *(self.ranks[t] for t in order)]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.find = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.cache = PieceCache(self._pack, 300_000)
        self.table = bytes(range(256)).decode("latin-1")

    def _pack(self, parts: list[str]) -> list[bytes]:
        """Packed ids of text parts; a match that is a token as a whole is that token."""
        matches = [[m.encode() for m in self.find(p)] for p in parts]
        todo = list({m for found in matches for m in found if m not in self.ranks})
        made = dict(zip(todo, self.model.encode([mapped(m) for m in todo], num_threads=1), strict=True)) if todo else {}
        name, ranks = self.id_of_piece, self.ranks
        out = []
        for found in matches:
            ids: list[int] = []
            for m in found:
                if m in ranks:
                    ids.append(ranks[m])
                else:
                    ids += [name[i] for i in made[m]]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.cache.texts(texts)

    def decode(self, packed: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in memoryview(packed).cast("I")])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > GROUP_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def round_trip(df: DataFrame, id_column: str, text_column: str, path: str, pattern: str) -> DataFrame:
    """One row per input row: the id, ``ids`` and ``decoded``.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes those ids stand for.
    A null or empty text has no ids and decodes to no bytes; null and repeated ids pass through; any
    other column is ignored, whatever its name.  Rows are independent, so there is no shuffle.
    """
    source = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verispark.llm.bpe import codec

        tool = codec(path, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _groups(texts):
                packed = tool.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).cast(pa.int64()), pa.array(packed, pa.binary()),
                     pa.array([tool.decode(p) for p in packed], pa.binary())], schema=schema)

    return source.mapInArrow(run, "id long, ids binary, decoded binary").withColumnRenamed("id", id_column)


def digests(coded: DataFrame, id_column: str) -> DataFrame:
    """Token count and digests of what ``round_trip`` returns."""
    return coded.select(
        F.col(id_column), F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
