"""Byte-level BPE and flat token files against the tokenizer libraries themselves."""

import base64
import hashlib
import struct
import zlib

import public_tokenizers
import pytest

from verispark.llm import bpe, flat_tokens
from verispark.llm.files import Stages

TEXTS = [
    (5, "Hello  world.\n\n It's   42 tokens \t x's   é  end "), (1, None), (2, ""), (2, "a"), (3, "  "), (None, "x y"),
    (9, "naïve 漢字 🙂🙂 don't <|endoftext|> <|im_end|>\x00\x1c \x85 z"), (9, "naïve 漢字"), (7, "ab " * 40_000), (8, "\n a \n\n b\r\n c"),
    (11, "x" * 5000), (12, "word　 next  \n  last\n"), (4, " lead"), (6, "\ttab tab\t"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", "z") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, id string, decoded string")


@pytest.fixture(scope="module")
def tik():
    import tiktoken
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def hug():
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tool.encode_special_tokens = True
    return tool


def expected_bpe(tik, rows):
    out = []
    for i, t in rows:
        ids = tik.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def expected_flat(hug, rows):
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*hug.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return sorted(out, key=str)


def test_bpe_small(docs, tik):
    coded = bpe.round_trip(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted([tuple(r) for r in bpe.digests(coded, "doc_id").collect()], key=str) == expected_bpe(tik, TEXTS)
    assert bpe.round_trip(docs.limit(0), "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_every_token_is_reachable_by_its_bytes(tik):
    tool = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for token, rank in list(tool.ranks.items())[::97]:
        assert tool.decode(struct.pack("<I", rank)) == token


def test_cache_is_bounded(tik):
    tool = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    tool.cache.limit = 10
    for k in range(5):
        text = " ".join(f"w{k}{j}" for j in range(20))
        assert list(memoryview(tool.encode([text])[0]).cast("I")) == tik.encode_ordinary(text)
        assert len(tool.cache.known) <= 10 + 20


def test_op8_query(spark, sf, tik):
    from verispark.llm.queries import op8
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op8(spark, sf).collect()], key=str) == expected_bpe(tik, rows)


def test_flat_small(spark, docs, hug):
    for partitions in (1, 3):
        shards = flat_tokens.write_flat(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), 0, Stages(spark, "t"), partitions)
        from pyspark.sql import functions as F
        got = flat_tokens.read_flat(shards, "doc_id").select("doc_id", "start", "n_tokens", F.crc32("ids"))
        assert sorted([tuple(r) for r in got.collect()], key=str) == expected_flat(hug, TEXTS)
    empty = flat_tokens.write_flat(docs.limit(0), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), 0, Stages(spark, "t"), 2)
    assert flat_tokens.read_flat(empty, "doc_id").count() == 0


def test_words_go_to_the_model_as_the_whole_tokenizer_would(hug):
    import random
    rng, tool = random.Random(7), flat_tokens.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert tool.model is not None
    letters = "abcXYZ '.,!-_0129éßŁ\t\n\r\x0b\x00\u00a0\u0250\u4e2d🙂<|>"
    parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(3000)] + [" don't", " we'll've", "  ", " \n x", "<|endoftext|>"]
    direct, whole = tool._pack(parts), tool._lines(parts)
    assert direct == whole
    assert [list(memoryview(p).cast("H")) for p in whole] == [hug.encode(p, add_special_tokens=False).ids for p in parts]


def test_range_reads_equal_the_memory_map(spark, docs, monkeypatch):
    shards = flat_tokens.write_flat(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), 0, Stages(spark, "t"), 1)
    row = shards.first()
    mapped = flat_tokens.ShardIds(row.file, row.width, row.n_tokens)
    monkeypatch.setattr(flat_tokens, "local_path", lambda path: None)
    ranged = flat_tokens.ShardIds(row.file, row.width, row.n_tokens)
    assert (ranged[3:9] == mapped[3:9]).all() and (ranged[0:row.n_tokens] == mapped[0:row.n_tokens]).all()
    ranged.close()


def test_sample_of_the_ranges_holds_no_texts(spark):
    docs = spark.createDataFrame([(i // 2, "word " * 500) for i in range(50)], "doc_id long, text string")
    seen = []
    frame = type(docs)
    real = frame.repartitionByRange
    try:
        frame.repartitionByRange = lambda self, n, *cols: (seen.append(cols), real(self, n, *cols))[1]
        flat_tokens.write_flat(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), 0, Stages(spark, "t"), 3)
    finally:
        frame.repartitionByRange = real
    assert seen == [("id", "head")]


def test_op4_query(spark, sf, hug):
    from verispark.llm.queries import op4
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op4(spark, sf).collect()], key=str) == expected_flat(hug, rows)
