"""Every stage of the pipeline against brute force on its own input."""

import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from verispark.llm import bpe, decontaminate, toxicity
from verispark.llm.files import Stages

from test_decontaminate import brute as brute_passages
from test_simhash import brute as brute_groups


def repeated_cut(rows, width=13):
    first = {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i, w in split.items():
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = {x for k in range(len(w) - width + 1) if first[tuple(w[k:k + width])] < i for x in range(k, k + width)}
        out[i] = b" ".join([x for k, x in enumerate(w) if k not in gone]).decode()
    return out


@pytest.fixture(scope="module")
def written(spark, sf):
    docs, stages, out = spark.read.parquet(f"{sf}/documents.parquet"), Stages(spark, "t"), []
    out.append(docs)
    for name, stage in cp.STAGES:
        docs = stages.put(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf, written):
    documents, clean, single, cut, held, coded = written
    for df in (clean, single, cut, held):
        assert df.columns == documents.columns
    model = toxicity.fit(documents, spark.read.parquet(f"{sf}/labels.parquet").filter(toxicity.fold() != 2))
    rejected = {r.doc_id for r in toxicity.score(documents, model).collect() if r.predicted}
    assert sorted(rows_of(clean)) == sorted(r for r in rows_of(documents) if r[0] not in rejected)
    assert sorted(r[0] for r in rows_of(single)) == sorted(i for i, _, c in brute_groups(rows_of(clean)) if i == c)
    assert dict(rows_of(cut)) == repeated_cut(rows_of(single))
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    inside = {d for d, t in rows_of(cut) for _, b in items if " ".join(decontaminate.words_of(b)) in " ".join(decontaminate.words_of(t))}
    dropped = dict(set(rows_of(cut)) - set(rows_of(held)))
    assert inside <= set(dropped) and set(dropped) == {d for d, _ in brute_passages(list(dropped.items()), items)}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows_of(held):
        ids = tik.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in coded.collect()) == sorted(want)


def test_odd_documents_pass_every_stage(spark, tmp_path):
    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (None, "no id at all here", "en", None, 3), (3, "x " * 40_000, "en", "s", 3), (4, "plain words", "en", "s", 3),
            (4, "plain words", "en", "s", 3), (5, "plain words", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame, want in ((docs, [1, 3, 4, 4, None]), (docs.limit(0), [])):
        frame = frame.withColumn("stay", docs.doc_id)
        stages = Stages(spark, "t")
        for name, stage in cp.STAGES:
            frame = stages.put(stage(spark, frame, str(tmp_path)), name)
        assert sorted([r.doc_id for r in frame.collect()], key=str) == sorted(want, key=str)
