"""A corpus pipeline of the operators in ``verispark.llm``; each stage is written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispark.llm import bpe, decontaminate, simhash, substring, toxicity
from verispark.llm.files import Stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier fitted to the labels outside one fold does not reject; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(toxicity.fold() != 2)
    return toxicity.without_toxic(docs, "text", toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest id, as it is.

    Null and empty texts share the fingerprint zero and are one group; rows that share an id stay or go together; a row without
    id stays only if no row of its group has one; an empty table stays empty.
    """
    return simhash.first_of_groups(docs, "doc_id", "text", Stages(spark, "simhash"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that an earlier one has; n_chars follows the text.

    A null text stays null, an empty one empty, a null id counts as smaller than all others, and rows that share an id do not cut
    each other.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = substring.remove_repeats(docs, "doc_id", "text", Stages(spark, "substring"), partitions)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, as they are; null and empty texts and repeated rows stay, an empty benchmark keeps all."""
    return decontaminate.without_passages(docs, "text", decontaminate.Benchmark(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded with the byte-level vocabulary and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is empty; repeated rows and null ids have rows of their own; columns beside id and text are ignored.
    """
    import public_tokenizers

    return bpe.digests(bpe.round_trip(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                      public_tokenizers.PATTERN), "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("substring", cut_repeated_passages), ("decontamination", drop_contaminated), ("byte_bpe", encode)]

#: SQL can state neither the classifier nor the tokenizer; the tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs, stages = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stages(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stages.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
