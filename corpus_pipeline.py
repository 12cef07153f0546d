"""The corpus pipeline: documents to a sharded training mix, each stage written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, jaccard, language, mixing, sharding
from foliant.llm.common import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null, empty and other texts without a letter, and those that no language fits with probability 0.5.

    Without labels (null ``lang``) only letterless texts go. Equal rows fare alike, long texts are read whole, an empty table stays empty, further
    columns of any name come along.
    """
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, Jaccard 0.75, by whole texts) one row stays: that of the smallest id, null last, then of the least text hash.

    Of equal rows one stays. Rows without words (null or empty text) all stay. An empty table stays empty, further columns of any name come along.
    """
    return jaccard.keep_first(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make a twentieth or more go, judged by their whole text.

    Null and empty texts stay, equal rows fare alike, an empty table stays empty, an empty benchmark removes nothing, further columns of any name come along.
    """
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it, up to twice.

    A null source is a source. Null and empty texts hold no words and are not taken; equal rows each get their copies; long texts count whole; an empty table stays empty;
    further columns of any name or type come along.
    """
    return mixing.apply_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row of the mix.

    Null ids are one key, null text counts as empty, equal rows get slots one after the other, an empty table gives no rows, further columns of any name are ignored.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Hashed models, hash-drawn copies and 64-bit shingle hashes have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
