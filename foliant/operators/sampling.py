"""Deterministic samples and shards."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The seeded draws that must equal other tools' list all positions in the driver; for larger tables there is ``hash_sample``.
MOST_POSITIONS = 5_000_000


def _listed(n: int) -> int:
    if n > MOST_POSITIONS:
        raise ValueError(f"over {MOST_POSITIONS} positions: use hash_sample")
    return n


def shuffled_ids(n: int, k: int, seed: int = 42) -> list[int]:
    """The first ``k`` of a seeded shuffle of the positions, sorted."""
    order = list(range(_listed(n)))
    random.Random(seed).shuffle(order)
    return sorted(order[:k])


def sampled_ids(n: int, k: int, seed: int = 42) -> list[int]:
    """A seeded sample of the positions in the order drawn."""
    return random.Random(seed).sample(range(_listed(n)), k)


def chosen_ids(n: int, k: int, seed: int = 42) -> list[int]:
    """The same by numpy's legacy generator."""
    return np.random.RandomState(seed).choice(_listed(n), k, replace=False).tolist()


def ids_frame(spark: SparkSession, ids: list[int], key: str = "doc_id") -> DataFrame:
    """``ord, key`` of a sample whose size the caller chose."""
    return spark.createDataFrame(list(enumerate(ids)), f"ord long, {key} long")


def select_in_order(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``ids(ord, key)`` with their place; ids without a row are left out."""
    return docs.join(ids, key)


def hash_sample(docs: DataFrame, k: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """``k`` rows by the order of a seeded digest: the way for tables whose ids the driver can't list."""
    return docs.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")))).orderBy("_h", key).limit(k).drop("_h")


def shard(ids: DataFrame, size: int) -> DataFrame:
    """Slices of ``size`` in the order of ``ord``: adds ``shard`` and ``place`` in it."""
    return ids.withColumn("shard", (F.col("ord") / size).cast("int")).withColumn("place", F.col("ord") % size)


def shard_report(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per shard its size and first and last id, whether it lies wholly after the one before, and how many ids it shares with others."""
    per = shards.groupBy("shard").agg(F.count("*").alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    twice = shards.groupBy(key).agg(F.count_distinct("shard").alias("c")).where("c > 1").select(F.col(key).alias("_k"))
    shared = shards.join(twice, F.col(key) == F.col("_k")).groupBy("shard").agg(F.count_distinct(key).alias("overlap"))
    return per.join(shared, "shard", "left").select("shard", "n", "first_id", "last_id", F.coalesce("overlap", F.lit(0)).alias("overlap"), F.expr("coalesce(first_id > lag(last_id) over (order by shard), true)").alias("in_order"))
