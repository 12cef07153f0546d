"""Checks and statistics of chunk tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import ChunkConfig
from ..functions import text as T
from ..functions import tokens as K


def validate(chunks: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """``doc_id, chunk_id, is_valid, warnings``: only a chunk over the budget is invalid; the other findings are warnings.

    ``chunks`` has ``text, token_count`` and, where known, ``sentences, coherence, overlap_tokens``.
    """
    w = "(partition by doc_id order by chunk_id)"
    has = set(chunks.columns)
    x = chunks.withColumn("_last", F.expr(f"lead(chunk_id) over {w} is null")).withColumn("_prev", F.expr(f"lag(token_count) over {w}"))
    found = [
        F.when(F.col("token_count") > cfg.max_tokens, F.lit("over budget")),
        F.when((F.col("token_count") < cfg.min_tokens) & ~F.col("_last"), F.lit("under minimum")),
        F.when(F.abs(K.token_count(F.col("text")) - F.col("token_count")) > 5, F.lit("count mismatch")),
    ]
    if "sentences" in has:
        found.append(F.when(T.strip(F.array_join("sentences", " ")) != T.strip(F.col("text")), F.lit("not reconstructible")))
    if "coherence" in has:
        found.append(F.when(F.col("coherence.local" if isinstance(chunks.schema["coherence"].dataType, StructType) else "coherence") < cfg.coherence_threshold, F.lit("low coherence")))
    if "overlap_tokens" in has:
        found.append(F.when(F.col("overlap_tokens") > 0.5 * F.least("_prev", "token_count"), F.lit("excessive overlap")))
    return x.select("doc_id", "chunk_id", (F.col("token_count") <= cfg.max_tokens).alias("is_valid"), F.array_join(F.filter(F.array(*found), lambda m: m.isNotNull()), "; ").alias("warnings"))


def longest_common_run(tail: list[str], head: list[str]) -> int:
    """The longest run of equal tokens that stands in ``tail`` no earlier than in ``head``: one row of the table at a time."""
    code = {t: i for i, t in enumerate(dict.fromkeys([*tail, *head]))}
    a, b = (np.array([code[t] for t in x], np.int64) for x in (tail, head))
    best, run = 0, np.zeros(len(b) + 1, np.int64)
    for i, x in enumerate(a.tolist()):
        new = np.zeros(len(b) + 1, np.int64)
        near = min(i + 1, len(b))
        new[1 : near + 1] = (run[:near] + 1) * (b[:near] == x)
        best, run = max(best, int(new.max())), new
    return best


def overlap_runs(chunks: DataFrame, slack: int = 20, beyond: int = 50) -> DataFrame:
    """``doc_id, chunk_id, reported, found, matches, too_small``: the overlap that a chunk reports against the run of tokens it shares with its predecessor.

    Looked for in the last tokens of the one and the first of the other, ``reported + beyond`` of them at most; off by more than ``max(slack, 20 %)`` does not match, and
    less than 5 % of the smaller chunk is too small.
    """

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([longest_common_run(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")

    w = "(partition by doc_id order by chunk_id)"
    x = chunks.withColumn("_p", F.expr(f"lag(text) over {w}")).where("_p is not null and overlap_tokens > 0")
    x = x.select("doc_id", "chunk_id", F.col("overlap_tokens").alias("reported"), K.tokens(F.col("text")).alias("_t"), K.tokens(F.col("_p")).alias("_p")).withColumn("_s", F.least(F.size("_t"), F.size("_p")))
    x = x.withColumn("_w", F.least(F.col("_s"), F.col("reported") + beyond))
    out = x.withColumn("found", run(F.slice("_p", F.size("_p") - F.col("_w") + 1, F.col("_w")), F.slice("_t", F.lit(1), F.col("_w"))))
    return out.select("doc_id", "chunk_id", "reported", "found", (F.abs(F.col("found") - F.col("reported")) <= F.greatest(F.lit(float(slack)), 0.2 * F.col("reported"))).alias("matches"), (F.col("found") < 0.05 * F.col("_s")).alias("too_small"))


def chunk_stats(chunks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """A row for each document: counts, token and sentence sums, means, population deviation, extremes, overlap and efficiency, and where chunks have a ``coherence`` record
    its means and extremes over those that do; 0 chunks for documents of ``docs`` without any."""
    o = F.col("overlap_tokens") if "overlap_tokens" in chunks.columns else F.lit(0)
    of = lambda part: [f(f"coherence.{part}").alias(f"{name}_{part}_coherence") for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    scored = [*of("local"), *of("global"), F.avg("coherence.variance").alias("mean_coherence_variance")] if "coherence" in chunks.columns else []
    agg = chunks.withColumn("_o", o).groupBy("doc_id").agg(
        F.count("*").alias("num_chunks"), F.sum("token_count").alias("total_tokens"), F.sum("_o").alias("overlap_total"), (F.sum("token_count") - F.sum("_o")).alias("net_tokens"),
        F.avg("token_count").alias("mean_tokens"), F.stddev_pop("token_count").alias("std_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"),
        F.count_if(F.col("_o") > 0).alias("overlapping"), F.coalesce(F.avg(F.when(F.col("_o") > 0, F.col("_o"))), F.lit(0.0)).alias("mean_overlap"), F.avg("sentence_count").alias("mean_sentences"),
        F.sum("sentence_count").alias("total_sentences"), F.min("sentence_count").alias("min_sentences"), F.max("sentence_count").alias("max_sentences"),
        F.coalesce(F.try_divide((F.sum("token_count") - F.sum("_o")) * F.lit(100.0), F.sum("token_count")), F.lit(0.0)).alias("efficiency"), *scored,
    )
    if docs is None:
        return agg
    return docs.select("doc_id").join(agg, "doc_id", "left").withColumn("num_chunks", F.coalesce("num_chunks", F.lit(0)))


def compare_modes(by_mode: dict[str, DataFrame]) -> DataFrame:
    """Per mode, the mean over documents of each document's statistics."""
    out = None
    for mode, chunks in by_mode.items():
        s = chunk_stats(chunks).agg(F.count("*").alias("num_docs"), F.avg("num_chunks").alias("mean_chunks"), F.avg("mean_tokens").alias("mean_tokens"), F.avg("std_tokens").alias("mean_std"), F.avg("overlap_total").alias("mean_overlap_total"), F.avg("efficiency").alias("mean_efficiency"), F.avg("mean_local_coherence" if "coherence" in chunks.columns else F.lit(None).cast("double")).alias("mean_coherence")).select(F.lit(mode).alias("mode"), "*")
        out = s if out is None else out.unionByName(s)
    return out
