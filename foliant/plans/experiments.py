"""Whole experiments as one plan each: systems to compare, the flagship reduction, a sweep over the blend weight, an evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig, ReduceConfig
from ..functions import tokens as K
from ..operators import chunking, reduce, scoring, signal

ALPHAS = tuple(i / 10 for i in range(11))


def clusters(docs: DataFrame, size: int = 5, noisy: bool = True) -> DataFrame:
    """Multi-article documents from single ones: ``doc_id`` (the cluster) and ``text``, the texts of ``size`` neighbours in order with line breaks as paragraphs."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n")
    if noisy:
        body = F.concat(F.lit("[photo] Enlarge this image x AP "), body, F.lit(" toggle caption y AP [note]"))
    keyed = docs.select(F.expr(f"doc_id div {size}").alias("doc_id"), F.struct(F.col("doc_id").alias("o"), body.alias("t")).alias("x"))
    return keyed.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("doc_id", F.array_join(F.transform("xs", lambda x: x["t"]), "|||").alias("text"))


def systems(docs: DataFrame) -> dict[str, DataFrame]:
    """Stand-ins for summarizers: ``doc_id, document, reference, summary``. The reference is the whole text; a system skips documents it has nothing of its own to say about:
    the longer lead those of up to 64 words, the tail those that don't end in an end mark, every second word those of under 128."""
    tok = K.tokens(F.col("text"))
    made = {
        "lead64": (K.decode(F.slice(tok, 1, 64)), F.lit(True)),
        "lead128": (K.decode(F.slice(tok, 1, 128)), F.size(tok) > 64),
        "tail64": (K.decode(F.slice(tok, F.greatest(F.lit(1), F.size(tok) - 63), F.lit(64))), F.right(F.get(tok, F.size(tok) - 1), F.lit(1)).isin(".", "!", "?")),
        "every2nd": (K.decode(F.slice(F.filter(tok, lambda t, i: i % 2 == 0), 1, 64)), F.size(tok) >= 128),
    }
    return {name: docs.where(kept).select("doc_id", F.col("text").alias("document"), K.decode(tok).alias("reference"), s.alias("summary")) for name, (s, kept) in made.items()}


def pairs(docs: DataFrame) -> DataFrame:
    """``model, doc_id, candidate, reference`` of all systems."""
    out = None
    for name, df in systems(docs).items():
        one = df.select(F.lit(name).alias("model"), "doc_id", F.col("summary").alias("candidate"), "reference")
        out = one if out is None else out.unionByName(one)
    return out


def scores(docs: DataFrame) -> DataFrame:
    """ROUGE-1 in long form: ``doc_id, model, metric, value``."""
    s = scoring.rouge_n(pairs(docs), 1, ["model", "doc_id"])
    return s.unpivot(["doc_id", "model"], ["precision", "recall", "f"], "metric", "value")


def summarize_clusters(docs: DataFrame, cfg: ReduceConfig | None = None) -> DataFrame:
    return reduce.summarize(clusters(docs), cfg=cfg)


def chunker(docs: DataFrame, cfg: ChunkConfig, encoder=None) -> DataFrame:
    """The cheapest chunker that a mode allows: expressions for the modes without a signal, the Arrow UDF for the others."""
    if cfg.mode == "greedy_sentence":
        return chunking.greedy_chunks(docs, cfg)
    if not cfg.semantic:
        return chunking.overlap_chunks(docs, cfg)
    return chunking.semantic_chunks(docs, encoder, cfg)


def alpha_sweep(signals: DataFrame, spark_alphas: Sequence[float] = ALPHAS, min_tokens: int = 64) -> DataFrame:
    """``alpha, doc_id, split_after`` of every document at every weight; ``signals(doc_id, xs)`` as ``signal.arrays`` makes them, so that all weights are tried where the document stands."""
    return signal.splits(signals, spark_alphas, min_tokens).select("alpha", "doc_id", "split_after", "score")
