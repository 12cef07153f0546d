"""Level-by-level tree reduction of chunk summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReduceConfig
from ..functions import tokens as K
from ..functions.interfaces import Generator, LeadGenerator
from . import chunking

_PACK = """
aggregate(sequence(0, size({a}) - 1), named_struct('cur', 0, 'at', array(0)), (z, i) ->
  if(i > element_at(z.at, -1) and z.cur + {a}[i] > {budget}, named_struct('cur', {a}[i], 'at', concat(z.at, array(i))), named_struct('cur', z.cur + {a}[i], 'at', z.at))).at
"""


def bin_pack(rows: DataFrame, costs: str, budget: int = 1000) -> DataFrame:
    """Adds ``starts``: where the groups begin when items are packed in order and a group closes before it passes ``budget``; an item over it is a group."""
    return rows.withColumn("starts", F.expr(f"if(size({costs}) = 0, cast(array() as array<int>), {_PACK.format(a=costs, budget=budget)})"))


def map_stage(chunks: DataFrame, gen: Generator | None = None, cfg: ReduceConfig | None = None) -> DataFrame:
    """``doc_id, chunk_id, summary``: long inputs of many chunks get short summaries."""
    gen, cfg = gen or LeadGenerator(), cfg or ReduceConfig()
    n = F.expr("count(*) over (partition by doc_id)")
    many = chunks.select("doc_id", "chunk_id", "text", n.alias("n"))
    most = F.when(F.col("n") > cfg.many_chunks, F.lit(cfg.map_short)).otherwise(F.lit(cfg.map_long))
    return many.select("doc_id", "chunk_id", gen.generate(F.col("text"), most).alias("summary"))


def _cut(df: DataFrame) -> DataFrame:
    """Writes a level to the shared folder where the session names one; a small in-memory plan goes on as it is otherwise."""
    at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not at:
        return df
    path = f"{at.rstrip('/')}/foliant-reduce/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MERGED = "transform(starts, (s, k) -> array_join(slice(texts, s + 1, coalesce(get(starts, k + 1), size(texts)) - s), ' '))"


def reduce_stage(level: DataFrame, gen: Generator | None = None, cfg: ReduceConfig | None = None) -> DataFrame:
    """``doc_id, final_summary, reduction_layers`` from ``doc_id, texts`` (an array of summaries in order).

    Each level: what fits the budget as one text is finished (returned as it is if it is short and was merged before, else
    generated once more); a single text over it is generated; the rest is packed, and each group generated. After ``max_layers``
    packings whatever is there is generated. With a generator of expressions all levels are one chain of projections over a
    document's row, without a shuffle; a generator behind a UDF sees only the rows that a level has left.
    """
    gen, cfg = gen or LeadGenerator(), cfg or ReduceConfig()
    return _reduce_rows(level, gen, cfg) if getattr(gen, "native", False) else _reduce_levels(level, gen, cfg)


def _reduce_rows(level: DataFrame, gen: Generator, cfg: ReduceConfig) -> DataFrame:
    open_, joined, none = F.col("final").isNull(), F.col("joined"), F.array().cast("array<string>")
    s = level.select("doc_id", "texts", F.lit(None).cast("string").alias("final"), F.lit(None).cast("int").alias("layers"))
    for layer in range(cfg.max_layers + 1):
        s = s.withColumn("joined", F.when(open_, F.array_join("texts", " "))).withColumn("tok", K.token_count(joined, cfg.specials))
        s = s.withColumn("over", open_ & (F.col("tok") > cfg.budget) & (F.size("texts") > 1))
        made = gen.generate(joined, cfg.final_len, 128)
        end = F.when(F.col("tok") < cfg.enough, joined).otherwise(made) if layer else made
        s = s.withColumn("layers", F.when(open_ & ~F.col("over"), F.lit(layer)).otherwise(F.col("layers"))).withColumn("final", F.when(open_ & ~F.col("over"), end).otherwise(F.col("final")))
        s = s.withColumn("texts", F.when(F.col("over"), F.col("texts")).otherwise(none)).withColumn("costs", F.transform("texts", lambda t: K.token_count(t, cfg.specials)))
        s = bin_pack(s, "costs", cfg.budget).withColumn("merged", F.expr(_MERGED)).withColumn("texts", F.transform("merged", lambda t: gen.generate(t, cfg.group_len))).select("doc_id", "texts", "final", "layers")
    last = F.when(open_, gen.generate(F.array_join("texts", " "), cfg.final_len)).otherwise(F.col("final"))
    return s.select("doc_id", last.alias("final_summary"), F.coalesce("layers", F.lit(cfg.max_layers + 1)).alias("reduction_layers"))


def _reduce_levels(level: DataFrame, gen: Generator, cfg: ReduceConfig) -> DataFrame:
    joined, done = F.array_join("texts", " "), None
    state = _cut(level.select("doc_id", "texts"))
    for layer in range(cfg.max_layers + 1):
        s = state.withColumn("joined", joined).withColumn("tok", K.token_count(F.col("joined"), cfg.specials))
        fits = F.col("tok") <= cfg.budget
        keep = (fits & (F.col("tok") < cfg.enough)) if layer else F.lit(False)
        full = s.where(fits | (F.size("texts") <= 1))
        for part in ([full.where(~keep).select("doc_id", gen.generate(F.col("joined"), cfg.final_len, 128).alias("final_summary"))] + ([full.where(keep).select("doc_id", F.col("joined").alias("final_summary"))] if layer else [])):
            part = part.withColumn("reduction_layers", F.lit(layer))
            done = part if done is None else done.unionByName(part)
        rest = s.where(~fits & (F.size("texts") > 1)).withColumn("costs", F.transform("texts", lambda t: K.token_count(t, cfg.specials)))
        each = bin_pack(rest, "costs", cfg.budget).select("doc_id", F.posexplode(F.expr(_MERGED)).alias("pos", "t")).select("doc_id", "pos", gen.generate(F.col("t"), cfg.group_len).alias("t"))
        state = _cut(each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("m")).select("doc_id", F.transform("m", lambda x: x["t"]).alias("texts")))
    last = state.select("doc_id", gen.generate(joined, cfg.final_len).alias("final_summary"), F.lit(cfg.max_layers + 1).alias("reduction_layers"))
    return done.unionByName(last)


def summarize(docs: DataFrame, gen: Generator | None = None, cfg: ReduceConfig | None = None, text: str = "text") -> DataFrame:
    """Documents to one summary each: ``doc_id, n_chunks, reduction_layers, final_tokens, final_summary, concatenated_intermediate``.

    Documents that are blank after cleaning get an empty summary, no chunks and no layers. A generator without UDFs leaves all of it one plan.
    """
    cfg = cfg or ReduceConfig()
    chunks = chunking.greedy_chunks(docs, cfg.chunk, text=text)
    mapped = map_stage(chunks, gen, cfg)
    level = mapped.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "summary"))).alias("m")).select("doc_id", F.transform("m", lambda x: x["summary"]).alias("texts"))
    final = reduce_stage(level, gen, cfg)
    head = level.select("doc_id", F.size("texts").alias("n_chunks"), F.array_join("texts", " ").alias("concatenated_intermediate"))
    full = docs.select("doc_id").join(head, "doc_id", "left").join(final, "doc_id", "left")
    empty = F.lit("")
    return full.select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("reduction_layers", F.lit(0)).alias("reduction_layers"), K.token_count(F.coalesce("final_summary", empty)).alias("final_tokens"), F.coalesce("final_summary", empty).alias("final_summary"), F.coalesce("concatenated_intermediate", empty).alias("concatenated_intermediate"))


def is_fit(c, cfg: ReduceConfig | None = None):
    """Whether a text is within the budget, special tokens counted once."""
    cfg = cfg or ReduceConfig()
    return K.token_count(c, cfg.specials) <= cfg.budget


