"""Coherence of groups of sentences, from sentence vectors in rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions.interfaces import attach, groups
from ..functions.similarity import cosine, dot, rescaled

SEGMENTS_OVER, MOST_SEGMENTS, GLOBAL_OVER, SWITCH_OVER = 10, 5, 2, 5


def _keys(keys: list[str]) -> str:
    return ", ".join(keys)


def adjacent(vectors: DataFrame, keys: list[str], pos: str = "pos", vector: str = "vector") -> DataFrame:
    """``keys, pos, cosine`` between each sentence and the next of its group."""
    return _neighbours(vectors, keys, pos, vector).where("_next is not null").select(*keys, pos, "cosine")


def _neighbours(vectors: DataFrame, keys: list[str], pos: str = "pos", vector: str = "vector") -> DataFrame:
    """Every row with ``_next``, the next vector of its group, and their ``cosine``; lengths are taken once."""
    w = f"over (partition by {_keys(keys)} order by {pos})"
    x = vectors.withColumn("_l", F.sqrt(dot(F.col(vector), F.col(vector)))).withColumns({"_next": F.expr(f"lead({vector}) {w}"), "_m": F.expr(f"lead(_l) {w}")})
    return x.withColumn("cosine", F.try_divide(dot(F.col(vector), F.col("_next")), F.col("_l") * F.col("_m")))


def local_coherence(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population variance, least and largest rescaled cosine of neighbours; groups of one count as 1 with variance 0. One window, one aggregate."""
    s = F.when(F.col("_next").isNotNull(), rescaled(F.coalesce("cosine", F.lit(0.0))))
    x = _neighbours(vectors, keys).select(*keys, s.alias("_s"))
    named = {"local_coherence": (F.avg, 1.0), "coherence_variance": (F.var_pop, 0.0), "min_coherence": (F.min, 1.0), "max_coherence": (F.max, 1.0)}
    return x.groupBy(*keys).agg(F.count("*").alias("n"), *[F.coalesce(f("_s"), F.lit(d)).alias(c) for c, (f, d) in named.items()])


def centroid(vectors: DataFrame, keys: list[str], dim: int = 64, vector: str = "vector") -> DataFrame:
    return vectors.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.col(vector)[i]).alias(f"_c{i}") for i in range(dim)]).select(*keys, "n", F.array(*[F.col(f"_c{i}") for i in range(dim)]).alias("centroid"))


def global_coherence(vectors: DataFrame, keys: list[str], dim: int = 64) -> DataFrame:
    """For groups over ``GLOBAL_OVER``: mean rescaled cosine with the centroid; over ``SEGMENTS_OVER`` mixed 6 to 4 with the mean
    rescaled cosine of neighbouring segments' centroids. Segments are equal, the last takes what is over.

    The sum of the cosines with a centroid is that of the unit vectors with the centroid's direction, so each segment's two sums are all that is
    kept: one window and one aggregate over a single pass of the vectors, on the groups' partitioning.
    """
    own = f"partition by {_keys(keys)}"
    x = vectors.withColumns({"n": F.expr(f"count(*) over ({own})"), "_r": F.expr(f"row_number() over ({own} order by pos) - 1")}).where(F.col("n") > GLOBAL_OVER)
    k = F.least(F.lit(MOST_SEGMENTS), F.expr("cast(n div 3 as int)"))
    x = x.withColumn("_k", F.when(F.col("n") > SEGMENTS_OVER, k).otherwise(1)).withColumn("_seg", F.expr("least(_r div (n div _k), _k - 1)"))
    x = x.withColumn("_l", F.sqrt(dot(F.col("vector"), F.col("vector"))))
    unit_ = F.transform("vector", lambda e: F.coalesce(F.try_divide(e.cast("double"), F.col("_l")), F.lit(0.0)))
    x = x.select(*keys, "n", "_seg", "vector", unit_.alias("_u"))
    per = x.groupBy(*keys, "n", "_seg").agg(*[F.sum(F.col(c)[i].cast("double")).alias(f"{c}{i}") for c in ("vector", "_u") for i in range(dim)])
    seg = per.select(*keys, "n", F.struct("_seg", F.array(*[F.col(f"vector{i}") for i in range(dim)]).alias("v"), F.array(*[F.col(f"_u{i}") for i in range(dim)]).alias("u")).alias("_s"))
    one = seg.groupBy(*keys, "n").agg(F.array_sort(F.collect_list("_s")).alias("_s"))  # MOST_SEGMENTS at most
    add = lambda f: F.aggregate(F.expr(f"transform(slice(_s, 2, size(_s)), x -> x.{f})"), F.expr(f"_s[0].{f}"), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    one = one.withColumn("_v", add("v")).withColumn("_u", add("u"))
    whole = rescaled(F.coalesce(F.try_divide(dot(F.col("_u"), F.col("_v")), F.sqrt(dot(F.col("_v"), F.col("_v"))) * F.col("n")), F.lit(0.0)))
    steps = F.zip_with(F.expr("slice(_s, 1, size(_s) - 1)"), F.expr("slice(_s, 2, size(_s))"), lambda a, b: rescaled(F.coalesce(cosine(a["v"], b["v"]), F.lit(0.0))))
    parts = F.when(F.size("_s") > 1, F.aggregate(steps, F.lit(0.0), lambda a, b: a + b) / (F.size("_s") - 1))
    both = one.select(*keys, "n", whole.alias("_w"), parts.alias("hierarchical_coherence"))
    return both.select(*keys, "n", F.when(F.col("hierarchical_coherence").isNull(), F.col("_w")).otherwise(0.6 * F.col("_w") + 0.4 * F.col("hierarchical_coherence")).alias("global_coherence"), "hierarchical_coherence")


def chunk_coherence(vectors: DataFrame, keys: list[str], dim: int = 64) -> DataFrame:
    """``keys, n, coherence``: the record of a chunk's coherence. Only chunks of more than ``SWITCH_OVER`` sentences are measured against a centroid; for the others the local one is the global one."""
    far = global_coherence(vectors, keys, dim).where(F.col("n") > SWITCH_OVER).drop("n")
    both = local_coherence(vectors, keys).join(far, keys, "left")
    parts = {"local": F.col("local_coherence"), "global": F.coalesce("global_coherence", "local_coherence"), "variance": F.col("coherence_variance"), "min": F.col("min_coherence"), "max": F.col("max_coherence"), "hierarchical": F.col("hierarchical_coherence")}
    return both.select(*keys, "n", F.struct(*[c.alias(k) for k, c in parts.items()]).alias("coherence"))


# --- the same from groups that hold their sentences as an array: encoded where they stand, so that no vector is shuffled or leaves the worker


def _cosines(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine row by row, 0 where a vector has no length, and whether both have one."""
    both = np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1)
    return np.divide((a * b).sum(axis=-1), both, out=np.zeros(both.shape), where=both > 0), both > 0


def _keys_of(encoder, sentences: Column) -> Column:
    return F.transform(sentences, lambda s: encoder.keys(K.tokens(s)))


def neighbours(encoder, tokens: Column) -> Column:
    """For each sentence (its tokens) of an array ``known`` (it has a vector), ``next`` (so has a later one) and its ``cosine`` with the next that has. Only for a small encoder."""
    sent = encoder.sent()

    @F.arrow_udf("array<struct<known: boolean, next: boolean, cosine: double>>")
    def run(keys: pa.Array) -> pa.Array:
        known_, next_, cos, ok, ends = [], [], [], [], [0]
        for vec, known in groups(keys, sent):
            at = np.flatnonzero(known)
            c, o, n = np.zeros(len(known)), np.zeros(len(known), bool), np.zeros(len(known), bool)
            if len(at) > 1:
                c[at[:-1]], o[at[:-1]] = _cosines(vec[at[:-1]], vec[at[1:]])
                n[at[:-1]] = True
            known_.append(known), next_.append(n), cos.append(c), ok.append(o), ends.append(ends[-1] + len(known))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        rows = pa.StructArray.from_arrays([pa.array(join(known_, bool)), pa.array(join(next_, bool)), pa.array(join(cos, float), mask=~join(ok, bool))], ["known", "next", "cosine"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return run.asNondeterministic()(F.transform(tokens, encoder.keys))


def _record(v: np.ndarray) -> dict:
    n = len(v)
    if not n:
        return {"n": 0}
    s = (_cosines(v[:-1], v[1:])[0] + 1) / 2
    out = {"n": n, "local": float(s.mean()) if n > 1 else 1.0, "variance": float(s.var()) if n > 1 else 0.0, "min": float(s.min()) if n > 1 else 1.0, "max": float(s.max()) if n > 1 else 1.0}
    if n > GLOBAL_OVER:
        out["whole"] = float((_cosines(v, v.mean(axis=0))[0] + 1).mean() / 2)
        if n > SEGMENTS_OVER:
            k = min(MOST_SEGMENTS, n // 3)
            mids = np.array([v[i * (n // k) : (i + 1) * (n // k) if i < k - 1 else n].mean(axis=0) for i in range(k)])
            out["hierarchical"] = float((_cosines(mids[:-1], mids[1:])[0] + 1).mean() / 2)
            out["whole"] = 0.6 * out["whole"] + 0.4 * out["hierarchical"]
    return out


_RECORD = ("local", "variance", "min", "max", "whole", "hierarchical")


def recorded(rows: DataFrame, encoder, keys: list[str], sentences: str = "sentences") -> DataFrame:
    """``rows`` with ``record``: ``n`` (sentences that have a vector), what ``local_coherence`` tells (``local, variance, min, max``) and what ``global_coherence`` does
    (``whole, hierarchical``, null for small groups). A row is a group, ``keys`` its own; null where no sentence has a vector."""
    if not encoder.small:
        v = attach(encoder, rows.select(*keys, F.posexplode(sentences).alias("pos", "_s")), "_s").where("vector is not null")
        both = local_coherence(v, keys).join(global_coherence(v, keys, encoder.dim).drop("n"), keys, "left")
        names = ("local_coherence", "coherence_variance", "min_coherence", "max_coherence", "global_coherence", "hierarchical_coherence")
        return rows.join(both.select(*keys, F.struct("n", *[F.col(a).alias(b) for a, b in zip(names, _RECORD, strict=True)]).alias("record")), keys, "left")
    sent = encoder.sent()

    @F.arrow_udf("struct<n: bigint, " + ", ".join(f"{x}: double" for x in _RECORD) + ">")
    def run(k: pa.Array) -> pa.Array:
        kind = pa.struct([("n", pa.int64()), *[(x, pa.float64()) for x in _RECORD]])
        return pa.array([_record(vec[known]) for vec, known in groups(k, sent)], kind)

    own = rows.withColumn("_r", run.asNondeterministic()(_keys_of(encoder, F.col(sentences))))
    return own.withColumn("record", F.when(F.col("_r.n") > 0, F.col("_r"))).drop("_r")


def similarities(rows: DataFrame, encoder, keys: list[str], sentences: str = "sentences") -> DataFrame:
    """``similarity_matrix`` of groups that are a row each."""
    if not encoder.small:
        return similarity_matrix(attach(encoder, rows.select(*keys, F.posexplode(sentences).alias("pos", "_s")), "_s").where("vector is not null"), keys)
    sent = encoder.sent()

    run = pair_batches(keys, sent)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, _keys_of(encoder, F.col(sentences)).alias("_k")).mapInArrow(run, f"{kinds}, i int, j int, similarity double")


#: Pairs of a batch on its way out of a worker, and the vectors whose products are taken at once.
MOST_PAIRS, STRIP = 500_000, 512


def pair_batches(keys: list[str], sent):
    """For ``mapInArrow``: ``keys, i, j, similarity`` of the pairs of each group ``keys, _k``, in batches of about ``MOST_PAIRS`` rows however many pairs the groups have."""

    def made(held):
        own, i, j, sim = zip(*held, strict=True)
        take = [pa.chunked_array([x[k] for x in own]).combine_chunks() for k in range(len(keys))]
        return pa.RecordBatch.from_arrays([*take, *[pa.array(np.concatenate(x)) for x in (i, j, sim)]], [*keys, "i", "j", "similarity"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            names = [batch.column(k) for k in keys]
            for g, (vec, known) in enumerate(groups(batch.column("_k"), sent)):
                at = np.flatnonzero(known).astype(np.int32)
                v = vec[at]
                long = np.linalg.norm(v, axis=1)[:, None]
                unit = np.divide(v, long, out=np.zeros(v.shape), where=long > 0)
                for low in range(0, len(at) - 1, STRIP):
                    cos = unit[low : low + STRIP] @ unit[low:].T
                    x, y = np.triu_indices(len(cos), 1, cos.shape[1])
                    for part in range(0, len(x), MOST_PAIRS):
                        p, q = x[part : part + MOST_PAIRS], y[part : part + MOST_PAIRS]
                        row = np.full(len(p), g)
                        held.append(([c.take(pa.array(row)) for c in names], at[p + low], at[q + low], (cos[p, q] + 1) / 2))
                        n += len(p)
                        if n >= MOST_PAIRS:
                            yield made(held)
                            held, n = [], 0
        if held:
            yield made(held)

    return run


def similarity_matrix(vectors: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Rescaled cosine of each pair of a group, ``i < j``; the diagonal is 1 and the rest symmetric. Pairs stay within a chunk, whose size the budget bounds."""
    a = vectors.select(*keys, F.col(pos).alias("i"), F.col("vector").alias("va"))
    b = vectors.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(pos).alias("j"), F.col("vector").alias("vb"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return a.join(b, on & (F.col("i") < F.col("j"))).select(*keys, "i", "j", rescaled(F.coalesce(cosine(F.col("va"), F.col("vb")), F.lit(0.0))).alias("similarity"))
