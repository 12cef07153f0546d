"""The chunkers: flat windows, greedy packing, packing with overlap, and splitting at dips of a hybrid signal.

A document stays one row until it is cut, so chunking needs no shuffle; documents are independent, articles of one are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions import text as T
from ..functions import tokens as K
from ..functions.interfaces import PunctuationSplitter, SentenceSplitter, Tokenizer, WhitespaceTokenizer, attach
from ..functions.similarity import KERNEL, SMOOTH_OVER
from .coherence import MOST_SEGMENTS, SEGMENTS_OVER, SWITCH_OVER

#: Sentences of a run of documents that are encoded at once.
RUN = 20_000
#: The weight of a late split; the shares of the overlap target
#: at which the walk back looks at coherence, stops, and may not pass.
LATE, LOOK, ENOUGH, MOST = 0.3, 0.75, 0.8, 1.5


def flat_windows(tok: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` tokens, each ``overlap`` into the one before; the last is the first that reaches the end."""
    n, step = F.size(tok), size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - F.lit(overlap)) / F.lit(step)).cast("int") - 1) * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(tok, s + 1, F.lit(size)))


def flat_chunks(docs: DataFrame, size: int = 1024, overlap: int = 0, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``doc_id, chunk_id, text, token_count`` from cleaned text."""
    tok = (tokenizer or WhitespaceTokenizer()).tokens(T.clean_text(F.col("text")))
    wide = docs.select("doc_id", T.let(tok, lambda t: flat_windows(t, size, overlap)).alias("w"))
    return wide.select("doc_id", F.posexplode("w").alias("chunk_id", "_t")).select("doc_id", "chunk_id", K.decode(F.col("_t")).alias("text"), F.size("_t").alias("token_count"))


def sentence_rows(docs: DataFrame, cfg: ChunkConfig, splitter: SentenceSplitter | None = None, tokenizer: Tokenizer | None = None, text: str = "text") -> DataFrame:
    """``doc_id, arts``: the articles of each document that is not blank, each an array of (s, n, p): sentence, tokens, paragraph."""
    sp, tk = splitter or PunctuationSplitter(), tokenizer or WhitespaceTokenizer()

    def article(a):
        paras = T.split_paragraphs(a) if cfg.preserve_paragraphs else F.array(a)
        nested = F.transform(paras, lambda p, i: F.transform(sp.sentences(p), lambda s: F.struct(s.alias("s"), F.size(tk.tokens(s)).alias("n"), i.alias("p"))))
        return F.flatten(nested)

    clean = docs.select("doc_id", T.clean_text(F.col(text)).alias("_c")).where(F.length("_c") > 0)
    return clean.select("doc_id", F.transform(T.split_articles(F.col("_c"), cfg.article_separator), article).alias("arts"))


def sentences(docs: DataFrame, cfg: ChunkConfig | None = None, **how) -> DataFrame:
    """``doc_id, pos, article, sentence, n``: a row for each sentence, numbered through the document."""
    rows = sentence_rows(docs, cfg or ChunkConfig(), **how)
    flat = F.flatten(F.transform("arts", lambda a, i: F.transform(a, lambda s: F.struct(i.alias("a"), s["s"].alias("s"), s["n"].alias("n")))))
    return rows.select("doc_id", F.posexplode(flat).alias("pos", "_s")).select("doc_id", "pos", F.col("_s.a").alias("article"), F.col("_s.s").alias("sentence"), F.col("_s.n").alias("n"))


_GREEDY = """
aggregate(sequence(0, size({a}) - 1), named_struct('cur', 0, 'at', array(0)), (z, i) -> case
  when z.cur + {a}[i].n > {max} and (z.cur >= {min} or size(z.at) = 1) and i > element_at(z.at, -1)
    then named_struct('cur', {a}[i].n, 'at', concat(z.at, array(i)))
  else named_struct('cur', z.cur + {a}[i].n, 'at', z.at) end).at
"""


def greedy_chunks(docs: DataFrame, cfg: ChunkConfig | None = None, text: str = "text", **how) -> DataFrame:
    """Sentences packed in order up to the budget: ``doc_id, chunk_id, article, text, sentences, token_count, sentence_count, start, end``.

    On overflow the chunk closes if it holds ``min_tokens`` or is the article's first; else it grows past the budget. A sentence over
    the budget is never cut. ``start`` and ``end`` are token offsets in the document. Each row is a document, also where rows share an id.
    """
    cfg = cfg or ChunkConfig(mode="greedy_sentence")
    rows = sentence_rows(docs, cfg, text=text, **how)
    article = F.expr(f"""
      flatten(transform(filter(transform(arts, (a, i) -> named_struct('i', i, 'a', a)), y -> size(y.a) > 0), y -> transform(array({_GREEDY.format(a="y.a", max=cfg.max_tokens, min=cfg.min_tokens)}),
        at -> transform(at, (s, k) -> named_struct('article', y.i, 'ss', slice(y.a, s + 1, coalesce(get(at, k + 1), size(y.a)) - s))))[0]))""")
    cut = rows.select("doc_id", F.transform(article, lambda c: F.struct(c["article"].alias("article"), F.transform(c["ss"], lambda x: x["s"]).alias("sentences"), F.aggregate(c["ss"], F.lit(0), lambda z, x: z + x["n"]).alias("n"))).alias("cs"))
    # the chunks are numbered and their offsets added up in the document's row
    cut = cut.withColumn("ends", F.expr("aggregate(cs, array(0L), (z, c) -> concat(z, array(element_at(z, -1) + c.n)))"))
    out = cut.select("doc_id", F.posexplode(F.transform("cs", lambda c, i: F.struct(c.alias("c"), F.get("ends", i).alias("start"), F.get("ends", i + 1).alias("end")))).alias("chunk_id", "x"))
    return out.select(
        "doc_id", "chunk_id", F.col("x.c.article").alias("article"), F.array_join("x.c.sentences", " ").alias("text"), F.col("x.c.sentences").alias("sentences"), F.col("x.c.n").alias("token_count"),
        F.size("x.c.sentences").alias("sentence_count"), F.col("x.start").alias("start"), F.col("x.end").alias("end"),
    )


# The walk back from the end of a chunk: the first sentence always counts, none that would pass 1.5 targets, none after 0.8 targets.
_BACK = f"""
aggregate(reverse(sequence({{s}}, {{e}} - 1)), named_struct('k', {{e}}, 'cur', 0, 'go', true), (w, j) -> case
  when not w.go or (w.k < {{e}} and w.cur + ss[j].n > {MOST}D * {{t}}) then named_struct('k', w.k, 'cur', w.cur, 'go', false)
  else named_struct('k', j, 'cur', w.cur + ss[j].n, 'go', w.cur + ss[j].n < {ENOUGH}D * {{t}}) end)
"""


def overlap_chunks(docs: DataFrame, cfg: ChunkConfig | None = None, text: str = "text", **how) -> DataFrame:
    """Packing with a carried-over tail, without a model: ``doc_id, chunk_id, article, text, sentences, token_count, sentence_count, has_overlap, overlap_tokens``.

    A chunk closes when the next sentence would pass the budget, and at the end of an article; the next one begins with the last
    sentences of the closed one (``overlap_tokens`` of them in tokens).
    """
    cfg = cfg or ChunkConfig(mode="fixed_overlap")
    flat = F.flatten(F.transform("arts", lambda a, i: F.transform(a, lambda s: F.struct(i.alias("a"), s["s"].alias("s"), s["n"].alias("n")))))
    rows = sentence_rows(docs, cfg, text=text, **how).select("doc_id", flat.alias("ss")).where(F.size("ss") > 0)
    back = _BACK.format(s="z.s", e="i", t=cfg.target)
    rows = rows.withColumn("f", F.expr(f"""
      aggregate(sequence(0, size(ss) - 1), named_struct('s', 0, 'cur', 0, 'tail', 0, 'out', cast(array() as array<struct<s: int, e: int, o: int>>)), (z, i) ->
        if(i > z.s and (z.cur + ss[i].n > {cfg.max_tokens} or ss[i].a <> ss[i - 1].a),
          aggregate(array({back}), z, (y, w) -> if(ss[i].a <> ss[i - 1].a and w.cur + ss[i].n > {cfg.max_tokens},
            aggregate(array({_BACK.format(s="w.k", e="i", t=cfg.target)}), y, (x, v) -> named_struct('s', v.k, 'cur', v.cur + ss[i].n, 'tail', i - v.k,
              'out', concat(z.out, array(named_struct('s', z.s, 'e', i, 'o', z.tail), named_struct('s', w.k, 'e', i, 'o', i - w.k))))),
            named_struct('s', w.k, 'cur', w.cur + ss[i].n, 'tail', i - w.k, 'out', concat(z.out, array(named_struct('s', z.s, 'e', i, 'o', z.tail)))))),
          named_struct('s', z.s, 'cur', z.cur + ss[i].n, 'tail', z.tail, 'out', z.out)))"""))  # fmt: skip
    # a chunk's row gets its own sentences only, not the document's
    cut = F.expr("transform(concat(f.out, array(named_struct('s', f.s, 'e', size(ss), 'o', f.tail))), r -> named_struct('p', slice(ss, r.s + 1, r.e - r.s), 'o', r.o))")
    part = rows.select("doc_id", F.posexplode(cut).alias("chunk_id", "r")).select("doc_id", "chunk_id", F.col("r.p").alias("p"), F.col("r.o").alias("o"), F.expr("transform(r.p, x -> x.s)").alias("sentences"))
    return part.select(
        "doc_id", "chunk_id", F.expr("p[size(p) - 1].a").alias("article"), F.array_join("sentences", " ").alias("text"), "sentences", F.expr("aggregate(p, 0, (z, x) -> z + x.n)").alias("token_count"),
        F.size("p").alias("sentence_count"), (F.col("chunk_id") > 0).alias("has_overlap"), F.expr("aggregate(slice(p, 1, o), 0, (z, x) -> z + x.n)").alias("overlap_tokens"),
    )


# --- splitting at dips of the hybrid signal: a sequential machine whose signal depends on the buffer, so it runs in an Arrow UDF


def smooth(v: np.ndarray) -> np.ndarray:
    """Gaussian smoothing with edges mirrored (each end value repeated); short signals stay as they are."""
    if len(v) <= SMOOTH_OVER:
        return v
    r = len(KERNEL) - 1
    padded = np.pad(v, r, mode="symmetric")
    return np.convolve(padded, np.array([*KERNEL[:0:-1], *KERNEL]), mode="valid")


def hybrid_signal(vectors: np.ndarray, words: list[set[str]], weight: float) -> np.ndarray:
    """Between neighbours: the raw cosine (0 without length) and the Jaccard similarity divided by its largest value."""
    norm = np.linalg.norm(vectors, axis=1)
    both = norm[:-1] * norm[1:]
    cos = np.divide((vectors[:-1] * vectors[1:]).sum(axis=1), both, out=np.zeros(len(both)), where=both > 0)
    jac = np.array([len(a & b) / len(a | b) if a and b else 0.0 for a, b in zip(words, words[1:], strict=False)])
    if len(jac) and jac.max() > 0:
        jac = jac / jac.max()
    return weight * cos + (1 - weight) * jac


def split_point(counts: list[int], vectors: np.ndarray | None, words: list[set[str]], cfg: ChunkConfig) -> int:
    """After how many sentences a full buffer is cut: at the local minimum that is low and late, at the lowest place if there is none."""
    n = len(counts)
    if not cfg.semantic or vectors is None or n < 3:
        return n
    signal, cum = smooth(hybrid_signal(vectors, words, cfg.semantic_weight)), np.cumsum(counts)
    valid = [i for i in range(n - 1) if cum[i] >= cfg.min_tokens]
    if not valid:
        return n
    v = signal[valid]
    dips = [k for k in range(1, len(valid) - 1) if v[k] < v[k - 1] and v[k] < v[k + 1]] if len(valid) >= 3 else []
    if not dips:
        return valid[int(np.argmin(v))] + 1
    total = cum[-1]
    return valid[min(dips, key=lambda k: v[k] + LATE * (total - cum[valid[k]]) / total)] + 1


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rescaled cosine row by row; 0.5 where a vector has no length."""
    both = np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1)
    dot = (a * b).sum(axis=-1)
    return (np.divide(dot, both, out=np.zeros(dot.shape), where=both > 0) + 1) / 2


def local_coherence(vectors: np.ndarray | None, n: int) -> dict[str, float]:
    if n < 2 or vectors is None:
        return {"local": 1.0, "variance": 0.0, "min": 1.0, "max": 1.0}
    s = _cosines(vectors[:-1], vectors[1:])
    return {"local": float(s.mean()), "variance": float(s.var()), "min": float(s.min()), "max": float(s.max())}


def coherence_record(vectors: np.ndarray, n: int) -> dict[str, float | None]:
    """A chunk's coherence: between neighbours, and over ``SWITCH_OVER`` sentences with the centroid too, mixed 6 to 4 with that of neighbouring segments where there are over ``SEGMENTS_OVER``."""
    out: dict[str, float | None] = {**local_coherence(vectors, n), "hierarchical": None}
    out["global"] = out["local"]
    if n > SWITCH_OVER:
        out["global"] = float(_cosines(vectors, vectors.mean(axis=0)).mean())
        if n > SEGMENTS_OVER:
            k = min(MOST_SEGMENTS, n // 3)
            mids = np.array([vectors[i * (n // k) : (i + 1) * (n // k) if i < k - 1 else n].mean(axis=0) for i in range(k)])
            out["hierarchical"] = float(_cosines(mids[:-1], mids[1:]).mean())
            out["global"] = 0.6 * out["global"] + 0.4 * out["hierarchical"]
    return out


def tail(counts: list[int], vectors: np.ndarray | None, cfg: ChunkConfig) -> int:
    """How many last sentences the next chunk begins with. The adaptive rule also stops, past 0.75 targets, where they no longer cohere."""
    cur = k = 0
    for i in range(len(counts) - 1, -1, -1):
        if k and cur + counts[i] > MOST * cfg.target:
            break
        cur, k = cur + counts[i], k + 1
        if cur >= LOOK * cfg.target:
            if cfg.semantic and vectors is not None:
                if cur >= cfg.target or (k > 1 and local_coherence(vectors[i:], k)["local"] < cfg.coherence_threshold):
                    break
            elif cur >= ENOUGH * cfg.target:
                break
    return k


def chunk_document(articles: list[list[dict]], cfg: ChunkConfig) -> list[dict]:
    """The chunks of a document; sentences have ``s, n, v`` (text, tokens, vector) and, where known, ``p`` (paragraph).

    A chunk counts to the article of its last sentence. ``start`` and ``end`` are token offsets in the document, the overlap included;
    ``paragraph_boundaries`` are the running sentence counts of that article's paragraphs. Modes without a signal have no coherence.
    """
    out: list[dict] = []
    offset = 0
    before: list[dict] = []
    edges = [[i + 1 for i, x in enumerate(sents) if i + 1 == len(sents) or sents[i + 1].get("p") != x.get("p")] for sents in articles]

    def emit(part, overlap):
        n = sum(x["n"] for x in part)
        at = part[-1]["article"] if part else a
        v = _vectors(part)
        start = part[0]["at"] if part else offset
        out.append(
            {"chunk_id": len(out), "article": at, "text": " ".join(x["s"] for x in part), "sentences": [x["s"] for x in part], "token_count": n, "sentence_count": len(part), "has_overlap": bool(out), "overlap_tokens": overlap,
             "coherence": coherence_record(v, len(part)) if cfg.semantic and v is not None else None, "start": start, "end": start + n, "paragraph_boundaries": edges[at] if cfg.preserve_paragraphs else []}
        )

    for a, sents in enumerate(articles):
        k = tail([x["n"] for x in before], _vectors(before), cfg) if before else 0
        buf = before[len(before) - k :] if k else []
        cur = overlap = sum(x["n"] for x in buf)
        for x in sents:
            x = {**x, "article": a, "at": offset}
            if cur + x["n"] > cfg.max_tokens and (buf or cfg.emit_empty_leading):
                at = split_point([y["n"] for y in buf], _vectors(buf), [y["w"] for y in buf] if buf and "w" in buf[0] else [{w.lower() for w in y["s"].split()} for y in buf], cfg)
                emit(buf[:at], overlap)
                k = tail([y["n"] for y in buf[:at]], _vectors(buf[:at]), cfg)
                overlap = sum(y["n"] for y in buf[at - k : at])
                buf = buf[at - k :]
                cur = sum(y["n"] for y in buf)
            buf.append(x)
            cur += x["n"]
            offset += x["n"]
        if buf:
            emit(buf, overlap)
            before = list(buf)
    return out


def _vectors(part: list[dict]) -> np.ndarray | None:
    if not part or part[0].get("v") is None:
        return None
    return np.array([x["v"] for x in part], np.float64)


_CHUNK = """array<struct<chunk_id: int, article: int, text: string, sentences: array<string>, token_count: int, sentence_count: int, has_overlap: boolean, overlap_tokens: int,
  coherence: struct<local: double, global: double, variance: double, min: double, max: double, hierarchical: double>, start: int, end: int, paragraph_boundaries: array<int>>>"""
_CHUNK_TYPE = pa.list_(pa.struct([
    ("chunk_id", pa.int32()), ("article", pa.int32()), ("text", pa.string()), ("sentences", pa.list_(pa.string())), ("token_count", pa.int32()), ("sentence_count", pa.int32()), ("has_overlap", pa.bool_()), ("overlap_tokens", pa.int32()),
    ("coherence", pa.struct([(x, pa.float64()) for x in ("local", "global", "variance", "min", "max", "hierarchical")])), ("start", pa.int32()), ("end", pa.int32()), ("paragraph_boundaries", pa.list_(pa.int32())),
]))


def semantic_chunks(docs: DataFrame, encoder, cfg: ChunkConfig | None = None, text: str = "text", **how) -> DataFrame:
    """Chunks cut at dips of the hybrid signal, with adaptive overlap: the columns of ``chunk_document`` and ``doc_id``.

    With an encoder whose table is small a document's sentences are encoded where it is cut, so nothing is shuffled. Others encode each distinct sentence
    once, and the vectors come back to the document as an array. Modes without a semantic signal skip the encoder.
    """
    cfg = cfg or ChunkConfig()
    rows = sentence_rows(docs, cfg, text=text, **how)
    here = cfg.semantic and getattr(encoder, "small", False)
    if here:
        keyed = F.transform("arts", lambda a, i: F.transform(a, lambda x: F.struct(i.alias("article"), x["s"].alias("s"), x["n"].alias("n"), x["p"].alias("p"), encoder.keys(K.tokens(x["s"])).alias("k"))))
        packed, sent = rows.select("doc_id", F.flatten(keyed).alias("ss")), encoder.sent()
    elif cfg.semantic:
        flat = rows.select("doc_id", F.posexplode("arts").alias("article", "a")).select("doc_id", "article", F.posexplode("a").alias("pos", "x")).select("doc_id", "article", "pos", "x.s", "x.n", "x.p")
        flat = attach(encoder, flat, "s", "v")
        packed = flat.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("article", "pos", "s", "n", "p", "v"))).alias("ss"))
    else:
        packed = rows.select("doc_id", F.flatten(F.transform("arts", lambda a, i: F.transform(a, lambda x: F.struct(i.alias("article"), x["s"].alias("s"), x["n"].alias("n"), x["p"].alias("p"))))).alias("ss"))

    @F.arrow_udf(_CHUNK)
    def cut(ss: pa.Array) -> pa.Array:
        out = []
        sizes, met = pc.list_value_length(ss).to_numpy(zero_copy_only=False), (0, 0, None)
        for i in range(len(ss)):  # one document at a time, so that memory follows the longest one
            one = ss[i : i + 1].flatten()
            cols = {c: one.field(c).to_pylist() for c in ("article", "s", "n", "p")}
            if here:
                if i >= met[1]:  # the vectors of a run of documents at once
                    end = max(i + 1, i + int(np.searchsorted(np.cumsum(sizes[i:]), RUN, side="right")))
                    met = (i, end, sent.sums(ss[i:end].flatten().field("k"))[0])
                low = int(sizes[met[0] : i].sum())
                vec = met[2][low : low + len(one)]
            arts: list[list[dict]] = []
            for j, at in enumerate(cols["article"]):
                while len(arts) <= at:
                    arts.append([])
                x = {"s": cols["s"][j], "n": cols["n"][j], "p": cols["p"][j]}
                if here:
                    x["v"] = vec[j]
                arts[at].append(x)
            if cfg.semantic and not here:
                flat = [x for a in arts for x in a]
                got = one.field("v").to_pylist()
                size = next((len(v) for v in got if v is not None), 1)
                for x, v in zip(flat, got, strict=True):
                    x["v"] = v if v is not None else [0.0] * size
            out.append(chunk_document(arts, cfg))
        return pa.array(out, _CHUNK_TYPE)

    return packed.where(F.size("ss") > 0).select("doc_id", F.explode(cut("ss")).alias("c")).select("doc_id", "c.*")
