"""Overlap scores of candidate and reference texts. A pair has a key; nothing is matched by position."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions.similarity import unit

#: Tokens of a run of pairs whose vectors are fetched at once.
RUN = 100_000


def score_tokens(c):
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda x: x != "")


def grams(tok, n: int):
    if n == 1:
        return tok
    return F.when(F.size(tok) >= n, F.transform(F.sequence(F.lit(0), F.size(tok) - n), lambda i: F.array_join(F.slice(tok, i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


#: How often both sides hold each gram, summed: in the sorted run of (gram, side) a gram's candidates come first and are used up by its references.
_HITS = """
aggregate(array_sort(concat(transform({c}, g -> named_struct('g', g, 's', 0)), transform({r}, g -> named_struct('g', g, 's', 1)))),
  named_struct('g', cast(null as string), 'own', 0, 'hit', 0),
  (z, x) -> case when x.s = 0 then named_struct('g', x.g, 'own', if(x.g <=> z.g, z.own + 1, 1), 'hit', z.hit)
    when x.g <=> z.g and z.own > 0 then named_struct('g', z.g, 'own', z.own - 1, 'hit', z.hit + 1)
    else z end).hit
"""


def rouge_n(pairs: DataFrame, n: int, keys: list[str], candidate: str = "candidate", reference: str = "reference", stem=None) -> DataFrame:
    """``keys, precision, recall, f`` of n-gram overlap with clipped counts; 0 where a side has no n-grams. ``stem``: a word's stem, such as ``stemming.stem``.

    Both sides stand in one row and are counted there, by one sorted run, so nothing is shuffled.
    """
    tok = _tokens(stem)
    rows = pairs.select(*keys, T.let(tok(candidate), lambda t: grams(t, n)).alias("_c"), T.let(tok(reference), lambda t: grams(t, n)).alias("_r"))
    hit = rows.select(*keys, F.size("_c").alias("_nc"), F.size("_r").alias("_nr"), F.expr(_HITS.format(c="_c", r="_r")).alias("_hit"))
    p, r = (F.coalesce(F.try_divide("_hit", n_), F.lit(0.0)) for n_ in ("_nc", "_nr"))
    scored = hit.select(*keys, p.alias("precision"), r.alias("recall"))
    return scored.withColumn("f", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def _tokens(stem):
    """Scored words of a text column; stemmed word by word in an Arrow UDF where a stem is asked for."""
    if stem is None:
        return lambda c: score_tokens(F.col(c))

    @F.arrow_udf("array<string>")
    def stemmed(words: pa.Array) -> pa.Array:
        coded = pc.list_flatten(words).dictionary_encode()
        stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), stems.take(coded.indices))

    return lambda c: stemmed(score_tokens(F.col(c)))


def _rows(a: list[str], b: list[str]) -> list[int]:
    """Row by row of the table of common subsequences of ``a`` and ``b``, as bits: bit j is 0 where the length grows from j to j + 1."""
    full, at = (1 << len(b)) - 1, {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    v, out = full, [full]
    for x in a:
        m = v & at.get(x, 0)
        v = (v + m | v - m) & full
        out.append(v)
    return out


def lcs(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, a machine word of ``b`` at a time."""
    return len(b) - _rows(a, b)[-1].bit_count() if a and b else 0


def lcs_places(a: list[str], b: list[str]) -> set[int]:
    """The places in ``a`` of one longest common subsequence."""
    rows = _rows(a, b)
    length = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return out


_STEPS = re.compile(r"[^a-z0-9]+")


def _words(t: str | None, stem=None) -> list[str]:
    w = [x for x in _STEPS.split((t or "").lower()) if x]
    return [stem(x) if stem else x for x in w]


def _prf(hit: int, nc: int, nr: int) -> tuple[float, float, float]:
    p, r = hit / nc if nc else 0.0, hit / nr if nr else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def rouge_l_score(candidate: str | None, reference: str | None, stem=None) -> tuple[float, float, float]:
    c, r = _words(candidate, stem), _words(reference, stem)
    return _prf(lcs(r, c), len(c), len(r))


def rouge_lsum_score(candidate: str | None, reference: str | None, stem=None) -> tuple[float, float, float]:
    """By lines: the union of each reference line's common subsequences with all candidate lines, each token counted as often as both sides have it."""
    cs = [w for x in (candidate or "").split("\n") if (w := _words(x, stem))]
    rs = [w for x in (reference or "").split("\n") if (w := _words(x, stem))]
    left = {}
    for c in cs:
        for x in c:
            left[x] = left.get(x, 0) + 1
    own = {}
    for r in rs:
        for x in r:
            own[x] = own.get(x, 0) + 1
    hit = 0
    for r in rs:
        for i in sorted(set().union(*[lcs_places(r, c) for c in cs])) if cs else []:
            x = r[i]
            if left.get(x, 0) > 0 and own.get(x, 0) > 0:
                hit, left[x], own[x] = hit + 1, left[x] - 1, own[x] - 1
    return _prf(hit, sum(map(len, cs)), sum(map(len, rs)))


def rouge_l(pairs: DataFrame, keys: list[str], summary_level: bool = False, candidate: str = "candidate", reference: str = "reference", stem=None) -> DataFrame:
    """``keys, precision, recall, f`` of the longest common subsequence (of lines: ``summary_level``), in an Arrow UDF; a row of the table is one sum of long integers."""
    score = rouge_lsum_score if summary_level else rouge_l_score

    @F.pandas_udf("struct<precision: double, recall: double, f: double>")
    def run(c: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score(x, y, stem) for x, y in zip(c, r, strict=True)], columns=["precision", "recall", "f"])

    return pairs.select(*keys, run(F.col(candidate), F.col(reference)).alias("s")).select(*keys, "s.*")


def corpus_mean(scores: DataFrame, pairs: DataFrame, keys: list[str], by: list[str], candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """Per group the mean of the scores times 100 over pairs with two texts, 0 if there is none."""
    full = pairs.where(~T.is_blank(F.col(candidate)) & ~T.is_blank(F.col(reference))).select(*keys)
    mean = scores.join(full, keys).groupBy(*by).agg(F.count("*").alias("n"), *[(F.avg(c) * 100).alias(c) for c in ("precision", "recall", "f")])
    return pairs.select(*by).distinct().join(mean, by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f")])


def match_scores(c: np.ndarray, r: np.ndarray) -> tuple[float, float]:
    """Mean best cosine of each row of ``c`` with ``r``, and the other way; 0 if a side is empty. Rows have length 1 or 0."""
    if not len(c) or not len(r):
        return 0.0, 0.0
    s = c @ r.T
    return float(s.max(axis=1).mean()), float(s.max(axis=0).mean())


def greedy_match(pairs: DataFrame, encoder, keys: list[str], candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """``keys, precision, recall, f``: each token's best cosine with the other side's tokens, averaged. Over hashed vectors these are not a model's scores.

    A pair's token vectors meet in one matrix product. They come from the encoder's table as a matrix where that is small, else by a join on the
    distinct tokens.
    """
    if encoder.small:
        sent = encoder.sent()

        def scores(cs: list[np.ndarray], rs: list[np.ndarray]) -> list[tuple[float, float]]:
            met = np.unique(np.concatenate([*cs, *rs]))
            got, known = sent.rows(met)
            size = np.linalg.norm(got, axis=1, keepdims=True)
            got = np.divide(got, size, out=np.zeros_like(got), where=size > 0)
            rows = lambda x: got[(at := np.searchsorted(met, x))[known[at]]]
            return [match_scores(rows(x), rows(y)) for x, y in zip(cs, rs, strict=True)]

        @F.pandas_udf("struct<precision: double, recall: double>")
        def meet(c: pd.Series, r: pd.Series) -> pd.DataFrame:
            out, cs, rs, held = [], [], [], 0
            for x, y in zip(c, r, strict=True):
                cs.append(np.asarray(x, np.int64)), rs.append(np.asarray(y, np.int64))
                held += len(x) + len(y)
                if held > RUN:
                    out, cs, rs, held = out + scores(cs, rs), [], [], 0
            return pd.DataFrame(out + (scores(cs, rs) if cs else []), columns=["precision", "recall"])

        key = lambda c: encoder.keys(score_tokens(F.col(c)))
        both = pairs.select(*keys, meet(key(candidate), key(reference)).alias("m")).select(*keys, "m.*")
    else:
        vocab = pairs.select(F.explode(F.array_union(score_tokens(F.col(candidate)), score_tokens(F.col(reference)))).alias("tok")).distinct()
        units = encoder.token_vectors(vocab, "tok").select("tok", unit([F.col(f"_e{i}") for i in range(encoder.dim)]).alias("v"))

        def side(text, name):
            each = pairs.select(*keys, F.explode(score_tokens(F.col(text))).alias("tok"))
            return each.join(units, "tok").groupBy(*keys).agg(F.collect_list("v").alias(name))

        @F.pandas_udf("struct<precision: double, recall: double>")
        def meet_vectors(c: pd.Series, r: pd.Series) -> pd.DataFrame:
            stack = lambda x: np.stack(list(x)) if x is not None and len(x) else np.zeros((0, 1))
            return pd.DataFrame([match_scores(stack(x), stack(y)) for x, y in zip(c, r, strict=True)], columns=["precision", "recall"])

        met = pairs.select(*keys).join(side(candidate, "c"), keys, "left").join(side(reference, "r"), keys, "left")
        both = met.select(*keys, meet_vectors("c", "r").alias("m")).select(*keys, "m.*")
    return both.withColumn("f", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def scored_safely(pairs: DataFrame, scorer, keys: list[str], filler: float = 0.0, candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """``keys, score, error``: ``scorer(list, list) -> list`` batch by batch; a failing batch is halved down to single pairs, and a pair that
    fails gets ``filler`` and its error. Blank pairs get ``filler`` unscored. Scores stay with their keys whatever fails."""

    def run(cs: list[str], rs: list[str]) -> list[tuple[float, str | None]]:
        try:
            return [(float(x), None) for x in scorer(cs, rs)]
        except Exception as e:  # noqa: BLE001  the scorer is the user's
            if len(cs) == 1:
                return [(filler, str(e)[:200])]
            h = len(cs) // 2
            return run(cs[:h], rs[:h]) + run(cs[h:], rs[h:])

    @F.pandas_udf("struct<score: double, error: string>")
    def udf(c: pd.Series, r: pd.Series) -> pd.DataFrame:
        ok = [i for i, (x, y) in enumerate(zip(c, r, strict=True)) if x and y and x.strip() and y.strip()]
        out: list[tuple[float, str | None]] = [(filler, None)] * len(c)
        got = run([c.iloc[i] for i in ok], [r.iloc[i] for i in ok]) if ok else []
        for i, x in zip(ok, got, strict=True):
            out[i] = x
        return pd.DataFrame(out, columns=["score", "error"])

    return pairs.select(*keys, udf(F.col(candidate), F.col(reference)).alias("s")).select(*keys, "s.score", "s.error")


