"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces

#: Bits of the hash of each n-gram length (1, 2, 3).
BITS = 15
#: Labelled rows of each language that the model is fitted on (expected number; a hash of doc_id picks them).
ROWS_PER_LANGUAGE = 2000
#: The log-probability matrix has a row for each language; it is broadcast, so their number is bounded. Of more labels the most frequent are learned.
MOST_LANGUAGES = 128
#: The n-grams of a text overlap and repeat each other's evidence: a text's log-probabilities count for no more than so many independent ones do.
EVIDENCE = 24
#: Texts whose language is told with a smaller probability go from the pipeline.
LEAST = 0.5

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point to its lower-case letter, 0 where it is no letter."""
    if not _letters:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                t[c] = ord(x.lower()) if len(x.lower()) == 1 else c
        _letters.append(t)
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of letters of each text; and for each n-gram length the features of all texts, with each text's start in them."""
    coded = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    gap = np.zeros(1, np.uint32)  # before and after each text, so that no n-gram reaches into a neighbour
    ends = np.cumsum([len(c) + 2 for c in coded]) if coded else np.zeros(0, np.int64)
    flat = np.concatenate([x for c in coded for x in (gap, c, gap)]) if coded else gap[:0]
    c = letters()[flat]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if coded else ends
    known = c != 0
    n_letters = np.add.reduceat(known, starts) if coded else ends
    a, b = c, np.append(c[1:], np.uint32(0))[: len(c)]
    before = np.concatenate([np.zeros(1, np.uint32), c[:-1]])[: len(c)]
    shift, out = np.uint32(32 - BITS), []
    mixed = a * np.uint32(0x9E3779B1)
    one = (mixed >> shift).astype(np.int32)
    two = ((mixed ^ (b * np.uint32(0x85EBCA77) + np.uint32(0x7F4A7C15))) * np.uint32(0xC2B2AE3D) >> shift).astype(np.int32) + (1 << BITS)
    three = (((before * np.uint32(0x27D4EB2F) ^ mixed) * np.uint32(0x165667B1) + b * np.uint32(0xC2B2AE35)) * np.uint32(0x85EBCA6B) >> shift).astype(np.int32) + (2 << BITS)
    for idx, keep in ((one, known), (two, known | (b != 0)), (three, known)):
        where = np.concatenate([[0], np.cumsum(keep)])
        out.append((idx[keep], where[starts] if coded else starts))
    return n_letters, out


def _count(langs: list[str]):
    at = {x: i for i, x in enumerate(langs)}

    def run(batches):
        for batch in pieces(batches):
            _, features = grams(batch.column("text").to_pylist())
            lang = np.array([at[x] for x in batch.column("lang").to_pylist()])
            # language by language, so that memory doesn't follow their number
            for j in np.unique(lang).tolist():
                total = np.zeros(3 << BITS, np.int64)
                for idx, starts in features:
                    sizes = np.diff(np.append(starts, len(idx)))
                    total += np.bincount(idx[np.repeat(lang == j, sizes)], minlength=len(total))
                (k,) = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(k + j * (3 << BITS)), pa.array(total[k])], ["k", "n"])

    return run


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The languages and their log-probability matrix, from the rows of ``docs(doc_id, text, lang)`` with a text and a label.

    At most ``rows_per_language`` rows of each language (in expectation) are used; a hash of ``doc_id`` picks them. Of more than ``most_languages``
    labels the most frequent are learned, ties by name; a text in another language gets the nearest of these.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    langs = sorted(n)
    if not langs:
        return [], np.zeros((0, 3 << BITS), np.float32)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows_per_language / n[k])))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    counts = chosen.mapInArrow(_count(langs), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(len(langs) * (3 << BITS))
    dense[counts["k"].to_numpy(np.int64)] = counts["n"]
    dense = dense.reshape(len(langs), 3, 1 << BITS) + 0.5
    return langs, np.log(dense / dense.sum(axis=2, keepdims=True)).reshape(len(langs), -1).astype(np.float32)


def score(texts: list[str | None], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: whether it has a letter, the index of the likeliest language, its posterior probability (even priors).

    The probability is that of ``EVIDENCE`` n-grams like the text's; with all of a long text's n-grams taken for independent it would always be 1.
    """
    n_letters, features = grams(texts)
    total, n = np.zeros((len(texts), len(matrix))), np.zeros(len(texts))
    for idx, starts in features:
        sizes = np.diff(np.append(starts, len(idx)))
        n += sizes
        full = sizes > 0
        if full.any():
            for j, row in enumerate(matrix):
                total[full, j] += np.add.reduceat(row[idx], starts[full], dtype=np.float64)
    best = total.argmax(axis=1)
    odds = np.exp((total - total.max(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None])
    return n_letters > 0, best, 1.0 / odds.sum(axis=1)


def identify(docs: DataFrame, labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """``doc_id, text_hash, lang_pred, score``, a row for each row of ``docs``, from its text alone.

    Null text, or one without a letter, is ``und`` with score 0, and so is everything if no row is labelled. Equal rows fare alike; texts are read whole,
    however long; an empty table gives no rows; the other columns of ``docs`` are ignored.
    """
    langs, matrix = train(labelled, rows_per_language)
    sent = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def run(batches):
        names, logs = sent.value
        for batch in pieces(batches, most=500_000):
            if names:
                known, best, p = score(batch.column("text").to_pylist(), logs)
            else:
                known, best, p = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            lang = [names[b] if k else "und" for k, b in zip(known, best, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(lang, pa.string()), pa.array(np.where(known, p, 0.0))], ["doc_id", "text_hash", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, lang_pred string, score double")


def held_out(doc_id="doc_id") -> F.Column:
    """Rows that the model never learns from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def keep_identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without the rows whose language can't be told: no letter at all (null, empty or blank text too), or a probability below ``least``.

    The model learns from the labelled rows of ``docs`` that are not held out. Where none is labelled no language can be the less likely one, and only rows without
    a letter go. Equal rows fare alike; long texts are read whole; an empty table stays empty; other columns, whatever their names, come along.
    """
    langs, matrix = train(docs.where(~held_out()))
    sent = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        for batch in pieces(batches, most=500_000):
            texts = batch.column("text").to_pylist()
            if langs:
                known, _, p = score(texts, sent.value)
                yield batch.filter(pa.array(known & (p >= least)))
            else:
                yield batch.filter(pa.array(grams(texts)[0] > 0))

    plain = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])  # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
