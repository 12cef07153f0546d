"""What a model can stand in for: each interface has a default without a model, which DuckDB can reproduce.

The defaults' scores say nothing about those of trained models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text, tokens

#: Rows of a block of the encoder's table that is sent to the workers as a matrix, the blocks there may be (a larger table is joined),
#: and those that a worker holds at once.
MATRIX_ROWS, MOST_BLOCKS, HELD = 100_000, 64, 4


class Tokenizer(Protocol):
    specials: int

    def tokens(self, c: Column) -> Column: ...


class SentenceSplitter(Protocol):
    def sentences(self, c: Column) -> Column: ...


class Encoder(Protocol):
    def encode(self, sentences: DataFrame) -> DataFrame:
        """``sentences(sentence)`` to ``(sentence, vector)``; each distinct sentence once."""


class Generator(Protocol):
    def generate(self, c: Column, max_len: int | Column, min_len: int = 64) -> Column: ...


@dataclass(frozen=True)
class WhitespaceTokenizer:
    specials: int = 1

    def tokens(self, c: Column) -> Column:
        return tokens.tokens(c)


@dataclass(frozen=True)
class PunctuationSplitter:
    def sentences(self, c: Column) -> Column:
        return text.split_sentences(c)


@dataclass(frozen=True)
class LeadGenerator:
    """The lead of the input; ``min_len`` has no effect on it. ``native``: an expression, which may stand inside others."""

    source: int = 1024
    native: bool = True

    def generate(self, c: Column, max_len: int | Column, min_len: int = 64) -> Column:
        return tokens.lead(c, max_len, self.source)


@dataclass(frozen=True)
class UdfGenerator:
    """A model behind an Arrow UDF ``udf(text, max_len, min_len) -> string``; a failure inside it should return an empty string."""

    udf: object
    native: bool = False

    def generate(self, c: Column, max_len: int | Column, min_len: int = 64) -> Column:
        n = max_len if isinstance(max_len, Column) else F.lit(max_len)
        return self.udf(c, n, F.lit(min_len))


@dataclass
class HashedVectors:
    """A sentence's vector is the sum of its tokens' vectors; a token's vector is the row of ``table(vec_id, embedding)`` that its md5 picks.

    The table goes to the workers in blocks of ``MATRIX_ROWS`` rows, and a sentence is encoded where it stands, so no token's vector is shuffled. One of more
    than ``MOST_BLOCKS`` blocks is joined on the distinct tokens. A sentence without a known token has no vector.
    """

    table: DataFrame
    dim: int = 64
    rows: int | None = None

    def __post_init__(self):
        self._count = self._sent = None

    @property
    def count(self) -> int:
        if self._count is None:
            self._count = self.table.count()
        return self._count

    @property
    def small(self) -> bool:
        return self.count <= MATRIX_ROWS * MOST_BLOCKS

    def keys(self, tok: Column) -> Column:
        """The rows of the table that an array of tokens picks."""
        return F.transform(tok, lambda t: F.pmod(tokens.token_hash(t), F.lit(self.rows or self.count)))

    def matrix(self, low: int | None = None, high: int | None = None):
        """The sorted ids and their vectors, of the whole table or of the ids from ``low`` to below ``high``. Only for a small table."""
        rows = self.table.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
        if low is not None:
            rows = rows.where((F.col("vec_id") >= low) & (F.col("vec_id") < high))
        got = rows.orderBy("vec_id").toArrow()
        kind = np.float32 if "float" in self.table.schema["embedding"].dataType.simpleString() else np.float64
        flat = got["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind) if got.num_rows else np.zeros(0, kind)
        return got["vec_id"].to_numpy().astype(np.int64), flat.reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, self.dim), kind)

    def sent(self) -> Matrix:
        """``matrix`` as broadcasts, a block each, made once."""
        if self._sent is None:
            spark, n = self.table.sparkSession, self.rows or self.count
            lows = [None] if n <= MATRIX_ROWS else range(0, n, MATRIX_ROWS)
            self._sent = Matrix([spark.sparkContext.broadcast(self.matrix(x, None if x is None else x + MATRIX_ROWS)) for x in lows], self.dim)
        return self._sent

    def token_vectors(self, df: DataFrame, token: str) -> DataFrame:
        """``df`` with the columns ``_e0 ...`` of each token's vector in double."""
        vec = self.table.select(F.col("vec_id").alias("_v"), *[F.col("embedding")[i].cast("double").alias(f"_e{i}") for i in range(self.dim)])
        return df.withColumn("_k", F.pmod(tokens.token_hash(F.col(token)), F.lit(self.rows or self.count))).join(vec, F.col("_k") == F.col("_v")).drop("_k", "_v")

    def attach(self, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
        """``df`` with the vector of each text; null where there is none."""
        if self.small:
            sent = self.sent()

            @F.arrow_udf("array<double>")
            def look(keys: pa.Array) -> pa.Array:
                return vector_arrays(*sent.sums(keys))

            # else a filter on the vectors would encode a second time
            return df.withColumn(out, look.asNondeterministic()(self.keys(tokens.tokens(F.col(text)))))
        key = F.md5(F.coalesce(F.col(text), F.lit("")))
        once = df.select(key.alias("_key"), F.col(text).alias("_text")).dropDuplicates(["_key"])
        each = once.select("_key", F.explode(tokens.tokens(F.col("_text"))).alias("_tok"))
        summed = self.token_vectors(each, "_tok").groupBy("_key").agg(*[F.sum(f"_e{i}").alias(f"_s{i}") for i in range(self.dim)])
        vec = summed.select("_key", F.array(*[F.col(f"_s{i}") for i in range(self.dim)]).alias(out))
        return df.withColumn("_own", key).join(vec, F.col("_own") == F.col("_key"), "left").drop("_own", "_key")

    def encode(self, sentences: DataFrame) -> DataFrame:
        return self.attach(sentences.select("sentence").distinct(), "sentence").where("vector is not null").select("sentence", "vector")


class Matrix:
    """The blocks of a table of vectors on the workers, each ``(ids, vectors)``; of more than ``HELD`` blocks one is in memory at a time."""

    def __init__(self, blocks: list, dim: int, held: int | None = None):
        self.blocks, self.dim, self.held = blocks, dim, HELD if held is None else held

    def _each(self):
        for b in self.blocks:
            yield b.value
            if len(self.blocks) > self.held:
                vars(b).pop("_value", None)

    def sums(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each list of keys the sum of their vectors, and whether a key is known."""
        out = known = None
        for ids, vectors in self._each():
            x, k = sums(keys, ids, vectors)
            out, known = (x, k) if out is None else (out + x, known | k)
        return out, known

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vector of each key, zeros where it is unknown, and whether it is known."""
        out, known = np.zeros((len(keys), self.dim)), np.zeros(len(keys), bool)
        for ids, vectors in self._each():
            if len(ids):
                at = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
                hit = ids[at] == keys
                out[hit] = vectors[at[hit]]
                known |= hit
        return out, known


def sums(keys: pa.Array, ids: np.ndarray, vectors: np.ndarray, most: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
    """For each list of keys the sum of their vectors, and whether a key is known; ``most`` token vectors are held at once, few enough for the processor's cache."""
    sizes = pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(keys).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.minimum(np.searchsorted(ids, flat), max(len(ids) - 1, 0))
    known = ids[at] == flat if len(ids) else np.zeros(len(flat), bool)
    row = np.repeat(np.arange(len(sizes)), sizes)[known]
    at = at[known]
    out = np.zeros((len(sizes), vectors.shape[1]))
    for low in range(0, len(row), most):
        r = row[low : low + most]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[first]] += np.add.reduceat(vectors[at[low : low + most]].astype(np.float64), first, axis=0)
    return out, np.bincount(row, minlength=len(sizes)) > 0


#: Sentences of a run of groups that are encoded at once.
RUN = 20_000


def groups(keys: pa.Array, sent: Matrix) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group, a list of its sentences' keys, the vectors and whether each sentence has one."""
    sizes = pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False)
    low = 0
    while low < len(keys):
        high = max(low + 1, low + int(np.searchsorted(np.cumsum(sizes[low:]), RUN, side="right")))
        vec, known = sent.sums(keys[low:high].flatten())
        ends = np.cumsum(sizes[low:high])
        for a, b in zip((ends - sizes[low:high]).tolist(), ends.tolist(), strict=True):
            yield vec[a:b], known[a:b]
        low = high


def vector_arrays(vectors: np.ndarray, known: np.ndarray) -> pa.Array:
    n, dim = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(vectors.ravel()), mask=pa.array(~known))


def attach(encoder, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
    """``df`` with each text's vector by any encoder: by its own ``attach`` if it has one, else each distinct text once, joined back by digest."""
    if hasattr(encoder, "attach"):
        return encoder.attach(df, text, out)
    vec = encoder.encode(df.select(F.col(text).alias("sentence")).distinct()).select(F.md5("sentence").alias("_key"), F.col("vector").alias(out))
    return df.withColumn("_own", F.md5(F.coalesce(F.col(text), F.lit("")))).join(vec, F.col("_own") == F.col("_key"), "left").drop("_own", "_key")
