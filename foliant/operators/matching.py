"""Matching the outputs of several systems by id."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_of(df: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """One row for each key: the last in order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def match_two(left: DataFrame, right: DataFrame, key: str = "doc_id", first: int | None = None) -> DataFrame:
    """Rows of ``left`` with the last row of their key among the first ``first`` rows (by ``ord``) of ``right``; the columns get suffixes."""
    build = last_of(right if first is None else right.where(F.col("ord") < first), key)
    name = lambda df, s: df.select(key, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != key])
    return name(left, "left").join(name(build, "right"), key)


def match_all(systems: Mapping[str, DataFrame], key: str = "doc_id", value: str = "summary") -> DataFrame:
    """``key`` and one column for each system, for the keys that all of them have."""
    out = None
    for name, df in systems.items():
        one = df.select(key, F.col(value).alias(name))
        out = one if out is None else out.join(one, key)
    return out


def match_report(left: DataFrame, right: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = ("document", "reference")) -> DataFrame:
    """One row: keys in both, in one only, equal fields, and the share of the larger side that both have."""
    a, b = left.select(key, *[F.col(f).alias(f"_l{f}") for f in fields]), right.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_r{f}") for f in fields])
    both = a.join(b, F.col(key) == F.col("_k"), "full")
    here = F.col(key).isNotNull() & F.col("_k").isNotNull()
    agg = both.agg(
        F.count_if(here).alias("common"), F.count_if(F.col("_k").isNull()).alias("only_in_left"), F.count_if(F.col(key).isNull()).alias("only_in_right"),
        *[F.count_if(here & F.col(f"_l{f}").eqNullSafe(F.col(f"_r{f}"))).alias(f"same_{f}") for f in fields], F.count(key).alias("n_left"), F.count("_k").alias("n_right"),
    )
    return agg.withColumn("overlap_pct", F.round(F.try_divide(F.col("common") * 100.0, F.greatest("n_left", "n_right")), 6))


def not_done(todo: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is left to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def lookup(ids: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The source row of each id; an id without one keeps nulls."""
    return ids.join(docs, key, "left")
