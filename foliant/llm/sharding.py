"""Sharding by weighted rendezvous hashing, with gapless slots inside each shard."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unfold

#: Rows that one numbering group holds on average; groups, not shards, are the unit of work when slots are dealt.
ROWS_PER_GROUP = 20_000
#: Up to so many groups their sizes are broadcast; beyond that they are joined by a shuffle.
MOST_GROUPS = 500_000


def draw(key: Column, shard: Column) -> Column:
    """A uniform number in (0, 1) that the key and the shard decide: 52 bits of an md5 digest."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("/"), shard.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose draw wins: least ``-ln(u) / weight``, ties to the lower shard.

    Every (key, shard) draw is independent of the other shards, so a further shard takes rows only into itself and moves
    its share of the total weight. A null key is one key of its own (all such rows share a shard).
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    even = len(set(weights)) == 1
    each = F.array(*[F.lit(float(w)) for w in weights]) if not even else None

    def score(i):
        s = -F.ln(draw(key, i))
        return F.struct((s if even else s / F.get(each, i)).alias("s"), i.alias("i"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), score))["i"].cast("int")


def number(df: DataFrame, shard: str, order: Sequence[str], rows: int, n_shards: int, out: str = "slot") -> DataFrame:
    """Adds a gapless number from 0 within each shard.

    Equal rows are counted first and stand as one row with its count, so that however many copies of a row there are, they cost one row of work until
    they are written out again (``unfold``). The distinct rows are numbered inside (shard, group) with groups of a bounded expected size, cut by a hash of
    the order columns; a small table of group sizes, one row for each group, gives the offsets.
    """
    groups = max(1, math.ceil(rows / max(1, n_shards) / ROWS_PER_GROUP))
    unit = df.groupBy(*df.columns).agg(F.count("*").alias("_m")).withColumn("_g", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    sizes = df.withColumn("_g", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int")).groupBy(shard, "_g").agg(F.count("*").alias("_n"))
    ahead = sizes.select(F.col(shard).alias("_s"), F.col("_g").alias("_h"), F.expr(f"sum(_n) over (partition by {shard} order by _g) - _n").alias("_before"))
    within = unit.withColumn("_r", F.expr(f"sum(_m) over (partition by {shard}, _g order by {', '.join(order)} rows between unbounded preceding and current row) - _m"))
    placed = within.join(F.broadcast(ahead) if groups * n_shards <= MOST_GROUPS else ahead, (F.col(shard) == F.col("_s")) & (F.col("_g") == F.col("_h"))).withColumn("_at", F.col("_before") + F.col("_r")).drop("_g", "_s", "_h", "_before", "_r")
    return unfold(placed, "_m", "_i").withColumn(out, (F.col("_at") + F.col("_i")).cast("bigint")).drop("_m", "_at", "_i")


def shard_documents(docs: DataFrame, n_shards: int = 40, weights: Sequence[float] | None = None, added: float = 1.0) -> DataFrame:
    """Deals rows over ``n_shards`` by ``doc_id``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``grown_shard`` is the shard with one more, of weight ``added``. Null text counts 16 bytes and crc32 0; rows with equal or
    null ``doc_id`` share a shard, and rows equal in both id and text get slots one after the other; long texts count whole; an empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    weights = list(weights or [1.0] * n_shards)
    if len(weights) != n_shards:
        raise ValueError("one weight for each shard")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    dealt = docs.select(
        "doc_id",
        (F.octet_length(body) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
    )
    # the further shard wins exactly where its own score beats the winner's
    old = -F.ln(draw(F.col("doc_id"), F.col("shard"))) / F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("shard"))
    new = -F.ln(draw(F.col("doc_id"), F.lit(n_shards))) / F.lit(float(added))
    dealt = dealt.withColumn("grown_shard", F.when(new < old, F.lit(n_shards)).otherwise(F.col("shard")).cast("int"))
    out = number(dealt, "shard", ["doc_id", "text_crc32", "size"], docs.count(), n_shards)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
