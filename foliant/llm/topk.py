"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Vectors of a block (fewer if they are long: ``COMPONENTS`` numbers at most), blocks that one task holds together, and queries that are scored together.
BLOCK, BLOCKS, QUERIES, COMPONENTS = 512, 32, 256, 1 << 16
#: Components from this size on could make sums that 64 bits don't hold.
WIDEST = 1 << 27
SCALE = 256
#: Marks an empty place; no score is that small.
NONE = -(1 << 62)
#: Groups of the longest vectors, in one of which each query batch begins.
HOMES = 64
_PACKED = "dim int, ids binary, body binary, hi binary, lo binary, longest double, group int"


def _valid(vectors: DataFrame) -> DataFrame:
    ok = F.expr("embedding is not null and size(embedding) > 0 and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(ok).withColumn("dim", F.size("embedding"))


def _pack(rows_each: int):
    """Runs of ``rows_each`` vectors of one length (fewer if long), in order: ids, integer components, and the largest and smallest of each component."""

    def run(batches):
        held: dict[int, list] = {}

        def out(dim):
            got = held.pop(dim)
            scaled = np.floor(SCALE * np.array([v for _, v in got], np.float64))
            if np.abs(scaled).max(initial=0) >= WIDEST:
                raise ValueError(f"components of {WIDEST // SCALE} and more make scores that 64 bits may not hold")
            body = scaled.astype(np.int64)
            ids = np.array([i for i, _ in got], np.int64)
            return [dim, ids.tobytes(), body.tobytes(), body.max(0).tobytes(), body.min(0).tobytes(), float(np.sqrt((scaled**2).sum(axis=1)).max()), 0]

        def send(rows):
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["dim", "ids", "body", "hi", "lo", "longest", "group"])

        for batch in batches:
            for i, v, d in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "embedding", "dim")), strict=True):
                held.setdefault(d, []).append((i, v))
                if len(held[d]) >= max(1, min(rows_each, COMPONENTS // d)):
                    yield send([out(d)])
        for d in sorted(held):
            yield send([out(d)])

    return run


def bounds(q: np.ndarray, blocks: list[tuple]) -> np.ndarray:
    """What no inner product of a query with a vector of a block passes: the lesser of its components times the block's extreme ones, summed, and of the product of
    its length with the longest vector's there."""
    hi, lo = np.array([b[2] for b in blocks]), np.array([b[3] for b in blocks])
    by_terms = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    length = lambda v: np.sqrt((v.astype(np.float64) ** 2).sum(axis=-1))
    by_length = length(q)[:, None] * np.array([length(b[1]).max(initial=0) for b in blocks])[None, :]
    return np.minimum(by_terms, np.floor(by_length * (1 + 1e-9)).astype(np.int64) + 1)


def search_block(q: np.ndarray, q_ids: np.ndarray, blocks: list[tuple], k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The best ``k`` scores and ids of each query among the blocks, and how many (query, block) pairs were scored.

    Each query visits the blocks by falling bound and stops when the bound is below its k-th score, or below ``floor``, a k-th score that it has elsewhere.
    The score NONE marks an empty place.
    """
    top, ids = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
    hi, lo = np.array([b[2] for b in blocks]), np.array([b[3] for b in blocks])
    bound = bounds(q, blocks)
    floor = np.full(len(q), NONE) if floor is None else floor
    order = np.argsort(-bound, axis=1, kind="stable")
    widest = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(hi).max(initial=0)), int(np.abs(lo).max(initial=0)), 1) * q.shape[1]
    exact = widest < 1 << 53  # then sums in doubles are exact integers
    qf = q.astype(np.float64)
    active, scored = np.arange(len(q)), 0
    for r in range(len(blocks)):
        at = order[active, r]
        live = bound[active, at] >= np.maximum(top[active, -1], floor[active])
        active, at = active[live], at[live]
        if not len(active):
            break
        for j in np.unique(at):
            rows = active[at == j]
            scored += len(rows)
            b_ids, body = blocks[j][0], blocks[j][1]
            s = (qf[rows] @ body.astype(np.float64).T).astype(np.int64) if exact else q[rows] @ body.T
            s[q_ids[rows][:, None] == b_ids[None, :]] = NONE
            both = np.concatenate([top[rows], s], axis=1)
            both_ids = np.concatenate([ids[rows], np.broadcast_to(b_ids, s.shape)], axis=1)
            if both.shape[1] > 4 * k:  # only what reaches the k-th value, ties included, is put in order
                kth = -np.partition(-both, k - 1, axis=1)[:, k - 1 : k]
                for n, row in enumerate(rows):
                    (c,) = np.nonzero(both[n] >= kth[n])
                    best = c[np.lexsort((both_ids[n, c], -both[n, c]))][:k]
                    top[row], ids[row] = both[n, best], both_ids[n, best]
            else:
                for n, row in enumerate(rows):
                    best = np.lexsort((both_ids[n], -both[n]))[:k]
                    top[row], ids[row] = both[n, best], both_ids[n, best]
    ids[top == NONE] = -1
    return top, ids, scored


_FOUND = "query_id long, vec_id long, score long, scored long, held long"


def _search(k: int):
    """Queries against the blocks of their group: their best candidates, and once for each batch how many (query, block) pairs were ``scored`` of those ``held``."""

    def run(batches):
        group, blocks = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    group, blocks = row["group"], {}
                n, ids = row["dim"], np.frombuffer(row["ids"], np.int64)
                body = np.frombuffer(row["body"], np.int64).reshape(-1, n)
                if not row["query"]:
                    blocks.setdefault(n, []).append((ids, body, np.frombuffer(row["hi"], np.int64), np.frombuffer(row["lo"], np.int64)))
                elif n in blocks:
                    # a query's extreme places hold its k-th score so far
                    top, best, scored = search_block(body, ids, blocks[n], k, np.frombuffer(row["hi"], np.int64) if row["known"] else None)
                    i, j = np.nonzero(top != NONE)
                    cols = [ids[i], best[i, j], top[i, j]]
                    once = np.zeros((2, len(i) + 1), np.int64)
                    once[:, -1] = scored, len(ids) * len(blocks[n])
                    none = np.append(np.zeros(len(i), bool), True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.append(c, 0), mask=none) for c in cols), pa.array(once[0]), pa.array(once[1])], ["query_id", "vec_id", "score", "scored", "held"])

    return run


def _best(near: DataFrame, k: int) -> DataFrame:
    return near.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)")).where(F.col("rank") <= k)


def _seeded(k: int):
    """Query batches with the k-th scores they have so far (``known``), as ``_search`` reads them."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                kth = dict(zip(row["with"] or [], row["kth"] or [], strict=True))
                row["hi"] = np.array([kth.get(i, NONE) for i in ids.tolist()], np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in (("dim", pa.int32()), ("ids", pa.binary()), ("body", pa.binary()), ("hi", pa.binary()), ("lo", pa.binary()), ("home", pa.int32()))], ["dim", "ids", "body", "hi", "lo", "home"])

    return run


def search(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """What ``top_k`` ranks, before ranking: candidates of each query with their scores, and in rows without a query the pairs of query and block ``scored`` and ``held``."""
    all_ = _valid(vectors).dropDuplicates(["vec_id", "embedding"])
    n = vectors.count()
    parts = max(1, math.ceil(n / (BLOCK * BLOCKS)))
    packed = all_.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id", "embedding").mapInArrow(_pack(BLOCK), _PACKED)
    blocks = table(packed.withColumn("group", F.spark_partition_id()).withColumn("query", F.lit(False)).withColumn("known", F.lit(False)), "blocks")
    block = blocks.drop("longest")
    asked = all_.where(F.col("vec_id") % every == 0).repartitionByRange(max(1, math.ceil(n / every / QUERIES / 8)), "vec_id").sortWithinPartitions("vec_id", "embedding").mapInArrow(_pack(QUERIES), _PACKED)
    homes = [r["group"] for r in blocks.groupBy("group").agg(F.max("longest").alias("l")).orderBy(F.desc("l"), "group").limit(HOMES).collect()] or [0]
    home = F.get(F.array(*[F.lit(h) for h in homes]), F.pmod(F.xxhash64("ids"), F.lit(len(homes))).cast("int"))
    asked = table(asked.drop("group", "longest").withColumn("home", home), "queries")

    def meet(queries):
        met = block.unionByName(queries.select(*[c if c in queries.columns else F.lit(True).alias(c) for c in block.columns]))
        return met.repartition(parts, "group").sortWithinPartitions("group", "query").mapInArrow(_search(k), _FOUND)

    # each query batch first meets one of the groups with the longest vectors; the k-th scores from there are carried to all others
    first = table(meet(asked.withColumn("group", F.col("home")).withColumn("known", F.lit(False))), "first")
    if parts == 1:
        return first
    kth = _best(first.where("query_id is not null"), k).where(F.col("rank") == k).select("query_id", "score")
    held = asked.mapInArrow(_named, "ids binary, id long, dim int").join(kth, F.expr("id = query_id")).groupBy(F.col("ids").alias("_ids"), F.col("dim").alias("_dim")).agg(F.collect_list("id").alias("with"), F.collect_list("score").alias("kth"))
    seeded = asked.join(held, F.expr("ids = _ids and dim = _dim"), "left").mapInArrow(_seeded(k), "dim int, ids binary, body binary, hi binary, lo binary, home int")
    rest = table(seeded, "seeded").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where("group <> home").withColumn("known", F.lit(True))
    return first.unionByName(meet(rest))


def _named(batches):
    for batch in batches:
        for ids, dim in zip(batch.column("ids").to_pylist(), batch.column("dim").to_pylist(), strict=True):
            each = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([ids] * len(each), pa.binary()), pa.array(each), pa.array(np.full(len(each), dim, np.int32))], ["ids", "id", "dim"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best candidates by integer inner product, ties to the smaller ``vec_id``.

    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates all rows with another ``vec_id``; equal (vec_id, vector) rows
    count once. Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids; vectors
    are compared with those of their own length. A component of 2**19 or more raises, for its scores may pass 64 bits. An empty table gives no rows; other columns are
    ignored. Blocks are ranges of ``vec_id``; each task holds ``BLOCKS`` of them and the query batches stream past, so memory does not
    follow the table. Queries take the k-th score of the first group they meet, one of those with the longest vectors, to all others.
    """
    return _best(search(vectors, k, every).where("query_id is not null"), k).select("query_id", "rank", "vec_id", "score")


def scored_share(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """One row, ``scored, held``: of all pairs of query and block, those that the bounds left to be scored."""
    return search(vectors, k, every).agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"), F.coalesce(F.sum("held"), F.lit(0)).alias("held"))
