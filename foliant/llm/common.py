"""Helpers the training-data operators share: scratch tables, connected components, batching."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []

# Fixed values of the word definitions: white space, and what separates "letter or digit" words.
SPACES = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master, whose executors are the driver's process, may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may be gone already; then the folder's owner cleans it
            return


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a table made by ``table`` that no later plan reads."""
    remove(df.sparkSession, df._foliant_path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more; otherwise they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c):
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(c, separators: str):
    """The words between separators; null text has none."""
    return F.coalesce(F.array_remove(F.split(c, separators), ""), F.array().cast("array<string>"))


#: Nodes with more neighbours than this are hubs; their few rows of least neighbours are broadcast, so that no task holds a hub's edges. Of so
#: many edges that more than ``MOST_HUBS`` nodes could pass, only nodes with a larger share of the edges count.
HUB, MOST_HUBS = 1_000, 200_000


def _beside(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``rows(a, b)`` with ``m`` of ``least(c, m, k)``, joined on ``a = c``: hubs (large ``k``) by broadcast, the others by shuffle."""
    over, own = max(HUB, 2 * n_edges // MOST_HUBS), F.col("a") == F.col("c")
    if n_edges <= over:
        return rows.join(least.select("c", "m"), own)
    hubs = F.broadcast(least.where(F.col("k") > over).select("c", "m"))
    rest = rows.join(hubs, own, "left_anti").join(least.where(F.col("k") <= over).select("c", "m"), own)
    return rows.join(hubs, own).unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, label)``, label the smallest node reached.

    Alternating large-star and small-star rounds over min aggregates, each round written to the shared folder; the number
    of rounds grows with the logarithm of the component size. No neighbour list is ever collected, and a hub's edges stay where they are.
    """
    e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        last = state
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"), F.count("*").alias("k")).select("c", F.least("c", "m").alias("m"), "k"), "least")
        # large star: every larger neighbour b of a hangs from the least of a's neighbourhood
        large = _beside(both.where("b > a"), least, state["n"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = table(large, "large")
        # small star: the smaller neighbours of a, and a itself, hang from the least of them
        low = table(large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"), F.count("*").alias("k")), "low")
        small = _beside(large, low, state["n"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = table(small, "small")
        drop(e), drop(large), drop(least), drop(low)
        e = new
    raise RuntimeError(f"the components have not settled in {max_rounds} rounds")


#: So many edges are settled by one task in memory (16 bytes each); each round of more takes some ten jobs, whose plans and threads the driver holds.
FEW_EDGES = 200_000


def settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, sorted, and the smallest node that each reaches. Roots hang from smaller ones until no edge joins two."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, to = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (to[i] != to[j]).any():
        np.minimum.at(to, np.maximum(to[i], to[j]), np.minimum(to[i], to[j]))
        while (to[to] != to).any():
            to = to[to]
    return nodes, nodes[to]


def _settled(batches):
    rows = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in settled(*map(np.concatenate, zip(*rows, strict=True)))], ["node", "label"])


def joined(edges: DataFrame) -> DataFrame:
    """``components`` of ``edges(a: bigint, b: bigint)``; no more than ``FEW_EDGES`` of them are settled by one task, without rounds."""
    e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return e.repartition(1).mapInArrow(_settled, "node long, label long") if e.count() <= FEW_EDGES else components(e)


#: Copies of one row that one task writes.
UNFOLD = 10_000


def unfold(df: DataFrame, times: str, number: str) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``number``; a row with very many copies is dealt over tasks in runs of ``UNFOLD``."""
    few = df.where(F.col(times).between(1, UNFOLD)).withColumn(number, F.explode(F.expr(f"sequence(0L, {times} - 1)")))
    many = df.where(F.col(times) > UNFOLD).withColumn("_run", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {UNFOLD})"))).repartition(slots(df.sparkSession))
    return few.unionByName(many.withColumn(number, F.explode(F.expr(f"sequence(_run * {UNFOLD}, least({times}, (_run + 1) * {UNFOLD}) - 1)"))).drop("_run"))


def wrapped(docs: DataFrame, **keys) -> DataFrame:
    """The rows of ``docs`` whole in the one column ``row``, beside these keys: no column of theirs can clash with a name used here."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[e.alias(k) for k, e in keys.items()])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_hash(docs: DataFrame, first: str = "text") -> Column:
    """A hash of ``first`` and all other columns; maps and the like, which can't be hashed, go through JSON."""
    plain = lambda f: not any(k in f.dataType.simpleString() for k in ("map<", "variant", "void"))
    fields = [F.col(quoted(f.name)) if plain(f) else F.to_json(F.struct(F.col(quoted(f.name)))) for f in docs.schema.fields if f.name != first]
    return F.xxhash64(F.col(first), *fields)
