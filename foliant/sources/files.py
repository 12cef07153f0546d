"""Readers and writers of datasets, result files and reports. Paths go through Hadoop's file systems, never the driver's own."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Results of one run; rows that failed carry an error and nulls.
RESULT = "doc_id long, document string, reference string, summary string, num_chunks int, error string"


def dataset(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer parts than there are cores, dealt out evenly; larger tables stay as they are read.

    The deal names no key: unions of tables that claim one hash partitioning are aggregated without an exchange, which leaves their halves unmerged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def require(spark: SparkSession, paths: Sequence[str]) -> None:
    """Raises ``FileNotFoundError`` with the paths that are missing."""
    if missing := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(", ".join(missing))


def present(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that exist, for inputs that may be absent."""
    return [p for p in paths if exists(spark, p)]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; only a local master may leave ``spark.checkpoint.dir`` unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="foliant-")
    return f"{at.rstrip('/')}/foliant-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def read_json_arrays(spark: SparkSession, paths: Sequence[str], schema: str = RESULT, skip_missing: bool = False) -> DataFrame:
    """The records of files that hold one JSON array each, in the order of ``paths`` (``file_ord``, for which the path must be unique)."""
    paths = present(spark, paths) if skip_missing else list(paths)
    require(spark, paths)
    out = None
    for i, p in enumerate(paths):
        one = spark.read.schema(schema).option("multiLine", True).json(p).withColumn("file_ord", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], spark.createDataFrame([], schema).withColumn("file_ord", F.lit(0)).schema)


def write_json(df: DataFrame, path: str) -> None:
    """One record a line; ``read_json_arrays`` is for files of other tools."""
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """One array of all records in order, as other tools read it: for tables of report size, which one task writes."""
    w = f"over (order by `{order}`)"
    row = F.concat(F.when(F.expr(f"row_number() {w} = 1"), "[").otherwise(""), F.to_json(F.struct(*df.columns)), F.when(F.expr(f"lead(1) {w} is null"), "]").otherwise(","))
    df.select(F.col(order).alias("_o"), row.alias("value")).coalesce(1).sortWithinPartitions("_o").select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def indexed_json(df: DataFrame, key: str) -> Column:
    """An aggregate: one JSON object of all rows by key. For tables of report size."""
    rest = [c for c in df.columns if c != key]
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.struct(*rest).alias("v"))))))


def chunk_export(chunks: DataFrame, stats: DataFrame, config_json: str) -> DataFrame:
    """``doc_id, export``: each document's settings, statistics and chunks as JSON."""
    cols = [c for c in chunks.columns if c != "doc_id"]
    per = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", *[c for c in cols if c != "chunk_id"]))).alias("chunks"))
    s = stats.select(F.col("doc_id").alias("_d"), F.struct(*[c for c in stats.columns if c != "doc_id"]).alias("statistics"))
    body = F.to_json(F.struct(F.col("statistics"), F.col("chunks")))
    return per.join(s, F.col("doc_id") == F.col("_d")).select("doc_id", F.concat(F.lit('{"config":'), F.lit(config_json), F.lit(","), F.substring(body, 2, 1 << 30)).alias("export"))


def read_export(exports: DataFrame, chunk: str, statistics: str, config: str) -> DataFrame:
    """The chunks of exported documents as rows again, with the fields asked for (DDL) of each chunk, the statistics and the settings."""
    body = F.from_json("export", f"config struct<{config}>, statistics struct<{statistics}>, chunks array<struct<{chunk}>>")
    each = exports.select("doc_id", body.alias("x")).select("doc_id", "x.config", "x.statistics", F.explode("x.chunks").alias("c"))
    return each.select("doc_id", "c.*", "statistics.*", "config.*")


def save_text(spark: SparkSession, path: str, lines: Sequence[str]) -> None:
    """A small report, as text."""
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def report_lines(summary: DataFrame, best: DataFrame, most: int = 1000) -> list[str]:
    """A table of a sweep and the best setting of each metric; the tables have a row for each metric and setting, and ``most`` rows at most are taken."""
    rows = [tuple(r) for r in summary.limit(most).collect()]
    out = [" | ".join(summary.columns), *(" | ".join(str(x) for x in r) for r in rows), ""]
    return out + [f"best {r['metric']}: {r['alpha']} ({r['value']:.6f})" for r in best.limit(most).collect()]


def run_metadata(spark: SparkSession, results: DataFrame, seconds: float, device: str, settings: Sequence[float] = ()) -> DataFrame:
    """One row about a run; seconds a sample are over the rows there are."""
    n = results.agg(F.count("*").alias("num_samples"))
    return n.select("num_samples", F.lit(json.dumps(list(settings))).alias("alpha_values"), F.lit(device).alias("device"), F.lit(float(seconds)).alias("total_time_seconds"), F.try_divide(F.lit(float(seconds)), "num_samples").alias("time_per_sample_avg"))


class Checkpoints:
    """Results appended batch by batch, and what of a task list is still to do. A finished run's checkpoints go when its result is in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, results: DataFrame, batch: int) -> None:
        results.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(self.path)

    def done(self, schema: str) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch int").parquet(self.path).drop("batch")

    def finish(self, to: str, schema: str) -> None:
        self.done(schema).write.mode("overwrite").parquet(to)
        delete(self.spark, self.path)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()
