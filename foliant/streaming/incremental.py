"""The row-wise part of the pipeline as a stream: clean, split, count, chunk; and a sink that skips what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions import tokens as K
from ..operators import chunking
from ..operators.matching import not_done

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents(spark: SparkSession, folder: str, pattern: str = "documents.parquet", files_each: int = 16) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_each).parquet(folder)


def flat_chunk_stream(docs: DataFrame, size: int = 1024, overlap: int = 128) -> DataFrame:
    """Flat windows need no state, so the batch operator serves as it is."""
    return chunking.flat_chunks(docs, size, overlap)


def tokens_by_source(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(K.token_count(F.col("text"))).alias("n_tokens"))


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window, for rows that come at most ``late`` after their time."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count("*").alias("n"))


def append_new(path: str, cfg: ChunkConfig | None = None, key: str = "doc_id"):
    """For ``foreachBatch``: greedy chunks of the documents that ``path`` doesn't have yet, a batch's rows in a folder of its own, so a replayed batch replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
        fresh = batch
        if there:
            done = spark.read.parquet(path)
            fresh = not_done(batch, done.where(F.col("batch") != number) if "batch" in done.columns else done, key)
        chunking.greedy_chunks(fresh.dropDuplicates([key]), cfg).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run
