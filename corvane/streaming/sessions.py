"""Streams over the log: counters per session, the log itself, and writing with a bounded amount in flight."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def session_counts(log: DataFrame, session: str = "session_id", at: str = "created_at") -> DataFrame:
    """(session, query_count, first_query_at, last_query_at), for tables and streams alike."""
    return log.where(F.col(session).isNotNull()).groupBy(session).agg(F.count("*").alias("query_count"), F.min(at).alias("first_query_at"), F.max(at).alias("last_query_at"))


def windowed_counts(log: DataFrame, at: str = "created_at", late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Rows per window of event time; rows later than `late` are dropped from a stream. A time without zone is read as UTC."""
    timed = log.withColumn("_at", F.col(at).cast("timestamp"))
    if log.isStreaming:
        timed = timed.withWatermark("_at", late)
    out = timed.groupBy(F.window("_at", length).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the parquet files of a folder, or of one file; at most so many files are in flight."""
    fields = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(fields).option("maxFilesPerTrigger", files_per_batch)
    if spark._jvm.java.io.File(path).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_to_folder(df: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and read what it left in `folder`; nothing passes through the driver.

    In mode 'append' rows are added as they come; in mode 'complete' every batch replaces what the one before wrote.
    """
    if mode == "append":
        append_stream(df, folder, checkpoint).awaitTermination()
    else:
        each = lambda rows, _: rows.write.mode("overwrite").parquet(folder)
        df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def append_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet folder; with its checkpoint, each row is written once."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to `write`; the first error ends the stream and is raised where it is awaited."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
