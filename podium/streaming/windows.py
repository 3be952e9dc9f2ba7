"""Structured Streaming: event streams, windows with watermarks, sessions, duplicates; `voice` has voice activity."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.session import new_folder


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder; ts becomes a TIMESTAMP, as watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, by: list[str], size: str = "1 minute", late: str = "10 minutes", value: str = "value") -> DataFrame:
    """start, by, n, total of each window; late rows beyond the watermark are left out in a stream."""
    w = F.window("ts", size)
    return df.withWatermark("ts", late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, by: list[str], size: str, slide: str, late: str = "10 minutes") -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.window("ts", size, slide), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(df: DataFrame, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """by, start, end, n of runs of events less than the gap apart."""
    w = F.session_window("ts", gap)
    return df.withWatermark("ts", late).groupBy(w, *by).agg(F.count("*").alias("n")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_duplicates(df: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives its result, from Parquet in the shared folder, where its state is kept too.

    In complete mode the last batch's result counts; in append mode rows are added, each once.
    """
    spark = stream.sparkSession
    path, state = new_folder(spark, name), new_folder(spark, f"{name}-state")
    if mode == "append":
        to_parquet(stream, path, state)
        return spark.read.schema(stream.schema).parquet(path)
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        """A batch's result stands in a folder of its own; a batch that is tried again overwrites only what it wrote itself."""
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        last[:] = [number]

    with on_rocksdb(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch-{last[0]}") if last else spark.createDataFrame([], stream.schema)


@contextlib.contextmanager
def on_rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, as list states and timers need; the caller's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream to Parquet, each row once, over all that is there."""
    with on_rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
