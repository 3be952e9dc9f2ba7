"""Pieces that the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that goes to a Python worker: it ends with whichever is reached first.
ROWS_PER_BATCH, BYTES_PER_BATCH = 2500, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Only where it is unset in a local session, as in tests, a folder of this machine is made and kept in the setting. On a cluster each
    executor would write to its own disk, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("podium.local.shared.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="podium-shared-")
            atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
            spark.conf.set("podium.local.shared.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/podium-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*written: DataFrame) -> None:
    """Deletes what `materialise` wrote for these frames: nothing that is still to run may rest on them."""
    for df in written:
        delete(df.sparkSession, _WRITTEN.pop(df))


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds, for the session, the batches in which whole texts go to Python workers: each is held by the JVM and by the worker at once.

    Plans read the setting when they run, after this returns, so it stays; lower ones of the caller are left as they are.
    """
    for key, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text with null as empty, and further columns by name; other columns are pruned."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
