"""Sessions with the settings that the engine is written for."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "podium", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session: UTC, Arrow, adaptive plans; master and partitions only where no cluster sets them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master).config("spark.driver.memory", "6g").config("spark.driver.host", "127.0.0.1")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Only a local session may do without that setting: it
    gets a folder of this machine, which goes with it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("podium.local.folder", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="podium-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shared = f"file://{folder}"
        spark.conf.set("podium.local.folder", shared)
    return f"{shared}/podium-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: what several plans read is computed once, and its lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
