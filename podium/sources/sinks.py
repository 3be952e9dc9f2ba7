"""Sinks: images, clusters, texts, JSON, catalogs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.operators.speech import write_wave


def derived_name(path: str, suffix: str):
    """A column: the path with the suffix before its extension, as in frame_5_noborder.jpg."""
    return F.concat(F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.lit(suffix), F.regexp_extract(path, r"(\.[^./]*)$", 1))


def write_images(df: DataFrame, out: str, path: str = "path", suffix: str = "") -> None:
    """Images as Parquet rows of path and content."""
    df.withColumn(path, derived_name(path, suffix)).write.mode("overwrite").parquet(out)


def write_clusters(df: DataFrame, out: str, cluster: str = "cluster_id") -> None:
    """A folder for each cluster; rows of a cluster are brought together first, so it has few files."""
    df.repartition(cluster).write.mode("overwrite").partitionBy(cluster).parquet(out)


def write_lines(df: DataFrame, out: str, text: str, append: bool = False) -> None:
    """A line for each row, as in the text of all slides."""
    df.select(F.col(text).cast("string").alias("value")).write.mode("append" if append else "overwrite").text(out)


def write_json(df: DataFrame, out: str) -> None:
    """An object for each row."""
    df.write.mode("overwrite").json(out)


def write_transcript(words: DataFrame, out: str, by: list[str], text: str = "transcript") -> None:
    """Texts and, where there are words, their JSON."""
    words.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias(text)).write.mode("overwrite").json(f"{out}/text")
    words.write.mode("overwrite").json(f"{out}/words")


def write_recordings(df: DataFrame, out: str, name: str, samples: str, rate: int) -> None:
    """A WAV file, name.wav, of each row's samples (16-bit integers, one channel)."""

    def work(parts):
        for part in parts:
            yield pd.DataFrame({"name": part["name"], "content": [write_wave(x, rate) for x in part["samples"]]})

    rows = df.select(F.concat(F.col(name).cast("string"), F.lit(".wav")).alias("name"), F.col(samples).cast("array<int>").alias("samples"))
    rows.mapInPandas(work, "name string, content binary").write.format("whole_files").mode("append").save(out)


def upserted(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table with changed rows in place of those of the same key, and new rows."""
    return table.join(changes.select(*key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def write_catalog(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(out)


def all_of(*tables: DataFrame) -> DataFrame:
    """Tables one below the other, columns by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
