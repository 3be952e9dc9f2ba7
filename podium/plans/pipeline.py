"""The lecture pipeline: named stages over DataFrames, a configuration, results that can be resumed from stored stages."""

from __future__ import annotations

import dataclasses
import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import align, ordered, structure, text, vectors


#: What settings with few values may be.
CHOICES = {
    "cluster_method": ("segment", "kmeans", "normal"),
    "combination_algorithm": ("only_asr", "only_slides", "concat", "full_sents", "keyword_based"),
    "summarization_ext": ("none", "text_rank", "lex_rank", "lsa", "luhn", "edmundson", "random"),
    "structured_method": ("none", "extractive", "abstractive"),
}


@dataclasses.dataclass
class Config:
    """What a run may be told. Unknown keys raise."""

    frame_every: float = 1.0
    cluster_method: str = "segment"
    gamma: float = 1.08
    num_centroids: int = 20
    combination_algorithm: str = "keyword_based"
    summarization_mods: tuple[str, ...] = ("none",)
    summarization_ext: str = "none"
    summarization_abs: str = "none"
    structured_method: str = "none"
    coverage: float = 0.70
    skip_to: int = 0

    @classmethod
    def of(cls, source: str | Path | dict | object | None = None, **more) -> Config:
        """From a path of JSON, a dict or an object with attributes; keyword arguments win."""
        if source is None:
            values = {}
        elif isinstance(source, dict):
            values = dict(source)
        elif isinstance(source, str | Path):
            values = json.loads(Path(source).read_text())
        else:
            values = dict(vars(source))
        out = cls(**(values | more))
        out.check()
        return out

    def check(self) -> None:
        for name, values in CHOICES.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {', '.join(values)}")
        if unknown := set(self.summarization_mods) - {"none", "full_sents"}:
            raise ValueError(f"unknown summarization_mods: {', '.join(sorted(unknown))}")
        if not 0 < self.coverage <= 1 or self.num_centroids < 1 or self.frame_every <= 0 or self.skip_to < 0:
            raise ValueError("coverage lies above 0 up to 1; num_centroids and frame_every are positive; skip_to is not negative")


def timed(f: Callable):
    """f with (what it gives, seconds) as its result."""

    def run(*args, **named):
        began = time.perf_counter()
        return f(*args, **named), time.perf_counter() - began

    return run


class Pipeline:
    """Runs named stages in order. A stage is a function of (results so far, config) that gives a DataFrame, kept under its name.

    With a store, each result is written there as Parquet and read back, and a run that begins at a later stage reads the earlier ones.
    """

    def __init__(self, spark: SparkSession, stages: list[tuple[str, Callable[[dict, Config], DataFrame]]], config: Config, store: str | None = None):
        self.spark, self.stages, self.config, self.store = spark, stages, config, store
        self.results: dict[str, DataFrame] = {}
        self.seconds: dict[str, float] = {}

    def run_all(self) -> dict[str, DataFrame]:
        for number, (name, stage) in enumerate(self.stages, 1):
            if number < self.config.skip_to:
                if not self.store:
                    raise ValueError("skip_to needs a store")
                self.results[name] = self.spark.read.parquet(f"{self.store}/{name}")
                continue
            self.results[name], self.seconds[name] = timed(self._run)(name, stage)
        return self.results

    def _run(self, name: str, stage: Callable) -> DataFrame:
        out = stage(self.results, self.config)
        if self.store:
            out.write.mode("overwrite").parquet(f"{self.store}/{name}")
            out = self.spark.read.parquet(f"{self.store}/{name}")
        return out


def lecture_stages(frames: DataFrame, words: DataFrame, ocr: DataFrame, figures: DataFrame | None = None, by: str = "lecture_id", models: dict[str, Callable] | None = None) -> list[tuple[str, Callable[[dict, Config], DataFrame]]]:
    """Stages for classified frames (lecture, frame_number, class, hash, features), recognised words of slides, transcripts and figures.

    models: functions of a column by name (summary, tagger), the places of learned models.
    """
    models = models or {}

    def slides(_: dict, __: Config) -> DataFrame:
        return frames.filter(F.col("class") == "slide")

    def unique(done: dict, _: Config) -> DataFrame:
        return ordered.keep_last(done["slides"], [by, "hash"], ["frame_number"])

    def clustered(done: dict, c: Config) -> DataFrame:
        options = {"segment": {"gamma": c.gamma, "include_tail": True}, "kmeans": {"num_centroids": c.num_centroids}, "normal": {}}[c.cluster_method]
        if c.cluster_method == "segment":
            return ordered.segment_clusters(done["unique"], "frame_number", "features", by=[by], **options)
        found = vectors.cluster_slides(done["unique"], c.cluster_method, "frame_number", "features", by, **options)
        rows = done["unique"].join(found, [by, "frame_number"])
        best = rows.groupBy(by, "cluster_id").agg(F.max("frame_number").alias("_best"))
        return rows.join(best, [by, "cluster_id"]).withColumn("is_best", F.col("frame_number") == F.col("_best")).drop("_best")

    def best(done: dict, _: Config) -> DataFrame:
        return done["clusters"].filter("is_best").select(by, "frame_number")

    def lines(done: dict, _: Config) -> DataFrame:
        return structure.analyse(ocr.join(done["best"], [by, "frame_number"], "left_semi"), [by, "frame_number"])

    def transcript(_: dict, __: Config) -> DataFrame:
        return words

    def summary(done: dict, c: Config) -> DataFrame:
        made = models.get("summary") if c.structured_method != "none" else None
        return align.structured_summary(done["best"], done["lines"], done["words"], figures, [by], every=c.frame_every, summarise=made)

    def notes(done: dict, c: Config) -> DataFrame:
        raw = structure.raw_text(done["lines"], [by, "frame_number"])
        said = done["words"].groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"))
        seen = raw.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame_number", "raw"))), lambda x: x["raw"]), " ").alias("text"))
        out = text.combine(seen, said, "text", [by], c.combination_algorithm).withColumnRenamed("combined", "text")
        if "full_sents" in c.summarization_mods:
            whole = text.complete_sentences(out, "text", [by], models.get("tagger"))
            out = whole.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
        if c.summarization_ext != "none":
            from podium.operators.summarise import extractive

            kept = extractive(out, "text", by, c.summarization_ext, c.coverage)
            out = kept.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
        if c.summarization_abs != "none":
            out = out.withColumn("text", models["summary"](F.col("text")))
        return out

    return [("slides", slides), ("unique", unique), ("clusters", clustered), ("best", best), ("lines", lines), ("words", transcript), ("summary", summary), ("notes", notes)]
