"""Frames that show a slide on a screen beside the slide itself: matching across switches of class, in runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.operators.ordered import islands


def run_table(frames: DataFrame, by: list[str], order: str, kind: str = "class") -> DataFrame:
    """by, run_id, kind, first, last and the neighbours' (prev_ and next_) of runs of equal class in frame order."""
    runs = islands(frames, kind, order, by).groupBy(*by, "run_id", kind).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    w = Window.partitionBy(*by).orderBy("run_id")
    near = {f"{n}_{c}": f(c).over(w) for n, f in (("prev", F.lag), ("next", F.lead)) for c in (kind, "first", "last")}
    return runs.withColumns(near)


def candidate_pairs(frames: DataFrame, by: list[str], order: str, kind: str = "class", slide: str = "slide", screen: str = "presenter_slide") -> DataFrame:
    """by, run_id, query (the slide that stands beside the run: the last before it, or the first after it), frame, step: each frame of
    a screen's run in the order in which it is tried, from the switch on."""
    runs = run_table(frames, by, order, kind).filter(F.col(kind) == screen)
    before = F.col(f"prev_{kind}") == slide
    runs = runs.filter(before | (F.col(f"next_{kind}") == slide)).withColumn("query", F.when(before, F.col("prev_last")).otherwise(F.col("next_first"))).withColumn("_before", F.coalesce(before, F.lit(False)))
    own = islands(frames, kind, order, by).select(*by, "run_id", F.col(order).alias("frame"))
    both = runs.join(own, [*by, "run_id"])
    w = Window.partitionBy(*by, "run_id").orderBy(F.when(F.col("_before"), F.col("frame")).otherwise(-F.col("frame")))
    return both.withColumn("step", F.row_number().over(w)).select(*by, "run_id", "query", "frame", "step")


def matched_until(pairs: DataFrame, by: list[str], matches: Column) -> DataFrame:
    """The pairs before the first of their run that doesn't match: from there on the screen shows something else."""
    cut = F.min(F.when(~matches, F.col("step"))).over(Window.partitionBy(*by, "run_id"))
    return pairs.withColumn("_cut", cut).filter(F.col("_cut").isNull() | (F.col("step") < F.col("_cut"))).drop("_cut")


def enough_matches(n_good: Column, area: Column, least: int = 33, share: float = 0.37) -> Column:
    """Whether a pair shows the same slide: more good matches than `least`, and a matched region of that share of the frame."""
    return (n_good > least) & (area >= share)


def unique_screens(frames: DataFrame, by: list[str], order: str, matches: Callable[[DataFrame], Column], kind: str = "class", screen: str = "presenter_slide") -> DataFrame:
    """Frames less those of a screen that repeat the slide beside their run. matches: a verdict on pairs (query, frame)."""
    pairs = candidate_pairs(frames, by, order, kind, screen=screen)
    gone = matched_until(pairs, by, matches(pairs)).select(*by, F.col("frame").alias(order)).distinct()
    return frames.join(gone, [*by, order], "left_anti")


def fullest_of_runs(pairs: DataFrame, by: list[str], added: str) -> DataFrame:
    """by, run_id, query, best: the frame that adds most to the slide, if any adds something; it takes the slide's place."""
    best = F.max(F.when(F.col(added) > 0, F.struct(F.col(added), (-F.col("step")).alias("s"), F.col("frame"))))
    return pairs.groupBy(*by, "run_id", "query").agg(best["frame"].alias("best"))
