"""Slides and speech: the alignment of two time lines at sentence ends, and the structured summary that is built on it.

A slide takes the words up to and including the first sentence end whose time has reached its own; each boundary must move on. With
sentence ends numbered and b the number of the first end at a slide's time, slide i ends at i + max(b_k - k, k <= i): one
running maximum instead of a loop over words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.operators.ordered import carried, default_titles, islands


def is_terminator(word: Column | str) -> Column:
    """Whether a word ends a sentence."""
    w = F.trim(F.col(word) if isinstance(word, str) else word)
    return F.coalesce(w.endswith(".") | w.endswith("!") | w.endswith("?"), F.lit(False))


def timed(words: DataFrame, by: list[str], pos: str, start: str, end: Column) -> DataFrame:
    """words with current_time, is_end and sentence: how many sentences end before the word (its sentence's number from 0)."""
    rows = carried(words, start, pos, by).withColumn("is_end", end)
    before = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("sentence", F.coalesce(F.sum(F.col("is_end").cast("long")).over(before), F.lit(0)))


def boundaries(slides: DataFrame, words: DataFrame, by: list[str], order: str, time: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """by, order and keep of the slides with idx (from 1), reach (the number of the sentence end where the slide ends) and n_ends (sentence ends of the part).

    words: what timed() gives. Instead of pairing slides with sentence ends, both are put on one line in time,
    and each slide counts the ends before it.
    """
    ends = words.filter("is_end").select(*by, F.col("current_time").alias("_time"), F.lit(None).cast("long").alias("_order"), F.lit(1).alias("_kind"))
    marks = slides.select(*by, F.col(time).cast("double").alias("_time"), F.col(order).cast("long").alias("_order"), F.lit(0).alias("_kind"), *keep)
    line = Window.partitionBy(*by).orderBy("_time", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    both = ends.unionByName(marks, allowMissingColumns=True).withColumn("_before", F.sum("_kind").over(line)).withColumn("n_ends", F.sum("_kind").over(whole)).filter("_kind = 0")
    idx = F.row_number().over(Window.partitionBy(*by).orderBy("_order"))
    both = both.withColumn("idx", idx.cast("long")).withColumn("_b", F.col("_before") + 1)
    upto = Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("reach", F.col("idx") + F.max(F.col("_b") - F.col("idx")).over(upto)).select(*by, F.col("_order").alias(order), *keep, "idx", "reach", "n_ends")


def slide_of_words(words: DataFrame, bounds: DataFrame, by: list[str], pos: str) -> DataFrame:
    """words with idx: the slide that takes the word; one more than the last slide for the conclusion.

    The word's slide is the first that reaches its sentence: both again stand on one line, by sentence number.
    """
    marks = bounds.select(*by, F.col("reach").alias("_at"), F.col("idx").alias("_idx"))
    last = bounds.groupBy(*by).agg(F.max("idx").alias("_last"))
    rows = words.select("*", (F.col("sentence") + 1).alias("_at"), F.lit(None).cast("long").alias("_idx")).unionByName(marks, allowMissingColumns=True)
    # slides stand behind the words of the sentence that they reach
    line = Window.partitionBy(*by).orderBy("_at", F.col("_idx").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    found = rows.withColumn("_first", F.first("_idx", True).over(line)).filter(F.col("_idx").isNull())
    return found.join(last, by, "left").withColumn("idx", F.coalesce("_first", F.col("_last") + 1, F.lit(1))).drop("_at", "_idx", "_first", "_last")


def joined(words: DataFrame, by: list[str], pos: str, word: str, name: str = "transcript") -> DataFrame:
    """Each slide's words in order, with a space between two words unless the second is a full stop."""
    nxt = F.lead(word).over(Window.partitionBy(*by, "idx").orderBy(pos))
    spaced = words.withColumn("_w", F.concat(F.col(word), F.when(nxt.isNull() | (nxt == "."), "").otherwise(" ")))
    return spaced.groupBy(*by, "idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, "_w"))), lambda x: x["_w"]), "").alias(name))


def align(slides: DataFrame, words: DataFrame, by: list[str], order: str = "frame_number", pos: str = "pos", start: str = "start", word: str = "word", every: float = 1.0, first_slide: bool = True, time: str | None = None) -> DataFrame:
    """by, ord, frame_number, kind (preface, slide or conclusion), transcript of each part.

    Slides stand by `order`; each frame is `every` long, or `time` names the column of the slides' times. Slides of one number are one after the other.

    A preface stands first where the first slide's frame isn't 0; a slide without words has an empty transcript; a conclusion (maybe
    empty) stands last unless the words ran out before.
    """
    rows = timed(words, by, pos, start, is_terminator(word))
    at = F.col(time).cast("double") if time else F.col(order).cast("long") * F.lit(float(every))
    marks = slides.select(*by, F.col(order).cast("long").alias("frame_number"), at.alias("_time"), F.lit("slide").alias("kind"), F.lit(1).alias("_second"))
    if first_slide:
        ahead = marks.groupBy(*by).agg(F.min("frame_number").alias("frame_number"), F.min_by("_time", "frame_number").alias("_time")).filter("frame_number <> 0")
        marks = marks.unionByName(ahead.select(*by, "frame_number", "_time", F.lit("preface").alias("kind"), F.lit(0).alias("_second")))
    marks = marks.withColumn("_key", F.col("frame_number") * 2 + F.col("_second"))
    found = boundaries(marks, rows, by, "_key", "_time", ("frame_number", "kind"))
    text = joined(slide_of_words(rows, found, by, pos), by, pos, word)
    full = rows.groupBy(*by).agg(F.count("*").alias("_words"))
    ends = found.groupBy(*by).agg(F.max("idx").alias("_last"), F.max("reach").alias("_reach"), F.max("n_ends").alias("_ends"))
    # words ran out where the last slide's sentence end doesn't exist
    rest = ends.join(full, by).filter("_reach <= _ends").select(*by, (F.col("_last") + 1).alias("idx"), F.lit(None).cast("long").alias("frame_number"), F.lit("conclusion").alias("kind"))
    parts = found.select(*by, "idx", "frame_number", "kind").unionByName(rest)
    return parts.join(text, [*by, "idx"], "left").select(*by, F.col("idx").alias("ord"), "frame_number", "kind", F.coalesce("transcript", F.lit("")).alias("transcript"))


# slide content


def paragraphs(lines: DataFrame, by: list[str], line: str = "line_num", text: str = "text", category: str = "category", least: int = 3) -> DataFrame:
    """by, paragraph, content: body lines (category 0 or 1) in runs of consecutive numbers, bold lines (1) marked, longer than `least`.

    Neighbouring bold lines of a paragraph share one pair of marks.
    """
    body = lines.filter(F.col(category).isin(0, 1))
    w = Window.partitionBy(*by).orderBy(line)
    new = F.coalesce((F.col(line) != F.lag(line).over(w) + 1).cast("long"), F.lit(1))
    body = body.withColumn("paragraph", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = islands(body, category, line, [*by, "paragraph"], "_run")
    runs = body.groupBy(*by, "paragraph", "_run", category).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(line, text))), lambda x: x[text]), " ").alias("_t"))
    runs = runs.withColumn("_t", F.when(F.col(category) == 1, F.concat(F.lit("**"), F.col("_t"), F.lit("**"))).otherwise(F.col("_t")))
    out = runs.groupBy(*by, "paragraph").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_run", "_t"))), lambda x: x["_t"]), " ").alias("content"))
    return out.filter(F.length("content") > least)


def structured_summary(slides: DataFrame, lines: DataFrame, words: DataFrame, figures: DataFrame | None, by: list[str], every: float = 1.0, summarise=None, longer_than: int = 50) -> DataFrame:
    """by, ord, title, transcript, slide_content, frame_number, figure_paths: the summary of each lecture, slide by slide.

    Titles are the lines of category 2; transcripts of more than `longer_than` words go through summarise (a function of a column).
    """
    slide = [*by, "frame_number"]
    parts = align(slides, words, by, every=every)
    titles = lines.filter("category = 2").groupBy(*slide).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_num", "text"))), lambda x: x["text"]), " ").alias("title"))
    body = paragraphs(lines, slide).groupBy(*slide).agg(F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "content"))), lambda x: x["content"]).alias("slide_content"))
    out = parts.filter("kind = 'slide'").join(titles, slide, "left").join(body, slide, "left")
    w = Window.partitionBy(*by).orderBy("ord")
    out = default_titles(out.withColumn("_n", F.row_number().over(w)), "title", "_n", by).drop("title", "_n").withColumnRenamed("unique_title", "title")
    others = parts.filter("kind <> 'slide'").withColumn("title", F.initcap("kind"))
    out = out.unionByName(others, allowMissingColumns=True)
    if figures is not None:
        out = out.join(attach(figures, slide), slide, "left")
    else:
        out = out.withColumn("figure_paths", F.lit(None).cast("array<string>"))
    if summarise is not None:
        long = F.size(F.split(F.trim("transcript"), r"\s+")) > longer_than
        out = out.withColumn("transcript", F.when(long, summarise(F.col("transcript"))).otherwise(F.col("transcript")))
    return out.select(*by, "ord", "title", "transcript", "slide_content", "frame_number", "figure_paths")


def attach(figures: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """by, figure_paths: the sorted figure files of each frame."""
    return figures.groupBy(*by).agg(F.sort_array(F.collect_list(path)).alias("figure_paths"))


def to_json(summary: DataFrame, by: list[str]) -> DataFrame:
    """by, json: each lecture's summary as a JSON list in order."""
    fields = [c for c in summary.columns if c not in by]
    return summary.groupBy(*by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*(["ord"] + [c for c in fields if c != "ord"]))))).alias("json"))
