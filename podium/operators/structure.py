"""Slide structure from recognised words: lines, their category by stroke and height, the title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_words(words: DataFrame) -> DataFrame:
    """Words without nulls, of a size, with a text that isn't blank."""
    return words.dropna().filter("width > 0 AND height > 0").filter(F.trim("text") != "")


def with_line(words: DataFrame, by: list[str], order: str = "word_ord", first: str = "word_num") -> DataFrame:
    """words with line: a new one at each word that is the first of its line."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return words.withColumn("line", F.sum((F.col(first) == 1).cast("long")).over(w))


def line_table(words: DataFrame, by: list[str], order: str = "word_ord", numbers: tuple[str, ...] = ("block_num", "par_num", "line_num", "height", "stroke_width")) -> DataFrame:
    """by, line, text (in order, with spaces) and the means of the numbers of each line."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")
    return words.groupBy(*by, "line").agg(text.alias("text"), *(F.avg(c).alias(c) for c in numbers))


def line_category(stroke: Column, height: Column, mean_stroke: Column, mean_height: Column, gamma: float = 0.1, beta: float = 0.2) -> Column:
    """1: bold (either clearly above the mean), -1: footer (both clearly below), else 0."""
    bold = (stroke > (1 + gamma) * mean_stroke) | (height > (1 + beta) * mean_height)
    small = (stroke < (1 - gamma) * mean_stroke) & (height < (1 - beta) * mean_height)
    return F.when(bold, 1).when(small, -1).otherwise(0)


def title_words(words: DataFrame, by: list[str], left_limit: float = 0.77, least_chars: int = 3) -> DataFrame:
    """by, title, is_title: the words of block 1 and paragraph 1, and whether they are a title.

    They are if all hold: in the upper third; begins left of `left_limit` of the width; more characters than least_chars; stroke above
    mean + deviation; height above the mean. The last two are left out where the slide has one block and one paragraph only.
    """
    every = words.groupBy(*by).agg(
        F.avg("stroke_width").alias("_ms"), F.stddev_samp("stroke_width").alias("_ss"), F.avg("height").alias("_mh"),
        F.max("block_num").alias("_blocks"), F.max("par_num").alias("_pars"), F.max("image_height").alias("_ih"), F.max("image_width").alias("_iw"),
    )
    head = words.filter("block_num = 1 AND par_num = 1")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_ord", "text"))), lambda x: x["text"]), " ")
    head = head.groupBy(*by).agg(text.alias("title"), F.avg("top").alias("_top"), F.min("left").alias("_left"), F.avg("stroke_width").alias("_stroke"), F.avg("height").alias("_height"))
    both = head.join(every, by)
    alone = (F.col("_blocks") == 1) & (F.col("_pars") == 1)
    fine = (F.col("_top") < F.col("_ih") / 3) & (F.col("_left") < F.col("_iw") * left_limit) & (F.length("title") > least_chars)
    strong = F.coalesce((F.col("_stroke") > F.col("_ms") + F.col("_ss")) & (F.col("_height") > F.col("_mh")), F.lit(False))
    return both.select(*by, "title", (fine & (alone | strong)).alias("is_title"))


def analyse(words: DataFrame, by: list[str], gamma: float = 0.1, beta: float = 0.2) -> DataFrame:
    """by, line, text, category (2 title, 1 bold, 0 body, -1 footer), block_num, par_num, line_num: means are over words, lines are compared."""
    clean = with_line(usable_words(words), by)
    lines = line_table(clean, by)
    means = clean.groupBy(*by).agg(F.avg("stroke_width").alias("_ms"), F.avg("height").alias("_mh"))
    titles = title_words(clean, by).filter("is_title").select(*by, F.lit(True).alias("_title"))
    both = lines.join(means, by).join(titles, by, "left")
    in_title = F.coalesce("_title", F.lit(False)) & (F.col("block_num") == 1) & (F.col("par_num") == 1)
    category = F.when(in_title, 2).otherwise(line_category(F.col("stroke_width"), F.col("height"), F.col("_ms"), F.col("_mh"), gamma, beta))
    return both.select(*by, "line", "text", category.alias("category"), *(F.col(c).cast("int").alias(c) for c in ("block_num", "par_num", "line_num")))


def raw_text(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, raw: the slide's text without footers, lines joined by spaces."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    return lines.filter("category <> -1").groupBy(*by).agg(text.alias("raw"))


def to_json(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, json: each slide's lines as one object of columns, as line -> value."""
    w = F.sort_array(F.collect_list(F.struct("line", "text", "category", "block_num", "par_num", "line_num")))
    column = lambda c: F.map_from_entries(F.transform("_l", lambda x: F.struct(x["line"].cast("string").alias("k"), x[c].alias("v")))).alias(c)
    rows = lines.groupBy(*by).agg(w.alias("_l"))
    return rows.select(*by, F.to_json(F.struct(*(column(c) for c in ("text", "category", "block_num", "par_num", "line_num")))).alias("json"))


def from_json(df: DataFrame, json: str, by: list[str]) -> DataFrame:
    """The lines of such objects again; unknown fields are ignored, missing ones null."""
    kinds = {"text": "string", "category": "int", "block_num": "int", "par_num": "int", "line_num": "int"}
    schema = ", ".join(f"{k} map<string, {v}>" for k, v in kinds.items())
    rows = df.select(*by, F.from_json(json, schema).alias("o")).select(*by, "o", F.explode(F.map_keys("o.text")).alias("line"))
    return rows.select(*by, F.col("line").cast("long").alias("line"), *(F.try_element_at(f"o.{k}", F.col("line")).alias(k) for k in kinds))
