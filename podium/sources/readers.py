"""Sources: image folders, catalogs, captions, web pages, metadata and notes as DataFrames with stated schemas."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions.scalars import as_column, catalog_id, frame_number, is_downloaded, iso_seconds, without_speaker, zero_as_null

VIDEOS = "idx INT, date STRING, provider STRING, video_id STRING, page_link STRING, download_link STRING, title STRING, description STRING, thumbnail_default STRING, thumbnail_medium STRING, thumbnail_high STRING, downloaded STRING"
SLIDES = "idx INT, presentation_title STRING, pdf_link STRING, course_title STRING, course_link STRING, downloaded STRING"
SUMMARY = "array<struct<ord:int,title:string,transcript:string,slide_content:array<string>,frame_number:int,figure_paths:array<string>>>"


def images(spark: SparkSession, folder: str, pattern: str = "*.jpg", suffix_done: str | None = None) -> DataFrame:
    """path, content, frame_number, class (the folder's name) of the images in a folder and its subfolders, less those of a suffix."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    rows = rows.select("path", "content", "length", frame_number("path").alias("frame_number"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class"))
    return rows.filter(~F.col("path").contains(suffix_done)) if suffix_done else rows


def binary_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, content: recordings, PDFs, videos."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def expanded(files: DataFrame, key: str, run: Callable[[bytes], list[dict]], schema: str, content: str = "content") -> DataFrame:
    """key and the rows that run gives for each file: a decoder of videos (frames), a renderer of PDFs (pages), a recogniser of text.

    run is injected, as no decoder is part of this library; it sees one file at a time and runs in the executors.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def work(parts):
        for part in parts:
            rows = [(k, r) for k, c in zip(part[key], part[content], strict=True) for r in run(bytes(c))]
            yield pd.DataFrame({key: pd.Series([k for k, _ in rows], dtype=part[key].dtype), **{n: [r[n] for _, r in rows] for n in names}})

    return files.select(key, content).mapInPandas(work, f"`{key}` {dict(files.dtypes)[key]}, {schema}")


def extracted_frames(videos: DataFrame, key: str, decode: Callable[[bytes, float], list[bytes]], every: float = 1.0) -> DataFrame:
    """key, frame_number, content: a frame each `every` seconds by the injected decoder, numbered by the second it stands for."""
    rows = expanded(videos, key, lambda c: [{"idx": i, "image": x} for i, x in enumerate(decode(c, every))], "idx int, image binary")
    return rows.select(key, F.floor(F.col("idx") * every).cast("int").alias("frame_number"), F.col("image").alias("content"))


def not_processed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The items that have no result yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def catalog(spark: SparkSession, path: str, schema: str = VIDEOS) -> DataFrame:
    """A catalog CSV: its index dropped, the flag as a boolean, 0 as null."""
    rows = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    texts = [c for c, t in rows.dtypes if t == "string" and c != "downloaded"]
    return rows.withColumns({c: zero_as_null(c) for c in texts}).withColumn("downloaded", is_downloaded("downloaded")).drop("idx")


def to_download(rows: DataFrame, provider: str | None = None) -> DataFrame:
    """Catalog rows that are still to be had, of one provider."""
    rows = rows.filter(~F.col("downloaded"))
    return rows.filter(F.col("provider") == provider) if provider else rows


# captions

_TIME = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"


def _seconds(stamp: Column) -> Column:
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(stamp, _TIME, i), F.lit("")).cast("double"), F.lit(0.0))
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / F.pow(F.lit(10.0), F.length(F.regexp_extract(stamp, _TIME, 4)))


def cues(files: DataFrame, key: str, body: str = "body", suffix: str = "suffix", remove_speakers: bool = False, place: str | None = None) -> DataFrame:
    """key, pos, start, end, word (a whole cue, line feeds as spaces) of SubRip, WebVTT and SBV captions; other suffixes give none.

    Rows are whole files or, with `place`, the blocks of files that format captions gives.
    """
    text = F.regexp_replace(F.col(body), "\r\n?", "\n")
    blocks = F.split(text, r"\n[ \t]*\n+")
    rows = files.filter(F.col(suffix).isin(".srt", ".vtt", ".sbv")).select(key, F.lit(0).alias("_p") if place is None else F.col(place).alias("_p"), F.posexplode(blocks).alias("_n", "_b"))
    line = rf"(?:{_TIME})[ \t]*(?:-->|,)[ \t]*(?:{_TIME})[^\n]*"
    rows = rows.filter(F.col("_b").rlike(line))
    stamp = F.regexp_extract("_b", line, 0)
    parts = F.split(stamp, r"[ \t]*-->[ \t]*|(?<=[.,]\d{1,3}),(?=\d)")
    said = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("_b", rf"(?s)^.*?{line}\n?", ""), "<[^>]*>", ""), "\n", " "))
    said = without_speaker(said) if remove_speakers else said
    rows = rows.select(key, "_p", "_n", _seconds(F.get(parts, F.lit(0))).alias("start"), _seconds(F.get(parts, F.lit(1))).alias("end"), said.alias("word"))
    from pyspark.sql import Window

    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_p", "_n")) - 1).alias("pos"), "start", "end", "word")


def transcript(cue_rows: DataFrame, key: str) -> DataFrame:
    """key, transcript: each cue's text with a space behind it."""
    return cue_rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: F.concat(x["word"], F.lit(" "))), "").alias("transcript"))


def caption_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, video_id, suffix, body of a folder of captions."""
    rows = spark.read.text(folder, wholetext=True).select("value", "_metadata.file_path")
    name = F.regexp_extract("file_path", r"([^/]*)$", 1)
    return rows.select(F.col("file_path").alias("path"), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1).alias("video_id"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("suffix"), F.col("value").alias("body"))


def custom_transcript(files: DataFrame, name: str) -> DataFrame:
    """The first file by path whose base name is `name`, whatever its suffix."""
    return files.filter(F.col("path").rlike(rf"/{name}\.[^/]*$")).orderBy("path").limit(1)


def chosen_track(tracks: DataFrame, by: str, lang: str = "en", kind: str = "standard") -> DataFrame:
    """by, track: the first caption track of that kind and language (columns kind, language, position, track)."""
    return tracks.filter((F.col("kind") == kind) & (F.col("language") == lang)).groupBy(by).agg(F.min_by("track", "position").alias("track"))


# pages and metadata


def page_title(html: Column | str) -> Column:
    """What stands in the first title element; null without one."""
    return F.nullif(F.regexp_extract(as_column(html), r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def pages_catalog(pages: DataFrame, html: str = "html", link: str = "url") -> DataFrame:
    """page_link, title, video_id of web pages that have a title."""
    rows = pages.select(F.col(link).alias("page_link"), page_title(html).alias("title")).filter("title IS NOT NULL")
    return rows.withColumn("video_id", catalog_id("title"))


METADATA = "struct<nextPageToken:string,items:array<struct<id:string,snippet:struct<publishedAt:string,title:string,description:string,channelId:string,thumbnails:map<string,struct<url:string>>>,contentDetails:struct<duration:string>>>>"


def metadata_rows(answers: DataFrame, json: str = "json") -> DataFrame:
    """video_id, date, title, description, thumbnail_default, seconds of the items of metadata answers."""
    rows = answers.select(F.explode(F.from_json(json, METADATA)["items"]).alias("i"))
    s = F.col("i.snippet")
    return rows.select(F.col("i.id").alias("video_id"), s["publishedAt"].alias("date"), s["title"].alias("title"), s["description"].alias("description"), F.try_element_at(s["thumbnails"], F.lit("default"))["url"].alias("thumbnail_default"), iso_seconds("i.contentDetails.duration").alias("seconds"))


def with_retries(fetch: Callable[[str], bytes], tries: int = 3) -> Callable[[str], bytes | None]:
    """fetch, tried again where it raises; None after the last try."""

    def get(link: str) -> bytes | None:
        for _ in range(tries):
            try:
                return fetch(link)
            except OSError:
                continue
        return None

    return get


def downloaded(items: DataFrame, key: str, link: str, fetch: Callable[[str], bytes], tries: int = 3) -> DataFrame:
    """key, content, failed: what the injected fetch gives for each link."""

    def work(parts):
        get = with_retries(fetch, tries)
        for part in parts:
            got = [get(x) for x in part[link]]
            yield pd.DataFrame({key: part[key], "content": got, "failed": [x is None for x in got]})

    return items.select(key, link).mapInPandas(work, f"`{key}` {dict(items.dtypes)[key]}, content binary, failed boolean")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Structured summaries from JSON files, a list of slides to a row."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", SUMMARY)).alias("s")).select("s.*")
