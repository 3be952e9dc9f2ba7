"""Queries on sources: pages, identifiers, captions, metadata, catalogs."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from podium.catalog.registry import Registry, rounded, table
from podium.functions import scalars as S
from podium.functions import tables
from podium.session import new_folder
from podium.sources import formats, readers, sinks
from podium.streaming import windows

_R = Registry()


@_R.add("html_title_catalog", "SELECT url AS page_link, t AS title, substr(sha1(t), 1, 11) AS video_id FROM (SELECT url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages) WHERE t <> ''")
def html_title_catalog(spark, sf_dir):
    return readers.pages_catalog(table(spark, sf_dir, "pages"))


@_R.add("video_id_hash", "SELECT doc_id, substr(sha1(text), 1, 11) AS catalog_id FROM documents")
def video_id_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.catalog_id("text").alias("catalog_id"))


@_R.add("speaker_strip", "SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 2 = 0 THEN role || ': ' || text ELSE text END, '(?s)^.*?: ', '') AS said FROM conversations")
def speaker_strip(spark, sf_dir):
    line = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit(": "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.without_speaker(line).alias("said"))


_LINE = "regexp_replace(text, '[\\n\\r:]+', ' ', 'g')"


_CUES = f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, round(turn * 4.0, 3)::DOUBLE AS start, round(turn * 4 + 3.5, 3)::DOUBLE AS \"end\", trim({_LINE}) AS word FROM conversations"


def _caption_files(spark, sf_dir):
    """conv_id, body: captions made of the turns."""
    turns = table(spark, sf_dir, "conversations")
    clock = lambda s: F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600).cast("int"), F.floor(s / 60 % 60).cast("int"), F.floor(s % 60).cast("int"), F.round(s * 1000 % 1000).cast("int"))
    t = F.col("turn") * 4.0
    cue = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), clock(t), F.lit(" --> "), clock(t + 3.5), F.lit("\n"), F.trim(F.regexp_replace("text", "[\n\r:]+", " ")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n\n").alias("body"))


@_R.add("caption_cues", _CUES)
def caption_cues(spark, sf_dir):
    """Captions written from the turns and read back."""
    files = _caption_files(spark, sf_dir).withColumn("suffix", F.lit(".srt"))
    return rounded(readers.cues(files, "conv_id"), "start", "end", digits=3)


def _written_captions(spark, sf_dir):
    """A folder with a caption file for each conversation."""
    formats.register(spark)
    folder = new_folder(spark, "captions")
    files = _caption_files(spark, sf_dir).select(F.concat("conv_id", F.lit(".srt")).alias("name"), F.col("body").alias("content"))
    files.write.format("whole_files").mode("append").save(folder)
    return folder


def _read_cues(blocks):
    return rounded(readers.cues(blocks, "video_id", place="place"), "start", "end", digits=3).withColumn("video_id", F.col("video_id").cast("long")).withColumnRenamed("video_id", "conv_id")


@_R.add("caption_source", _CUES)
def caption_source(spark, sf_dir):
    """The same through files of their own, read in ranges of 2 kB by the data source."""
    return _read_cues(spark.read.format("captions").option("split", 2048).load(_written_captions(spark, sf_dir)))


@_R.add("caption_source_by_key", f"SELECT * FROM ({_CUES}) WHERE conv_id IN (SELECT max(conv_id) FROM conversations UNION ALL SELECT min(conv_id) FROM conversations)")
def caption_source_by_key(spark, sf_dir):
    """Two conversations' captions: the data source opens their files only."""
    ends = table(spark, sf_dir, "conversations").agg(F.max("conv_id").cast("string"), F.min("conv_id").cast("string")).first()
    return _read_cues(spark.read.format("captions").option("keys", json.dumps(ends)).load(_written_captions(spark, sf_dir)))


@_R.add("caption_stream", _CUES)
def caption_stream(spark, sf_dir):
    """The same as a stream of new files."""
    return _read_cues(windows.run_to_end(spark.readStream.format("captions").load(_written_captions(spark, sf_dir)), "captions"))


@_R.add("wav_source", """WITH r AS (SELECT user_id, floor(value)::BIGINT % 20000 AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, i // 30 AS frame_idx, round(i // 30 * 0.03, 6)::DOUBLE AS ts, sum(x)::BIGINT AS total FROM r WHERE i // 30 < ceil(n / 30.0) - 1 GROUP BY ALL""")
def wav_source(spark, sf_dir):
    """Recordings of 1 kHz, a sample an event, written as WAV files and read as frames of 30 ms, in ranges of 64 bytes."""
    formats.register(spark)
    folder = new_folder(spark, "recordings")
    value = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: (F.floor(x["value"]) % 20000).cast("int"))
    sinks.write_recordings(table(spark, sf_dir, "events").groupBy("user_id").agg(value.alias("samples")), folder, "user_id", "samples", 1000)

    @F.pandas_udf("long")
    def total(pcm: pd.Series) -> pd.Series:
        return pcm.map(lambda x: int(np.frombuffer(x, "<i2").sum(dtype=np.int64)))

    rows = spark.read.format("wav_frames").option("split", 64).load(folder)
    return rounded(rows.select(F.col("recording").cast("long").alias("user_id"), "frame_idx", "ts", total("pcm").alias("total")), "ts")


@_R.add("frame_times_lateral", """WITH s AS (SELECT doc_id, n_chars::DOUBLE AS s, greatest(1, floor(n_chars / (CASE WHEN n_chars < 1200 THEN 100.0 WHEN n_chars > 4800 THEN 300.0 ELSE 200.0 END) + 0.5)::BIGINT) AS step FROM documents WHERE n_chars > 0)
SELECT doc_id, (i * step)::INT AS frame_number, (i * step)::DOUBLE AS ts, 'img_' || (i * step) || '.jpg' AS name FROM (SELECT *, unnest(range(0, ceil(s / step)::BIGINT)) AS i FROM s)""")
def frame_times_lateral(spark, sf_dir):
    """Frames of videos as long as the documents, in seconds, by a table function in a lateral join."""
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, f.* FROM {docs} d, LATERAL frame_times(CAST(d.n_chars AS DOUBLE), prefix => 'img_') f", docs=table(spark, sf_dir, "documents"))


@_R.add("metadata_flatten", "SELECT 'v' || p_partkey AS video_id, p_name AS title, (p_size * 60 + p_partkey % 60)::BIGINT AS seconds FROM part")
def metadata_flatten(spark, sf_dir):
    """Metadata answers of one item each, made from the parts and taken apart."""
    item = F.struct(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("id"), F.struct(F.lit("2020-01-01T00:00:00Z").alias("publishedAt"), F.col("p_name").alias("title")).alias("snippet"), F.struct(F.format_string("PT%dM%dS", F.col("p_size"), (F.col("p_partkey") % 60).cast("int")).alias("duration")).alias("contentDetails"))
    answers = table(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("json"))
    return readers.metadata_rows(answers).select("video_id", "title", "seconds")


@_R.add("minimum_duration", "SELECT p_partkey FROM part WHERE floor((p_size * 60 + p_partkey % 60) / 60) > 20")
def minimum_duration(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(S.longer_than(F.col("p_size") * 60 + F.col("p_partkey") % 60, 20)).select("p_partkey")


@_R.add("clock_seconds", "SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS seconds FROM events")
def clock_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.clock_seconds(F.date_format("ts", "HH:mm:ss.SSS")).alias("seconds"))


@_R.add("frame_numbers", "SELECT p_partkey, p_partkey::INT AS frame, CASE WHEN p_size % 2 = 0 THEN p_partkey::INT END AS figure FROM part")
def frame_numbers(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("/data/set_7/img_"), F.format_string("%06d", F.col("p_partkey").cast("long")), F.lit(".jpg"))
    figure = F.concat(F.lit("/data/set_7/"), F.when(F.col("p_size") % 2 == 0, F.concat(k, F.lit("_figure_3.png"))).otherwise(F.lit("plain.png")))
    return table(spark, sf_dir, "part").select("p_partkey", S.frame_number(path).alias("frame"), S.figure_frame(figure).alias("figure"))


@_R.add("not_yet_processed", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def not_yet_processed(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.not_processed(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@_R.add("catalog_upsert", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'new' ELSE p_name END AS p_name FROM part UNION ALL SELECT p_partkey + 10000000, 'new' FROM part WHERE p_size = 1")
def catalog_upsert(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    changed = parts.filter("p_size > 40").select("p_partkey", F.lit("new").alias("p_name"))
    added = parts.filter("p_size = 1").select((F.col("p_partkey") + 10000000).alias("p_partkey"), F.lit("new").alias("p_name"))
    return sinks.upserted(parts.select("p_partkey", "p_name"), sinks.all_of(changed, added), ["p_partkey"])


@_R.add("split_by_file_name", "SELECT lang, count(*) AS n FROM documents WHERE source IN ('src0', 'src3') GROUP BY lang")
def split_by_file_name(spark, sf_dir):
    """Rows meet a split by the id inside their file's name: it is taken out of the name and joined, not searched in all names."""
    names = table(spark, sf_dir, "documents").select("lang", F.concat(F.lit("frames/"), "source", F.lit("-frame_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    split = spark.createDataFrame([("src0",), ("src3",)], "video string")
    return names.withColumn("video", F.regexp_extract("path", r"([^/]+)-frame_", 1)).join(split, "video").groupBy("lang").agg(F.count("*").alias("n"))


@_R.add("caption_track_choice", "SELECT user_id, arg_min(event_id, ts) AS track FROM events WHERE event_type = 'view' AND value > 5 GROUP BY user_id")
def caption_track_choice(spark, sf_dir):
    tracks = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("track"), F.col("ts").alias("position"), F.when(F.col("event_type") == "view", "standard").otherwise("asr").alias("kind"), F.when(F.col("value") > 5, "en").otherwise("fr").alias("language"))
    return readers.chosen_track(tracks, "user_id")


QUERIES, ORACLE_SQL = _R.queries, _R.sql
