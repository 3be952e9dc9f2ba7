"""Queries on speech and streams. Events stand for audio frames, voiced in alternating stretches."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.catalog.registry import Registry, rounded, table
from podium.functions import tables
from podium.operators import speech
from podium.streaming import voice, windows

_R = Registry()


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("frame_idx"), (F.floor(F.col("event_id") / 2000) % 2 == 0).alias("is_speech"))


def _vad_sql(ring: int = 10, ratio: float = 0.9) -> str:
    """The hysteresis as a recursion over each recording's frames: h is the ring with the new frame, k the segments so far, a the place where the last began."""
    return f"""WITH RECURSIVE f AS (SELECT user_id, event_id AS frame, (event_id // 2000) % 2 = 0 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS i, []::BOOLEAN[] AS ring, false AS active, 0::BIGINT AS k, 0::BIGINT AS a, false AS inside FROM f
 UNION ALL SELECT user_id, i, CASE WHEN turns THEN [] ELSE h END, active <> turns, k + (turns AND NOT active)::BIGINT, CASE WHEN turns AND NOT active THEN i - len(h) + 1 ELSE a END, active OR turns
 FROM (SELECT *, len(list_filter(h, lambda x: x <> active)) > {ratio} * {ring} AS turns FROM (SELECT s.user_id, f.i, list_append(s.ring, f.v)[-{ring}:] AS h, s.active, s.k, s.a FROM s JOIN f ON f.user_id = s.user_id AND f.i = s.i + 1))),
g AS (SELECT user_id, k AS segment, any_value(a) AS a, max(i) AS b FROM s WHERE inside GROUP BY ALL)
SELECT g.user_id, segment, x.frame AS first, y.frame AS last, b - a + 1 AS n_frames FROM g JOIN f x ON x.user_id = g.user_id AND x.i = a JOIN f y ON y.user_id = g.user_id AND y.i = b"""


@_R.add("vad_segments", _vad_sql())
def vad_segments(spark, sf_dir):
    return speech.vad_segments(_frames(spark, sf_dir), "user_id")


@_R.add("vad_microphone", _vad_sql(**voice.MICROPHONE))
def vad_microphone(spark, sf_dir):
    """The same with a microphone's ring and ratio."""
    return speech.vad_segments(_frames(spark, sf_dir), "user_id", **voice.MICROPHONE)


@_R.add("voice_segments_function", _vad_sql(**voice.MICROPHONE))
def voice_segments_function(spark, sf_dir):
    """The same by a table function, through which frames pass one by one."""
    tables.register(spark)
    return spark.sql("SELECT * FROM voice_segments(TABLE({frames}), key => 'user_id', `order` => 'frame_idx', voiced => 'is_speech', ring => 15, ratio => 0.75D)", frames=_frames(spark, sf_dir))


@_R.add("audio_frames", "SELECT vec_id, i AS frame_idx, round(i * 0.03, 6)::DOUBLE AS ts FROM (SELECT vec_id, unnest(range(0, greatest(0, ceil((100 + vec_id * 7 % 900) * 2 / 480.0)::BIGINT - 1))) AS i FROM embeddings)")
def audio_frames(spark, sf_dir):
    """30 ms frames of recordings of 100 to 999 samples at 8 kHz."""
    pcm = F.expr("cast(repeat('ab', cast(100 + vec_id * 7 % 900 as int)) as binary)")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8000).alias("rate"), pcm.alias("pcm"))
    return rounded(speech.frames(rows, "vec_id").select("vec_id", F.col("frame_idx").cast("long").alias("frame_idx"), "ts"), "ts")


@_R.add("silence_chunks", """WITH r AS (SELECT user_id, event_id, coalesce(value < avg(value) OVER (PARTITION BY user_id) - 5, true) AS q, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, q ORDER BY event_id) AS run FROM r),
s AS (SELECT *, q AND count(*) OVER (PARTITION BY user_id, q, run) * 0.5 >= 2.0 AS gap FROM g),
m AS (SELECT *, (NOT gap AND coalesce(lag(gap) OVER (PARTITION BY user_id ORDER BY event_id), true))::INT AS new FROM s),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS chunk, count(*) OVER (PARTITION BY user_id) * 0.5 AS len FROM m)
SELECT user_id, chunk::BIGINT AS chunk, round(greatest(0.0, min(n) * 0.5 - 0.5), 6)::DOUBLE AS start, round(least(any_value(len), (max(n) + 1) * 0.5 + 0.5), 6)::DOUBLE AS "end" FROM c WHERE NOT gap GROUP BY ALL""")
def silence_chunks(spark, sf_dir):
    return rounded(speech.silence_chunks(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 0.5), "start", "end")


@_R.add("char_word_merge", """WITH w AS (SELECT conv_id, turn, regexp_extract_all(replace(text, chr(10), ' '), '[^ .]+|\\.') AS ws FROM conversations) SELECT conv_id, turn, i - 1 AS word_idx, ws[i] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)""")
def char_word_merge(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    chars = turns.select("conv_id", "turn", F.posexplode(F.split(F.translate("text", "\n", " "), "")).alias("pos", "text")).withColumn("start_time", F.col("pos") * 0.1)
    return speech.chars_to_words(chars, ["conv_id", "turn"]).select("conv_id", "turn", "word_idx", "word")


# streams: the query runs a stream over the table to its end


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@_R.add("tumbling_counts_stream", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts_stream(spark, sf_dir):
    rows = windows.run_to_end(windows.tumbling(_stream(spark, sf_dir), ["event_type"], "1 hour"), "tumbling", "complete")
    return rounded(rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "total", digits=4)


@_R.add("session_counts", """WITH f AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 3600000000 * 12 OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL)::INT AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM f)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = windows.sessions(events, ["user_id"], "12 hours")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@_R.add("sliding_counts", """SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS start FROM events) GROUP BY ALL""")
def sliding_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sliding(events, ["event_type"], "2 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@_R.add("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return windows.run_to_end(windows.without_duplicates(_stream(spark, sf_dir), ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "dedup")


@_R.add("vad_stream", _vad_sql())
def vad_stream(spark, sf_dir):
    """The batch's segments from a stream, the last ones by timers: frames are 20 ms apart, and a sign of life of no recording comes two days behind them all."""
    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    rows = _stream(spark, sf_dir).select("user_id", F.col("event_id").alias("frame_idx"), F.timestamp_millis(F.col("event_id") * 20 + 1_700_000_000_000).alias("ts"), (F.floor(F.col("event_id") / 2000) % 2 == 0).alias("is_speech"))
    alive = F.when(F.col("frame_idx") == F.lit(last), F.struct(F.lit(-1).cast("long").alias("user_id"), "frame_idx", (F.col("ts") + F.expr("interval 2 days")).alias("ts"), F.lit(False).alias("is_speech")))
    both = rows.select(F.explode(F.array_compact(F.array(F.struct("user_id", "frame_idx", "ts", "is_speech"), alive))).alias("r")).select("r.*")
    return windows.run_to_end(voice.utterances(both, "user_id", idle_ms=24 * 3600 * 1000), "vad")


QUERIES, ORACLE_SQL = _R.queries, _R.sql
