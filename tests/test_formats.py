"""Data sources for captions and recordings, the sink of whole files, and table functions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.functions import tables
from podium.operators import speech
from podium.sources import formats, readers, sinks
from podium.streaming import windows


@pytest.fixture(autouse=True, scope="module")
def known(spark):
    formats.register(spark)
    tables.register(spark)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or ["*"]).collect()), key=repr)


def srt(n, rng, newline="\n"):
    cues = [f"{i}{newline}00:{i // 60 % 60:02d}:{i % 60:02d},000 --> 00:{i // 60 % 60:02d}:{i % 60:02d},900{newline}é {'word ' * rng.randrange(1, 9)}{newline}<i>more</i> {i}" for i in range(1, n)]
    return "".join(c + newline * 2 + rng.choice(("", newline, " \t" + newline)) for c in cues)


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_ranges_of_captions_give_each_cue_once(spark, tmp_path, split):
    rng = random.Random(split)
    bodies = {"long": srt(150, rng), "windows": srt(20, rng, "\r\n"), "blank": "\n \n\n" + srt(3, rng), "white": "  \n" * 40, "empty": "", "plain": "no cues here"}
    for k, body in bodies.items():
        (tmp_path / f"{k}.srt").write_text(body, newline="")
    (tmp_path / "other.txt").write_text(bodies["long"])
    (tmp_path / "_hidden.srt").write_text(bodies["long"])
    read = spark.read.format("captions").option("split", split).load(str(tmp_path))
    files = spark.createDataFrame([(k, ".srt", b) for k, b in bodies.items()], "video_id string, suffix string, body string")
    found = got(readers.cues(read, "video_id", place="place"))
    assert found == got(readers.cues(files, "video_id")) and len(found) == 149 + 19 + 2
    if split == 64:
        assert read.rdd.getNumPartitions() > 100


def test_files_of_other_keys_stay_closed(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"v{k}.srt").write_text(f"1\n00:00:0{k},000 --> 00:00:09,000\nhello\n")
    (tmp_path / "v9.srt").mkdir()
    rows = spark.read.format("captions").option("keys", '["v1", "v3", "v9"]').load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 2 and got(rows, "video_id") == [("v1",), ("v3",)]


def test_a_stream_takes_each_file_once(spark, tmp_path):
    """Two runs with one checkpoint: the second takes what is new only."""
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    seen = []
    for k in range(3):
        (tmp_path / "in" / f"v{k}.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\none\n\n2\n00:00:02,000 --> 00:00:03,000\ntwo\n")
        windows.to_parquet(spark.readStream.format("captions").option("split", 30).load(folder), out, state)
        seen.append(spark.read.parquet(out).groupBy("video_id").count().orderBy("video_id").collect())
    assert [[tuple(r) for r in x] for x in seen] == [[(f"v{i}", 2) for i in range(k + 1)] for k in range(3)]


@pytest.mark.parametrize("channels", [1, 2])
def test_frames_of_recordings(spark, tmp_path, channels):
    """Ranges of one file give the frames of the whole."""
    rng = np.random.default_rng(1)
    data = {f"r{n}": rng.integers(-3000, 3000, n).astype("<i2") for n in (0, 10, 240, 241, 480, 5000)}
    if channels == 1:
        sinks.write_recordings(spark.createDataFrame([(k, x.tolist()) for k, x in data.items()], "name string, samples array<int>"), str(tmp_path / "w"), "name", "samples", 8000)
    else:
        import wave

        (tmp_path / "w").mkdir()
        for k, x in data.items():
            with wave.open(str(tmp_path / "w" / f"{k}.wav"), "wb") as w:
                w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
                w.writeframes(np.stack([x, x], axis=1).tobytes())
    read = spark.read.format("wav_frames").option("split", 900).load(str(tmp_path / "w"))
    whole = spark.createDataFrame([(k, 8000, x.tobytes()) for k, x in data.items()], "recording string, rate int, pcm binary")
    assert got(read, "recording", "frame_idx", "pcm") == got(speech.frames(whole, "recording"), "recording", "frame_idx", "pcm")
    assert got(read.filter("recording = 'r5000'"), "frame_idx") == [(i,) for i in sorted(range(20), key=repr)] or read.filter("recording = 'r5000'").count() == 20


def test_whole_files_are_seen_when_all_are_there(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", "é"), ("b.txt", None), ("c.txt", "")], "name string, content string")
    rows.write.format("whole_files").mode("append").save(str(tmp_path / "out"))
    assert {x.name: x.read_text() for x in (tmp_path / "out").iterdir()} == {"a.txt": "é", "b.txt": "", "c.txt": ""}
    with pytest.raises(Exception, match="no file name"):
        spark.createDataFrame([("d.txt", "x"), ("../e.txt", "y")], "name string, content string").coalesce(1).write.format("whole_files").mode("append").save(str(tmp_path / "out"))
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["a.txt", "b.txt", "c.txt"]


def test_frame_times(spark):
    videos = spark.createDataFrame([(1, 3.5), (2, None), (3, 0.0), (4, 2000.0)], "id int, seconds double")
    plain = spark.sql("SELECT v.id, f.* FROM {v} v, LATERAL frame_times(v.seconds, every => 2.0D) f", v=videos.filter("id < 4"))
    assert plain.columns == ["id", "frame_number", "ts"] and got(plain) == [(1, 0, 0.0), (1, 2, 2.0)]
    named = spark.sql("SELECT v.id, f.* FROM {v} v, LATERAL frame_times(v.seconds, prefix => 'f_') f", v=videos)
    assert named.columns[-1] == "name" and named.filter("id = 4").count() == 200 and got(named.filter("id = 1"), "name") == [("f_0.jpg",), ("f_1.jpg",), ("f_2.jpg",), ("f_3.jpg",)]
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT f.* FROM {v} v, LATERAL frame_times(v.seconds, every => v.seconds) f", v=videos).count()


def test_voice_segments_function(spark):
    rng, rows = random.Random(7), []
    for k in ("a", "b", None):
        state = False
        for i in range(200):
            state ^= rng.random() < 0.04
            rows.append((k, i, state))
    rng.shuffle(rows)
    frames = spark.createDataFrame(rows, "k string, i int, v boolean")
    found = spark.sql("SELECT * FROM voice_segments(TABLE({f}), key => 'k', `order` => 'i', voiced => 'v')", f=frames)
    expected = [(k, n, a, b, b - a + 1) for k in ("a", "b", None) for n, (a, b) in enumerate(speech.segments_of(((i, v) for _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]))), 1)]
    assert got(found) == sorted(expected, key=repr)
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM voice_segments(TABLE({f}), key => 'x', `order` => 'i', voiced => 'v')", f=frames).count()
