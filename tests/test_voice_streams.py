"""Utterances on streams: as the batch gives them, with frames out of order, late frames, timers and audio."""

import random
import time

import pytest
from pyspark.sql import functions as F

from podium.operators import speech
from podium.streaming import voice, windows

SCHEMA = "k int, frame_idx int, ts timestamp, is_speech boolean, pcm binary"


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or ["*"]).collect())


def frames(seed, recordings=3, n=300):
    rng, rows = random.Random(seed), []
    for k in range(recordings):
        state = True
        for i in range(n):
            if rng.random() < 0.03:
                state = not state
            rows.append((k, i, i * 20, state))
    return rows


def streamed(spark, folder, batches):
    """A stream of the batches, a file each, of (k, frame, ms, voiced)."""
    for rows in batches:
        df = spark.createDataFrame(rows, "k int, frame_idx int, ms long, is_speech boolean")
        df = df.select("k", "frame_idx", F.timestamp_millis(F.col("ms") + 1_700_000_000_000).alias("ts"), "is_speech", F.encode(F.format_string("%d.", "frame_idx"), "utf-8").alias("pcm"))
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


HEARTBEAT = [(-1, 0, 10_000_000, False)]


@pytest.mark.parametrize(("setting", "seed"), [({}, 3), (voice.MICROPHONE, 4)])
def test_stream_gives_the_batch_s_segments(spark, tmp_path, setting, seed):
    """Frames are out of order by up to 400 ms within and across batches; the last segments are given by timers."""
    rng, rows = random.Random(seed), frames(seed)
    rows.sort(key=lambda r: r[2] + rng.randrange(400))
    cut = [0, 250, 251, 600, len(rows)]
    stream = streamed(spark, str(tmp_path / "in"), [rows[a:b] for a, b in zip(cut, cut[1:], strict=False)] + [HEARTBEAT])
    found = windows.run_to_end(voice.utterances(stream, "k", late="1 second", idle_ms=60_000, pcm="pcm", **setting), "voice")
    batch = speech.vad_segments(spark.createDataFrame(rows, "k int, frame_idx int, ms long, is_speech boolean"), "k", **setting)
    columns = ("k", "segment", "first", "last", "n_frames")
    assert got(found, *columns) == got(batch, *columns) and any(r[3] == 299 for r in got(batch, *columns))
    assert all(bytes(pcm).decode() == "".join(f"{i}." for i in range(a, b + 1)) for a, b, pcm in got(found, "first", "last", "pcm"))


def test_late_frames_and_recordings_that_go_on(spark, tmp_path):
    """A frame behind the watermark is left out; what comes after a recording was closed counts from 1 again; the setting of the state's store comes back."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    said = [(0, i, i * 20, True) for i in range(30) if i != 15]
    late, again = [(0, 15, 300, True)], [(0, i, 200_000 + i * 20, True) for i in range(100, 120)]
    stream = streamed(spark, str(tmp_path / "in"), [said, [(-1, 0, 150_000, False)], [(-1, 1, 160_000, False)], late, again, HEARTBEAT])
    found = windows.run_to_end(voice.utterances(stream, "k", late="1 second", idle_ms=60_000), "voice")
    assert got(found, "k", "segment", "first", "last", "n_frames") == [(0, 1, 0, 29, 29), (0, 1, 100, 119, 20)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == was


def test_odd_frames(spark, tmp_path):
    """Null verdicts are unvoiced, frames without number or time are none, an empty stream has no segments."""
    rows = [(1, i, i * 20, True) for i in range(20)] + [(1, None, 5, True), (1, 21, None, True), (1, 20, 400, None), (None, 3, 60, True)]  # a null recording too is none
    stream = streamed(spark, str(tmp_path / "in"), [rows, HEARTBEAT])
    assert got(windows.run_to_end(voice.utterances(stream, "k"), "voice"), "k", "segment", "first", "last", "n_frames") == [(1, 1, 0, 20, 21)]
    nothing = spark.readStream.schema(SCHEMA).parquet(str((tmp_path / "none").mkdir() or tmp_path / "none"))
    assert got(windows.run_to_end(voice.utterances(nothing, "k"), "voice")) == []
    assert voice.ring_of(300, 20) == voice.MICROPHONE["ring"]
