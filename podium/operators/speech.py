"""Speech operators: audio frames, voice activity, chunks, token merging; recognisers are injected."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rates that voice-activity detection takes.
RATES = (8000, 16000, 32000, 48000)


def read_wave(data: bytes, rate: int = 16000, force: bool = True) -> tuple[np.ndarray, int, float]:
    """(samples, rate, seconds) of 16-bit WAV bytes, mixed to one channel and resampled where they differ and force is set."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit samples")
        own, channels, n = w.getframerate(), w.getnchannels(), w.getnframes()
        x = np.frombuffer(w.readframes(n), "<i2").reshape(-1, channels)
    if force and (channels != 1 or own != rate):
        return resampled(x.astype(float).mean(axis=1), own, rate), rate, n / own
    if channels != 1:
        raise ValueError("only one channel")
    return x[:, 0].copy(), own, n / own


def resampled(x: np.ndarray, own: int, rate: int) -> np.ndarray:
    """Linear interpolation to another rate, as 16-bit samples."""
    n = int(round(len(x) * rate / own))
    return np.clip(np.rint(np.interp(np.arange(n) * own / rate, np.arange(len(x)), x)), -32768, 32767).astype(np.int16)


def write_wave(samples: np.ndarray, rate: int) -> bytes:
    """One channel of 16-bit samples as WAV bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def recordings(df: DataFrame, key: str, content: str = "content", rate: int = 16000) -> DataFrame:
    """key, rate, duration, pcm of WAV files."""

    def work(parts):
        for part in parts:
            rows = [read_wave(bytes(c), rate) for c in part[content]]
            yield pd.DataFrame({key: part[key], "rate": [r for _, r, _ in rows], "duration": [d for *_, d in rows], "pcm": [x.astype("<i2").tobytes() for x, *_ in rows]})

    return df.select(key, content).mapInPandas(work, f"`{key}` {dict(df.dtypes)[key]}, rate int, duration double, pcm binary")


def frames(df: DataFrame, key: str, frame_ms: int = 30) -> DataFrame:
    """key, frame_idx, ts, duration, pcm: whole frames; one that ends exactly with the recording is left out, as is a shorter rest."""
    size = (F.col("rate") * frame_ms / 1000).cast("int") * 2
    n = F.greatest(F.lit(0), F.ceil(F.length("pcm") / size) - 1).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("_size", size).select(key, "rate", "pcm", "_size", F.explode(places).alias("frame_idx"))
    seconds = frame_ms / 1000
    return rows.select(key, "frame_idx", (F.col("frame_idx") * seconds).alias("ts"), F.lit(seconds).alias("duration"), F.substring("pcm", F.col("frame_idx") * F.col("_size") + 1, F.col("_size")).alias("pcm"))


def loudness(pcm: Column | str) -> Column:
    """dBFS of 16-bit samples by a kernel; null for silence."""

    @F.pandas_udf("double")
    def db(data: pd.Series) -> pd.Series:
        def one(b):
            x = np.frombuffer(b, "<i2").astype(float)
            r = np.sqrt((x * x).mean()) if len(x) else 0.0
            return 20 * np.log10(r / 32768) if r > 0 else None

        return data.map(one).astype(float)

    return db(pcm)


# voice activity


class VoiceState:
    """Hysteresis over a ring of frames: on when more than `ratio` of the ring is voiced, off when as much is not.

    feed(frame, voiced) gives frames that belong to the segment now and whether it ends; the ring is part of a segment that begins.
    """

    def __init__(self, ring: int = 10, ratio: float = 0.9, held: list | None = None, active: bool = False):
        self.ring, self.ratio = ring, ratio
        self.held: list[tuple[int, bool]] = held or []
        self.active = active

    def feed(self, frame: int, voiced: bool) -> tuple[list[int], bool]:
        self.held = (self.held + [(frame, voiced)])[-self.ring :]
        n = sum(v for _, v in self.held)
        if not self.active:
            if n > self.ratio * self.ring:
                self.active = True
                out = [f for f, _ in self.held]
                self.held = []
                return out, False
            return [], False
        if len(self.held) - n > self.ratio * self.ring:
            self.active, self.held = False, []
            return [frame], True
        return [frame], False


def segments_of(voiced: Iterator[tuple[int, bool]], ring: int = 10, ratio: float = 0.9) -> list[tuple[int, int]]:
    """(first, last) frame of each segment; one that is open at the end is kept."""
    state, out, now = VoiceState(ring, ratio), [], []
    for frame, v in voiced:
        got, ended = state.feed(frame, bool(v))
        now += got
        if ended:
            out.append((now[0], now[-1]))
            now = []
    if now:
        out.append((now[0], now[-1]))
    return out


def vad_segments(df: DataFrame, key: str, order: str = "frame_idx", voiced: str = "is_speech", ring: int = 10, ratio: float = 0.9) -> DataFrame:
    """key, segment (from 1), first, last, n_frames of each recording."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        found = segments_of(zip(part[order].tolist(), part[voiced].fillna(False).tolist(), strict=True), ring, ratio)
        place = {f: i for i, f in enumerate(part[order].tolist())}
        return pd.DataFrame({key: [part[key].iloc[0]] * len(found), "segment": range(1, len(found) + 1), "first": [a for a, _ in found], "last": [b for _, b in found], "n_frames": [place[b] - place[a] + 1 for a, b in found]})

    kinds = dict(df.dtypes)
    return df.select(key, order, voiced).groupBy(key).applyInPandas(work, f"`{key}` {kinds[key]}, segment long, first long, last long, n_frames long")


def energy_voiced(df: DataFrame, pcm: str = "pcm", above: float = -40.0) -> DataFrame:
    """Frames with is_speech: a stand-in for a voice model, by loudness."""
    return df.withColumn("is_speech", F.coalesce(loudness(pcm) > above, F.lit(False)))


def check_rate(rate: int) -> None:
    if rate not in RATES:
        raise ValueError(f"rate must be one of {RATES}")


def silence_chunks(df: DataFrame, by: list[str], order: str, db: str, frame_s: float, offset: float = 5.0, least_s: float = 2.0, pad_s: float = 0.5) -> DataFrame:
    """by, chunk, start, end (seconds): sound between silences of `least_s` or more, padded on both sides.

    Silent is what is quieter than the mean loudness less the offset. Runs by gaps and islands; all in one plan.
    """
    w = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by)
    quiet = F.coalesce(F.col(db) < F.avg(db).over(whole) - offset, F.lit(True))
    rows = df.withColumn("_q", quiet).withColumn("_n", F.row_number().over(w) - 1)
    rows = rows.withColumn("_run", F.col("_n") - F.row_number().over(Window.partitionBy(*by, "_q").orderBy(order)))
    runs = rows.groupBy(*by, "_q", "_run").agg(F.min("_n").alias("a"), F.max("_n").alias("b"))
    long = F.col("_q") & ((F.col("b") - F.col("a") + 1) * frame_s >= least_s)
    marked = rows.join(runs, [*by, "_q", "_run"]).withColumn("_gap", long)
    new = marked.withColumn("_new", (~F.col("_gap") & F.coalesce(F.lag("_gap").over(w), F.lit(True))).cast("int"))
    new = new.withColumn("chunk", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = new.filter(~F.col("_gap")).groupBy(*by, "chunk").agg(F.min("_n").alias("a"), F.max("_n").alias("b"))
    length = rows.groupBy(*by).agg((F.count("*") * frame_s).alias("_len"))
    return out.join(length, by).select(*by, F.col("chunk").cast("long").alias("chunk"), F.greatest(F.lit(0.0), F.col("a") * frame_s - pad_s).alias("start"), F.least("_len", (F.col("b") + 1) * frame_s + pad_s).alias("end"))


# recognition

#: Recognisers by name: functions of (samples, rate) that give a list of (start, end, word).
RECOGNISERS: dict[str, Callable[[np.ndarray, int], list[tuple[float, float, str]]]] = {}


def register(name: str, recogniser: Callable[[np.ndarray, int], list[tuple[float, float, str]]]) -> None:
    RECOGNISERS[name] = recogniser


def transcribed(df: DataFrame, key: str, method: str, offset: str | None = None) -> DataFrame:
    """key, pos, start, end, word of each recording or chunk (columns pcm and rate) by a registered recogniser; times are moved by the
    chunk's offset, so they count from the recording's begin."""
    if method not in RECOGNISERS:
        raise ValueError(f"no recogniser {method}; there are {', '.join(RECOGNISERS) or 'none'}")
    recognise = RECOGNISERS[method]

    def work(parts):
        for part in parts:
            rows = []
            for k, pcm, rate, off in zip(part[key], part["pcm"], part["rate"], part["_offset"], strict=True):
                rows += [(k, i, off + a, off + b, w) for i, (a, b, w) in enumerate(recognise(np.frombuffer(pcm, "<i2"), rate))]
            yield pd.DataFrame(rows, columns=[key, "pos", "start", "end", "word"])

    at = F.col(offset).cast("double") if offset else F.lit(0.0)
    return df.select(key, "pcm", "rate", at.alias("_offset")).mapInPandas(work, f"`{key}` {dict(df.dtypes)[key]}, pos int, start double, end double, word string")


def joined_chunks(words: DataFrame, by: list[str], chunk: str) -> DataFrame:
    """by, transcript: the words of all chunks in order, with spaces."""
    return words.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(chunk, "pos", "word"))), lambda x: x["word"]), " ").alias("transcript"))


def chars_to_words(df: DataFrame, by: list[str], pos: str = "pos", char: str = "text", time: str = "start_time") -> DataFrame:
    """by, word_idx, word, start, end: characters merged at spaces and full stops; a full stop is a word too; empty words are none.

    A word starts with its first character and ends when the boundary after it comes (the last one with its last character).
    """
    w = Window.partitionBy(*by).orderBy(pos)
    stop, space = F.col(char) == ".", F.col(char) == " "
    before = F.lag(char).over(w)
    new = (space | stop | before.isin(" ", ".") | before.isNull()).cast("int")
    rows = df.withColumn("_end", F.coalesce(F.lead(time).over(w), F.col(time))).withColumn("_g", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_end", F.when(stop, F.col(time)).otherwise(F.col("_end"))).filter(~space)
    words = rows.groupBy(*by, "_g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, char))), lambda x: x[char]), "").alias("word"), F.min(time).alias("start"), F.max("_end").alias("end"))
    idx = F.row_number().over(Window.partitionBy(*by).orderBy("_g")) - 1
    return words.select(*by, idx.cast("long").alias("word_idx"), "word", "start", "end")
