"""Voice activity on streams of audio frames: utterances as they end, with timers.

A recording's frames may come in any order within the watermark's delay. They wait in a list state until the watermark has passed them and are
fed to the hysteresis in their own order, so a stream gives the segments that the batch operator gives, whatever the batches. A recording that has no frame
for `idle` is over: a timer gives what is still open and takes the recording's state away. Frames behind the watermark are left out, as Spark does
with late rows; a frame that comes after its recording was closed begins a new one, whose segments count from 1.

State of a recording: the frames that wait (those of the watermark's delay and of one batch), the ring (`ring` at most), the open segment's numbers and, where audio is
asked for, its frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from podium.operators.speech import VoiceState

#: A microphone's setting: blocks of 20 ms, 300 ms of padding, off and on at three quarters of it.
MICROPHONE = {"ring": 15, "ratio": 0.75}
NUMBERS = ["active", "segment", "first", "last", "n", "at", "ends"]
#: No time: nothing is registered.
NEVER = -1


def ring_of(padding_ms: int, frame_ms: int) -> int:
    """Frames of a ring that holds so much sound."""
    return padding_ms // frame_ms


class Utterances(StatefulProcessor):
    """Frames (frame, at: its time in ms, voiced, pcm) of a recording to segments."""

    def __init__(self, key: str, ring: int, ratio: float, idle_ms: int, audio: bool):
        self.key, self.ring, self.ratio, self.idle_ms, self.audio = key, ring, ratio, idle_ms, audio

    def init(self, handle: StatefulProcessorHandle) -> None:
        frame = "frame long, at long, voiced boolean" + (", pcm binary" if self.audio else "")
        self.handle = handle
        self.waiting = handle.getListState("waiting", frame)
        self.held = handle.getListState("ring", frame)
        self.sound = handle.getListState("sound", "pcm binary") if self.audio else None
        self.numbers = handle.getValueState("numbers", "active boolean, segment long, first long, last long, n long, at long, ends long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = NEVER
        for part in rows:
            frames = [(int(f), int(at), bool(v), *more) for f, at, v, *more in zip(*(part[c] for c in self._columns()), strict=True)]
            self.waiting.appendList(frames)
            latest = max(latest, *(at for _, at, *_ in frames))
        if latest > NEVER:
            self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter([])

    def _columns(self) -> list[str]:
        return ["frame", "at", "voiced", *(["pcm"] if self.audio else [])]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        found = sorted(self.waiting.get(), key=lambda x: x[0]) if self.waiting.exists() else []
        ready, later = [x for x in found if x[1] <= now], [x for x in found if x[1] > now]
        out = self._fed(ready, later) if ready else []
        state = self._state()
        if not later and NEVER < state["ends"] <= now:
            out += self._closed(state)
        if out:
            names = [self.key, "segment", "first", "last", "n_frames", *(["pcm"] if self.audio else [])]
            yield pd.DataFrame([(key[0], *row) for row in out], columns=names)

    def _state(self) -> dict:
        if not self.numbers.exists():
            return dict(zip(NUMBERS, (False, 0, None, None, 0, NEVER, NEVER), strict=True))
        return dict(zip(NUMBERS, self.numbers.get(), strict=True))

    def _fed(self, ready: list[tuple], later: list[tuple]) -> list[tuple]:
        """Segments that end with these frames. What is not yet due goes on waiting."""
        s = self._state()
        held = list(self.held.get()) if self.held.exists() else []
        sound = [x[0] for x in self.sound.get()] if self.audio and self.sound.exists() else []
        known = {x[0]: tuple(x) for x in held} | {x[0]: tuple(x) for x in ready}
        vad = VoiceState(self.ring, self.ratio, [(x[0], x[2]) for x in held], s["active"])
        out = []
        for x in ready:
            got, ended = vad.feed(x[0], x[2])
            if got:
                s["first"] = got[0] if s["first"] is None else s["first"]
                s["last"], s["n"] = got[-1], s["n"] + len(got)
                sound += [known[f][3] for f in got] if self.audio else []
            if ended:
                s["segment"] += 1
                out.append((s["segment"], s["first"], s["last"], s["n"], *([b"".join(sound)] if self.audio else [])))
                s["first"], s["last"], s["n"], sound = None, None, 0, []
        s["active"], s["at"] = vad.active, max(s["at"], *(x[1] for x in ready))
        s["ends"] = s["at"] + self.idle_ms
        self.handle.registerTimer(s["ends"])
        self.numbers.update(tuple(s[c] for c in NUMBERS))
        _put(self.held, [known[f] for f, _ in vad.held])
        _put(self.waiting, [tuple(x) for x in later])
        if self.audio:
            _put(self.sound, [(x,) for x in sound])
        return out

    def _closed(self, s: dict) -> list[tuple]:
        """The open segment, if any; the recording's state goes."""
        sound = [x[0] for x in self.sound.get()] if self.audio and self.sound.exists() else []
        for state in (self.waiting, self.held, self.numbers, *([self.sound] if self.audio else [])):
            state.clear()
        return [(s["segment"] + 1, s["first"], s["last"], s["n"], *([b"".join(sound)] if self.audio else []))] if s["n"] else []

    def close(self) -> None:
        pass


def _put(state, rows: list[tuple]) -> None:
    state.put(rows) if rows else state.clear()


def utterances(frames: DataFrame, key: str, order: str = "frame_idx", ts: str = "ts", voiced: str = "is_speech", late: str = "10 seconds", idle_ms: int = 60_000, ring: int = 10, ratio: float = 0.9, pcm: str | None = None) -> DataFrame:
    """key, segment (from 1), first, last, n_frames, and with `pcm` the segment's audio, of a stream of frames (ts a TIMESTAMP).

    A null recording, frame number or time is no frame, a null verdict is unvoiced. The stream must run on RocksDB state (`windows.run_to_end` sees to it).
    """
    rows = frames.filter(F.col(key).isNotNull() & F.col(order).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(key), F.col(order).cast("long").alias("frame"), F.unix_millis(ts).alias("at"), F.coalesce(voiced, F.lit(False)).alias("voiced"), ts, *([F.col(pcm).alias("pcm")] if pcm else []))
    schema = f"`{key}` {dict(frames.dtypes)[key]}, segment long, first long, last long, n_frames long" + (", pcm binary" if pcm else "")
    processor = Utterances(key, ring, ratio, idle_ms, pcm is not None)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventtime")
