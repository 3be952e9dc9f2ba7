"""File formats as Python data sources: captions and WAV recordings, in batches and as streams, and a sink of whole files.

`register(spark)` makes them known; then `spark.read.format("captions").load(folder)`, `spark.readStream.format("wav_frames")` and so on. One long file is cut into
ranges of about `split` bytes, which tasks read each for itself; the option `keys` (a JSON list of names without suffix) leaves out files before any
is opened. (Filters are not pushed: Spark 4.1 keeps the pushed ones with the frame that was filtered, whose other uses would lose rows.) A stream takes the files of a folder in the order of their times, each once: its offset is the time and path of the last file taken, so a file must be
complete when it appears (moved into the folder). Folders may be of any file system that Arrow knows.
"""

from __future__ import annotations

import json
import re
import uuid
import wave
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SPLIT = 4 << 20
#: Bytes of the ranges that one task reads, those that opening a file counts for, and the number of ranges from which on they share tasks.
TASK, OPEN, LEAST = 4 << 20, 16 << 10, 500
#: Bytes of a batch of frames.
BATCH = 1 << 20
WHITE = b" \t\r\n"
_BLANK_LINE = re.compile(rb"\n[ \t\r]*\n\s*")


@dataclass
class Found:
    """A file of a folder: time of its last change (ns), path, key (its name without suffix), suffix, size."""

    time: int
    path: str
    key: str
    suffix: str
    size: int


def files_of(folder: str, suffixes: tuple[str, ...]) -> list[Found]:
    """Files of these suffixes in a folder and its subfolders, by time and path; names that begin with . or _ are none."""
    system, root = fs.FileSystem.from_uri(folder)
    out = []
    for x in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        hidden = any(p[:1] in "._" for p in x.path[len(root) :].split("/") if p)
        name, dot, suffix = x.base_name.rpartition(".")
        if x.type == fs.FileType.File and not hidden and dot + suffix in suffixes:
            out.append(Found(x.mtime_ns or 0, x.path, name, dot + suffix, x.size))
    return sorted(out, key=lambda f: (f.time, f.path))


@dataclass
class Range:
    """The n-th of `of` parts of a file."""

    file: Found
    n: int
    of: int


def ranges(files: Iterable[Found], split: int) -> list[Range]:
    out = []
    for f in files:
        of = max(1, -(-f.size // split))
        out += [Range(f, n, of) for n in range(of)]
    return out


class Task(InputPartition):
    """Ranges that one task reads one after the other: many small files or ranges are few tasks."""

    def __init__(self, parts: list[Range]):
        self.parts = parts


def tasks(parts: list[Range]) -> list[Task]:
    """The ranges in their order: a task each, or beyond LEAST of them tasks of about equal cost, at most TASK."""
    costs = [OPEN + p.file.size // p.of for p in parts]
    most = min(TASK, sum(costs) / LEAST) if len(parts) > LEAST else 0
    out, size = [], 0
    for p, cost in zip(parts, costs, strict=True):
        if not out or size + cost > most:
            out.append(Task([]))
            size = 0
        out[-1].parts.append(p)
        size += cost
    return out


class FolderSource(DataSource):
    """Files of some suffixes. Kinds of them say how a range is read."""

    suffixes: tuple[str, ...] = ()

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def files(self) -> list[Found]:
        keys = json.loads(self.options.get("keys", "null"))
        return [f for f in files_of(self.options["path"], self.suffixes) if keys is None or f.key in set(keys)]

    def split(self) -> int:
        return int(self.options.get("split", SPLIT))

    def reader(self, schema):
        return FolderReader(self)

    def streamReader(self, schema):
        return FolderStream(self)


class FolderReader(DataSourceReader):
    def __init__(self, source: FolderSource):
        self.source = source

    def partitions(self) -> list[Task]:
        return tasks(ranges(self.source.files(), self.source.split()))

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        for part in partition.parts if partition else ():
            yield from self.source.rows(part)


class FolderStream(DataSourceStreamReader):
    def __init__(self, source: FolderSource):
        self.source = source

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.source.files()
        return {"time": files[-1].time, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Task]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return tasks(ranges((f for f in self.source.files() if after < (f.time, f.path) <= upto), self.source.split()))

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from self.source.rows(part)

    def commit(self, end: dict) -> None:
        pass


# captions


def blocks(file, size: int, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the blocks between blank lines that begin in [begin, end), read to their ends."""
    at = begin
    while at > 0:  # back over white space: a blank line may stand across the edge
        from_ = max(0, at - 4096)
        file.seek(from_)
        before = file.read(at - from_)
        at = from_ + len(before.rstrip(WHITE))
        if at > from_:
            break
    file.seek(at)
    data, done = file.read(end - at), end
    while done < size and not any(m.end() >= end - at and m.end() < len(data) for m in _BLANK_LINE.finditer(data, max(0, end - at - 4096))):
        more = file.read(1 << 16)
        data, done = data + more, done + len(more)
    first = len(data) - len(data.lstrip(WHITE)) if at == 0 else None
    starts = ([first] if first is not None else []) + [m.end() for m in _BLANK_LINE.finditer(data) if first is None or m.end() > first]
    for k, start in enumerate(starts):
        if begin <= at + start < end and start < len(data):
            yield at + start, data[start : starts[k + 1] if k + 1 < len(starts) else None].rstrip(WHITE)


class Captions(FolderSource):
    """Blocks of caption files: video_id, suffix, place (of the block in its file, in bytes), body. `readers.cues` takes them apart."""

    suffixes = (".srt", ".vtt", ".sbv")

    @classmethod
    def name(cls) -> str:
        return "captions"

    def schema(self) -> str:
        return "video_id string, suffix string, place long, body string"

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        f = part.file
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        with system.open_input_file(f.path) as file:
            found = list(blocks(file, f.size, f.size * part.n // part.of, f.size * (part.n + 1) // part.of))
        n = len(found)
        body = [b.decode("utf-8", "replace") for _, b in found]
        yield pa.RecordBatch.from_arrays([pa.array([f.key] * n, pa.string()), pa.array([f.suffix] * n, pa.string()), pa.array([p for p, _ in found], pa.int64()), pa.array(body, pa.string())], ["video_id", "suffix", "place", "body"])


# recordings


class WavFrames(FolderSource):
    """Frames of 16-bit WAV files, channels mixed to one: recording, rate, frame_idx, ts, duration, pcm. Option frame_ms (30).

    Frames are those of `speech.frames`: whole ones; one that ends exactly with the recording is left out, as is a shorter rest.
    """

    suffixes = (".wav",)

    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return "recording string, rate int, frame_idx long, ts double, duration double, pcm binary"

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        ms = int(self.options.get("frame_ms", 30))
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        with system.open_input_file(part.file.path) as file, wave.open(file) as w:
            if w.getsampwidth() != 2:
                raise ValueError(f"{part.file.path}: only 16-bit samples")
            rate, channels, size = w.getframerate(), w.getnchannels(), int(w.getframerate() * ms / 1000)
            n = max(0, -(-w.getnframes() // size) - 1)
            at, end = n * part.n // part.of, n * (part.n + 1) // part.of
            step = max(1, BATCH // (2 * size * channels))
            while at < end:
                upto = min(end, at + step)
                w.setpos(at * size)
                x = np.frombuffer(w.readframes((upto - at) * size), "<i2").reshape(-1, channels)
                x = x[:, 0] if channels == 1 else np.rint(x.mean(axis=1)).astype("<i2")
                idx = np.arange(at, upto)
                pcm = [p.tobytes() for p in x.reshape(upto - at, size)]
                m = len(pcm)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.file.key] * m), pa.array([rate] * m, pa.int32()), pa.array(idx, pa.int64()), pa.array(idx * (ms / 1000)), pa.array([ms / 1000] * m), pa.array(pcm, pa.binary())],
                    ["recording", "rate", "frame_idx", "ts", "duration", "pcm"],
                )
                at = upto


# whole files


@dataclass
class Written(WriterCommitMessage):
    folder: str


class Files(DataSource):
    """A sink: each row (name, content: a string or bytes) is a file of the folder. Tasks write aside; files are moved into the folder when all are there, so one
    that is seen is complete, and what a failed task wrote is never seen. Of two files of one name the last one moved stays."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FilesWriter(self.options["path"])


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.folder)
        own = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(own)
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content").cast(pa.binary()), strict=True):
                if "/" in (name.as_py() or "/"):
                    raise ValueError(f"{name.as_py()} is no file name")
                with system.open_output_stream(f"{own}/{name}") as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
        return Written(own)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.folder)
        for message in filter(None, messages):
            for x in system.get_file_info(fs.FileSelector(message.folder)):
                system.move(x.path, f"{root}/{x.base_name}")
        self._clean(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*fs.FileSystem.from_uri(self.folder))

    def _clean(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for kind in (Captions, WavFrames, Files):
        spark.dataSource.register(kind)
