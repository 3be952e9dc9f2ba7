"""Token-id files with shuffled bit or byte planes.

A file: the magic, then chunks, then a footer, then the footer's size (8 bytes) and the magic again. A chunk is a block of at most
`CHUNK_IDS` ids as little-endian unsigned 32-bit integers, transposed into 4 byte planes or 32 bit planes, each plane
compressed with zstandard. The footer (zstandard, JSON head and arrays) holds the chunk index (offset, ids, crc32 and the
size of each plane) and the document index (doc_id, whether it is null, number of ids).

Tasks write files of their own into a shared folder, chunk by chunk, under a name of the attempt that is changed to the final one when the
file is whole; an attempt that is lost leaves a name that nobody reads, and one that runs again writes the same file. A reader takes the
index from a file's end and fetches the chunks that it needs, so nobody holds a whole file. The folder is of any kind that pyarrow's
file systems know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from podium.llm.common import materialise, new_path, partitions, texts
from podium.llm.tokens import encoded

MAGIC = b"PODIUM-IDS-1\n"
CHUNK_IDS = 1 << 16
#: Ids or documents after which a file ends; one longer document has a file of its own.
FILE_IDS, FILE_DOCS = 1 << 24, 1 << 20
PLANES = {"byte": 4, "bit": 32}
#: Documents in a batch of rows that were read.
ROWS = 10_000


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids, lowest first."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [x.tobytes() for x in np.ascontiguousarray(rows.T)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [x.tobytes() for x in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        rows = np.stack([np.frombuffer(x, np.uint8, n) for x in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little") for x in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


class Writer:
    """Writes documents into an open file, a chunk as soon as it is full."""

    def __init__(self, out: BinaryIO, kind: str = "byte", level: int = 3):
        self.out, self.kind, self.press = out, kind, zstandard.ZstdCompressor(level=level)
        self.at, self.index, self.doc_ids, self.sizes = len(MAGIC), [], [], []
        self.held, self.n_held, self.n_ids = [], 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= CHUNK_IDS:
            ids = np.concatenate(self.held)
            whole = len(ids) - len(ids) % CHUNK_IDS
            for k in range(0, whole, CHUNK_IDS):
                self._chunk(ids[k : k + CHUNK_IDS])
            self.held, self.n_held = [ids[whole:].copy()], len(ids) - whole

    def _chunk(self, block: np.ndarray) -> None:
        planes = [self.press.compress(x) for x in to_planes(block, self.kind)]
        self.index.append([self.at, len(block), zlib.crc32(block.astype("<u4")), *map(len, planes)])
        for x in planes:
            self.out.write(x)
            self.at += len(x)

    def close(self) -> None:
        """Writes the last chunk and the footer; the file stays open."""
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        head = json.dumps({"kind": self.kind, "docs": len(self.sizes), "chunks": len(self.index)}).encode()
        parts = [np.array([len(head)], "<i8"), head, np.array(self.index, "<i8"), np.array([d is None for d in self.doc_ids], "u1"), np.array([d or 0 for d in self.doc_ids], "<i8"), np.array(self.sizes, "<i8")]
        footer = self.press.compress(b"".join(bytes(x) for x in parts))
        self.out.write(footer + np.array([len(footer)], "<i8").tobytes() + MAGIC)


class Reader:
    """Reads an open file that can be sought: its documents in order, chunk by chunk, or any run of ids."""

    def __init__(self, file: BinaryIO):
        self.file, self.press, tail = file, zstandard.ZstdDecompressor(), 8 + len(MAGIC)
        size = file.seek(0, 2)
        if size < tail + len(MAGIC) or self._read(0, len(MAGIC)) != MAGIC or (end := self._read(size - tail, tail))[8:] != MAGIC:
            raise ValueError("not a token-id file")
        n = int(np.frombuffer(end, "<i8", 1)[0])
        footer = self.press.decompress(self._read(size - tail - n, n))
        size = int(np.frombuffer(footer, "<i8", 1)[0])
        head, at = json.loads(footer[8 : 8 + size]), 8 + size
        self.kind, docs, width = head["kind"], head["docs"], 3 + PLANES[head["kind"]]
        self.index = np.frombuffer(footer, "<i8", head["chunks"] * width, at).reshape(-1, width)
        at += self.index.nbytes
        null = np.frombuffer(footer, "u1", docs, at)
        numbers = np.frombuffer(footer, "<i8", docs, at + docs)
        self.sizes = np.frombuffer(footer, "<i8", docs, at + 9 * docs)
        self.doc_ids = [None if x else int(d) for x, d in zip(null, numbers, strict=True)]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, crc, *sizes = map(int, self.index[k])
        raw, planes, done = memoryview(self._read(at, sum(sizes))), [], 0
        for size in sizes:
            planes.append(self.press.decompress(raw[done : done + size]))
            done += size
        ids = from_planes(planes, n, self.kind)
        if zlib.crc32(ids.astype("<u4")) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, of the whole file; only the chunks that hold them are read."""
        first, last = start // CHUNK_IDS, max(start, stop - 1) // CHUNK_IDS
        if stop <= start:
            return np.zeros(0, np.uint32)
        got = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return got[start - first * CHUNK_IDS : stop - first * CHUNK_IDS]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the file and ids of each document; it keeps the chunks of one document at a time."""
        rest, k, start = np.zeros(0, np.uint32), 0, 0
        for doc, n in zip(self.doc_ids, self.sizes.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc, start, rest[:n]
            rest, start = rest[n:], start + n


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, and its path there."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, kind: str = "byte", folder: str | None = None) -> DataFrame:
    """Writes all documents in ascending doc_id order (null first; equal ones by text) and returns a row for each written file.

    Columns: part, file (parts in order, files in a part in order), before (ids of the part before this file), n_ids, path. Without a folder
    they go to a new one in the shared folder. A null text is empty; equal rows are written each for itself. An empty table gives no files;
    other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ids")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")

    def run(batches):
        system, root = store(folder)
        task, part, before, n = TaskContext.get(), TaskContext.get().partitionId(), 0, 0
        own, out, now = f"{root}/_attempt-{task.taskAttemptId()}.ids", None, None
        system.create_dir(root, recursive=True)

        def finish():
            now.close()
            out.close()
            name = f"part-{part:06d}-{n:06d}.ids"
            system.move(own, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([n], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([now.n_ids], pa.int64()), "path": pa.array([f"{folder}/{name}"])})

        for batch, ids, ends in encoded(tokenizer, batches, end_id):
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if now and (now.n_ids + b - a > FILE_IDS or len(now.sizes) == FILE_DOCS):
                    yield finish()
                    before, n, now = before + now.n_ids, n + 1, None
                if not now:
                    out = system.open_output_stream(own)
                    now = Writer(out, kind)
                now.add(doc, ids[a:b])
        if now:
            yield finish()

    ordered = texts(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(run, "part int, file int, before long, n_ids long, path string"), "files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files that `write` lists; a file is read by one task, in chunks.

    A null doc_id comes first; equal rows have a row each, one after the other; no files give no rows.
    """
    spark = files.sparkSession
    sizes = {r[0]: r[1] for r in files.groupBy("part").agg({"n_ids": "sum"}).collect()}  # one row for each partition of the write
    starts, at = {}, 0
    for part in sorted(sizes):
        starts[part] = at
        at += sizes[part]
    where = spark.sparkContext.broadcast(starts)

    def run(batches):
        for batch in batches:
            for part, before, path in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "path")), strict=True):
                base = where.value[part] + before
                system, name = store(path)
                with system.open_input_file(name) as file:
                    found = Reader(file).documents()
                    while rows := [(doc, base + start, len(x), zlib.crc32(x.astype("<u4"))) for doc, start, x in islice(found, ROWS)]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = files.select("part", "before", "path").repartition(partitions(spark), "part", "file")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
