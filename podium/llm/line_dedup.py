"""Lines that many documents share, found by levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z in lower case; keys shorter than `least` code points take no part. Documents
come in batches, those of the largest doc_ids first. A run is a table of keys (128-bit hashes), bucketed and sorted by the hash, with the number of documents
that hold the key and the largest doc_id of them. Each new batch
1. is counted by key, partial sums before the shuffle,
2. is merge-anti-joined with the runs' keys that enough documents hold already, about which no later batch can tell anything new (its
   doc_ids are smaller),
3. is added as a run of its own on level 0. As soon as a level has FAN runs they are merged, by an outer join of sorted buckets without a
   shuffle, into one run of the next level; so each key is rewritten once a level only.
When all batches are in, the runs are merged to one, whose keys that enough documents hold are joined with the lines. The written table of these
keys is what hot lines meet, so Spark's skew join can split them. The texts are gone through twice: for keys, and for the lines to keep.

Documents are rows: two rows with one doc_id count as two. A null doc_id is the smallest. Null and empty texts have one empty line, which is kept.
Equal rows get equal results. A very long text is a batch of its own in a worker. Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import delete, discard, materialise, new_path, partitions, texts
from podium.llm.tokens import slices

#: ASCII white space, as a key's ends lose it.
BLANK = b" \t\n\v\f\r"
#: Batches of documents, and runs of a level that are merged.
BATCHES, FAN = 4, 2
KEY = ["h1", "h2"]


def key_of(line: bytes, least: int) -> bytes | None:
    """128 bits of the line's key; None if it has less than `least` code points."""
    key = line.strip(BLANK).lower()  # of bytes: A-Z alone
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def keyed(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, tk (a hash of the text), h1, h2 of each key of a row, once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [{k for line in x.as_buffer().to_pybytes().split(b"\n") if (k := key_of(line, least))} for x in batch.column("text").cast(pa.binary())]
            n = np.fromiter(map(len, found), np.int64, len(found))
            if n.sum():
                h = np.frombuffer(b"".join(k for keys in found for k in keys), ">i8").reshape(-1, 2).astype(np.int64)
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("tk").take(at), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "tk", *KEY])

    return docs.mapInArrow(run, "doc_id long, tk long, h1 long, h2 long")


class Runs:
    """Levelled sorted runs: tables of h1, h2, n (rows that hold the key: all of them, or `enough` at least) and last (their largest doc_id)."""

    def __init__(self, spark: SparkSession, enough: int, fan: int = FAN):
        self.spark, self.enough, self.fan = spark, enough, fan
        self.buckets = partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        """One file a bucket, sorted."""
        name = f"podium_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "run")
        writer = rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", self.paths[name]).option("compression", "zstd").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, self.paths.pop(name))

    @contextlib.contextmanager
    def _sorted(self):
        """While runs are read here, Spark may rely on the order inside a bucket's file; the caller's setting comes back."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        was = self.spark.conf.get(name)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, was)

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def without(self, batch: DataFrame, enough: int = 1) -> DataFrame:
        """The batch's rows whose key is in no run with `enough` rows or more: with 1, the lines that are new."""
        for name in self.names():
            batch = batch.join(self.spark.table(name).filter(F.col("n") >= enough).select(*KEY), KEY, "left_anti")
        return batch

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs as one, by outer joins of their sorted buckets."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select(*KEY, F.col("n").alias("_n"), F.col("last").alias("_last"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
            out = out.join(other, KEY, "full").select(*KEY, n.alias("n"), F.greatest("last", "_last").alias("last"))
        return out

    def add(self, batch: DataFrame) -> None:
        """Counts a batch (doc_id, h1, h2, a row for each key of a document), whose doc_ids are not above those added before."""
        counted = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        with self._sorted():
            self._put(self._write(self.without(counted, self.enough)), 0)

    def _put(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan:
            old, self.levels[level] = self.levels[level], []
            new = self._write(self._merged(old))
            for x in old:
                self._drop(x)
            self._put(new, level + 1)

    def shared(self) -> DataFrame:
        """h1, h2, last of the keys that enough rows hold, written; the runs go."""
        with self._sorted():
            out = materialise(self._merged(self.names()).filter(F.col("n") >= self.enough).select(*KEY, "last"), "shared-lines")
        for name in self.names():
            self._drop(name)
        self.levels = []
        return out


def _batches(lines: DataFrame, n: int) -> DataFrame:
    """lines with batch, from 0: equal parts by doc_id, the largest first."""
    cuts = lines.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.01)
    above = [(F.coalesce("doc_id", F.lit(-(1 << 63))) < F.lit(int(c))).cast("int") for c in cuts]
    return lines.withColumn("batch", sum(above, F.lit(0)))


def shared_lines(docs: DataFrame, least: int = 40, copies: int = 5, batches: int = BATCHES) -> DataFrame:
    """doc_id, tk, keys: the keys that each document loses (16 bytes each)."""
    spark = docs.sparkSession
    lines = materialise(_batches(keyed(docs, least), batches), "lines")
    runs = Runs(spark, copies)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i))
    shared = runs.shared()
    lost = lines.join(shared, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    lost = materialise(lost.groupBy("doc_id", "tk").agg(F.collect_set(F.struct(*KEY)).alias("keys")), "lost-lines")
    discard(lines, shared)
    return lost


def dedup(docs: DataFrame, least: int = 40, copies: int = 5, batches: int = BATCHES) -> DataFrame:
    """doc_id, kept (the text without the lines that it loses), n_lines (before), n_dropped of every document.

    A key of `least` code points or more that `copies` documents or more hold loses all its lines except in the largest doc_id holding it.
    """
    rows = texts(docs).withColumn("tk", F.xxhash64("text"))
    lost = shared_lines(rows, least, copies, batches).select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "keys")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts):
            kept, n_lines, n_dropped = [], [], []
            h = batch.column("keys").flatten()
            pairs = np.stack([h.field(k).to_numpy(zero_copy_only=False) for k in KEY], axis=1).astype(">i8").tobytes()
            n = np.concatenate([[0], np.cumsum(batch.column("keys").value_lengths().fill_null(0).to_numpy())]).tolist()
            for i, x in enumerate(batch.column("text").cast(pa.binary())):
                lines = x.as_buffer().to_pybytes().split(b"\n")
                gone = {pairs[16 * k : 16 * k + 16] for k in range(n[i], n[i + 1])}
                stay = [line for line in lines if key_of(line, least) not in gone] if gone else lines
                kept.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "kept", "n_lines", "n_dropped"])

    both = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), "left")
    return both.select("doc_id", "text", "keys").mapInArrow(run, "doc_id long, kept string, n_lines long, n_dropped long")


def report(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup(docs, **options).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def sql(documents: str = "documents", least: int = 40, copies: int = 5) -> str:
    """The same in DuckDB's SQL, for rows whose doc_ids differ."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}),
l AS (SELECT doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{upper}', '{upper.lower()}') AS key FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= {least} GROUP BY key HAVING count(DISTINCT doc_id) >= {copies}),
m AS (SELECT l.*, coalesce(k.last <> l.doc_id, false) AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
