"""Removal of byte strings of a given length that occur more than once, found by interval expansion on a Burrows-Wheeler transform.

A transform of the whole corpus fits no machine, so windows are first brought together by content. Every window of `length` bytes
has an anchor, the leftmost of its smallest-hashed 64-byte grams; equal windows have equal anchors. Neighbouring windows with the same
anchor form a run, about one for 70 bytes of text, and each window is in one run. Then
1. anchors that occur once in the corpus drop out (hash counts, summed before the shuffle), with nearly all of the text;
2. runs with equal anchor and bytes are counted, and those that occur twice are repeated whole;
3. one copy of each different run goes, with its anchor's others, into a task's text of some 200 kB, where `bwt.repeated` tells which of
   its windows start elsewhere too; runs that agree with none of the others around the anchor stay out. An anchor with more than `MOST_RUNS`
   different runs, which would fill a task, is dealt by the hashes (128 bits) of its whole windows instead, which are counted in parts: there
   the transform does not decide (README);
4. covered bytes are joined to their documents.
Texts are compressed wherever they are shuffled. doc_id and a hash of the text tell documents apart. What a hot key's rows are joined with is a
written table, so that Spark's skew join can split them.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.bwt import repeated
from podium.llm.common import discard, materialise, partitions, texts
from podium.llm.hashes import of_grams, sums
from podium.llm.shingles import bytes_of
from podium.llm.tokens import slices, trim

GRAM = 64
#: Bytes of text that are hashed at once: some arrays of eight times that size, which a processor's cache holds.
SLICE = 100_000
#: Different runs of one anchor that meet in one text, and the bytes of a text.
MOST_RUNS, TEXT_BYTES = 4096, 200_000
#: Anchors that a task counts at once.
ROWS = 50_000
#: Parts of what a window has beside its anchor, for telling which runs can share one.
STEPS = 4


def _least(x: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` neighbours."""
    width = 1
    while 2 * width <= wide:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = wide - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs_of(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts in a row: text, first window (from the text's begin), number of windows, anchor's place in the run, and anchor of each run."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    grams = of_grams(sums(data), GRAM)
    low = np.uint64(max(20, int(len(grams)).bit_length()))
    keyed = grams >> low
    keyed <<= low
    keyed |= np.arange(len(grams), dtype=np.uint64)
    least = _least(keyed, length - GRAM + 1)  # its low bits are the anchor's place
    inside = np.ones(len(least) + 1, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        inside[max(a, b - length + 1) : b] = False
    inside[-1] = False
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[bounds[:-1][bounds[:-1] < len(new)]] = True
    first = np.flatnonzero(new & inside[:-1])
    end = np.append(new[1:], True)
    end |= ~inside[1:]
    last = np.flatnonzero(end & inside[:-1])
    text = np.searchsorted(bounds, first, side="right") - 1
    anchor = (least[first] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    return text, first - bounds[text], last - first + 1, anchor - first, grams[anchor]


def _key(text: bytes) -> int:
    """64 bits, signed: rows with one doc_id, or with none, are told apart by them."""
    return int.from_bytes(xxhash.xxh3_64_digest(text), "big", signed=True)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, tk (a hash of the text), z (the text, compressed)."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, most=SLICE):
            raw = [x.as_buffer().to_pybytes() for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(_key, raw), pa.int64()), pa.array([press.compress(x) for x in raw], pa.binary())], ["doc_id", "tk", "z"])

    return docs.mapInArrow(run, "doc_id long, tk long, z binary")


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """h and k: each anchor with its number of runs, summed by some slices of documents."""

    def counted(held):
        h, k = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k, pa.int64())], ["h", "k"])

    def run(batches):
        held, n = [], 0
        for batch in slices(batches, most=SLICE):
            held.append(runs_of(*bytes_of(batch.column("text")), length)[-1])
            n += len(held[-1])
            if n > ROWS:
                yield counted(held)
                held, n = [], 0
        if n:
            yield counted(held)

    return docs.select("text").mapInArrow(run, "h long, k long")


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """h, sk (hash of the run's bytes), doc_id, tk, a (first window), w (windows), o (the anchor's place in the run) of every run."""

    def run(batches):
        for batch in slices(batches, most=SLICE):
            data, bounds = bytes_of(batch.column("text"))
            text, first, windows, place, h = runs_of(data, bounds, length)
            if not len(text):
                continue
            begin = bounds[text] + first
            raw = memoryview(np.ascontiguousarray(data))
            sk = np.fromiter((xxhash.xxh3_64_intdigest(raw[b:e]) for b, e in zip(begin.tolist(), (begin + windows + length - 1).tolist(), strict=True)), np.uint64, len(text))
            tk = np.fromiter((_key(raw[b:e]) for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), np.int64, len(bounds) - 1)
            doc = batch.column("doc_id").take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sk.view(np.int64)), doc, pa.array(tk[text]), pa.array(first, pa.int32()), pa.array(windows, pa.int32()), pa.array(place, pa.int32())], ["h", "sk", "doc_id", "tk", "a", "w", "o"])

    return docs.mapInArrow(run, "h long, sk long, doc_id long, tk long, a int, w int, o int")


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    """a left joined with b by doc_id (null equals null) and tk."""
    b = b.withColumnRenamed("doc_id", "_d").withColumnRenamed("tk", "_t")
    return a.join(b, a["doc_id"].eqNullSafe(b["_d"]) & (a["tk"] == b["_t"]), "left").drop("_d", "_t")


def _cut_out(kinds: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """h, sk, hot, o, run (bytes) of each different run, cut out of the document that was chosen for it; of equal rows, out of each."""

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for z, wanted in zip(batch.column("z"), batch.column("wanted").to_pylist(), strict=True):
                text = open_.decompress(z.as_buffer())
                rows += [(x["h"], x["sk"], x["hot"], x["o"], text[x["a"] : x["a"] + x["w"] + length - 1]) for x in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()))], ["h", "sk", "hot", "o", "run"])

    by_doc = kinds.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("h", "sk", "hot", "o", "a", "w")).alias("wanted"))
    return _same(by_doc, _packed(docs)).select("z", "wanted").mapInArrow(run, "h long, sk long, hot boolean, o int, run binary")


def _expanded(runs: DataFrame, length: int) -> DataFrame:
    """h, sk, at (repeated windows, as little-endian 32-bit places in the run), by texts of whole anchors."""

    rest = length - GRAM
    part = rest // STEPS
    sides = [(part * k, part * (STEPS - 1 - k)) for k in range(STEPS)]

    def likely(group):
        """The runs of an anchor that agree with another one in one of STEPS ways: if a window is shared, its bytes before the anchor, cut
        down to whole parts, and what is then missing behind it are."""
        if len(group) < 2:
            return []
        keys = [[r[o - a : o + GRAM + b] if o >= a and len(r) >= o + GRAM + b else None for a, b in sides] for _, _, o, r in group]
        seen = [Counter(x) for x in zip(*keys, strict=True)]
        return [x for x, own in zip(group, keys, strict=True) if any(k is not None and s[k] > 1 for k, s in zip(own, seen, strict=True))]

    def work(held):
        found = repeated([r for *_, r in held], length) if held else []
        rows = [(h, sk, x.astype("<i4").tobytes()) for (h, sk, *_), x in zip(held, found, strict=True) if len(x)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["h", "sk", "at"])

    def run(batches):
        held, group, now = [], [], None
        for batch in batches:
            for h, sk, o, r in zip(*(batch.column(c).to_pylist() for c in ("h", "sk", "o", "run")), strict=True):
                if h != now:
                    held += likely(group)
                    group, now = [], h
                    if len(held) * length >= TEXT_BYTES:  # a run has some more than `length` bytes
                        yield work(held)
                        held = []
                elif group and group[-1][1] == sk:  # cut out of two equal rows
                    continue
                group.append((h, sk, o, r))
        held += likely(group)
        if held:
            yield work(held)
        trim()

    dealt = runs.repartition(partitions(runs.sparkSession), "h").sortWithinPartitions("h", "sk")
    return dealt.mapInArrow(run, "h long, sk long, at binary")


def _counted(runs: DataFrame, length: int) -> DataFrame:
    """The same by hashes of whole windows: for anchors with very many different runs."""

    def windows(batches):
        for batch in batches:
            for h, sk, r in zip(batch.column("h").to_pylist(), batch.column("sk").to_pylist(), batch.column("run").to_pylist(), strict=True):
                n = len(r) - length + 1
                hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r[i : i + length]) for i in range(n)), "<i8").reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array([h] * n), pa.array([sk] * n), pa.array(np.arange(n, dtype=np.int32))], ["x", "y", "h", "sk", "at"])

    def gather(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("sk"), pa.array([np.sort(np.array(x, "<i4")).tobytes() for x in batch.column("list").to_pylist()], pa.binary())], ["h", "sk", "at"])

    rows = runs.dropDuplicates(["h", "sk"]).mapInArrow(windows, "x long, y long, h long, sk long, at int")
    twice = rows.groupBy("x", "y").agg(F.count("*").alias("k")).filter("k > 1").select("x", "y")
    return rows.join(twice, ["x", "y"], "left_semi").groupBy("h", "sk").agg(F.collect_list("at").alias("list")).mapInArrow(gather, "h long, sk long, at binary")


def repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, tk, spans: for each document with repeated strings, its runs as structs of a (first window), w (windows) and at (the repeated
    ones of them; null: all). Equal rows count as the documents that they are, and are listed once."""
    shared = materialise(_anchors(docs, length).groupBy("h").agg(F.sum("k").alias("k")).filter("k > 1").select("h"), "shared")
    found = materialise(_runs(docs, length).join(shared, "h", "left_semi"), "runs")
    kinds = found.groupBy("h", "sk").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "tk", "a", "w", "o")).alias("at"))
    kinds = materialise(kinds.select("h", "sk", "k", "at.*"), "kinds")
    several = kinds.groupBy("h").agg(F.count("*").alias("different")).filter("different > 1").select("h", (F.col("different") > MOST_RUNS).alias("hot"))
    several = materialise(several, "several")
    cut = materialise(_cut_out(kinds.join(several, "h"), docs, length), "cut")
    part = _expanded(cut.filter("NOT hot"), length).unionByName(_counted(cut.filter("hot"), length))
    once = kinds.filter("k = 1").select("h", "sk")
    hits = part.join(once, ["h", "sk"], "left_semi").unionByName(kinds.filter("k > 1").select("h", "sk", F.lit(None).cast("binary").alias("at")))
    hits = materialise(hits, "hits")
    spans = found.join(hits, ["h", "sk"]).groupBy("doc_id", "tk").agg(F.collect_set(F.struct("a", "w", "at")).alias("spans"))
    spans = materialise(spans, "spans")
    discard(shared, found, kinds, several, cut, hits)
    return spans


def covered(sizes: np.ndarray, spans: pa.ListArray, length: int) -> np.ndarray:
    """Which bytes of documents in a row some repeated window covers; spans: each one's runs, null for none."""
    begin = np.cumsum(sizes) - sizes
    edge = np.zeros(int(sizes.sum()) + 1, np.int32)
    count = np.asarray(pc.fill_null(pc.list_value_length(spans), 0), dtype=np.int64)
    flat = spans.flatten()
    a, w = (np.asarray(flat.field(k), dtype=np.int64) for k in ("a", "w"))
    a = a + np.repeat(begin, count)
    at = flat.field("at")
    whole = np.asarray(at.is_null())
    np.add.at(edge, a[whole], 1)
    np.add.at(edge, (a + w)[whole] + length - 1, -1)
    some = at.filter(pa.array(~whole))
    places = np.frombuffer(b"".join(x.as_buffer() for x in some), "<i4").astype(np.int64)
    places += np.repeat(a[~whole], np.asarray(pc.binary_length(some), dtype=np.int64) // 4)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + length, -1)
    return np.cumsum(edge[:-1]) > 0


def small(batches, rows: int = 100):
    """The batches in parts of so many rows: what they unfold to is held part by part."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    trim()


def dedup(docs: DataFrame, length: int = 200, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with keep_text also kept (the remaining bytes).

    A null text is empty and has nothing to remove; a text shorter than `length` stays whole; copies of a long text are removed
    whole, all of them; equal rows count as two documents. An empty table gives no rows; other columns are ignored.
    """
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM}")
    docs = texts(docs)
    hits = repeats(docs, length)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if keep_text else [])]

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in small(batches):
            texts_ = [open_.decompress(z.as_buffer()) for z in batch.column("z")]
            sizes = np.array([len(x) for x in texts_], np.int64)
            gone = covered(sizes, batch.column("spans"), length)
            rows, end = [], 0
            for doc, x in zip(batch.column("doc_id").to_pylist(), texts_, strict=True):
                own = gone[end : end + len(x)]
                end += len(x)
                kept = np.frombuffer(x, np.uint8)[~own].tobytes() if own.any() else x
                edges = np.count_nonzero(own[1:] & ~own[:-1]) + bool(len(own) and own[0])
                rows.append((doc, len(x), len(x) - len(kept), int(edges), hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return _same(_packed(docs), hits).select("doc_id", "z", "spans").mapInArrow(run, schema)
