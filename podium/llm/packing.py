"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths (at most `capacity` rows, so bounded)
reaches the driver. There whole combinations are planned on counts: for a piece of length L the gap is filled exactly by one, two
or three lengths whose sum equals it, looked up by that sum in hash indexes of single, pair and triple sums and taken as often as the counts
allow; what is left is packed best-fit, longest first. A plan is a list of (times, lengths): it has a few rows for each length whatever the
number of documents. Pieces then find their place by their rank among the pieces of their length: the rank in their task, counted as they
are cut and written with them, and how many the tasks before have. So no length's pieces are gathered or sorted, whatever their number.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import materialise, texts
from podium.llm.tokens import encoded


_KINDS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "task": pa.int32(), "at": pa.int64()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with the task that cut it and how many of the length it cut before (at).

    A null or empty text is the end id alone; a null doc_id stays null. The rows are to be written before they are used: at is theirs alone.
    """

    def cut(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, ids, ends in encoded(tokenizer, batches, end_id):
            sizes = np.diff(ends)
            many = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            raw, begin = memoryview(ids).cast("B"), 4 * (ends[doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order])
            at = np.empty(len(doc), np.int64)
            at[order] = np.arange(len(doc)) - first + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            cols = (batch.column("doc_id").take(pa.array(doc)), piece.astype(np.int32), start, length, crc, np.full(len(doc), task, np.int32), at)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS.values(), strict=True)], list(_KINDS))

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, at long")


class Sums:
    """Hash indexes of single, pair and triple sums of the lengths that are left, made when first asked for.

    An index maps a sum to its combinations in an order of their own. Counts only fall, so a combination that has run out is dropped from the
    front of its list for good, and a lookup goes on where the one before stopped: it never goes through the lengths again.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.looked = 0  # combinations looked at
        self._pairs: dict[int, list[int]] | None = None
        self._triples: dict[int, list[int]] | None = None

    def _grouped(self, sums: np.ndarray, values: np.ndarray) -> dict[int, list[int]]:
        """sum: its values, the largest last."""
        order = np.lexsort((values, sums))
        sums, values = sums[order], values[order]
        cuts = np.append(np.flatnonzero(np.diff(sums, prepend=-1)), len(sums))
        return {int(sums[a]): values[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)}

    def pairs(self) -> dict[int, list[int]]:
        """Sum: the shorter lengths of its pairs, the longest (and so the most even pair) last."""
        if self._pairs is None:
            there = np.flatnonzero(self.left)
            fits = [(low, there[(there >= low) & (there < len(self.left) - low)]) for low in there.tolist()]
            lows = np.concatenate([np.zeros(0, np.int64), *(np.full(len(h), low) for low, h in fits)])
            self._pairs = self._grouped(lows + np.concatenate([np.zeros(0, np.int64), *(h for _, h in fits)]), lows)
        return self._pairs

    def triples(self) -> dict[int, list[int]]:
        """Sum: the longest lengths of its triples, the longest last; what is missing is a pair's sum."""
        if self._triples is None:
            there, sums = np.flatnonzero(self.left), np.array(sorted(self.pairs()), np.int64)
            fits = [(c, sums[(sums <= 2 * c) & (sums < len(self.left) - c)]) for c in there.tolist()]
            longest = np.concatenate([np.zeros(0, np.int64), *(np.full(len(p), c) for c, p in fits)])
            self._triples = self._grouped(longest + np.concatenate([np.zeros(0, np.int64), *(p for _, p in fits)]), longest)
        return self._triples

    def _alive(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def single(self, gap: int, first: int) -> tuple[int, ...] | None:
        """The length that fills the gap beside `first`."""
        self.looked += 1
        return (gap,) if self._alive(gap, first) else None

    def pair(self, gap: int, *with_: int) -> tuple[int, ...] | None:
        """Two lengths that fill the gap beside the others; in a triple none is longer than the last of those."""
        found = self.pairs().get(gap, [])
        while found and not self._alive(found[-1], gap - found[-1]):
            found.pop()
            self.looked += 1
        for low in reversed(found):  # few are passed over: only those that need one of `with_` for themselves
            self.looked += 1
            if len(with_) > 1 and gap - low > with_[-1]:
                break
            if self._alive(low, gap - low, *with_):
                return gap - low, low
        return None

    def triple(self, gap: int, first: int) -> tuple[int, ...] | None:
        """Three lengths that fill the gap beside `first`."""
        found = self.triples().get(gap, [])
        while found:
            self.looked += 1
            longest = found[-1]
            if self._alive(first, longest) and (rest := self.pair(gap - longest, first, longest)):
                return (longest, *rest)
            found.pop()  # a gap belongs to one first length: what doesn't fit now never will
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths in a sequence) for all pieces; no sequence exceeds the capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    sums, out = Sums(left), []

    def take(lengths: tuple[int, ...]) -> None:
        use = Counter(lengths)
        times = min(int(left[k]) // n for k, n in use.items())
        for k, n in use.items():
            left[k] -= times * n
        out.append((times, lengths))

    if left[capacity]:
        take((capacity,))
    for find in (sums.single, sums.pair, sums.triple):
        for length in range(capacity - 1, 0, -1):
            while left[length] > 0 and (fill := find(capacity - length, length)):
                take((length, *fill))
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # open sequences by the room left
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            room = min((g for g in groups if g >= length), default=None)
            if room is None:
                fit = min(capacity // length, int(left[length]))
                times = int(left[length]) // fit
                left[length] -= times * fit
                groups.setdefault(capacity - fit * length, []).append((times, (length,) * fit))
                continue
            times, lengths = groups[room].pop()
            use = min(times, int(left[length]))
            if times > use:
                groups[room].append((times - use, lengths))
            if not groups[room]:
                del groups[room]
            left[length] -= use
            groups.setdefault(room - length, []).append((use, (*lengths, length)))
    return out + [x for g in groups.values() for x in g]


def places(made: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each length and run of ranks: its first sequence, how many of this length each sequence has, the offset of the first."""
    rows, ranks, sequence = [], Counter(), 0
    for times, lengths in made:
        offset = 0
        for length, n in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, ranks[length], sequence, n, offset))
            ranks[length] += times * n
            offset += n * length
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "n", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; a null doc_id stays null. Rows with equal doc_id, equal rows too, are packed each for itself;
    ties of equal lengths go by the order in which they were cut. Empty table: no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, capacity, end_id), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {int(r[0]): int(r[1]) for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    where = spark.sparkContext.broadcast(places(plan(counts, capacity)))  # some rows for each length at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    by_task = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))  # a row a task and length
    ranked = cut.join(by_task, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("rank"))

    def put(batches):
        w = where.value
        key = w["length"] << 44 | w["rank"]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "rank"))
            i = np.searchsorted(key, length << 44 | rank, side="right") - 1
            t = rank - w["rank"][i]
            own = {"sequence_id": w["sequence"][i] + t // w["n"][i], "offset": w["offset"][i] + t % w["n"][i] * length}
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, own.values())], [*batch.schema.names[:5], *own])

    return ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
