"""Truncated singular value decomposition of sparse rows, by a randomised range finder with subspace iterations.

Rows lie in blocks (compressed sparse rows of bounded size). A pass multiplies each block by a matrix of one column block, which has a row for each feature: of fixed size, whatever
the number of rows, and sent to all tasks; the first one is random and made by the tasks from a seed. Products are never kept: each pass makes them again.
An iteration is one pass: products with the rows and their transpose together, made orthonormal on the features' side. Blocks that are not too sparse are multiplied as dense slices
of bounded size, others entry by entry. In the end triangular factors meet by a tree of QR decompositions, first in a task, then some of them at a time. Only triangular factors, (k + spare) squared, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.session import written

#: Columns beyond the wanted ones, subspace iterations, entries of a block, and factors that meet in a task of the tree.
SPARE, ITERATIONS, ENTRIES, FAN = 30, 7, 50_000, 32
#: Rows and cells of a dense slice, and how many cells may lie there for each entry.
SLICE, CELLS, THIN = 256, 2_560_000, 150


@cache
def _random(seed: int, width: int, columns: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, columns))


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, "<f8").tobytes()], pa.binary())


def _packed(entries: DataFrame, key: str, width: int) -> DataFrame:
    """keys, ends, at, x: blocks of rows, of entries (key, j, x); equal places of a row are summed."""
    kept = entries.filter(F.col("j").between(0, width - 1) & F.col("x").isNotNull()).select(key, F.col("j").cast("int").alias("j"), F.col("x").cast("double").alias("x"))
    rows = kept.groupBy(key).agg(F.collect_list(F.struct("j", "x")).alias("e")).select(key, F.col("e.j").alias("at"), F.col("e.x").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("at").value_lengths().to_numpy())
            first = 0
            while first < batch.num_rows:
                done = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + ENTRIES, side="right")))
                part = batch.slice(first, last - first)
                at, x = (part.column(c).flatten().to_numpy() for c in ("at", "x"))
                row = np.repeat(np.arange(len(part)), np.diff(ends[first:last], prepend=done))
                cells, same = np.unique(row * width + at, return_inverse=True)
                keys = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(key))
                counts = np.bincount(cells // width, minlength=len(part))
                yield pa.RecordBatch.from_arrays([keys, _binary(np.cumsum(counts)), _binary(cells % width), _binary(np.bincount(same, x))], ["keys", "ends", "at", "x"])
                first = last

    return rows.mapInArrow(run, f"keys array<{dict(entries.dtypes)[key]}>, ends binary, at binary, x binary")


def _factor(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x, mode="r")


def _whitening(r: np.ndarray) -> np.ndarray:
    """The matrix that makes a table's columns orthonormal, given its triangular factor; columns without rank become 0."""
    _, s, vt = np.linalg.svd(r)
    keep = s > 1e-12 * max(s[0], 1e-300)
    return vt.T * np.where(keep, 1 / np.where(keep, s, 1), 0)


class _Block:
    """Rows of a block: row, at, x of their entries, and products with them."""

    def __init__(self, ends: np.ndarray, at: np.ndarray, x: np.ndarray, buffer: np.ndarray):
        self.n, self.at, self.x, self.buffer = len(ends), at, x, buffer
        self.bounds = np.append(0, ends)
        self.row = np.repeat(np.arange(self.n), np.diff(self.bounds))
        self.dense = len(at) * THIN > self.n * buffer.shape[1]

    def slices(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Places of some rows, and these rows in the buffer, which is empty before and after."""
        size, width = self.buffer.shape
        for a in range(0, self.n, size):
            b = min(a + size, self.n)
            part = slice(self.bounds[a], self.bounds[b])
            cells = (self.row[part] - a) * width + self.at[part]
            self.buffer.reshape(-1)[cells] = self.x[part]
            yield slice(a, b), self.buffer[: b - a]
            self.buffer.reshape(-1)[cells] = 0

    def times(self, m: np.ndarray) -> np.ndarray:
        if self.dense:
            return np.concatenate([d @ m for _, d in self.slices()])
        return np.add.reduceat(m[self.at] * self.x[:, None], self.bounds[:-1], axis=0)

    def add_turned(self, z: np.ndarray, m: np.ndarray, left: np.ndarray | None) -> None:
        """Adds the rows' transpose times their product with m (and left) to z."""
        m = m if left is None else m @ left
        if self.dense:
            for _, d in self.slices():
                z += d.T @ (d @ m)
        else:
            order = np.argsort(self.at, kind="stable")
            places, first = np.unique(self.at[order], return_index=True)
            z[places] += np.add.reduceat(self.times(m)[self.row[order]] * self.x[order][:, None], first, axis=0)


class Decomposition:
    def __init__(self, entries: DataFrame, key: str, width: int, k: int, seed: int = 0):
        self.key, self.kind, self.width, self.seed = key, dict(entries.dtypes)[key], width, seed
        self.spark = entries.sparkSession
        self.k, self.columns = k, min(width, k + SPARE)
        self.blocks = written(_packed(entries, key, width), "sparse")
        self.right: DataFrame | None = None  # a row: the matrix of the next pass; None: the random one

    def _pass(self, work: Callable, schema: str) -> DataFrame:
        """work(blocks' keys, block, matrix) of each block, in tasks."""
        width, columns, seed = self.width, self.columns, self.seed
        first = self.right is None
        rows = self.blocks if first else self.blocks.crossJoin(F.broadcast(self.right))

        def products(batches: Iterator[pa.RecordBatch]):
            m = _random(seed, width, columns) if first else None
            buffer = np.zeros((max(1, min(SLICE, CELLS // width)), width))
            for batch in batches:
                for i in range(batch.num_rows):
                    read = lambda c: np.frombuffer(batch.column(c)[i].as_buffer())  # noqa: B023, E731
                    m = read("m").reshape(width, columns) if m is None else m  # one matrix in all rows
                    ends, at, x = read("ends").astype(int), read("at").astype(int), read("x")
                    yield batch.column("keys")[i].values, _Block(ends, at, x, buffer), m

        return rows.mapInArrow(lambda batches: work(products(batches)), schema)

    def _joined(self, factors: DataFrame) -> np.ndarray:
        """The triangular factor of all, by a tree: some factors at a time."""
        columns = self.columns

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = np.zeros((0, columns))
            for batch in batches:
                for x in batch.column("r"):
                    r = _factor(np.vstack([r, np.frombuffer(x.as_buffer()).reshape(-1, columns)]))
            yield pa.RecordBatch.from_arrays([_binary(r)], ["r"])

        factors = written(factors, "factors")
        n = factors.count()
        while n > FAN:
            n = -(-n // FAN)
            factors = written(factors.repartition(n).mapInArrow(meet, "r binary"), "factors")
        r = np.zeros((0, columns))
        for row in factors.collect():  # FAN at most, (k + spare) squared each
            r = np.vstack([r, np.frombuffer(row["r"]).reshape(-1, columns)])
        out = np.zeros((columns, columns))
        r = _factor(r) if len(r) else out
        out[: len(r)] = r
        return out

    def left_factor(self) -> np.ndarray:
        """The triangular factor of rows times the matrix."""
        columns = self.columns

        def work(products):
            r = np.zeros((0, columns))
            for _, block, m in products:
                r = _factor(np.vstack([r, block.times(m)]))
            yield pa.RecordBatch.from_arrays([_binary(r)], ["r"])

        return self._joined(self._pass(work, "r binary"))

    def turned(self, left: np.ndarray | None = None) -> DataFrame:
        """j, z: the rows' transpose times their product with the matrix (and left, which makes it orthonormal); sums are made in tasks, then by feature."""
        width, columns = self.width, self.columns

        def work(products):
            z, met = np.zeros((width, columns)), np.zeros(width, bool)
            for _, block, m in products:
                block.add_turned(z, m, left)
                met[block.at] = True
            j = np.flatnonzero(met)
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), *(pa.array(z[j, c]) for c in range(columns))], ["j", *(f"z{c}" for c in range(columns))])

        sums = self._pass(work, "j int, " + ", ".join(f"z{c} double" for c in range(columns)))
        sums = sums.groupBy("j").agg(*(F.sum(f"z{c}").alias(f"z{c}") for c in range(columns)))
        return written(sums.select("j", F.array(*(f"z{c}" for c in range(columns))).alias("z")), "turned")

    def placed(self, turned: DataFrame) -> DataFrame:
        """The table of features, its columns made orthonormal, as the matrix of the next pass: one row of fixed size."""
        width, columns = self.width, self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = np.zeros((width, columns))
            for batch in batches:
                if batch.num_rows:
                    m[batch.column("j").to_numpy()] = batch.column("z").flatten().to_numpy().reshape(-1, columns)
            yield pa.RecordBatch.from_arrays([_binary(np.linalg.qr(m / max(np.abs(m).max(), 1e-300))[0])], ["m"])

        return written(turned.coalesce(1).mapInArrow(run, "m binary"), "matrix")

    def solve(self) -> tuple[np.ndarray, DataFrame, DataFrame]:
        """(singular values, rows' features: key, features; features' directions: j, direction), k of each: features are left vectors times values."""
        columns, k = self.columns, self.k
        for _ in range(ITERATIONS):
            self.right = self.placed(self.turned())
        left = _whitening(self.left_factor())
        turned = self.turned(left)

        def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = np.zeros((0, columns))
            for batch in batches:
                if batch.num_rows:
                    r = _factor(np.vstack([r, batch.column("z").flatten().to_numpy().reshape(-1, columns)]))
            yield pa.RecordBatch.from_arrays([_binary(r)], ["r"])

        r = self._joined(turned.mapInArrow(factors, "r binary"))
        u, s, vt = np.linalg.svd(r.T)  # of the small matrix: u turns the orthonormal product, vt the features
        sign = np.where(np.take_along_axis(u, np.abs(u).argmax(axis=0)[None], axis=0)[0] < 0, -1, 1)
        u, s, v = (u * sign)[:, :k], s[:k], (vt.T * sign)[:, :k]
        key, to_features = self.key, left @ u * s

        def work(products):
            for keys, block, m in products:
                f = block.times(m) @ to_features
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * f.shape[1], pa.int32()), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([keys, values], [key, "features"])

        rows = self._pass(work, f"`{self.key}` {self.kind}, features array<double>")
        inverse = np.linalg.pinv(r) @ v

        def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = batch.column("z").flatten().to_numpy().reshape(-1, columns) @ inverse
                yield pa.RecordBatch.from_arrays([batch.column("j"), pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))], ["j", "direction"])

        return s, rows, turned.mapInArrow(directions, "j int, direction array<double>")


def truncated(entries: DataFrame, key: str, width: int, k: int, seed: int = 0) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """(k singular values, key and features of each row, j and direction of each feature that occurs) of a sparse table of entries (key, j, x), j from 0 below
    width. Rows without an entry are no rows; a null value is no entry; fewer values than k where the width is less. Reruns with one seed agree up to rounding."""
    return Decomposition(entries, key, width, min(k, width), seed).solve()
