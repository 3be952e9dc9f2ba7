"""k-means by mini-batches: each row moves its center once, by a rate of one over the rows that the center has had."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.operators.vectors import first_nearest, kmeans_labels
from podium.session import new_folder

#: Rows of the first batch, a bounded sample by a hash, on which the first centers are fitted; rows of a local batch.
FIRST, BATCH = 4000, 256


def moved(centers: np.ndarray, had: np.ndarray, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centers and what they have had, after a batch with these sums and numbers of rows."""
    had = had + n
    return centers + (sums - n[:, None] * centers) / np.maximum(had, 1)[:, None], had


class Sparse:
    """Rows of (row, place, value) entries, by row; products and sums without a full matrix."""

    def __init__(self, row: np.ndarray, at: np.ndarray, x: np.ndarray, n: int, width: int):
        order = np.argsort(row, kind="stable")
        self.row, self.at, self.x, self.n, self.width = row[order], at[order], x[order], n, width
        self.bounds = np.searchsorted(self.row, np.arange(n + 1))

    def taken(self, rows: np.ndarray) -> Sparse:
        size = self.bounds[rows + 1] - self.bounds[rows]
        own = np.repeat(np.arange(len(rows)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bounds[rows], size)
        return Sparse(own, self.at[at], self.x[at], len(rows), self.width)

    def full(self) -> np.ndarray:
        return np.bincount(self.row * self.width + self.at, self.x, self.n * self.width).reshape(self.n, self.width)

    def packed(self) -> tuple[Sparse, np.ndarray]:
        """The rows on only those places that they have, and the places: others are 0 in all rows and in all means of rows."""
        places, at = np.unique(self.at, return_inverse=True)
        return Sparse(self.row, at, self.x, self.n, max(1, len(places))), places

    def nearest(self, centers: np.ndarray) -> np.ndarray:
        """The nearest center of each row, the first of equally near ones, by c c - 2 x c."""
        far, size = np.zeros((self.n, len(centers))), (centers**2).sum(axis=1)
        for k, c in enumerate(centers):
            far[:, k] = size[k] - 2 * np.bincount(self.row, self.x * c[self.at], self.n)
        return first_nearest(far, np.bincount(self.row, self.x**2, self.n)[:, None] + size)

    def sums(self, label: np.ndarray, k: int) -> np.ndarray:
        return np.bincount(label[self.row] * self.width + self.at, self.x, k * self.width).reshape(k, self.width)


def labels(rows: Sparse, k: int, seed: int = 0, batch: int = BATCH) -> np.ndarray:
    """Clusters of one part's sparse rows: first centers from the first batch, one pass over dealt batches, then each row's nearest center.

    Matrices have the places that the rows have (the first batch's own for its fit), so their size goes with the text and not with the width of the hash."""
    rows, _ = rows.packed()
    order = np.random.default_rng(seed).permutation(rows.n)
    first = rows.taken(order[:batch])
    own, places = first.packed()
    dense = own.full()
    label = kmeans_labels(dense, min(k, first.n), seed)
    n = np.bincount(label)
    centers = np.zeros((len(n), rows.width))
    centers[:, places] = np.stack([dense[label == c].mean(axis=0) if n[c] else dense[0] for c in range(len(n))])[:, : len(places)]
    had = n.astype(float)
    for at in range(batch, rows.n, batch):
        part = rows.taken(order[at : at + batch])
        own = part.nearest(centers)
        centers, had = moved(centers, had, part.sums(own, len(centers)), np.bincount(own, minlength=len(centers)))
    return rows.nearest(centers)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (2 * x @ centers.T - (centers**2).sum(axis=1)).argmax(axis=1)


def kmeans(df: DataFrame, vector: str, k: int = 20, seed: int = 0, batches: int = 10) -> tuple[DataFrame, np.ndarray, float]:
    """(df with cluster, centers, cost): mini-batch k-means of a table of dense vectors of one length, in one pass.

    Rows are dealt to batches by a hash and written so that each batch is read once; a batch's sums, a row a cluster, are what reaches the driver. The first
    centers come from at most FIRST rows of the first batch. The cost is the sum of squared distances. Rows with a null vector get no cluster.
    """
    spark = df.sparkSession
    v = F.col(vector).cast("array<double>")
    path = new_folder(spark, "batches")
    df.filter(F.col(vector).isNotNull()).select(v.alias("v"), F.pmod(F.xxhash64(vector, F.lit(seed)), F.lit(batches)).cast("int").alias("batch")).write.partitionBy("batch").parquet(path)
    rows = spark.read.schema("v array<double>, batch int").parquet(path)
    sample = np.array([r["v"] for r in rows.orderBy("batch", F.xxhash64("v")).limit(FIRST).select("v").collect()], float)
    if not len(sample):
        return df.withColumn("cluster", F.lit(None).cast("int")), sample, 0.0
    label = kmeans_labels(sample, k, seed)
    centers = np.stack([sample[label == c].mean(axis=0) for c in np.unique(label)])
    had, d = np.zeros(len(centers)), sample.shape[1]
    names = [f"s{i}" for i in range(d)]
    for b in range(batches):
        found = _assigned_sums(rows.filter(F.col("batch") == b), centers, names).groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in [*names, "cost"])).collect()  # a row a cluster
        n, sums = np.zeros(len(centers)), np.zeros_like(centers)
        for r in found:
            n[r["cluster"]], sums[r["cluster"]] = r["n"], [r[c] for c in names]
        centers, had = moved(centers, had, sums, n)
    cost = _assigned_sums(rows, centers, names).agg(F.sum("cost")).first()[0]
    at = centers

    @F.pandas_udf("int")
    def cluster(x):
        known = x.notna()
        out = x.map(lambda _: None).astype("Int32")
        if known.any():
            out[known] = _nearest(np.stack(x[known].to_numpy()).astype(float), at)
        return out

    return df.withColumn("cluster", cluster(v)), centers, float(cost)


def _assigned_sums(rows: DataFrame, centers: np.ndarray, names: list[str]) -> DataFrame:
    """cluster, n, sums, cost of the rows of each task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cost = np.zeros(len(centers), np.int64), np.zeros_like(centers), np.zeros(len(centers))
        for part in parts:
            if part.num_rows:
                x = _matrix(part.column("v"))
                own = _nearest(x, centers)
                n += np.bincount(own, minlength=len(centers))
                np.add.at(sums, own, x)
                np.add.at(cost, own, ((x - centers[own]) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n), *(pa.array(sums[:, i]) for i in range(sums.shape[1])), pa.array(cost)], ["cluster", "n", *names, "cost"])

    return rows.select("v").mapInArrow(run, "cluster int, n long, " + "".join(f"{c} double, " for c in names) + "cost double")
