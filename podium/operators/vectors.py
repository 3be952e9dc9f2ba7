"""Vector operators: centroids, nearest samples, neighbours, clusterings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.scalars import cosine_distance, squared_distance
from podium.session import written


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, centroid: mean vectors, by partial sums of each dimension."""
    dims = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return dims.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_to_centroid(df: DataFrame, label: str, vector: str, name: str) -> DataFrame:
    """label, best (the name nearest to the label's centroid, ties by name), distance (squared)."""
    both = df.join(centroids(df, label, vector), label).withColumn("distance", F.round(squared_distance(vector, "centroid"), 9))
    return both.groupBy(label).agg(F.min(F.struct("distance", name)).alias("b")).select(label, F.col(f"b.{name}").alias("best"), "b.distance")


#: Rows of a side that is sent to all tasks at once.
BLOCK = 10_000


def in_blocks(side: DataFrame, key: str, most: int = BLOCK) -> list[DataFrame]:
    """side, written once and counted, in as many parts by a hash of its key as keep one at about `most` rows; each is marked to be sent to all tasks."""
    side = written(side, "blocks")
    n = -(-side.count() // most) or 1
    return [F.broadcast(side.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else side) for i in range(n)]


def assigned(df: DataFrame, centers: DataFrame, vector: str, name: str, block: int = BLOCK) -> DataFrame:
    """name, cluster, distance: the nearest of the given centers (cluster, centroid). Many centers are sent to the rows block by block; a block
    leaves one center a row."""

    def nearest(part: DataFrame) -> DataFrame:
        both = df.select(name, vector).crossJoin(part).withColumn("distance", F.round(squared_distance(vector, "centroid"), 9))
        return both.groupBy(name).agg(F.min(F.struct("distance", "cluster")).alias("b"))

    parts = [nearest(x) for x in in_blocks(centers.select("cluster", "centroid"), "cluster", block)]
    best = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy(name).agg(F.min("b").alias("b"))
    return best.select(name, "b.cluster", "b.distance")


def kmeans(df: DataFrame, vector: str, k: int = 20, seed: int = 0, max_iter: int = 20):
    """(df with cluster, model): k-means; the model has centers and the training cost."""
    rows = df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("_features"), model


def first_nearest(distance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each row's nearest column, of equal ones the first: what rounding may part, given the sizes that the distances were made of, is equal."""
    return (distance <= distance.min(axis=1)[:, None] + 1e-12 * size).argmax(axis=1)


def kmeans_labels(x: np.ndarray, k: int = 20, seed: int = 0, max_iter: int = 20) -> np.ndarray:
    """k-means of one part's rows, first centers by k-means++: each row's cluster (of equally near ones the first), at most as many as there are different rows."""
    rng, size = np.random.default_rng(seed), (x**2).sum(axis=1)
    apart = lambda c: np.maximum(size[:, None] - 2 * x @ c.T + (c**2).sum(axis=1), 0)
    own = lambda c: first_nearest(apart(c), size[:, None] + (c**2).sum(axis=1))
    exact = lambda c: ((x - c) ** 2).sum(axis=1)  # noqa: E731  equal rows are 0 apart
    centers = x[[rng.integers(len(x))]]
    nearest = exact(centers[0])
    while len(centers) < k and nearest.sum() > 0:
        centers = np.vstack([centers, x[rng.choice(len(x), p=nearest / nearest.sum())]])
        nearest = np.minimum(nearest, exact(centers[-1]))
    label = own(centers)
    for _ in range(max_iter):
        n = np.bincount(label, minlength=len(centers))
        sums = np.stack([x[label == c].sum(axis=0) for c in range(len(centers))])
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        was, label = label, own(centers)
        if np.array_equal(was, label):
            break
    return label


def kmeans_by(df: DataFrame, by: str, vector: str, name: str, k: int = 20, **options) -> DataFrame:
    """by, name, cluster_id: k-means in each part, with centers of its own."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(name)
        _, cluster = np.unique(kmeans_labels(np.stack(part[vector].to_numpy()).astype(float), k, **options), return_inverse=True)
        return pd.DataFrame({by: part[by].to_numpy(), name: part[name].to_numpy(), "cluster_id": cluster.astype("int64")})

    kinds = dict(df.dtypes)
    return df.select(by, name, vector).groupBy(by).applyInPandas(kernel, f"`{by}` {kinds[by]}, `{name}` {kinds[name]}, cluster_id long")


def cost_by_k(df: DataFrame, vector: str, ks: list[int], seed: int = 0) -> DataFrame:
    """k, cost: the elbow's curve."""
    rows = df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>"))).select("_features").cache()
    try:
        found = [(k, float(KMeans(k=k, seed=seed, featuresCol="_features").fit(rows).summary.trainingCost)) for k in ks]
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(found, "k int, cost double")


def best_samples(clustered: DataFrame, vector: str, name: str) -> DataFrame:
    return nearest_to_centroid(clustered, "cluster", vector, name)


#: Rows of a block of similarities, and how many of a row's next similarities are kept at first.
AFFINITY_ROWS, AFFINITY_NEXT = 256, 32


def _similarities(x: np.ndarray, preference: float) -> Iterator[tuple[int, np.ndarray]]:
    """first row, similarities of a block of rows to all: negative squared distances, the preference on the diagonal, with noise, as ties would oscillate."""
    n, size, rng = len(x), (x**2).sum(axis=1), np.random.default_rng(0)
    for at in range(0, n, AFFINITY_ROWS):
        own = np.arange(at, min(n, at + AFFINITY_ROWS))
        s = np.minimum(2 * x[own] @ x.T - size[own, None] - size[None, :], 0)
        s[own - at, own] = preference
        yield at, s + 1e-12 * rng.standard_normal(s.shape) * np.abs(s)


class _Next:
    """The largest similarities of each row that are less than its own to itself, from the largest down: as many as were asked for, more where they didn't do."""

    def __init__(self, x: np.ndarray, preference: float):
        self.x, self.preference = x, preference
        self.wide = np.full(len(x), AFFINITY_NEXT)
        self.links: list | None = []  # filled by the first pass
        self._read(np.arange(len(x)))
        self.row, self.col, self.s = (np.concatenate(c) for c in zip(*self.links, strict=True))
        self.links = None

    def _read(self, wanted: np.ndarray) -> None:
        """The lists of the wanted rows; the links on the first pass."""
        own, n, lists = np.zeros(len(self.x), bool), len(self.x), {}
        own[wanted] = True
        for at, s in _similarities(self.x, self.preference):
            rows = np.arange(at, at + len(s))
            linked = s >= s[rows - at, rows][:, None]
            if self.links is not None:
                row, col = np.nonzero(linked)
                self.links.append((row + at, col, s[row, col]))
            s[linked] = -np.inf
            for i in np.flatnonzero(own[rows]):
                most = min(n, int(self.wide[at + i]))
                k = np.argpartition(-s[i], most - 1)[:most]
                k = k[np.argsort(-s[i][k], kind="stable")]
                lists[at + i] = k[np.isfinite(s[i][k])], s[i][k][np.isfinite(s[i][k])]
        if self.links is not None:
            self.k, self.v = zip(*(lists[i] for i in range(n)), strict=True)
            self.k, self.v = list(self.k), list(self.v)
        for i, (k, v) in lists.items():
            self.k[i], self.v[i] = k, v
        sizes = np.array([len(k) for k in self.k])
        self.start = np.cumsum(sizes) - sizes
        self.sizes, self.flat_k, self.flat_v = sizes, np.concatenate(self.k), np.concatenate(self.v)
        self.rest = np.array([v[-1] if len(v) == w and w < n else -np.inf for v, w in zip(self.v, self.wide, strict=True)])

    def best(self, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
        """The largest a + similarity of each row's not linked ones, a at most 0; what lies behind a list has no more than its last similarity."""
        while True:
            size = self.sizes[rows]
            out = np.full(len(rows), -np.inf)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[rows], size)
            value = a[self.flat_k[at]] + self.flat_v[at]
            if len(value):
                full = size > 0
                out[full] = np.maximum.reduceat(value, (np.cumsum(size) - size)[full])
            short = rows[out < self.rest[rows]]
            if not len(short):
                return out
            self.wide[short] *= 8
            self._read(short)


def affinity_labels(x: np.ndarray, preference: float = -8.0, damping: float = 0.72, max_iter: int = 1000, steady: int = 15, most: int | None = None) -> np.ndarray:
    """Affinity propagation by message passing, similarity the negative squared distance: each row's exemplar's row.

    Only pairs at least as similar as a row is to itself (links) have messages of their own: another pair's responsibility is below 0 from the first step on, so
    it adds nothing to an availability, which is then one number for all such pairs of a column; and it is never a row's largest sum. What
    it can be is the second largest, which is looked up from the most similar down. So the result is that of all messages, and memory goes with the links.
    With more than `most` links it raises.
    """
    n = len(x)
    if n <= 1:
        return np.arange(n)
    rest = _Next(x, preference)
    row, col, s = rest.row, rest.col, rest.s
    if most is not None and len(row) > most:
        raise ValueError(f"{len(row)} links in one part; affinity propagation takes {most} at most")
    first, diag = np.searchsorted(row, np.arange(n)), np.flatnonzero(row == col)
    r, a, free, rows = np.zeros(len(row)), np.zeros(len(row)), np.zeros(n), np.arange(n)
    same, was = 0, None
    for _ in range(max_iter):
        t = a + s
        top = np.maximum.reduceat(t, first)
        hit = np.flatnonzero(t == top[row])
        best = hit[np.searchsorted(row[hit], rows)]  # of equal ones the first
        t[best] = -np.inf
        second = np.maximum.reduceat(t, first)
        # an unlinked pair has no more than the row's own similarity, so it matters only where no link has as much
        ask = np.flatnonzero(second < s[diag])
        second[ask] = np.maximum(second[ask], rest.best(ask, free))
        new = s - top[row]
        new[best] = s[best] - second
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        p[diag] = r[diag]
        sums = np.bincount(col, p, n)
        new = sums[col] - p
        own = new[diag].copy()
        new = np.minimum(new, 0)
        new[diag] = own
        a = damping * a + (1 - damping) * new
        free = damping * free + (1 - damping) * np.minimum(sums, 0)
        chosen = np.flatnonzero(a[diag] + r[diag] > 0)
        same = same + 1 if was is not None and np.array_equal(chosen, was) else 0
        was = chosen
        if same >= steady and len(chosen):
            break
    if not len(was):
        return np.zeros(n, np.int64)
    label = np.concatenate([was[part[:, was].argmax(axis=1)] for _, part in _similarities(x, preference)])
    label[was] = was
    return label


def affinity(df: DataFrame, by: str, vector: str, name: str, most: int = 3000, **options) -> DataFrame:
    """by, name, exemplar, cluster_id: affinity propagation in each part. A part of any number of rows is taken whole by one task, which keeps its vectors and
    its links; where these are more than most x most it raises."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(name)
        label = affinity_labels(np.stack(part[vector].to_numpy()).astype(float), most=most * most, **options)
        _, cluster = np.unique(label, return_inverse=True)
        return pd.DataFrame({by: part[by].to_numpy(), name: part[name].to_numpy(), "exemplar": part[name].to_numpy()[label], "cluster_id": cluster.astype("int32")})

    kinds = dict(df.dtypes)
    return df.select(by, name, vector).groupBy(by).applyInPandas(kernel, f"`{by}` {kinds[by]}, `{name}` {kinds[name]}, exemplar {kinds[name]}, cluster_id int")


def cluster_slides(df: DataFrame, method: str, order: str, vector: str, by: str | None = None, num_centroids: int = 20, **options) -> DataFrame:
    """df's order with cluster_id, by one of the ways: segment, kmeans, normal (affinity propagation), in each part where `by` is given."""
    from podium.operators.ordered import segment_clusters

    if method == "segment":
        return segment_clusters(df, order, vector, by=[by] if by else None, **options).select(*([by] if by else []), order, "cluster_id")
    if method == "kmeans" and by:
        return kmeans_by(df, by, vector, order, num_centroids, **options)
    if method == "kmeans":
        return kmeans(df, vector, num_centroids, **options)[0].select(order, F.col("cluster").cast("long").alias("cluster_id"))
    if method == "normal":
        return affinity(df, by, vector, order, **options).select(by, order, F.col("cluster_id").cast("long").alias("cluster_id"))
    raise ValueError(f"unknown method {method}; there are segment, kmeans, normal")


def ratio_matches(queries: DataFrame, items: DataFrame, query: str, item: str, vector: str, ratio: float = 0.7) -> DataFrame:
    """query, item, d1, d2: the nearest item where it is nearer than `ratio` times the second; an item of the query's own name is none."""
    from podium.operators.neighbours import nearest

    two = nearest(queries, items, query, item, vector, k=2, skip_same=True)
    first = F.col("rank") == 1
    both = two.groupBy("query").agg(F.max(F.when(first, F.col("item"))).alias("item"), F.max(F.when(first, F.col("distance"))).alias("d1"), F.max(F.when(~first, F.col("distance"))).alias("d2"))
    return both.filter(F.col("d1") < ratio * F.col("d2"))


#: Rows of a block of vectors that meets other blocks, and of the part of it that is compared at once.
PAIR_BLOCK, PAIR_ROWS = 8192, 1024


def near_pairs(df: DataFrame, vector: str, name: str, distance: float, block: int = PAIR_BLOCK) -> DataFrame:
    """a, b, distance: all pairs nearer than a distance, a before b. Exact.

    In many dimensions neither buckets nor pivots leave much out, so blocks of rows meet, each two of them once, in a product of matrices of bounded size. Rows
    without a name, a vector or with a null or non-finite component take no part.
    """
    from podium.operators.neighbours import _distances, _matrix, _sound

    rows = written(df.filter(F.col(name).isNotNull() & _sound(F.col(vector))).select(F.col(name).alias("id"), F.col(vector).alias("v")), "pairs")
    n = -(-rows.count() // block) or 1
    dealt = rows.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("i").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select("i", F.col("rows.id").alias("ids"), F.col("rows.v").alias("vs"))
    dealt = written(dealt, "blocks")
    there = dealt.select(F.col("i").alias("j"), F.col("ids").alias("js"), F.col("vs").alias("ws"))
    both = dealt.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(n - 1)))).join(there.hint("shuffle_hash"), "j").repartition(n * (n + 1) // 2, "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, js = batch.column("ids")[k].values, batch.column("js")[k].values
                x, y = _matrix(batch.column("vs")[k].values), _matrix(batch.column("ws")[k].values)
                same = batch.column("i")[k].as_py() == batch.column("j")[k].as_py()
                for at in range(0, len(x), PAIR_ROWS):
                    d = _distances(x[at : at + PAIR_ROWS], y)
                    row, col = np.nonzero(d <= distance * (1 + 1e-6) + 1e-6)
                    row = row + at
                    if same:
                        row, col = row[row < col], col[row < col]
                    exact = np.sqrt(((x[row] - y[col]) ** 2).sum(axis=1))
                    near = exact < distance
                    row, col = row[near], col[near]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), js.take(pa.array(col)), pa.array(exact[near])], ["a", "b", "distance"])

    kind = dict(df.dtypes)[name]
    found = both.select("i", "j", "ids", "vs", "js", "ws").mapInArrow(run, f"a {kind}, b {kind}, distance double")
    return found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def document_similarity(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """key, similarity: cosine of the mean vectors of two sets of rows."""
    x, y = centroids(a, key, vector), centroids(b, key, vector).withColumnRenamed("centroid", "_other")
    return x.join(y, key).select(key, (1 - cosine_distance("centroid", "_other")).alias("similarity"))


def svm_threshold(df: DataFrame, value: str, label: str, max_iter: int = 100) -> float:
    """The value at which a linear support-vector classifier on one number changes its mind."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[value], outputCol="_f").transform(df.select(F.col(value).cast("double").alias(value), F.col(label).cast("double").alias(label)))
    model = LinearSVC(featuresCol="_f", labelCol=label, maxIter=max_iter, regParam=0.01).fit(rows)
    return float(-model.intercept / model.coefficients[0])

