"""Exact nearest neighbours by pivots.

Items lie in the cell of their nearest pivot (a bounded number of items, chosen by a hash). A query first visits the cells of its nearest pivots until they hold k items, which
bounds the distance of its k-th neighbour; then it visits those further cells that the triangle inequality does not rule out: a cell whose items are
between r and R from their pivot, at D from the query, holds nothing nearer than D - R, r - D, or half of what D exceeds the distance of the nearest pivot.
Cells and the queries that visit them are dealt in blocks of bounded size and meet by an equi-join on the cell, so a hot cell is many blocks. Blocks give
their own k best; no list of a query's distances is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.session import written

#: Pivots at most, and rows of a block of items or queries.
PIVOTS, BLOCK = 1024, 2048
#: What rounding may take from a bound, in parts of the distances it is made of.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1), 0))


class Pivots:
    """Pivots of a table of items (id, v), and what is known of their cells: n, least and largest distance."""

    def __init__(self, items: DataFrame, most: int = PIVOTS):
        n = items.count()
        wanted = max(1, min(most, math.isqrt(n)))
        picked = items.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()
        self.at = np.unique(np.array([r["v"] for r in picked], float), axis=0) if picked else np.zeros((0, 0))
        at = self.at

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(k, BLOCK)
                    d = _distances(_matrix(part.column("v")), at)
                    cell = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], [*part.schema.names, "cell", "far"])

        if not picked:
            return
        kind = dict(items.dtypes)["id"]
        self.items = written(items.select("id", "v").mapInArrow(run, f"id {kind}, v array<double>, cell int, far double"), "cells")
        known = {r["cell"]: r for r in self.items.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}  # a row a pivot
        self.n, self.low, self.high = (np.array([known[c][k] if c in known else 0 for c in range(len(at))]) for k in ("n", "low", "high"))

    def first(self, d: np.ndarray, k: int) -> np.ndarray:
        """Of each query's distances to the pivots: the cells that it visits first."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & (self.n > 0)

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """The least distance that an item of each cell may have."""
        side = (d - d.min(axis=1, keepdims=True)) / 2
        return np.maximum.reduce([d - self.high, self.low - d, side]) - SLACK * (1 + d + self.high)

    def routes(self, queries: DataFrame, k: int, limit: bool) -> DataFrame:
        """q, v, cell: the cells that each query (q, v; with `limit` also far, the distance of its k-th so far) visits first, or then."""
        me = self._small()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    d = _distances(_matrix(part.column("v")), me.at)
                    go = me.first(d, k)
                    if limit:
                        far = part.column("far").fill_null(math.inf).to_numpy(zero_copy_only=False)
                        go = ~go & (me.n > 0) & (me.bounds(d) <= far[:, None])
                    row, cell = np.nonzero(go)
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column("q").take(row), part.column("v").take(row), pa.array(cell, pa.int32())], ["q", "v", "cell"])

        return queries.mapInArrow(run, f"q {dict(queries.dtypes)['q']}, v array<double>, cell int")

    def _small(self) -> Pivots:
        """What tasks need: no tables."""
        out = object.__new__(Pivots)
        out.at, out.n, out.low, out.high = self.at, self.n, self.low, self.high
        return out


def _blocks(df: DataFrame, id: str, sizes: dict[int, int]) -> DataFrame:
    """cell, ids, vs: rows of a cell in blocks of about BLOCK, dealt by a hash of the id."""
    parts = F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, -(-n // BLOCK)))) if sizes else F.lit(None).cast("map<int,int>")
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(id), parts[F.col("cell")]))
    rows = dealt.groupBy("cell", "_part").agg(F.collect_list(F.struct(F.col(id).alias("id"), "v")).alias("rows"))
    return rows.select("cell", F.col("rows.id").alias("ids"), F.col("rows.v").alias("vs"))


def _met(routes: DataFrame, items: DataFrame, sizes: dict[int, int], k: int, skip: bool) -> DataFrame:
    """q, id, d: the k best of each query in each block of a cell that it visits.

    The join is never a broadcast: a query's vector is in the routes once a cell, which files store so well that Spark takes them for small, and the driver would gather them all.
    """
    asked = {r["cell"]: r["n"] for r in routes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    both = _blocks(items, "id", sizes).join(_blocks(routes, "q", asked).select("cell", F.col("ids").alias("qs"), F.col("vs").alias("ws")).hint("merge"), "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, qs = batch.column("ids")[i].values, batch.column("qs")[i].values
                x, w = (_matrix(batch.column(c)[i].values) for c in ("vs", "ws"))
                d = _distances(w, x)
                if skip:
                    own = {v: n for n, v in enumerate(ids.to_pylist())}
                    for n, q in enumerate(qs.to_pylist()):
                        if q in own:
                            d[n, own[q]] = math.inf
                most = min(k, d.shape[1])
                limit = np.partition(d, most - 1, axis=1)[:, most - 1]
                row, at = np.nonzero((d <= limit[:, None] * (1 + 1e-6) + 1e-6) & np.isfinite(d))
                exact = np.sqrt(((w[row] - x[at]) ** 2).sum(axis=1))
                name = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
                order = np.lexsort((name[at], exact, row))
                row, at, exact = row[order], at[order], exact[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, at, exact = (a[place < k] for a in (row, at, exact))
                yield pa.RecordBatch.from_arrays([qs.take(pa.array(row)), ids.take(pa.array(at)), pa.array(exact)], ["q", "id", "d"])

    return both.mapInArrow(run, f"q {dict(routes.dtypes)['q']}, id {dict(items.dtypes)['id']}, d double")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _sound(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def nearest(queries: DataFrame, items: DataFrame, query: str, item: str, vector: str, k: int = 1, skip_same: bool = False, pivots: int = PIVOTS, visits: list | None = None) -> DataFrame:
    """query, item, distance, rank (from 1): the k nearest items of each query by Euclidean distance, ties by the item's name.

    Vectors are of one length. Rows without a name, without a vector or with a null or non-finite component take no part. With skip_same an item
    of the query's own name is none. A query has fewer than k rows where there are fewer items. `visits` gets the tables (query, cell) of both rounds.
    """
    there = items.filter(F.col(item).isNotNull() & _sound(F.col(vector))).select(F.col(item).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.filter(F.col(query).isNotNull() & _sound(F.col(vector))).select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    p = Pivots(there, pivots)
    if not len(p.at):  # no items
        return asked.join(there.select(F.col("id").alias("item")), F.lit(False)).select(F.col("q").alias("query"), "item", F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
    sizes = {c: int(n) for c, n in enumerate(p.n) if n}
    rounds, found = [], None
    for limit in (False, True):
        rows = asked if not limit else asked.join(found.filter(F.col("rank") == k).select("q", F.col("d").alias("far")), "q", "left")
        routes = written(p.routes(rows, k + skip_same, limit), "routes")
        rounds.append(routes.select("q", "cell"))
        new = _met(routes, p.items, sizes, k, skip_same)
        found = written(_top(new if found is None else new.unionByName(found.drop("rank")), k), "nearest")
    if visits is not None:
        visits += rounds
    return found.select(F.col("q").alias("query"), F.col("id").alias("item"), F.col("d").alias("distance"), "rank")
