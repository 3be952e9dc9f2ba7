"""Nearest neighbours by pivots against brute force."""

import numpy as np
import pytest

from podium.operators import neighbours
from podium.operators.neighbours import nearest

SCHEMA = "id long, v array<double>"


def by_force(queries, items, k, skip):
    out = []
    for q, w in queries:
        d = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, v in items if not (skip and i == q))
        out += [(q, i, round(x, 9), n) for n, (x, i) in enumerate(d[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r["query"], r["item"], round(r["distance"], 9), r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("k", "skip", "block", "pivots"), [(1, False, 2048, 1024), (3, True, 16, 5), (2, True, 7, 40), (500, False, 64, 9)])
def test_neighbours_by_force(spark, monkeypatch, k, skip, block, pivots):
    """Lattice points, so many distances tie and rows are equal; blocks are small, so cells are cut up."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(k)
    items = [(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(300)]
    queries = [(i * 3, [float(x) for x in rng.integers(-1, 5, 3)]) for i in range(40)]
    if skip:
        queries = items[::9]
    found = nearest(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(items, SCHEMA), "id", "id", "v", k, skip, pivots)
    assert got(found) == by_force(queries, items, k, skip)


def test_few_cells_are_visited(spark):
    """On 20 clusters a query visits a small share of the cells; twice the items take less than three times the visited items."""
    rng = np.random.default_rng(0)
    centers, visited = rng.normal(0, 10, (20, 8)), []
    for n in (1000, 2000):
        items = [(i, (centers[i % 20] + rng.normal(0, 0.5, 8)).tolist()) for i in range(n)]
        queries, rounds = items[::25], []
        found = nearest(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(items, SCHEMA), "id", "id", "v", 3, True, visits=rounds)
        assert got(found) == by_force(queries, items, 3, True)
        routes = rounds[0].unionByName(rounds[1])
        assert routes.count() == routes.distinct().count()
        visited.append(routes.count())
        assert routes.count() < 0.2 * len(queries) * int(n**0.5)
    assert visited[1] < 3 * visited[0]


def test_odd_rows(spark):
    nan = float("nan")
    items = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, []), (5, [1.0, None]), (None, [0.0, 0.1]), (6, [3.0, 4.0])], SCHEMA)
    assert got(nearest(items, items, "id", "id", "v", 2)) == [(1, 1, 0.0, 1), (1, 6, 5.0, 2), (6, 1, 5.0, 2), (6, 6, 0.0, 1)]
    assert nearest(items, items.limit(0), "id", "id", "v", 2).count() == 0 and nearest(items.limit(0), items, "id", "id", "v", 2).count() == 0
    named = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("é", [2.0])], "id string, v array<float>")
    assert got(nearest(named, named, "id", "id", "v", 1, True)) == [("a", "b", 0.0, 1), ("b", "a", 0.0, 1), ("é", "a", 1.0, 1)]
