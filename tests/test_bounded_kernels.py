"""Kernels whose memory and time once went with a width or a batch, and not with a row."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.operators import images, minibatch, neighbours, summarise, text, vectors


def test_clusters_of_rows_with_a_huge_width():
    """A full matrix of 300 rows of 2 ** 28 places would not fit."""
    place = (np.arange(300) % 3) * (1 << 27) // 2
    rows = minibatch.Sparse(np.arange(300), place, np.ones(300), 300, 1 << 28)
    label = minibatch.labels(rows, 3)
    assert all(len(set(label[i::3])) == 1 for i in range(3)) and len(set(label)) == 3


def test_equally_near_centers_are_not_told_apart_by_rounding():
    d = np.array([[1 + 2e-16, 1.0, 2.0], [3.0, 1.0, 1 - 2e-16]])
    assert vectors.first_nearest(d, np.ones((2, 3))).tolist() == [0, 1]


def dense_affinity(x, preference, damping=0.72, steady=15):
    """All n x n messages."""
    n, size = len(x), (x**2).sum(axis=1)
    s = np.minimum(2 * x @ x.T - size[:, None] - size[None, :], 0)
    np.fill_diagonal(s, preference)
    s = s + 1e-12 * np.random.default_rng(0).standard_normal((n, n)) * np.abs(s)
    r, a, rows, same, was = np.zeros((n, n)), np.zeros((n, n)), np.arange(n), 0, None
    for _ in range(1000):
        t = a + s
        best = t.argmax(axis=1)
        top = t[rows, best]
        t[rows, best] = -np.inf
        new = s - top[:, None]
        new[rows, best] = s[rows, best] - t.max(axis=1)
        r = damping * r + (1 - damping) * new
        p = np.where(np.eye(n, dtype=bool), r, np.maximum(r, 0))
        sums = p.sum(axis=0)
        a = damping * a + (1 - damping) * np.where(np.eye(n, dtype=bool), sums - p, np.minimum(sums - p, 0))
        chosen = np.flatnonzero(np.diag(a) + np.diag(r) > 0)
        same = same + 1 if was is not None and np.array_equal(chosen, was) else 0
        was = chosen
        if same >= steady and len(chosen):
            break
    label = was[s[:, was].argmax(axis=1)]
    label[was] = was
    return label


@pytest.mark.parametrize(("n", "d", "preference", "next_"), [(300, 2, -1, 32), (300, 2, -1, 1), (400, 3, -0.05, 2), (200, 1, -100, 32), (600, 6, -0.5, 1)])
def test_affinity_of_links_is_that_of_all_messages(monkeypatch, n, d, preference, next_):
    monkeypatch.setattr(vectors, "AFFINITY_NEXT", next_)
    x = np.random.default_rng(n).normal(size=(n, d))
    x[n // 2 :] = x[: n - n // 2]
    assert vectors.affinity_labels(x, preference).tolist() == dense_affinity(x, preference).tolist()


def test_affinity_of_more_than_3000_rows(spark):
    rows = spark.range(3200).selectExpr("1 AS label", "id", "array(cast(id div 2 * 10 AS double), 0.0D) AS v")
    out = vectors.affinity(rows, "label", "v", "id", preference=-1.0)
    assert (out.count(), out.select("cluster_id").distinct().count()) == (3200, 1600)
    with pytest.raises(ValueError, match="links in one part"):
        vectors.affinity_labels(np.zeros((40, 2)), -1.0, most=100)


def test_queries_and_cells_are_not_broadcast(spark, monkeypatch):
    plans, written = [], neighbours.written

    def kept(df, name):
        if name == "nearest":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(neighbours, "written", kept)
    rows = spark.range(300).selectExpr("id", "array(cast(id % 17 AS double), cast(id % 5 AS double)) AS v")
    assert neighbours.nearest(rows.filter("id % 10 = 0"), rows, "id", "id", "v", 2, True).count() == 60
    assert len(plans) == 2 and not any("BroadcastHashJoin [cell" in p for p in plans)


def test_summaries_of_many_texts_leave_the_task_as_they_come(spark, monkeypatch):
    """3000 texts of 400 sentences in one batch: what the worker holds does not grow by them."""

    def resident(docs):
        with open("/proc/self/statm") as f:
            return np.full(len(docs), int(f.read().split()[1]) * 4096 / 2**20)

    monkeypatch.setitem(summarise.METHODS, "luhn", resident)
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('ab. ', 400) AS t")
    summarise.extractive(rows.limit(9), "t", "id", "luhn", 1.0).collect()  # workers import what they need
    low, high = summarise.extractive(rows, "t", "id", "luhn", 1.0).agg(F.min("rating"), F.max("rating")).first()
    assert high - low < 40


def test_keyword_pairs_are_those_of_a_walk():
    word = np.random.default_rng(5).integers(0, 9, 200)
    for window in (1, 2, 5, 300):
        links = {}
        for k, x in enumerate(word.tolist()):
            for y in word[k + 1 : k + 1 + window].tolist():
                if x != y:
                    links[min(x, y), max(x, y)] = links.get((min(x, y), max(x, y)), 0) + 1
        a, b, w = summarise._neighbours(word, 9, window)
        assert list(zip(a.tolist(), b.tolist(), w.tolist(), strict=True)) == [(*k, v) for k, v in links.items()]


def test_the_last_word_of_a_long_unbroken_text_takes_linear_time(spark):
    rows = spark.range(2).selectExpr("id", "concat('A b. ', repeat('x', if(id = 0, 3, 400000)), '. C d.') AS t")
    text.learned_sentences(rows.filter("id = 0"), "t", ["id"], []).collect()
    began = time.perf_counter()
    got = text.learned_sentences(rows.filter("id = 1"), "t", ["id"], []).selectExpr("length(sentence)").collect()
    assert [r[0] for r in got] == [4 + 1 + 400_001, 4] and time.perf_counter() - began < 10


def test_rows_mixed_once_give_the_four_neighbours_mean():
    a = np.random.default_rng(2).integers(0, 256, (30, 40)).astype(np.uint8)
    y, x = (np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1) for m, n in ((45, 30), (60, 40)))
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx, p, q = (y - i)[:, None], x - j, np.minimum(i + 1, 29), np.minimum(j + 1, 39)
    four = [a[np.ix_(r, c)].astype(float) for r in (i, p) for c in (j, q)]
    assert np.array_equal(images.to_height(a, 45), (four[0] * (1 - fx) + four[1] * fx) * (1 - fy) + (four[2] * (1 - fx) + four[3] * fx) * fy)
    three = images.model_input(np.repeat(a[:, :, None], 3, axis=2))
    assert np.array_equal(images.model_input(a), three) and images.model_input(a).flags["C_CONTIGUOUS"]
