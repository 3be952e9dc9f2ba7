"""Mini-batch k-means of tables and of single texts, and summaries by clusters."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.operators import minibatch, text, vectors


def cost_of(x, label):
    return sum(((x[label == c] - x[label == c].mean(axis=0)) ** 2).sum() for c in np.unique(label))


@pytest.mark.parametrize("k", [5, 20])
def test_cost_is_near_that_of_full_k_means(spark, sf_dir, monkeypatch, k):
    monkeypatch.setattr(minibatch, "FIRST", 150)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found, centers, cost = minibatch.kmeans(rows, "embedding", k)
    full = min(vectors.kmeans(rows, "embedding", k, seed)[1].summary.trainingCost for seed in (0, 1))
    x = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()], float)
    label = np.array([r["cluster"] for r in found.orderBy("vec_id").collect()])
    assert np.isclose(cost, ((x - centers[label]) ** 2).sum()) and cost <= 1.05 * full
    again = minibatch.kmeans(rows.repartition(3), "embedding", k)[1]
    assert np.allclose(centers, again)


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0])], "id int, v array<float>")
    found, centers, cost = minibatch.kmeans(rows, "v", 4)
    assert sorted((r["id"], r["cluster"]) for r in found.collect()) == [(1, 0), (2, None), (3, 0)] and np.allclose(centers, [[1, 0]]) and cost == 0
    none, centers, cost = minibatch.kmeans(rows.filter("id = 2"), "v", 4)
    assert [r["cluster"] for r in none.collect()] == [None] and len(centers) == 0 and cost == 0


def test_sparse_rows_as_full_ones():
    rng = np.random.default_rng(2)
    full = rng.normal(size=(60, 12)) * (rng.random((60, 12)) > 0.6)
    rows = minibatch.Sparse(*np.nonzero(full), full[np.nonzero(full)], 60, 12)
    centers = rng.normal(size=(5, 12))
    label = ((full[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
    pick = rng.permutation(60)[:17]
    assert np.array_equal(rows.nearest(centers), label) and np.array_equal(rows.taken(pick).full(), full[pick])
    assert np.allclose(rows.sums(label, 5), [full[label == c].sum(axis=0) for c in range(5)])


def test_one_pass_over_sentences_of_a_text():
    """2000 sentences of four subjects: clusters are the subjects, though each row moves its center once."""
    rng = np.random.default_rng(1)
    subject = rng.integers(0, 4, 2000)
    at = rng.integers(0, 50, (2000, 8)) + 50 * subject[:, None]
    rows = minibatch.Sparse(np.repeat(np.arange(2000), 8), at.ravel(), np.full(16000, 8**-0.5), 2000, 200)
    label = minibatch.labels(rows, 4)
    assert cost_of(rows.full(), label) <= 1.05 * cost_of(rows.full(), subject)


BODY = " ".join(f"The {a} near the {b} has word{i % 7} and more." for i, (a, b) in enumerate([("cat", "mouse"), ("sun", "star"), ("tax", "law")] * 10))


@pytest.mark.parametrize("features", ["hash", "bow"])
def test_each_text_has_its_own_summary(spark, features):
    own = [(1, BODY), (2, BODY), (3, "Too short. Really."), (4, None), (5, ""), (None, BODY.replace("cat", "dog"))]
    out = text.cluster_summary(spark.createDataFrame(own, "id long, body string"), "body", "id", k=3, feature_extraction=features)
    rows = out.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["id"]].append(r)
    assert set(by) == {1, 2, None}
    said = [s.strip() + "." for s in BODY.split(".") if s.strip()]
    for key, found in by.items():
        sizes = collections.Counter(r["cluster"] for r in found)
        assert len(sizes) == 3 and max(sizes.values()) <= int(30 * 0.7) // 3 and sorted(r["final_order"] for r in found) == list(range(len(found)))
        assert key is None or all(said[r["sent_idx"]] == r["sentence"] for r in found)
        subjects = collections.defaultdict(set)
        for r in found:
            subjects[r["cluster"]].add(r["sent_idx"] % 3)
        assert all(len(s) == 1 for s in subjects.values())
    assert [tuple(r)[1:] for r in by[1]] == [tuple(r)[1:] for r in by[2]]


def test_titles_orders_and_abstracts(spark):
    df = spark.createDataFrame([(1, BODY)], "id long, body string")
    out = text.cluster_summary(df, "body", "id", k=3, titles=lambda c: F.substring(c, 1, 7))
    assert {r["title"] for r in out.collect()} <= {"The cat", "The sun", "The tax"}
    summary = text.titled(out, "id").first()["summary"]
    assert summary.count("Title: The ") == 3 and summary.count("\nContent: ") == 3
    by_order = text.cluster_summary(df, "body", "id", k=3, final_sort_by="order").orderBy("final_order").collect()
    assert [r["sent_idx"] for r in by_order] == sorted(r["sent_idx"] for r in by_order)
    by_rating = text.cluster_summary(df, "body", "id", k=3, final_sort_by="rating").orderBy("final_order").collect()
    assert [r["rating"] for r in by_rating] == sorted((r["rating"] for r in by_rating), reverse=True)
    short = text.cluster_summary(df, "body", "id", k=3, summarise=lambda c: F.upper(c)).collect()
    assert len(short) == 3 and all(r["sentence"].isupper() or r["sentence"].upper() == r["sentence"] for r in short)
    with pytest.raises(ValueError):
        text.cluster_summary(df, "body", "id", feature_extraction="neural")
