"""Registered queries that SQL doesn't express, against straightforward Python on the same tables; and operators that work in blocks."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium import catalog
from podium.operators import evaluate, images, ordered, summarise, text, vectors


@pytest.fixture(scope="module")
def embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").orderBy("vec_id").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)


def run(spark, sf_dir, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, sf_dir).collect()]


# vectors


def test_kmeans_is_a_fixed_point(spark, sf_dir, embeddings):
    ids, _, x = embeddings
    label = dict(run(spark, sf_dir, "kmeans_clusters"))
    assert set(label) == set(ids.tolist())
    own = np.array([label[i] for i in ids.tolist()])
    names = np.unique(own)
    assert run(spark, sf_dir, "cluster_count") == [(len(names),)] and 2 <= len(names) <= 20
    centers = np.stack([x[own == k].mean(axis=0) for k in names])
    d = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (names[d.argmin(axis=1)] == own).mean() > 0.97  # as far as 20 rounds go
    best = {c: (n, dist) for c, n, dist in run(spark, sf_dir, "kmeans_best_samples")}
    for i, k in enumerate(names.tolist()):
        want = np.flatnonzero(own == k)[d[own == k, i].argmin()]
        assert best[k][0] == ids[want] and best[k][1] == pytest.approx(d[want, i], abs=1e-5)


def test_cost_falls_with_clusters(spark, sf_dir, embeddings):
    x = embeddings[2]
    cost = dict(run(spark, sf_dir, "cost_by_k"))
    whole = ((x - x.mean(axis=0)) ** 2).sum()
    assert sorted(cost) == [2, 4, 8] and whole > cost[2] > cost[4] > cost[8] > 0


def test_affinity_assigns_the_nearest_exemplar(spark, sf_dir, embeddings):
    ids, label, x = embeddings
    at = {i: k for k, i in enumerate(ids.tolist())}
    found = catalog.QUERIES["affinity_clusters"](spark, sf_dir).collect()
    assert len(found) == len(ids)
    for name in np.unique(label).tolist():
        part = [r for r in found if r["label"] == name]
        exemplars = sorted({r["exemplar"] for r in part})
        assert {r["vec_id"] for r in part} == set(ids[label == name].tolist())
        assert len({r["cluster_id"] for r in part}) == len(exemplars)
        for r in part:
            d = {e: ((x[at[r["vec_id"]]] - x[at[e]]) ** 2).sum() for e in exemplars}
            assert r["exemplar"] == r["vec_id"] if r["vec_id"] in exemplars else d[r["exemplar"]] <= min(d.values()) + 1e-9


def test_near_pairs_recall(spark, sf_dir, embeddings):
    ids, _, x = embeddings
    d = np.sqrt(np.maximum(((x[:, None, :] - x[None]) ** 2).sum(axis=2), 0))
    want = {(int(ids[i]), int(ids[j])): d[i, j] for i, j in zip(*np.nonzero(d < 1.0), strict=True) if ids[i] < ids[j]}
    found = {(a, b): dist for a, b, dist in run(spark, sf_dir, "near_vector_pairs")}
    assert set(found) <= set(want) and len(found) >= 0.9 * len(want)
    assert all(dist == pytest.approx(want[p], abs=1e-5) for p, dist in found.items())


def hinge(x, y, w, b, reg):
    return np.maximum(0, 1 - y * (w * x + b)).mean() + reg / 2 * w * w


def narrowed(f, a, b, steps=80):
    """Where a convex function is least, by thirds."""
    for _ in range(steps):
        c, d = a + (b - a) / 3, b - (b - a) / 3
        a, b = (a, d) if f(c) < f(d) else (c, b)
    return (a + b) / 2


def test_svm_threshold_against_a_plain_solver(spark, sf_dir):
    ((threshold,),) = run(spark, sf_dir, "svm_match_threshold")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("text", "quality").collect()
    rows = [(len(re.findall("[a-z]", r["text"])) / len(r["text"]), 1 if r["quality"] else -1) for r in docs if r["text"] and r["quality"] is not None]
    x, y = (np.array(c, float) for c in zip(*rows, strict=True))
    z = x / x.std(ddof=1)  # the solver scales values, and its penalty is on the scaled weight
    best = lambda w: narrowed(lambda b: hinge(z, y, w, b, 0.01), -60, 60)
    w = narrowed(lambda w: hinge(z, y, w, best(w), 0.01), -40, 40, 50)
    plain = -best(w) / w * x.std(ddof=1)
    assert threshold == pytest.approx(plain, abs=0.02 * (x.max() - x.min()))
    side = (x > threshold) if w > 0 else (x < threshold)
    assert (side == (y > 0)).mean() > 0.93


def test_cross_validation_against_a_plain_one(spark, sf_dir):
    accuracy = dict(run(spark, sf_dir, "classifier_cross_validation"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x, label = np.array([r["embedding"] for r in rows], float), np.array([r["label"] for r in rows])
    x, fold = x / x.std(axis=0), np.random.default_rng(0).integers(0, 3, len(rows))
    kinds = np.unique(label)
    for reg, found in accuracy.items():
        right = 0
        for f in range(3):
            a, own = x[fold != f], (label[fold != f][:, None] == kinds).astype(float)
            w, bias = np.zeros((x.shape[1], len(kinds))), np.zeros(len(kinds))
            for _ in range(1500):
                e = np.exp(a @ w + bias - (a @ w + bias).max(axis=1, keepdims=True))
                g = (e / e.sum(axis=1, keepdims=True) - own) / len(a)
                w, bias = w - 0.3 * (a.T @ g + reg * w), bias - 0.3 * g.sum(axis=0)
            right += (kinds[(x[fold == f] @ w + bias).argmax(axis=1)] == label[fold == f]).sum()
        assert found == pytest.approx(right / len(rows), abs=0.06)


def test_costs_are_near_the_best_of_plain_runs(spark, sf_dir, embeddings):
    _, _, x = embeddings
    for k, cost in run(spark, sf_dir, "cost_by_k"):
        plain = []
        for seed in range(6):
            label = vectors.kmeans_labels(x, k, seed)
            plain.append(sum(((x[label == c] - x[label == c].mean(axis=0)) ** 2).sum() for c in np.unique(label)))
        assert 0.98 * min(plain) <= cost <= 1.05 * max(plain)


@pytest.mark.parametrize("block", [7, 10_000])
def test_blocks_change_nothing(spark, sf_dir, block):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    some = rows.filter("vec_id % 20 = 0")
    centers = some.select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("centroid"))
    one, many = (sorted(map(repr, vectors.assigned(rows, centers, "embedding", "vec_id", block=b).collect())) for b in (10**6, block))
    assert one == many and len(one) == rows.count()


# images


def test_image_measures(spark, sf_dir, embeddings):
    ids, _, x = embeddings
    found = {r["vec_id"]: r.asDict() for r in catalog.QUERIES["image_measures"](spark, sf_dir).collect()}
    assert set(found) == set(ids.tolist())
    hexed = lambda bits: f"{int(''.join(str(int(b)) for b in bits), 2):0{-(-len(bits) // 4)}x}"
    for i, v in zip(ids.tolist()[:200], x[:200], strict=True):
        p = np.clip((128 + v * 400).astype(int), 0, 255)[:64].reshape(8, 8)
        r = found[i]
        assert r["average"] == hexed((p > p.mean()).ravel())
        counts = np.array(list(collections.Counter(p.ravel().tolist()).values())) / 64
        assert r["entropy"] == pytest.approx(-(counts * np.log2(counts)).sum(), abs=1e-6)
        assert r["solid"] == bool((abs(p - p[0, 0]) < 5).all()) and r["border"] == any((e < 5).all() for e in (p[0], p[-1], p[:, 0], p[:, -1]))


# texts


def dense_rank(n, links, damping=0.85, steps=200):
    m = np.zeros((n, n))
    for (a, b), w in links.items():
        m[a, b] += w
        m[b, a] += w
    out = m.sum(axis=1)
    rank = np.full(n, 1 / n)
    for _ in range(steps):
        rank = (1 - damping) / n + damping * (m / np.where(out > 0, out, 1)[:, None]).T @ rank
    return rank


def test_keywords_by_a_dense_rank(spark, sf_dir):
    texts_ = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect())
    df = spark.createDataFrame(list(texts_.items()), "doc_id long, text string")
    found = collections.defaultdict(dict)
    for d, term, rating in summarise.keywords(df, "text", "doc_id").collect():
        found[d][term] = rating
    for d, t in texts_.items():
        tokens = [w for w in re.split(r"[^\w]+", (t or "").lower()) if w and w not in summarise._STOP]
        names = sorted(set(tokens))
        if not names:
            assert d not in found
            continue
        at, links = {w: i for i, w in enumerate(names)}, collections.Counter()
        for k, w in enumerate(tokens):
            for o in tokens[k + 1 : k + 3]:
                if o != w:
                    links[tuple(sorted((at[w], at[o])))] += 1
        rank = dense_rank(len(names), links) if links else np.full(len(names), 1 / len(names))
        kept = found[d]
        assert len(kept) == max(1, int(len(names) * 0.2))
        assert all(r == pytest.approx(rank[at[w]], abs=2e-5) for w, r in kept.items())
        assert min(rank[at[w]] for w in kept) >= max((rank[at[w]] for w in names if w not in kept), default=0) - 2e-5


def split_sentences(t):
    return [s for s in (m.strip() for m in re.findall(r"[^.!?]+[.!?]*", t or "")) if s]


def test_tfidf_selection_by_hand(spark, sf_dir):
    docs = {r[0]: split_sentences(r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    tokens = lambda s: [w for w in re.split(r"[^A-Za-z0-9_]+", s.lower()) if w and w not in text.STOP_WORDS]
    rows = {(d, i): collections.Counter(tokens(s)) for d, ss in docs.items() for i, s in enumerate(ss)}
    df, every = collections.Counter(), collections.Counter()
    for c in rows.values():
        df.update(c.keys())
        every.update(c)
    n = len(rows)
    terms = sorted((w for w in df if 2 <= df[w] <= 0.5 * n), key=lambda w: (-every[w], w))[:10_000]
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in terms}
    rating = {}
    for k, c in rows.items():
        w = [m * idf[t] for t, m in c.items() if t in idf]
        rating[k] = round(sum(w) / math.sqrt(sum(v * v for v in w)), 9) if w else 0.0
    found = {(r["doc_id"], r["sent_idx"]): r for r in catalog.QUERIES["tfidf_sentence_selection"](spark, sf_dir).collect()}
    for d, ss in docs.items():
        kept = sorted(i for e, i in found if e == d)
        assert len(kept) == int(len(ss) * 0.7)
        for i in kept:
            assert found[d, i]["sentence"] == ss[i] and found[d, i]["rating"] == pytest.approx(rating[d, i], abs=1e-6)
        left = [rating[d, i] for i in range(len(ss)) if i not in kept]
        assert not kept or not left or min(rating[d, i] for i in kept) >= max(left) - 1e-6


@pytest.mark.parametrize("method", ["text_rank", "lsa", "luhn", "edmundson", "random", "lex_rank"])
def test_extractive_keeps_the_best_rated(spark, sf_dir, method):
    texts_ = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(50).collect()
    df = spark.createDataFrame([tuple(r) for r in texts_], "doc_id long, text string")
    found = collections.defaultdict(list)
    for r in summarise.extractive(df, "text", "doc_id", method).collect():
        found[r["doc_id"]].append((r["sent_idx"], r["sentence"], r["rating"]))
    for d, t in texts_:
        ss = split_sentences(t)
        assert len(found[d]) == int(len(ss) * 0.7) and all(ss[i] == s for i, s, _ in found[d])
        if ss:
            rating = np.round(summarise.METHODS[method]([summarise._tokens(s) for s in ss]), 9)
            assert sorted(x for *_, x in found[d]) == sorted(sorted(rating.tolist())[len(ss) - len(found[d]) :])


# ranks and counts in parts


def test_folds_are_those_of_one_sorted_list(spark):
    for n in (0, 1, 2, 7, 100, 257):
        df = spark.createDataFrame([(f"g{i}",) for i in range(n)] * 2, "g string")
        order = sorted((__import__("hashlib").sha1(f"g{i}-0".encode()).hexdigest(), f"g{i}") for i in range(n))
        fold = {g: f for g, f in evaluate.folds(df, "g", 3).collect()}
        sizes = [n // 3 + (i < n % 3) for i in range(3)]
        assert [fold[g] for _, g in order] == [i + 1 for i, m in enumerate(sizes) for _ in range(m)]
        split = dict(evaluate.group_split(df, "g", 0.2).collect())
        assert [split[g] for _, g in order] == ["test"] * math.floor(0.2 * n) + ["train"] * (n - math.floor(0.2 * n))


def test_titles_in_buckets_are_the_same(spark):
    rows = spark.createDataFrame([(i, ["Intro", "", None, "End", "Intro"][i % 5]) for i in range(1, 400)], "o int, t string")
    one, many = (sorted(map(tuple, ordered.default_titles(rows, "t", "o", most=m, rows=20).select("o", "unique_title").collect())) for m in (1, 16))
    assert one == many and one[0] == (1, "Slide 1") and dict(one)[396] == f"Slide {396}" if not 396 % 5 else one == many
    assert len({t for _, t in many}) == len(many)


def test_hash_names():
    assert set(images.HASHES) == {"average", "perceptual", "difference", "wavelet_haar", "wavelet_db4"}
