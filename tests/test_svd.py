"""Truncated singular value decomposition against NumPy's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from podium.operators import svd, text

SCHEMA = "row long, j int, x double"


def entries_of(a):
    return [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]


@pytest.mark.parametrize(("rank", "entries"), [(4, 30), (12, 50_000)])
def test_low_rank_is_exact(spark, monkeypatch, rank, entries):
    monkeypatch.setattr(svd, "FAN", 2)
    monkeypatch.setattr(svd, "ENTRIES", entries)
    monkeypatch.setattr(svd, "SPARE", 4)
    rng = np.random.default_rng(rank)
    a = rng.normal(size=(90, rank)) @ rng.normal(size=(rank, 40)) * (rng.random((90, 1)) > 0.1)
    values, rows, directions = svd.truncated(spark.createDataFrame(entries_of(a), SCHEMA).repartition(7), "row", 40, 8)
    exact = np.linalg.svd(a)[1][:8]
    found = np.zeros((90, 8))
    for r in rows.collect():
        found[r["row"]] = r["features"]
    right = np.zeros((40, 8))
    for r in directions.collect():
        right[r["j"]] = r["direction"]
    assert np.allclose(values, exact, atol=1e-6 * exact[0])
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(found @ right.T, u[:, :8] * s[:8] @ vt[:8], atol=1e-6 * exact[0])


def test_documents_within_a_hundredth(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    values, rows, _ = text.latent_features(docs, "text", "doc_id", k=20, n_features=2000)
    weights = text.tfidf(docs, "text", "doc_id", n_features=None).select("doc_id", F.pmod(F.xxhash64("term"), F.lit(2000)).cast("int").alias("j"), "weight").toPandas()
    ids = {d: i for i, d in enumerate(weights["doc_id"].unique())}
    a = np.zeros((len(ids), 2000))
    np.add.at(a, (weights["doc_id"].map(ids).to_numpy(), weights["j"].to_numpy()), weights["weight"].to_numpy())
    exact = np.linalg.svd(a, compute_uv=False)[:20]
    assert (np.abs(values - exact) <= 0.01 * exact).all()
    f = np.array([r["features"] for r in rows.collect()])
    assert len(f) == len(ids) and np.allclose(f.T @ f, np.diag(values**2), atol=1e-6 * values[0] ** 2)


def test_odd_entries(spark):
    rows = [(1, 0, 3.0), (1, 0, 1.0), (2, 1, None), (3, 9, 5.0), (4, -1, 5.0), (None, 2, 2.0)]
    values, found, _ = svd.truncated(spark.createDataFrame(rows, SCHEMA), "row", 3, 5)
    assert np.allclose(values, [4, 2, 0]) and sorted(repr(r[0]) for r in found.collect()) == ["1", "None"]
    values, found, directions = svd.truncated(spark.createDataFrame([], SCHEMA), "row", 3, 2)
    assert np.allclose(values, 0) and found.count() == 0 and directions.count() == 0


@pytest.mark.parametrize("thin", [0, 10**9])
def test_a_block_multiplies_as_its_matrix(monkeypatch, thin):
    """Dense slices (some to a block) and single entries; an iteration is one pass, not two."""
    monkeypatch.setattr(svd, "THIN", thin)
    rng = np.random.default_rng(3)
    a = rng.normal(size=(23, 40)) * (rng.random((23, 40)) < 0.2)
    a[:, 0] = 1
    row, at = np.nonzero(a)
    block = svd._Block(np.cumsum(np.bincount(row)), at, a[row, at], np.zeros((5, 40)))
    m, left, z = rng.normal(size=(40, 6)), rng.normal(size=(6, 6)), np.ones((40, 6))
    assert np.allclose(block.times(m), a @ m)
    block.add_turned(z, m, left)
    assert np.allclose(z, 1 + a.T @ a @ m @ left) and not block.buffer.any()


def test_an_iteration_reads_the_rows_once(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(svd.Decomposition, "_pass", lambda *a, f=svd.Decomposition._pass: (passes.append(1), f(*a))[1])
    svd.truncated(spark.createDataFrame(entries_of(np.eye(6)), SCHEMA), "row", 6, 2)
    assert len(passes) == svd.ITERATIONS + 3
