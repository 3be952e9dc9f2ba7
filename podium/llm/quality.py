"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A white-space-separated word gives its stem, the signs at its end and, if it is all capitals, a mark; neighbouring stems
give pairs, a word beside itself one common feature. Counts are hashed into 2^BITS places and scaled to length one; a score is the sparse
dot product with the weights. Training takes at most `most` labelled documents (those with the smallest hashed ids), in one
task; the weights that are not zero are all that leaves it, and are sent to the scoring tasks.
"""

from __future__ import annotations

import binascii

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import texts
from podium.llm.hashes import mixed
from podium.llm.tokens import SIGNS, slices

BITS = 20
#: Labelled documents that the model is fitted on, at most, and times that it sees each.
MOST, EPOCHS = 10_000, 4
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.02, 0.5
FOLDS = 5
_SAME, _CAPITALS, _TAIL, _PAIR = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in ("same word again", "capitals", "signs", "pair"))


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each text's features; an empty text has none."""
    parts = pc.ascii_split_whitespace(column)
    bounds = np.asarray(parts.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    ends = [w.rstrip(SIGNS) for w in words]
    digest = xxhash.xxh3_64_intdigest
    n = len(words)
    stem = np.fromiter((digest(s.lower()) if s else 0 for s in ends), np.uint64, n)
    tail = np.fromiter((digest(w[len(s) :]) if len(s) < len(w) else 0 for w, s in zip(words, ends, strict=True)), np.uint64, n)
    loud = np.fromiter((len(s) > 1 and s.isupper() for s in ends), bool, n)
    at = np.asarray(coded.indices, dtype=np.int64)
    stem, tail, loud = stem[at], tail[at], loud[at]
    mask, none = np.uint64((1 << BITS) - 1), np.uint64(0)
    with np.errstate(over="ignore"):
        pair = mixed(stem[:-1] * np.uint64(0x9E3779B97F4A7C15) + stem[1:] + _PAIR)
        pair = np.where(stem[:-1] == stem[1:], _SAME, pair) & mask
        one, signs = mixed(stem) & mask, mixed(tail + _TAIL) & mask
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        s, t = stem[a:b] != none, tail[a:b] != none
        places = np.concatenate([one[a:b][s], signs[a:b][t], pair[a : max(a, b - 1)][s[:-1] & s[1:]], np.full(int(loud[a:b].sum()), _CAPITALS & mask)])
        where, counts = np.unique(places, return_counts=True)
        value = np.sqrt(counts)
        out.append((where.astype(np.int64), value / (np.sqrt((value * value).sum()) or 1.0)))
    return out


class Model:
    """Weights that follow the regularised leader, coordinate by coordinate; place 2^BITS is the constant."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; one without an id is."""
    return doc_id is None or binascii.crc32(str(doc_id).encode()) % FOLDS == 0


def labelled(labels: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, label of the documents to learn from: out of the held-out fold's, labelled alike in all their rows."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL")
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most").drop("_most")
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> np.ndarray:
    """The weights. Without labelled documents all are 0, and every score is 0.5."""

    def pick(batches):
        for batch in slices(batches):
            rows = features(pc.fill_null(batch.column("text"), ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())], ["doc_id", "label", "at", "x"])

    def fit(batches):
        rows = []
        for batch in batches:
            for doc, label, at, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "at", "x")), strict=True):
                rows.append((xxhash.xxh3_64_intdigest(str(doc)), np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4"), label))
        rows.sort(key=lambda r: r[0])
        model, constant = Model(), np.array([1 << BITS])
        for _ in range(EPOCHS):
            for _, at, x, label in rows:
                model.learn(np.concatenate([at, constant]), np.append(x.astype(float), 1.0), label)
        w = model.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "w"])

    chosen = docs.join(F.broadcast(labelled(labels, most)), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of several texts of one id the same one always
    found = chosen.mapInArrow(pick, "doc_id long, label int, at binary, x binary").repartition(1).mapInArrow(fit, "at long, w double").toPandas()  # at most 2^BITS rows
    weights = np.zeros((1 << BITS) + 1)
    weights[found["at"].to_numpy(np.int64)] = found["w"].to_numpy(float)
    return weights


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels, lang, source and doc_id are no features.

    A null or empty text has the constant's score. Equal texts get equal scores. An empty table gives no rows; other columns are
    ignored. Labels that are neither 0 nor 1, or disagree on a document, are not learnt from.
    """
    docs = texts(docs)
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most).astype(np.float32))

    def run(batches):
        w = weights.value
        for batch in slices(batches):
            logits = np.array([float(w[at] @ x) + float(w[-1]) for at, x in features(pc.fill_null(batch.column("text"), ""))])
            found = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            doc = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([doc, pa.array(map(held_out, doc.to_pylist()), pa.bool_()), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
