"""Extractive summaries of documents, each document's sentence graph or matrix in NumPy: kernels per document, by the published methods.

A kernel sees all sentences of one document, however many. Terms are in long form and sentences are linked through the terms that they
share, so memory goes with the terms and links that there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from podium.operators.rowwise import by_row
from podium.operators.text import STOP_WORDS, sentence_array

_STOP = frozenset(STOP_WORDS)
#: Letters, digits and underscores: what isalnum() tells, and "_".
_WORD = re.compile(r"\w+")


def _tokens(sentence: str) -> list[str]:
    return [t for t in _WORD.findall(sentence.lower()) if t not in _STOP]


def _ranked(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, damping: float = 0.85, steps: int = 100, close: float = 1e-6) -> np.ndarray:
    """PageRank of a graph of n nodes with links from a to b of weight w, by power iteration; a node without links goes anywhere."""
    sums = np.bincount(a, w, n)
    move, stuck = w / sums[a], (sums == 0) / max(n, 1)
    rank = np.full(n, 1 / max(n, 1))
    if 8 * len(a) >= n * n:  # as a full matrix, no larger than the links
        full = np.zeros((n, n))
        full[b, a] = move
    for _ in range(steps):
        moved = full @ rank if 8 * len(a) >= n * n else np.bincount(b, rank[a] * move, n)
        new = (1 - damping) / n + damping * (moved + stuck @ rank)
        if np.abs(new - rank).sum() < close:
            return new
        rank = new
    return rank


def _matrix(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sentence, term and count of each term of each sentence, in the sentences' order, and the number of terms."""
    at: dict[str, int] = {}
    found = [Counter(d) for d in docs]
    row = np.repeat(np.arange(len(docs)), [len(c) for c in found])
    col = np.array([at.setdefault(t, len(at)) for c in found for t in c], np.int64)
    return row, col, np.array([k for c in found for k in c.values()], float), len(at)


def _links(n: int, row: np.ndarray, col: np.ndarray, value: np.ndarray, terms: int, weights: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, w of all pairs of sentences that weights(sentences, products of those with all) gives more than 0, a block of sentences at a time."""
    order = np.argsort(col, kind="stable")
    sentence, there = row[order], value[order]
    start, first = np.searchsorted(col[order], np.arange(terms + 1)), np.searchsorted(row, np.arange(n + 1))
    many = (start[1:] - start[:-1])[col]
    found, each = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], max(1, 250_000 // max(n, 1))
    for i in range(0, n, each):
        rows = np.arange(i, min(n, i + each))
        own = slice(first[rows[0]], first[rows[-1] + 1])
        k = many[own]
        at = np.arange(k.sum()) + np.repeat(start[col[own]] - (np.cumsum(k) - k), k)
        spot = np.repeat((row[own] - i) * n, k) + sentence[at]
        w = weights(rows, np.bincount(spot, there[at] * np.repeat(value[own], k), len(rows) * n).astype(float).reshape(len(rows), n))
        a, b = np.nonzero(w > 0)
        found.append((a + i, b, w[a, b]))
    a, b, w = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b, w


def text_rank(docs: list[list[str]]) -> np.ndarray:
    """Sentences linked by shared words, scaled by the logarithms of their lengths."""
    n = len(docs)
    row, col, value, terms = _matrix(docs)
    size = np.array([len(d) for d in docs])
    logs = np.log(np.maximum(size, 1))

    def weights(rows: np.ndarray, shared: np.ndarray) -> np.ndarray:
        fine = (size > 1) & (size[rows, None] > 1) & (np.arange(n) != rows[:, None])
        return np.divide(shared, logs + logs[rows, None], out=np.zeros_like(shared), where=fine)

    return _ranked(n, *_links(n, row, col, np.ones(len(value)), terms, weights))


def lex_rank(docs: list[list[str]], threshold: float = 0.1) -> np.ndarray:
    """Sentences linked where the cosine of their TF-IDF vectors passes the threshold."""
    n = len(docs)
    row, col, value, terms = _matrix(docs)
    value = value * (np.log(n / np.bincount(col, minlength=terms)) + 1)[col]
    value = value / np.sqrt(np.bincount(row, value**2, n))[row]
    return _ranked(n, *_links(n, row, col, value, terms, lambda _, cosine: (cosine > threshold).astype(float)))


def lsa(docs: list[list[str]], ratio: float = 1.0, least: int = 3) -> np.ndarray:
    """Length of each sentence in the space of the strongest topics, weighed by their strength. With all topics it is the sentence's own length."""
    row, col, value, terms = _matrix(docs)
    n = len(docs)
    if not terms:
        return np.zeros(n)
    most = np.zeros(terms)
    np.maximum.at(most, col, value)
    value = value / most[col]
    k = max(least, int(min(n, terms) * ratio))
    if k >= min(n, terms):
        return np.sqrt(np.bincount(row, value**2, n))
    m = np.zeros((terms, n))
    m[col, row] = value
    _, sigma, v = np.linalg.svd(m, full_matrices=False)
    return np.sqrt(((sigma[:k, None] * v[:k]) ** 2).sum(axis=0))


def luhn(docs: list[list[str]], share: float = 0.2, gap: int = 4) -> np.ndarray:
    """Best cluster of significant words: their number squared over the cluster's span, clusters cut at `gap` others."""
    counts: dict[str, int] = {}
    for d in docs:
        for t in d:
            counts[t] = counts.get(t, 0) + 1
    good = set(sorted(counts, key=lambda t: (-counts[t], t))[: max(1, int(len(counts) * share))])
    out = np.zeros(len(docs))
    for i, d in enumerate(docs):
        at = [k for k, t in enumerate(d) if t in good]
        best, start = 0.0, 0
        for k in range(len(at)):
            if k and at[k] - at[k - 1] > gap:
                start = k
            best = max(best, (k - start + 1) ** 2 / (at[k] - at[start] + 1))
        out[i] = best
    return out


def edmundson(docs: list[list[str]], bonus: tuple[str, ...] = (), stigma: tuple[str, ...] = ()) -> np.ndarray:
    """Cue words (bonus less stigma), frequent words, and place: the first and the last sentence count more."""
    counts: dict[str, int] = {}
    for d in docs:
        for t in d:
            counts[t] = counts.get(t, 0) + 1
    cue = np.array([sum(t in bonus for t in d) - sum(t in stigma for t in d) for d in docs], float)
    key = np.array([np.mean([counts[t] for t in d]) if d else 0.0 for d in docs])
    place = np.zeros(len(docs))
    place[[0, -1]] = 1 if len(docs) else 0
    return cue + key / max(1.0, key.max() if len(key) else 1) + place


def at_random(docs: list[list[str]], seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).random(len(docs))


METHODS = {"text_rank": text_rank, "lex_rank": lex_rank, "lsa": lsa, "luhn": luhn, "edmundson": edmundson, "random": at_random}


def extractive(df: DataFrame, text: str, by: str, method: str = "text_rank", coverage: float = 0.70) -> DataFrame:
    """by, sent_idx, sentence, rating: int(n * coverage) best sentences (ties: the earlier) of each row's text by the method, in their order."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; there are {', '.join(METHODS)}")
    rate = METHODS[method]

    def kept(found: list[str]):
        if found:
            rating = np.round(rate([_tokens(x) for x in found]), 9)
            for i in np.sort(np.argsort(-rating, kind="stable")[: int(len(found) * coverage)]).tolist():
                yield i, found[i], float(rating[i])

    return by_row(df.select(by, sentence_array(text).alias("_sentences")), [by], kept, {"sent_idx": "int", "sentence": "string", "rating": "double"})


def keywords(df: DataFrame, text: str, by: str | list[str], share: float = 0.2, window: int = 2) -> DataFrame:
    """by, term, rating: TextRank keywords: words linked where they stand within the window, the best third or so of them."""
    by = [by] if isinstance(by, str) else by

    def best(body: str | None):
        tokens = _tokens(body or "")
        names = sorted(set(tokens))
        if names:
            at = {x: i for i, x in enumerate(names)}
            rank = np.round(_sparse_rank(len(names), *_neighbours(np.array([at[x] for x in tokens]), len(names), window)), 9)
            for i in np.argsort(-rank, kind="stable")[: max(1, int(len(names) * share))].tolist():
                yield names[i], float(rank[i])

    return by_row(df.select(*by, text), by, best, {"term": "string", "rating": "double"})


def _neighbours(word: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, how often: pairs of different words of n that stand within the window, a before b, in the order in which they first do."""
    pairs = np.full((len(word), window), -1)
    for k in range(1, min(window, len(word) - 1) + 1):
        x, y = word[:-k], word[k:]
        pairs[: len(x), k - 1] = np.where(x != y, np.minimum(x, y) * n + np.maximum(x, y), -1)
    pair, first, many = np.unique(pairs[pairs >= 0], return_index=True, return_counts=True)
    order = np.argsort(first)
    return pair[order] // n, pair[order] % n, many[order].astype(float)


def _sparse_rank(n: int, one: np.ndarray, other: np.ndarray, weight: np.ndarray, damping: float = 0.85, steps: int = 50) -> np.ndarray:
    if not len(one):
        return np.full(n, 1 / n)
    a, b, w = np.concatenate([one, other]), np.concatenate([other, one]), np.concatenate([weight, weight])
    out = np.bincount(a, w, n)[a]
    rank = np.full(n, 1 / n)
    for _ in range(steps):
        rank = (1 - damping) / n + damping * np.bincount(b, rank[a] * w / out, n)
    return rank
