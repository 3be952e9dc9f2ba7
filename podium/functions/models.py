"""Where learned models attach: loaders by name, one model a Python worker, predictions in Arrow batches.

A loader is called once in each worker, not for each row or batch; what it gives must take a list of inputs and give a list of outputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOADED: dict[str, Callable] = {}


def loaded(name: str, loader: Callable[[], Callable]) -> Callable:
    """The worker's model of that name."""
    if name not in _LOADED:
        _LOADED[name] = loader()
    return _LOADED[name]


def as_column(name: str, loader: Callable[[], Callable[[list], list]], kind: str) -> Callable[[Column], Column]:
    """A function of a column that runs a model over its values: an abstract, a title, tags, an embedding."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(name, loader)
        for part in parts:
            yield pd.Series(model(part.tolist()), index=part.index)

    return run


def classified(df: DataFrame, key: str, name: str, loader: Callable[[], Callable[[list], tuple[np.ndarray, np.ndarray]]], classes: list[str], content: str = "content") -> DataFrame:
    """key, class, idx, probs, features of each image: the model gives scores and features, the scores become probabilities here."""

    def work(parts):
        model = loaded(name, loader)
        for part in parts:
            scores, features = model(part[content].tolist())
            e = np.exp(scores - scores.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            yield pd.DataFrame({key: part[key], "class": [classes[i] for i in best], "idx": best.astype("int32"), "probs": [dict(zip(classes, map(float, row), strict=True)) for row in p], "features": list(np.asarray(features, np.float32))})

    return df.select(key, content).mapInPandas(work, f"`{key}` {dict(df.dtypes)[key]}, class string, idx int, probs map<string,double>, features array<float>")


def low_confidence(df: DataFrame, probs: str = "probs", limit: float = 0.60) -> DataFrame:
    """Rows whose best class is less probable than the limit: for a human to check."""
    return df.filter(F.array_max(F.map_values(probs)) < limit)


def occlusion(image: np.ndarray, score: Callable[[list[np.ndarray]], list[float]], patch: int, stride: int, fill: float = 0.0) -> np.ndarray:
    """How much a class's score falls when a patch of the image is covered, for each place of the patch."""
    ys, xs = range(0, max(1, image.shape[0] - patch + 1), stride), range(0, max(1, image.shape[1] - patch + 1), stride)
    covered = []
    for y in ys:
        for x in xs:
            c = image.copy()
            c[y : y + patch, x : x + patch] = fill
            covered.append(c)
    whole = score([image])[0]
    return whole - np.array(score(covered)).reshape(len(ys), len(xs))


def text_regions(scores: np.ndarray, geometry: np.ndarray, least: float = 0.5, cell: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(boxes as xmax, ymax, xmin, ymin, scores) of a text detector's maps: scores (H x W), geometry (5 x H x W: distances to the top, right,
    bottom and left edge, and the angle)."""
    y, x = np.nonzero(scores >= least)
    top, right, bottom, left, angle = geometry[:, y, x]
    cos, sin = np.cos(angle), np.sin(angle)
    end_x, end_y = x * cell + cos * right + sin * bottom, y * cell - sin * right + cos * bottom
    boxes = np.stack([end_x, end_y, end_x - (right + left), end_y - (top + bottom)], axis=1)
    return np.rint(boxes).astype(int), scores[y, x]


def retried(run: Callable, tries: int = 5, wait: float = 0.0, fallback: Callable | None = None) -> Callable:
    """run, tried again where it raises; then the fallback (a model that takes longer inputs), if there is one."""
    import time

    def go(*args):
        for k in range(tries):
            try:
                return run(*args)
            except (OSError, RuntimeError):
                if k + 1 == tries:
                    break
                time.sleep(wait)
        if fallback is None:
            raise RuntimeError(f"failed {tries} times")
        return fallback(*args)

    return go
