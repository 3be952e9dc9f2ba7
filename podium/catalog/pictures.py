"""Queries on images that are drawn from the rows' numbers, so that SQL knows what the kernels must find."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from podium.catalog.registry import Registry, table
from podium.operators import images

_R = Registry()


def _drawn(spark, sf_dir, height: int, width: int, **pixels):
    """vec_id, height, width and a column of pixels for each expression of k (vec_id), y (a long) and x. Rows are drawn within the image, so that no pixel divides for its place."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(height).alias("height"), F.lit(width).alias("width"))
    at = lambda e: f"flatten(transform(sequence(0L, {height - 1}L), y -> transform(sequence(0, {width - 1}), x -> cast({re.sub(r'\bk\b', 'vec_id', e)} as int))))"
    return rows.select("*", *(F.expr(at(e)).alias(name) for name, e in pixels.items()))


def vector_pixels(vector: str):
    """A column: the components of a vector of floats as grey values, in single precision as in SQL."""
    real = lambda x: F.lit(float(x)).cast("float")
    return F.transform(vector, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), (real(128) + x.cast("float") * real(400)).cast("int"))))


_BORDER = "SELECT vec_id, vec_id % 4 AS t, vec_id // 4 % 4 AS b, vec_id // 16 % 4 AS l, vec_id // 64 % 4 AS r FROM embeddings"


@_R.add("border_removal", f"""SELECT vec_id, CASE WHEN vec_id % 10 = 9 THEN 'solid' WHEN t + b + l + r = 0 THEN 'none' ELSE 'cut' END AS how,
CASE WHEN vec_id % 10 = 9 THEN 0 WHEN t + b + l + r = 0 THEN 60 ELSE 60 - t - b + least(t, 2) + least(b, 2) - 6 END AS new_height,
CASE WHEN vec_id % 10 = 9 THEN 0 WHEN t + b + l + r = 0 THEN 80 ELSE 80 - l - r + least(l, 2) + least(r, 2) - 6 END AS new_width FROM ({_BORDER})""")
def border_removal(spark, sf_dir):
    """Chequered images in black borders of 0 to 3 pixels a side; every tenth has one colour. What is brighter than the border reaches two
    pixels into it (the blur), and three are cut off behind it."""

    def work(image):
        out, how = images.without_border(image)
        return (how, *(out.shape if out is not None else (0, 0)))

    inside = "y >= k % 4 AND y < 60 - (k div 4) % 4 AND x >= (k div 16) % 4 AND x < 80 - (k div 64) % 4"
    drawn = _drawn(spark, sf_dir, 60, 80, pixels=f"CASE WHEN k % 10 = 9 THEN 77 WHEN {inside} THEN 120 + (x + y) % 2 * 60 ELSE 0 END")
    return images.applied(drawn, "vec_id", work, "how string, new_height long, new_width long")


@_R.add("camera_shift", "SELECT vec_id, round(sqrt((vec_id % 3) * (vec_id % 3) + (vec_id // 3 % 3) * (vec_id // 3 % 3)), 6) AS shift FROM embeddings")
def camera_shift(spark, sf_dir):
    """A texture and the same moved by 0 to 2 pixels down and right."""
    grain = "pmod(hash(({y}) * 131 + ({x}) * 7919 + 17), 256)"
    first, second = grain.format(y="y", x="x"), grain.format(y="pmod(y - k % 3, 60)", x="pmod(x - (k div 3) % 3, 80)")
    drawn = _drawn(spark, sf_dir, 60, 80, first=first, second=second)
    return images.applied(drawn, "vec_id", lambda a, b: (round(images.camera_move(a, b), 6),), "shift double", "first", "second")


def _squares(n: str) -> str:
    """Black squares of 8 pixels on white, n of 12 places in a grid of 4 by 3."""
    return f"CASE WHEN y % 20 BETWEEN 6 AND 13 AND x % 20 BETWEEN 6 AND 13 AND (y div 20) * 4 + (x div 20) < {n} THEN 0 ELSE 255 END"


@_R.add("content_added", "SELECT vec_id, (1 + vec_id % 6) * 1.09 < 1 + vec_id // 6 % 12 AS added, sign((vec_id // 6 % 12) - vec_id % 6)::INT AS more FROM embeddings")
def content_added(spark, sf_dir):
    """One to six squares, then one to twelve."""

    def work(a, b):
        added, more = images.content_added(a, b)
        return added, int(more > 0) - int(more < 0)

    drawn = _drawn(spark, sf_dir, 60, 80, first=_squares("1 + k % 6"), second=_squares("1 + (k div 6) % 12"))
    return images.applied(drawn, "vec_id", work, "added boolean, more int", "first", "second")


@_R.add("bar_stroke_width", "SELECT vec_id, ceil((1 + vec_id % 9) / 2)::DOUBLE AS stroke FROM embeddings")
def bar_stroke_width(spark, sf_dir):
    """A bar of one to nine rows: the way from its middle to the ground."""
    drawn = _drawn(spark, sf_dir, 30, 20, pixels="CASE WHEN y BETWEEN 10 AND 10 + k % 9 THEN 0 ELSE 255 END")
    return images.applied(drawn, "vec_id", lambda a: (images.stroke_width(a < 128),), "stroke double")


@_R.add("image_resizing", "SELECT vec_id, 45 AS new_height, 60 AS new_width, (vec_id * 37 % 256)::DOUBLE AS low, (vec_id * 37 % 256)::DOUBLE AS high, 224 AS input_height, 224 AS input_width FROM embeddings")
def image_resizing(spark, sf_dir):
    """Images of one colour, to a height and to a model's input."""

    def work(a):
        out = images.to_height(a, 45)
        return (*out.shape, float(out.min().round(6)), float(out.max().round(6)), *images.model_input(a).shape[1:])

    drawn = _drawn(spark, sf_dir, 30, 40, pixels="k * 37 % 256")
    return images.applied(drawn, "vec_id", work, "new_height int, new_width int, low double, high double, input_height int, input_width int")


@_R.add("image_predicates", """WITH p AS (SELECT vec_id, i, greatest(0, least(255, trunc(128 + x * 400)))::INT AS p FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
m AS (SELECT vec_id, avg(p) AS m, min(p) FILTER (i = 0) AS f FROM p GROUP BY 1),
e AS (SELECT vec_id, round(-sum(n / 64.0 * log2(n / 64.0)), 6) AS entropy FROM (SELECT vec_id, p, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1)
SELECT vec_id, format('{:016x}', sum(CASE WHEN p > m THEN 1::HUGEINT << (63 - i) ELSE 0 END)::UBIGINT) AS average, bool_and(abs(p - f) < 5) AS solid,
bool_and(p < 5) FILTER (i < 8) OR bool_and(p < 5) FILTER (i >= 56) OR bool_and(p < 5) FILTER (i % 8 = 0) OR bool_and(p < 5) FILTER (i % 8 = 7) AS border, any_value(entropy) AS entropy
FROM p JOIN m USING (vec_id) JOIN e USING (vec_id) GROUP BY vec_id""")
def image_predicates(spark, sf_dir):
    """Average hash, one colour, black edge and entropy of small images drawn from the vectors."""
    drawn = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), vector_pixels("embedding").alias("pixels"))
    work = lambda a: (images.average_hash(a), images.is_solid(a), images.has_black_border(a), round(images.entropy(a), 6))
    return images.applied(drawn, "vec_id", work, "average string, solid boolean, border boolean, entropy double")


@_R.add("page_crop", "SELECT vec_id, vec_id % 7 = 6 AS failed, CASE WHEN vec_id % 7 = 6 THEN 60 ELSE 29 + vec_id % 5 END AS page_height, CASE WHEN vec_id % 7 = 6 THEN 90 ELSE 50 + vec_id % 11 END AS page_width FROM embeddings")
def page_crop(spark, sf_dir):
    """A bright page on a dark wall, 31 rows or more high; every seventh wall has none. The blur takes the pixels at the page's corners, so the
    ways from corner to corner are 29 or more and 50 or more."""

    def work(a):
        page, failed = images.cropped(a, "contours")
        return (failed, *page.shape)

    page = "y BETWEEN 12 AND 12 + 30 + k % 5 AND x BETWEEN 14 AND 14 + 50 + k % 11"
    drawn = _drawn(spark, sf_dir, 60, 90, pixels=f"CASE WHEN k % 7 <> 6 AND {page} THEN 230 ELSE 20 END")
    return images.applied(drawn, "vec_id", work, "failed boolean, page_height long, page_width long")


QUERIES, ORACLE_SQL = _R.queries, _R.sql
