"""Hard negatives by distributed radix selection: no list of all scores of an anchor is made, sorted or shuffled.

A window is a range of scores of one anchor, over rows of its own label or of all others. Its best k are found by digits: in each block of rows a histogram
counts the window's scores by their next DIGIT bits, sums by window and bucket tell in which bucket the kth score lies, and the next level looks into
that bucket alone. At the last level the bucket is one score; then only rows with that score or a better one are gathered, of equal scores those with the least ids.
A block gives no bucket below the one in which its own k best end, for the kth of all is not below the kth of a part.

The anchors are a stated query set. Rows and anchors are packed into blocks of bounded bytes, and a block of rows meets one of anchors in a kernel (a matrix
product). Blocks of anchors are broadcast, SENT of them at a time, whatever the number of anchors. Rows are dealt without regard to labels, so a hot label
is no hot key. Positives come first, as windows over all scores of the anchor's label, then each anchor and positive is a window over the other labels.

Scores are exact: products of integers in double precision where all sums stay below 2^53, else 64-bit integers; beyond those the operator raises. A missing component of a
shorter vector is 0. Rows with a null label, a null vector or a null or non-finite component take no part. A row with a null id does, behind others of equal
score. Rows are told apart by a number of their own, so repeated rows are rows each for itself. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import discard, materialise, small_batches

#: Bits of a level's digit.
DIGIT = 10
#: Components of a block of rows and of a block of anchors (eight bytes each), and blocks of anchors that are broadcast at once.
ROW_CELLS, ANCHOR_CELLS, SENT = 1 << 18, 1 << 13, 512
#: A window of an anchor, which is found by its block and place there.
WINDOW = ["block", "pos", "w"]


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale x) of each component, as doubles, which hold these integers exactly."""
    return F.transform(vector, lambda x: F.rint(F.floor(x.cast("double") * scale)))


def takes_part(label: Column, vector: Column) -> Column:
    """Whether the label and all components are there and finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(label.isNotNull() & sound, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, shorter ones with zeros behind."""
    out = np.zeros((len(column), width))
    out[np.arange(width) < column.value_lengths().to_numpy()[:, None]] = column.flatten().to_numpy()
    return out


def _packed(rows: DataFrame, width: int, cells: int) -> DataFrame:
    """Blocks of rows as they lie: row, id, label (arrays of a value a row) and vectors (their doubles)."""
    most = max(1, cells // max(width, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(c))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*map(whole, ("row", "id", "label")), pa.array([_matrix(part.column("vector"), width).tobytes()], pa.binary())], ["row", "id", "label", "vectors"])

    return rows.select("row", "id", "label", "vector").mapInArrow(run, "row array<long>, id array<long>, label array<long>, vectors binary")


class Scored:
    """Blocks of rows and of anchors, and the scores of their pairs."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, width: int, exact: bool):
        self.width, self.exact = width, exact
        self.rows = materialise(_packed(rows, width, ROW_CELLS), "row-blocks")
        self.anchors = materialise(_packed(anchors, width, ANCHOR_CELLS).withColumn("block", F.monotonically_increasing_id()), "anchor-blocks")
        self.parts = -(-self.anchors.count() // SENT) or 1

    def places(self) -> DataFrame:
        """block, pos, anchor_id of each anchor."""
        return self.anchors.select("block", F.posexplode("id").alias("pos", "anchor_id"))

    def visit(self, windows: DataFrame, same: bool, found: Callable, schema: str) -> DataFrame:
        """What `found` gives for the windows (block, pos, w, hi, start, stop, need) and the rows of each block of rows that lie in them: those of the anchor's own
        label, itself left out, or of the others, whose depth (hi - score) is at least start and below stop."""
        fields = ("pos", "w", "hi", "start", "stop", "need")
        width, exact = self.width, self.exact

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = {c: batch.column(c) for c in batch.schema.names}
                for i in range(batch.num_rows):
                    numbers = lambda c: held[c][i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    row, label, ids = numbers("row"), numbers("label"), held["id"][i].values
                    unknown, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                    own_row, own_label = numbers("a_row"), numbers("a_label")
                    block, w = held["block"][i].as_py(), {c: held["windows"][i].values.field(c).to_numpy() for c in fields}
                    x, a = (np.frombuffer(held[c][i].as_buffer()).reshape(len(n), width) for c, n in (("vectors", row), ("a_vectors", own_row)))
                    scores = np.rint(a @ x.T).astype(np.int64) if exact else a.astype(np.int64) @ x.astype(np.int64).T
                    out = []
                    for pos in np.unique(w["pos"]).tolist():
                        inside = label == own_label[pos]
                        inside = np.flatnonzero(inside & (row != own_row[pos]) if same else ~inside)
                        score = scores[pos, inside]
                        for j in np.flatnonzero(w["pos"] == pos).tolist():
                            depth = w["hi"][j] - score
                            at = np.flatnonzero((depth >= w["start"][j]) & (depth < w["stop"][j]))
                            if len(at):
                                each = inside[at]
                                got = found(depth[at], int(w["start"][j]), int(w["need"][j]), ids[each], unknown[each], row[each])
                                n = len(got[0])
                                out.append((np.full(n, block), np.full(n, pos), np.full(n, w["w"][j]), *got))
                    if out:
                        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        names = [*WINDOW, *(c.split()[0] for c in schema.split(", "))]
        held = windows.groupBy("block").agg(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in fields))).alias("windows"))
        asked = self.anchors.select("block", F.col("row").alias("a_row"), F.col("label").alias("a_label"), F.col("vectors").alias("a_vectors")).join(held, "block")
        part = F.pmod(F.xxhash64("block"), F.lit(self.parts))
        meet = [self.rows.crossJoin(F.broadcast(asked.filter(part == i))) for i in range(self.parts)]
        return reduce(DataFrame.unionByName, [x.mapInArrow(run, f"block long, pos long, w long, {schema}") for x in meet])

    def best(self, windows: DataFrame, same: bool, k: int, deepest: int) -> DataFrame:
        """block, pos, w, rank, id, score of the first k rows of each window (block, pos, w, hi, start, stop); no depth is above `deepest`."""
        levels = max(1, -(-deepest.bit_length() // DIGIT))
        state = windows.select(*WINDOW, "hi", "start", "stop", F.lit(k).cast("long").alias("need"))
        for level in reversed(range(levels)):
            state = materialise(self._refined(state, same, DIGIT * level), "windows")
        end = state.select(*WINDOW, "hi", F.lit(0).alias("start"), (F.col("start") + 1).alias("stop"), F.lit(k).alias("need"))

        def gathered(depth, start, need, ids, unknown, row):
            order = np.lexsort((row, ids, unknown, depth))[:need]
            return depth[order], ids[order], unknown[order].astype(np.int64), row[order]

        rows = self.visit(end, same, gathered, "depth long, id long, unknown long, row long")
        rank = F.row_number().over(Window.partitionBy(*WINDOW).orderBy("depth", "unknown", "id", "row"))
        rows = rows.withColumn("rank", rank).filter(F.col("rank") <= k).join(state.select(*WINDOW, "hi"), WINDOW)
        return rows.select(*WINDOW, "rank", F.when(F.col("unknown") == 0, F.col("id")).alias("id"), (F.col("hi") - F.col("depth")).alias("score"))

    def _refined(self, state: DataFrame, same: bool, shift: int) -> DataFrame:
        """The windows, narrowed to the bucket of 2^shift depths that holds their need-th best row; a window with fewer rows ends with its last depth."""

        def histogram(depth, start, need, ids, unknown, row):
            bucket, n = np.unique((depth - start) >> shift, return_counts=True)
            keep = int(np.searchsorted(np.cumsum(n), need)) + 1
            return bucket[:keep], n[:keep]

        counts = self.visit(state, same, histogram, "bucket long, n long").groupBy(*WINDOW, "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*WINDOW).orderBy("bucket"))
        reached = counts.withColumn("upto", upto).join(state.select(*WINDOW, "need"), WINDOW).filter("upto >= need")
        end = reached.groupBy(*WINDOW).agg(F.min(F.struct("bucket", "upto", "n")).alias("end"))
        first = F.col("start") + F.shiftleft(F.col("end.bucket"), shift)
        missing = F.col("end").isNull()
        return state.join(end, WINDOW, "left").select(
            *WINDOW, "hi",
            F.when(missing, F.col("stop") - 1).otherwise(first).alias("start"),
            F.when(missing, F.col("stop")).otherwise(F.least(first + (1 << shift), "stop")).alias("stop"),
            F.when(missing, F.col("need")).otherwise(F.col("need") - F.col("end.upto") + F.col("end.n")).alias("need"),
        )


def mine(df: DataFrame, id: Column, label: Column, vector: Column, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product with the anchor of vectors of floor(scale x); higher ones come first, ties by the smaller id. Anchors are the rows
    where `anchor` holds; their positives are the first other rows of their label. Of each anchor and positive, the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Labels and ids are numbers.
    """
    small_batches(df.sparkSession)
    sound = df.filter(takes_part(label, vector)).select(id.cast("long").alias("id"), label.cast("long").alias("label"), quantised(vector, scale).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = materialise(sound.withColumn("row", F.monotonically_increasing_id()), "vectors")
    width, norm = rows.agg(F.max(F.size("vector")), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()
    if (norm or 0) >= 1 << 56:
        raise ValueError("scores of these vectors do not fit into 64 bits")
    scored = Scored(rows, rows.filter("anchor"), width or 0, exact=(norm or 0) < 1 << 53)
    most = int(norm or 0) + 1
    whole = scored.places().select("block", "pos", F.lit(0).alias("w"), F.lit(most).cast("long").alias("hi"), F.lit(0).cast("long").alias("start"), F.lit(2 * most + 1).cast("long").alias("stop"))
    found = scored.best(whole, True, positives, 2 * most).select("block", "pos", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = materialise(found, "positives")
    p = F.col("positive_score")
    least, top = F.call_function("div", p * low + 99, F.lit(100).cast("long")), F.call_function("div", p * high, F.lit(100).cast("long"))
    windows = found.filter(p >= 0).select(*WINDOW, top.alias("hi"), F.lit(0).cast("long").alias("start"), (top - least + 1).alias("stop")).filter("stop > 0")
    deepest = windows.agg(F.max("stop")).first()[0] or 1
    best = materialise(scored.best(windows, False, negatives, deepest), "negatives")
    out = best.join(found, WINDOW).join(scored.places(), ["block", "pos"])
    out = materialise(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined")
    discard(rows, scored.rows, scored.anchors, found, best)
    return out


def report(embeddings: DataFrame) -> DataFrame:
    """mine over embeddings: anchors are vec_ids divisible by 100; where they are divisible by 7 the label becomes (label + 1) % 10."""
    v = F.col("vec_id")
    label = F.when(v % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(embeddings, v, label, F.col("embedding"), v % 100 == 0)


def sql(embeddings: str = "embeddings") -> str:
    """The same in DuckDB's SQL."""
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM {embeddings}
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, br) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.br ORDER BY s.score DESC, s.vec_id, s.br) AS rank
 FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
