"""Operators on rows in an order: neighbours, running sums, islands, segments, restored ranks.

Each takes the columns that part the rows (a lecture, a conversation, a user) and an order in them. Rows that no column parts, one
global order, are cut into buckets at quantiles: windows run in buckets, and a row a bucket carries what crosses their edges, so no
task gets all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions.scalars import cosine_distance

#: Buckets of a global order, at most, and rows that are worth a bucket.
MOST_BUCKETS, BUCKET_ROWS = 512, 50_000


def with_bucket(df: DataFrame, order: str, most: int = MOST_BUCKETS, rows: int = BUCKET_ROWS) -> DataFrame:
    """df with _bucket, which follows the order (a numeric column). The cuts are one small aggregate over that column."""
    wanted = F.least(F.lit(most), F.ceil(F.count(F.lit(1)) / rows)).cast("int")
    n = df.agg(wanted).first()[0] or 1
    cuts = df.approxQuantile(order, [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    at = F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>")
    return df.withColumn("_bucket", F.size(F.filter(at, lambda c: c <= F.col(order))).cast("int"))


def lead_global(df: DataFrame, order: str, columns: list[str], **cut: int) -> DataFrame:
    """df with next_<column>: the values in the next row of the global order."""
    parted = with_bucket(df, order, **cut)
    w = Window.partitionBy("_bucket").orderBy(order)
    value = F.struct(*columns)
    heads = parted.groupBy("_bucket").agg(F.min_by(value, F.col(order)).alias("_head"))  # a row a bucket
    heads = heads.select("_bucket", F.lead("_head").over(Window.orderBy("_bucket")).alias("_head"))
    both = parted.withColumn("_next", F.lead(value).over(w)).join(F.broadcast(heads), "_bucket", "left")
    found = F.coalesce("_next", "_head")
    return both.withColumns({f"next_{c}": found[c] for c in columns}).drop("_bucket", "_next", "_head")


def running_sum_global(df: DataFrame, order: str, value: Column, name: str, before: bool = False, **cut: int) -> DataFrame:
    """df with the sum of value up to each row of the global order, or up to the one before it."""
    parted = with_bucket(df, order, **cut).withColumn("_value", value)
    sums = parted.groupBy("_bucket").agg(F.sum("_value").alias("_sum"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_bucket", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    both = parted.withColumn("_run", F.coalesce(F.sum("_value").over(w), F.lit(0))).join(F.broadcast(sums), "_bucket")
    return both.withColumn(name, F.col("_base") + F.col("_run")).drop("_bucket", "_value", "_run", "_base")


# segments of ordered vectors


def change_points(frames: DataFrame, order: str, vector: str, gamma: float = 1.08, by: list[str] | None = None) -> DataFrame:
    """Rows with distance (to the next vector), threshold (mean distance times gamma) and is_change (distance above the threshold).

    Fewer than two frames have no distance and no change.
    """
    if by:
        w = Window.partitionBy(*by)
        rows = frames.withColumn(f"next_{vector}", F.lead(vector).over(w.orderBy(order)))
        rows = rows.withColumn("distance", cosine_distance(vector, f"next_{vector}")).drop(f"next_{vector}")
        rows = rows.withColumn("threshold", F.avg("distance").over(w) * gamma)
    else:
        rows = lead_global(frames, order, [vector]).withColumn("distance", cosine_distance(vector, f"next_{vector}")).drop(f"next_{vector}")
        rows = rows.join(F.broadcast(rows.agg((F.avg("distance") * gamma).alias("threshold"))), how="cross")  # one row
    return rows.withColumn("is_change", F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)))


def segment_clusters(frames: DataFrame, order: str, vector: str, gamma: float = 1.08, by: list[str] | None = None, include_tail: bool = False) -> DataFrame:
    """Rows with cluster_id, a running count of changes, and is_best: the row before a jump opens the next cluster and represents it.

    The rows after the last change have no representative unless include_tail is set: then their last row is one.
    """
    rows = change_points(frames, order, vector, gamma, by)
    if by:
        w = Window.partitionBy(*by).orderBy(order)
        rows = rows.withColumn("cluster_id", F.sum(F.col("is_change").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        last = F.lead(order).over(w).isNull()
    else:
        rows = running_sum_global(rows, order, F.col("is_change").cast("long"), "cluster_id")
        last = F.col("distance").isNull()
    return rows.withColumn("is_best", F.col("is_change") | (F.lit(include_tail) & last))


def movement_stats(frames: DataFrame, order: str, vector: str, limit: float) -> DataFrame:
    """share_moved, mean_move, max_move over distances of neighbours; zeros for fewer than two rows."""
    rows = lead_global(frames, order, [vector]).select(cosine_distance(vector, f"next_{vector}").alias("d"))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return rows.agg(zero(F.avg((F.col("d") > limit).cast("double")), "share_moved"), zero(F.avg("d"), "mean_move"), zero(F.max("d"), "max_move"))


# duplicates and names


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in the order."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_last_value(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The same where only key and order are wanted: partial maxima, no sort, so a hot key is no hot task."""
    return df.groupBy(*key).agg(F.max(order).alias(order))


def hash_groups(df: DataFrame, hash_col: str, name: str) -> DataFrame:
    """The names of each hash, sorted."""
    return df.groupBy(hash_col).agg(F.count("*").alias("n_files"), F.array_join(F.sort_array(F.collect_list(F.col(name).cast("string"))), ",").alias("files"))


def default_titles(df: DataFrame, title: str, order: str, by: list[str] | None = None, **cut: int) -> DataFrame:
    """Empty titles become 'Slide <order>' (order counts from 1); the n-th repetition of a title gets ' (n)'.

    Without `by` a title may be any number of rows': they are counted in buckets of the order, and a row a title and bucket says how many
    come before.
    """
    named = F.coalesce(F.nullif(F.trim(F.col(title)), F.lit("")), F.concat(F.lit("Slide "), F.col(order).cast("string")))
    df = df.withColumn("_t", named)
    if by:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_t").orderBy(order)) - 1)
    else:
        df = with_bucket(df, order, **cut)
        every = Window.partitionBy("_t").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = df.groupBy("_t", "_bucket").agg(F.count("*").alias("_k")).select("_t", "_bucket", F.coalesce(F.sum("_k").over(every), F.lit(0)).alias("_base"))
        inside = F.row_number().over(Window.partitionBy("_t", "_bucket").orderBy(order)) - 1
        df = df.withColumn("_n", inside).join(before, ["_t", "_bucket"]).withColumn("_n", F.col("_n") + F.col("_base")).drop("_bucket", "_base")
    n = F.col("_n")
    return df.withColumn("unique_title", F.when(n > 0, F.concat("_t", F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col("_t"))).drop("_t", "_n")


# islands


def islands(df: DataFrame, value: str, order: str, by: list[str], name: str = "run_id") -> DataFrame:
    """Numbers runs of equal values in each part, from 1."""
    w = Window.partitionBy(*by).orderBy(order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()
    return df.withColumn("_new", new.cast("long")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def best_of_runs(df: DataFrame, value: str, order: str, by: list[str], score: str, name: str) -> DataFrame:
    """Of each run of equal values: its first order, rows, and the row with the largest positive score (by name, null if there is none)."""
    rows = islands(df, value, order, by)
    positive = F.when(F.col(score) > 0, F.struct(F.col(score), F.col(name).alias("_n")))
    return rows.groupBy(*by, "run_id", value).agg(F.min(order).alias("first_order"), F.count("*").alias("n_rows"), F.max(positive)["_n"].alias("best"))


def carried(df: DataFrame, time: str, order: str, by: list[str], name: str = "current_time") -> DataFrame:
    """The last time so far that is neither null nor 0; 0 before the first."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(F.nullif(F.col(time).cast("double"), F.lit(0.0)), True).over(w), F.lit(0.0)))


def top_restored(df: DataFrame, rating: str, order: str, share: float, by: list[str]) -> DataFrame:
    """The int(n * share) best-rated rows of each part (ties: the earlier), with their order kept in `rank_in_part`."""
    w = Window.partitionBy(*by)
    keep = F.floor(F.count(F.lit(1)).over(w) * F.lit(share))
    return df.withColumn("_k", keep).withColumn("rank_in_part", F.row_number().over(w.orderBy(F.col(rating).desc(), F.col(order)))).filter("rank_in_part <= _k").drop("_k")


def run_filled(df: DataFrame, value: str, order: str, by: list[str], reach: int, name: str = "filled") -> DataFrame:
    """Run-length smoothing of a row of 0 and 255: a run of white cells between two black ones is filled when it is shorter than reach."""
    w = Window.partitionBy(*by).orderBy(order)
    black = F.when(F.col(value) == 0, F.col(order))
    before = F.last(black, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(black, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    gap = after - before
    return df.withColumn(name, F.when((F.col(value) != 0) & (gap <= reach), 0).otherwise(F.col(value)))
