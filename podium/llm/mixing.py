"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed place on a line of hashes. A source's budget becomes a threshold on that line: sizes are summed by source
and hash bucket, the bucket where the budget ends is refined with the next bits of the hash, and documents below the threshold are
taken. Nothing is sorted and no source's documents meet in one task: partial sums of at most 4096 buckets a source are
shuffled, and levels after the first touch the documents of one bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import materialise

#: White-space-separated words, as a regular expression.
WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 3
#: Sources whose thresholds may be broadcast (some 50 bytes each).
MOST_SENT = 100_000


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _number, from 0 without gaps, among the rows of equal doc_id and text, so that each has a place of its own.

    Where none are equal, which a count of their hashes tells, nothing is shuffled. Else a hot group is numbered in the parts in which its rows were
    read, and parts are told how many rows stand before them; which of equal rows gets which number is the same to the result.
    """
    group = [F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_t")]
    if not docs.select(*group).groupBy("_d", "_t").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").limit(1).count():
        return docs.withColumn("_number", F.lit(0).cast("long"))
    rows = docs.select(F.struct("*").alias("_whole"), *group, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_t", "_part").orderBy("_at")))
    before = Window.partitionBy("_d", "_t").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = docs.select(*group, F.spark_partition_id().alias("_part")).groupBy("_d", "_t", "_part").agg(F.count(F.lit(1)).alias("_k"))
    parts = parts.withColumn("_base", F.coalesce(F.sum("_k").over(before), F.lit(0))).filter("_base > 0").drop("_k")
    same = F.expr("r._d <=> p._d AND r._t = p._t AND r._part = p._part")
    both = rows.alias("r").join(parts.alias("p"), same, "left")
    return both.select("_whole.*", (F.col("_n") - 1 + F.coalesce("_base", F.lit(0))).cast("long").alias("_number"))


def place(docs: DataFrame) -> Column:
    """A row's place on the line of hashes, of 36 bits: by its text and its number among equal rows too."""
    return F.shiftrightunsigned(F.xxhash64(docs["doc_id"].cast("long"), docs["text"], docs["_number"]), 64 - BITS * LEVELS)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; a null text has none) and place of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), place(docs).alias("place"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """source, source_size, target of each source.

    Sources by code point, null last, weigh by `weights`, repeating, and share `share` of all sizes; none gets more than `most`
    times its size, the excess goes to the others by weight. Sources are levelled in the order in which they reach their limit.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * most
    rows = by_source.withColumn("weight", weight).withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(share)).withColumn("reach", limit / F.col("weight"))
    by_reach = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(limit).over(by_reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.col("budget") - before) / F.sum("weight").over(by_reach.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("full", F.col("reach") <= F.col("level"))
    rest = F.min(F.when(~F.col("full"), F.struct("reach", "source", "level"))).over(Window.partitionBy())["level"]
    return rows.select("source", "source_size", F.when(F.col("full"), limit.cast("double")).otherwise(F.col("weight") * rest).alias("target"))


def _refine(sized: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """The state with the next bits of each source's threshold. prefix: the bits so far; left: the budget inside the bucket."""
    below = BITS * (LEVELS - 1 - level)
    inside = sized.alias("d").join(state.select("source", "prefix", "left").alias("s"), F.expr("d.source <=> s.source") & (F.shiftright(F.col("place"), below + BITS) == F.col("prefix")))
    bucket = F.shiftright(F.col("place"), below).bitwiseAND((1 << BITS) - 1)
    sums = inside.groupBy("s.source", "left", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
    found = sums.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "upto", "words"))).alias("end"))
    both = state.alias("s").join(found.alias("f"), F.expr("s.source <=> f.source"), "left")
    return both.select(
        "s.source", "source_size", "target", "copies",
        # without an end the whole bucket is taken: the threshold then stands behind all of it
        (F.col("prefix") * (1 << BITS) + F.coalesce(F.col("end.bucket"), F.lit((1 << BITS) - 1))).alias("prefix"),
        F.when(F.col("end").isNull(), F.lit(float(1 << 62))).otherwise(F.col("left") - (F.col("end.upto") - F.col("end.words"))).alias("left"),
        F.col("end.words").alias("words"),
    )


def thresholds(sized: DataFrame, target: DataFrame) -> DataFrame:
    """source, source_size, target, copies (that all its documents get), threshold (places below it get one more)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    target = materialise(target, "targets")  # a row a source, as are the states
    state = target.withColumn("copies", F.floor(rate).cast("long")).withColumn("prefix", F.lit(0).cast("long")).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    for level in range(LEVELS):
        state = materialise(_refine(sized, state.drop("words"), level), "thresholds")
    nearer = F.col("left") * 2 >= F.coalesce(F.col("words"), F.lit(0))  # the last bucket is taken whole if that is nearer
    return state.select("source", "source_size", "target", "copies", (F.col("prefix") + nearer.cast("long")).alias("threshold"))


def _sent(limits: DataFrame) -> DataFrame:
    """limits, marked to be broadcast if they are counted to be few; else documents meet them by a shuffle."""
    return F.broadcast(limits) if limits.count() <= MOST_SENT else limits


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    Equal rows (doc_id and text) are taken one by one. A null or empty text has size 0 and takes nothing; null sources form one source; an
    empty table gives no rows; other columns are ignored. The choice depends on doc_id and text alone, so reruns agree.
    """
    sized = materialise(sizes(numbered(docs.select("doc_id", "text", "source"))), "sizes")
    limits = _sent(thresholds(sized, targets(sized, weights, most, share)))
    more: Column = (F.col("place") < F.col("threshold")).cast("long")
    both = sized.alias("d").join(limits.alias("s"), F.expr("d.source <=> s.source"))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + more)).alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """The documents, all columns as they are, each as often as the mix takes it. Those without words, null texts too, come once: they cost
    nothing. Equal rows are taken one by one; an empty table stays empty."""
    docs = numbered(docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source"))
    sized = materialise(sizes(docs), "sizes")
    limits = thresholds(sized, targets(sized, weights, most, share))
    limits = _sent(limits.select(F.col("source").alias("_source"), F.col("copies").alias("_copies"), F.col("threshold").alias("_threshold")))
    placed = docs.select("_row", F.col("source").cast("string").alias("_own"), place(docs).alias("_place"), (F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) == 0).alias("_empty"))
    both = placed.join(limits, F.col("_own").eqNullSafe(F.col("_source")))
    times = F.when(F.col("_empty"), 1).otherwise(F.col("_copies") + (F.col("_place") < F.col("_threshold")).cast("long"))
    return both.filter(times > 0).select("_row.*", F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("_time")).drop("_time")
