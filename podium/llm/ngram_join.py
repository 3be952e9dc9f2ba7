"""N-gram Jaccard join of documents: rare-first prefix filtering with length, positional and suffix filters.

1. A sketch counts all documents' shingles by hash bucket (its size is a parameter, not the data's); the order "rarer bucket first, then
   hash" is the same everywhere, so two sets that link share a shingle in their prefixes whatever the sketch says.
2. Documents with equal sets form one class, numbered by its smallest doc_id (by a hash of the set where one doc_id stands for several). One
   document of it goes on. Its prefix goes into an index by shingle, where only shingles of two classes or more stay.
3. Pairs that share a prefix shingle pass the length and the positional filter, then, once per pair, the suffix filter: what lies behind the
   pair's first common shingle is cut into parts by hash, whose sizes bound from above what can still be common. What is left is verified
   once by merging both whole sets.
4. First each class is paired with the first class of each of its index rows only; their links make components. Then all pairs that share a prefix
   shingle and lie in different components so far follow, without those that were verified before. Pairs inside a component can't change it,
   so a large group of near copies never becomes all its pairs, and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import discard, materialise, partitions, texts
from podium.llm.graph import components
from podium.llm.shingles import batches_of_sets

#: 2^SKETCH_BITS counters of a byte, summed in blocks. The more of them, the better rare shingles are told apart.
SKETCH_BITS, BLOCK = 24, 1 << 14
#: Parts of a set by hash, and the coarser ones (a byte of a long each) that are counted up to each place of a prefix.
PARTS, COARSE = 32, 8
#: Rows of one shingle that are compared in one task; longer rows are cut into blocks.
ROW = 8192
#: Ids that may be broadcast (16 bytes each at most); more are joined by a shuffle.
MOST_SENT = 500_000
#: Members that are compared with one set in a task.
FAN = 512


def needed(n, percent: int):
    """The least size of a partner of a set of n, which is the least overlap too."""
    return -(-percent * n // 100)


def overlap(a, b, percent: int):
    """The least overlap of linked sets of these sizes: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents' shingles fall in each hash bucket, 255 at most; summed by blocks of buckets on the executors."""
    spark, shift = docs.sparkSession, np.uint64(64 - SKETCH_BITS)

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, "<u2")
        for _, sets in batches_of_sets(batches, size):
            if sets:
                where, more = np.unique(np.concatenate(sets) >> shift, return_counts=True)
                where = where.astype(np.int64)
                total[where] = np.minimum(total[where] + more, 65535)
        press = zstandard.ZstdCompressor(level=1)
        total = total.reshape(-1, BLOCK)
        for k in np.flatnonzero(total.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([press.compress(total[k].tobytes())], pa.binary())], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, x in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(open_.decompress(x.as_buffer()), "<u2").astype(np.uint32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 255).astype(np.uint8).tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    parts = docs.select("text").mapInArrow(count, "block int, counts binary").repartition(partitions(spark), "block").mapInArrow(add, "block int, counts binary")
    whole = np.zeros(1 << SKETCH_BITS, np.uint8)
    for k, counts in parts.collect():  # a byte a bucket
        whole[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(counts, np.uint8)
    return whole


def class_of(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8", 1)[0])


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, tk, n, h (its set's hash; null without words), prefix (shingles, rarest first), parts (sizes by hash) of every document."""
    spark, shift = docs.sparkSession, np.uint64(64 - SKETCH_BITS)
    counts = spark.sparkContext.broadcast(sketch(docs, size))

    def run(batches):
        for batch, sets in batches_of_sets(batches, size):
            keys, heads, parts = [], [], []
            for s in sets:
                keys.append(class_of(s) if len(s) else None)
                n = len(s) - needed(len(s), percent) + 1 if len(s) else 0
                heads.append(s[np.lexsort((s, counts.value[s >> shift]))[:n]].astype("<u8").tobytes())
                parts.append(np.bincount(part_of(s, PARTS), minlength=PARTS).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.int64()), pa.array(heads, pa.binary()), pa.array(parts, pa.binary())], ["doc_id", "tk", "n", "h", "prefix", "parts"])

    return docs.select("doc_id", F.xxhash64("text").alias("tk"), "text").mapInArrow(run, "doc_id long, tk long, n long, h long, prefix binary, parts binary")


def part_of(shingles: np.ndarray, parts: int) -> np.ndarray:
    """The part of each shingle, by the top bits of its hash."""
    return (shingles >> np.uint64(64 - parts.bit_length() + 1)).astype(np.int64)


def upto(prefix: np.ndarray) -> np.ndarray:
    """For each place of a prefix: how many of its shingles up to there, itself included, lie in each coarse part, 127 at most, a byte each of
    a long. The longs ascend with the places."""
    counts = np.zeros((len(prefix), COARSE), np.int64)
    counts[np.arange(len(prefix)), part_of(prefix, COARSE)] = 1
    return np.minimum(np.cumsum(counts, axis=0), 127).astype(np.uint8).view("<i8").reshape(-1)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their sizes."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(key)))


def index(classes: DataFrame) -> DataFrame:
    """shingle, c, n, at, upto of each class's prefix, where another class has the shingle too; with the first class of that shingle's row (o_)."""
    spark = classes.sparkSession
    names = ("shingle", "c", "n", "at", "upto")

    def spread(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                heads = [np.frombuffer(x.as_buffer(), "<u8") for x in part.column("prefix")]
                sizes = [len(h) for h in heads]
                at = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
                rep = lambda c: np.repeat(np.asarray(part.column(c), dtype=np.int64), sizes)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(rep("c")), pa.array(rep("n").astype(np.int32)), pa.array(at), pa.array(np.concatenate(list(map(upto, heads))))], list(names))

    def shared(batches):
        last: dict[str, np.ndarray] | None = None  # the open run's first row, and the row before this batch

        def out(x, first, keep):
            cols = [pa.array(x[k][keep]) for k in names] + [pa.array(x[k][first][keep]) for k in names[1:]]
            return pa.RecordBatch.from_arrays(cols, [*names, *(f"o_{k}" for k in names[1:])])

        for batch in batches:
            x = {k: np.asarray(batch.column(k)) for k in names}
            if not len(x["c"]):
                continue
            if last is not None:  # two rows are put before: the open run's first and its last, which is still to be judged
                x = {k: np.concatenate([last[k], v]) for k, v in x.items()}
            lead = 0 if last is None else 2
            begin, sizes = _runs(x["shingle"])
            number = np.repeat(np.arange(len(begin)), sizes)
            first = begin[number]
            more = np.zeros(len(number), bool)
            more[:-1] = number[1:] == number[:-1]
            keep = (np.arange(len(number)) > first) | more
            if lead and x["c"][0] == x["c"][1] and x["shingle"][0] == x["shingle"][1]:  # the run's first is its last so far: it is judged once
                keep[1] = more[1]
            keep[:1] &= not lead
            keep[-1] = False  # judged with the next batch
            if keep.any():
                yield out(x, first, keep)
            last = {k: v[[first[-1], -1]] for k, v in x.items()}
        if last is not None and last["c"][0] != last["c"][1]:
            yield out(last, np.array([0, 0]), np.array([False, True]))

    flat = "shingle long, c long, n int, at int, upto long"
    rows = classes.select("c", "n", "prefix").mapInArrow(spread, flat)
    dealt = rows.repartition(partitions(spark), "shingle").sortWithinPartitions("shingle", "c")
    return dealt.mapInArrow(shared, flat + ", o_c long, o_n int, o_at int, o_upto long")


def small(ids: DataFrame) -> DataFrame:
    """A list of ids, marked to be broadcast if it is counted to be short enough; a longer one is joined by a shuffle."""
    ids = materialise(ids, "ids")
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


def _passes(a: str, b: str, percent: int) -> str:
    """Length and positional filter in SQL, of columns with these prefixes."""
    least = f"{percent} * ({a}n + {b}n)"
    room = f"least({a}n - {a}at, {b}n - {b}at)"
    return f"100 * {a}n >= {percent} * {b}n AND 100 * {b}n >= {percent} * {a}n AND {100 + percent} * {room} >= {least}"


#: A pair as it leaves the index, at its first shared row: its classes, how many shingles before that one can be common, and for each class
#: what lies up to there.
PAIR = "a long, b long, before int, upto_a long, upto_b long"


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair (columns of PAIR) once, at its first row: all three ascend with the places, so the least ones belong together."""
    return pairs.groupBy("a", "b").agg(*(F.min(k).alias(k) for k in ("before", "upto_a", "upto_b")))


def first_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each class with the first class of its index row (rows are sorted by class), once. Both may share rows of another first class."""
    fine = rows.filter(f"o_c <> c AND {_passes('o_', '', percent)}")
    return _once(fine.select(F.col("o_c").alias("a"), F.col("c").alias("b"), F.least("o_at", "at").alias("before"), F.col("o_upto").alias("upto_a"), F.col("upto").alias("upto_b")))


def other_pairs(rows: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs that share an index row but no component, once. Rows whose classes are all of one component are left out before they are unfolded."""
    spark = rows.sparkSession
    roots = materialise(labels.select(F.col("node").alias("c"), "root"), "roots")
    rooted = rows.select("shingle", "c").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    several = rooted.groupBy("shingle").agg(F.count("*").alias("k"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    several = materialise(several.select("shingle", "k"), "several")
    named = rows.select("shingle", "c", "n", "at", "upto").join(several, "shingle").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    blocks = F.ceil(F.col("k") / (ROW // 2)).cast("int")
    named = named.withColumn("m", F.when(F.col("k") > ROW, blocks).otherwise(1)).withColumn("mine", F.pmod(F.xxhash64("c"), F.col("m")).cast("int"))
    named = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))

    def cross(batches):
        names = ("shingle", "lo", "hi", "mine", "c", "n", "at", "root", "upto")
        rest = None

        def pairs(x):
            """x: whole groups (shingle, lo, hi), sorted by them and n."""
            begin, sizes = _runs(x["shingle"] * np.int64(31) + x["lo"] * np.int64(1_000_003) + x["hi"] * np.int64(7919))
            found = []
            for i, k in zip(begin[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                c, n, at, root, mine = (x[f][i : i + k] for f in ("c", "n", "at", "root", "mine"))
                if (root == root[0]).all():
                    continue
                cross_only = x["lo"][i] != x["hi"][i]
                for a in range(0, k, 1024):
                    s = slice(a, a + 1024)
                    least = -(-percent * (n[s, None] + n[None, :]) // (100 + percent))
                    good = (root[s, None] != root[None, :]) & (n[s, None] <= n[None, :]) & (100 * n[s, None] >= percent * n[None, :]) & (np.minimum(n[s, None] - at[s, None], n[None, :] - at[None, :]) >= least)
                    if cross_only:
                        good &= mine[s, None] != mine[None, :]
                    u, v = np.nonzero(good)
                    u, v = u + (i + a), v + i
                    low = x["c"][u] < x["c"][v]
                    found.append(np.stack([np.where(low, u, v), np.where(low, v, u)], axis=1)[x["c"][u] != x["c"][v]])
            u, v = (np.concatenate(found) if found else np.zeros((0, 2), np.int64)).T
            order = np.lexsort((x["at"][u], x["c"][v], x["c"][u]))  # a pair of several rows leaves once, at the first
            u, v = u[order], v[order]
            new = np.ones(len(u), bool)
            new[1:] = (x["c"][u[1:]] != x["c"][u[:-1]]) | (x["c"][v[1:]] != x["c"][v[:-1]])
            u, v = u[new], v[new]
            return [x["c"][u], x["c"][v], np.zeros(len(u), np.int32), x["upto"][u], x["upto"][v]]

        def send(p):
            return pa.RecordBatch.from_arrays(list(map(pa.array, p)), ["a", "b", "before", "upto_a", "upto_b"])

        for batch in batches:
            x = {k: np.asarray(batch.column(k), dtype=np.int64) for k in names}
            if rest is not None:
                x = {k: np.concatenate([rest[k], v]) for k, v in x.items()}
            if not len(x["c"]):
                continue
            # the last group may go on in the next batch
            same = (x["shingle"] == x["shingle"][-1]) & (x["lo"] == x["lo"][-1]) & (x["hi"] == x["hi"][-1])
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            rest = {k: v[whole:] for k, v in x.items()}
            if whole and len((p := pairs({k: v[:whole] for k, v in x.items()}))[0]):
                yield send(p)
        if rest is not None and len((p := pairs(rest))[0]):
            yield send(p)

    dealt = named.select("shingle", "lo", "hi", "mine", "c", "n", "at", "root", "upto").repartition(partitions(spark), "shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi", "n", "c")
    return _once(dealt.mapInArrow(cross, PAIR))


def most_common(parts_a: np.ndarray, parts_b: np.ndarray, before: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> np.ndarray:
    """The suffix filter's bound: how many shingles two sets can have in common.

    Those before a common one, as many as are said, that one, and of each part of what lies behind it the smaller side's. Counts up to there
    stop at 127, so that more may seem to lie behind than does, never less. Whole parts bound it as well.
    """
    coarse = lambda x: x.reshape(len(x), COARSE, -1).sum(axis=2)
    counts = lambda x: np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, COARSE).astype(np.int64)
    behind = np.minimum(coarse(parts_a) - counts(upto_a), coarse(parts_b) - counts(upto_b)).sum(axis=1)
    return np.minimum(before + 1 + behind, np.minimum(parts_a, parts_b).sum(axis=1))


def suffix_filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs whose sets can still link."""
    of = lambda x: classes.select(F.col("c").alias(x), F.col("parts").alias(f"parts_{x}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.frombuffer(b"".join(v.as_buffer() for v in batch.column(f"parts_{k}")), "<u4").reshape(-1, PARTS).astype(np.int64) for k in "ab"]
            most = most_common(*parts, *(np.asarray(batch.column(k), dtype=np.int64) for k in ("before", "upto_a", "upto_b")))
            keep = pa.array(most >= overlap(*(x.sum(axis=1) for x in parts), percent))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in "ab"], ["a", "b"])

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "before", "upto_a", "upto_b", "parts_a", "parts_b").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose whole sets link, each verified once. Sets are made anew, for the documents that stand for classes in pairs."""
    spark = docs.sparkSession
    asked = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    asked = asked.join(reps, "c").select(F.col("doc_id").alias("_doc"), "h", "c")

    def sets_of(batches):
        for batch, sets in batches_of_sets(batches, size):
            own = [(c, s) for s, h, c in zip(sets, batch.column("h").to_pylist(), batch.column("c").to_pylist(), strict=True) if len(s) and class_of(s) == h]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int64()), pa.array([s.astype("<u8").tobytes() for _, s in own], pa.binary())], ["c", "items"])

    made = docs.join(small(asked), F.col("doc_id") == F.col("_doc")).select("text", "h", "c").mapInArrow(sets_of, "c long, items binary")
    sets = materialise(made, "sets", "uncompressed")
    fan = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("salts")), "fan")
    firsts = fan.join(sets, F.col("a") == F.col("c")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "items")
    others = pairs.join(fan, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b").join(sets, F.col("b") == F.col("c")).select("a", "salt", "b", "items")

    def verify(batches):
        one, last = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, b, items in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("items"), strict=True):
                if b is None:
                    one = np.frombuffer(items.as_buffer(), "<u8").copy()
                elif (a, b) != last:  # a class's set may be there several times, made of equal rows
                    x, last = np.frombuffer(items.as_buffer(), "<u8"), (a, b)
                    both = len(np.intersect1d(one, x, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(x) - both):
                        a_out.append(a)
                        b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    dealt = firsts.unionByName(others).repartition(partitions(spark), "a", "salt").sortWithinPartitions(F.col("a"), F.col("salt"), F.col("b").asc_nulls_first())
    out = materialise(dealt.mapInArrow(verify, "a long, b long"), "links")
    discard(sets, fan)
    return out


def joined(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, tk (a hash of the text), n_shingles, component_id of every document."""
    docs = texts(docs)
    made = materialise(prefixes(docs, size, percent), "prefixes", "uncompressed")
    of_sets = made.filter("h IS NOT NULL AND doc_id IS NOT NULL")
    least = materialise(of_sets.groupBy("h").agg(F.min("doc_id").alias("doc_id")), "least")
    several = small(least.groupBy(F.col("doc_id").alias("_several")).agg(F.count("*").alias("k")).filter("k > 1").select("_several"))
    number = F.when(F.col("_several").isNull(), F.col("doc_id")).otherwise(F.col("h"))
    reps = materialise(least.join(several, F.col("doc_id") == F.col("_several"), "left").select("h", "doc_id", number.alias("c")), "classes")
    copies = of_sets.select("h", "doc_id").join(reps.select("h", F.col("doc_id").alias("_rep")), "h").filter("doc_id <> _rep").select("h", "doc_id").distinct()
    renamed = small(reps.filter("c <> doc_id").select("h", "c"))
    classes = of_sets.join(small(copies), ["h", "doc_id"], "left_anti").join(renamed, "h", "left").select(F.coalesce("c", "doc_id").alias("c"), "n", "prefix", "parts")
    rows = materialise(index(classes), "index")
    sizes = materialise(classes.select("c", "parts").dropDuplicates(["c"]), "sizes")
    thin = materialise(made.select("doc_id", "tk", F.col("n").alias("n_shingles"), "h"), "documents")
    discard(made, least)
    one = materialise(suffix_filtered(first_pairs(rows, percent), sizes, percent), "pairs")
    links = linked(one, docs, reps, size, percent)
    new = other_pairs(rows, components(links), percent).join(one, ["a", "b"], "left_anti")
    two = materialise(suffix_filtered(new, sizes, percent), "pairs")
    discard(rows, sizes)
    more = linked(two, docs, reps, size, percent)
    found = components(links.unionByName(more))
    rooted = reps.join(found.withColumnRenamed("node", "c"), "c", "left").select("h", "doc_id", F.coalesce("root", "c").alias("root"))
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = materialise(rooted.select("h", "root").join(materialise(first, "components"), "root").select("h", "component_id"), "components")
    own = thin.filter("h IS NOT NULL AND doc_id IS NOT NULL").join(by_class, "h").select("doc_id", "tk", "n_shingles", "component_id")
    return own.unionByName(thin.filter("h IS NULL OR doc_id IS NULL").select("doc_id", "tk", "n_shingles", F.col("doc_id").alias("component_id")))


def join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, linked where 100 * intersection >= percent * union of its shingle sets.

    A document without words links with nothing. Rows with equal doc_id and different texts are linked each by its own text. A null
    doc_id has no component and links nothing. Empty table: no rows. Other columns are ignored.
    """
    return joined(docs, size, percent).drop("tk")


def keep_first(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with all its columns.

    Of rows with equal doc_id and equal text all stay or go; rows without a doc_id or without words stay. An empty table stays empty.
    """
    gone = joined(docs, size, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("tk").alias("_gone_tk")).distinct()
    own = (docs["doc_id"].cast("long") == F.col("_gone")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_gone_tk"))
    return docs.join(small(gone), own, "left_anti")
