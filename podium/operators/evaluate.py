"""Evaluation: word error rates, classification reports, uncertainty, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions.scalars import as_column, catalog_id

# word errors


def normal_tokens(text: Column | str) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(as_column(text), F.lit(""))), r"\s+"), lambda t: t != "")


def alignment_counts(truth: Column, said: Column) -> Column:
    """Struct of hits, subs, dels, ins of a least-cost alignment of two token arrays.

    One row of the table of costs at a time, as an array of structs; of equal costs the one with more hits counts, then fewer deletions.
    """
    cell = lambda cost, h, s, d, i: F.struct(cost.alias("cost"), (-h).alias("h"), d.alias("d"), s.alias("s"), i.alias("i"))
    zero = F.lit(0)
    first = F.transform(F.sequence(F.lit(0), F.size(said)), lambda k: cell(k, zero, zero, zero, k))

    def step(row: Column, word: Column) -> Column:
        def add(new: Column, k: Column) -> Column:
            """new: the row so far; k: the place in said, from 0."""
            left, up, diag = F.get(new, k), F.get(row, k + 1), F.get(row, k)
            same = F.get(said, k) == word
            go = F.when(same, cell(diag["cost"], -diag["h"] + 1, diag["s"], diag["d"], diag["i"])).otherwise(cell(diag["cost"] + 1, -diag["h"], diag["s"] + 1, diag["d"], diag["i"]))
            drop = cell(up["cost"] + 1, -up["h"], up["s"], up["d"] + 1, up["i"])
            put = cell(left["cost"] + 1, -left["h"], left["s"], left["d"], left["i"] + 1)
            return F.concat(new, F.array(F.least(go, drop, put)))

        head = F.get(row, F.lit(0))
        start = F.array(cell(head["cost"] + 1, -head["h"], head["s"], head["d"] + 1, head["i"]))
        places = F.when(F.size(said) > 0, F.sequence(F.lit(0), F.size(said) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, add)

    last = F.element_at(F.aggregate(truth, first, step), -1)
    return F.struct((-last["h"]).alias("hits"), last["s"].alias("subs"), last["d"].alias("dels"), last["i"].alias("ins"))


def word_errors_kernel(pairs: DataFrame, key: str, truth: str, said: str) -> DataFrame:
    """key, hits, subs, dels, ins, by a NumPy table of one pair at a time: the same choice among equal costs as alignment_counts."""
    import numpy as np

    from podium.operators.rowwise import by_row

    def count(a: list[str], b: list[str]) -> tuple[int, int, int, int]:
        n, m = len(a), len(b)
        # one number for (cost, -hits, deletions), compared as a whole; each field has room for all words
        unit = 1 << 21
        cost, hit, gone = unit * unit, -unit, 1
        ids: dict[str, int] = {}
        x = np.array([ids.setdefault(t, len(ids)) for t in a], np.int64)
        y = np.array([ids.setdefault(t, len(ids)) for t in b], np.int64)
        row = np.arange(m + 1, dtype=np.int64) * cost
        ramp = np.arange(m + 1, dtype=np.int64) * cost
        for i in range(n):
            best = row + cost + gone
            np.minimum(best[1:], row[:-1] + np.where(y == x[i], hit, cost), out=best[1:])
            row = np.minimum.accumulate(best - ramp) + ramp  # insertions run to the right
        value = int(row[-1])
        errors = (value + cost // 2) // cost  # value is cost * errors - unit * hits + deletions
        rest = errors * cost - value
        hits = -(-rest // unit)
        dels = hits * unit - rest
        subs = n - hits - dels
        return hits, subs, dels, errors - subs - dels

    rows = pairs.select(key, normal_tokens(truth).alias("a"), normal_tokens(said).alias("b"))
    return by_row(rows, [key], lambda a, b: [count(a, b)], dict.fromkeys(("hits", "subs", "dels", "ins"), "long"))


def error_rates(counts: DataFrame) -> DataFrame:
    """Adds wer, mer, wil to hits, subs, dels, ins; null where a divisor is 0."""
    h, s, d, i = (F.col(c).cast("double") for c in ("hits", "subs", "dels", "ins"))
    zero = F.lit(0.0)
    errors = s + d + i
    return counts.withColumns({
        "wer": errors / F.nullif(h + s + d, zero),
        "mer": errors / F.nullif(h + s + d + i, zero),
        "wil": 1 - (h / F.nullif(h + s + d, zero)) * (h / F.nullif(h + s + i, zero)),
    })


def macro_rates(rates: DataFrame) -> DataFrame:
    """One row: unweighted means over files."""
    return rates.agg(*(F.avg(c).alias(f"mean_{c}") for c in ("wer", "mer", "wil")), F.count("*").alias("n_files"))


# classification


def confusion(df: DataFrame, truth: str, found: str) -> DataFrame:
    """truth, found, n, share (of the true class)."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(found).alias("found")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def report(df: DataFrame, truth: str, found: str) -> DataFrame:
    """label, precision, recall, f1, support of each class, and of 'macro avg' and 'weighted avg'; accuracy as a row too.

    A class that is never found or never true has precision or recall 0. Only counts by class leave the executors' partial sums.
    """
    counts = confusion(df, truth, found)
    rows = counts.groupBy(F.col("truth").cast("string").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("found"), F.col("n")).otherwise(0)).alias("hit"))
    cols = counts.groupBy(F.col("found").cast("string").alias("label")).agg(F.sum("n").alias("said"))
    both = rows.join(cols, "label", "full").na.fill(0, ["support", "hit", "said"])
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    classes = both.withColumn("precision", ratio("hit", "said")).withColumn("recall", ratio("hit", "support"))
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    classes = classes.withColumn("f1", F.coalesce(f1, F.lit(0.0)))
    names = ("precision", "recall", "f1")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    means = classes.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(weighted(c).alias(f"w_{c}") for c in names), F.sum("support").alias("support"), (F.sum("hit") / F.sum("support")).alias("accuracy"))
    line = lambda label, values: F.struct(F.lit(label).alias("label"), *(v.alias(c) for c, v in zip(names, values, strict=True)), F.col("support"))
    lines = means.select(F.explode(F.array(line("macro avg", [F.col(f"m_{c}") for c in names]), line("weighted avg", [F.col(f"w_{c}") for c in names]), line("accuracy", [F.col("accuracy")] * 3))).alias("x")).select("x.*")
    return classes.select("label", *names, "support").unionByName(lines)


def batch_means(df: DataFrame, truth: str, found: str, batch: str) -> DataFrame:
    """accuracy, precision, recall, f1: weighted metrics of each batch, then their plain mean (this overstates precision)."""
    counts = df.groupBy(batch, F.col(truth).alias("t"), F.col(found).alias("p")).agg(F.count("*").alias("n"))
    rows = counts.groupBy(batch, F.col("t").alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    cols = counts.groupBy(batch, F.col("p").alias("k")).agg(F.sum("n").alias("said"))
    both = rows.join(cols, [batch, "k"], "left")
    precision = F.coalesce(F.col("hit") / F.col("said"), F.lit(0.0))
    recall = F.col("hit") / F.col("support")
    both = both.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0)))
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    batches = both.groupBy(batch).agg((F.sum("hit") / F.sum("support")).alias("accuracy"), *(weighted(c) for c in ("precision", "recall", "f1")))
    return batches.agg(*(F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")), F.count("*").alias("n_batches"))


def running_meter(df: DataFrame, value: str, n: str) -> DataFrame:
    """One row: the mean of value weighted by n."""
    return df.agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("avg"), F.sum(n).alias("count"))


# uncertainty


def certainty(df: DataFrame, by: str, prob: str, limit: float = 0.70) -> DataFrame:
    """by, average_certainty, n_frames, num_incorrect (below the limit), percent_incorrect."""
    below = F.count_if(F.col(prob) < limit)
    return df.groupBy(by).agg(F.avg(prob).alias("average_certainty"), F.count("*").alias("n_frames"), below.alias("num_incorrect"), (below / F.count("*")).alias("percent_incorrect"))


def most_uncertain(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of least average certainty, ties by name."""
    return rows.orderBy("average_certainty", by).limit(k)


def best_guess(probs: Column | str) -> Column:
    """Struct of the most probable class of a map and its probability; ties go to the class that sorts last."""
    entries = F.transform(F.map_entries(as_column(probs)), lambda e: F.struct(e["value"].alias("probability"), e["key"].alias("class")))
    best = F.array_max(entries)
    return F.struct(best["class"].alias("class"), best["probability"].alias("probability"))


# splits


def by_hash(name: Column, seed: int) -> Column:
    """A place in an order that is random but the same everywhere."""
    return F.sha1(F.concat(name.cast("string"), F.lit(f"-{seed}")).cast("binary"))


def _ranked(df: DataFrame, group: str, seed: int) -> DataFrame:
    """group, _r (its rank from 1 in the order of hashes), _n (all groups): ranks are made in 256 parts by the hash's first signs."""
    groups = df.select(group).distinct().withColumn("_h", by_hash(F.col(group), seed)).withColumn("_part", F.substring("_h", 1, 2))
    parts = groups.groupBy("_part").agg(F.count("*").alias("_k"))  # 256 rows at most
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_k").over(every), F.lit(0)).alias("_base"), F.sum("_k").over(Window.partitionBy()).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_h", group))
    return groups.withColumn("_r", rank).join(F.broadcast(parts), "_part").select(group, (F.col("_r") + F.col("_base")).alias("_r"), "_n")


def group_split(df: DataFrame, group: str, share: float, seed: int = 0) -> DataFrame:
    """group, split: floor(share * groups) whole groups are 'test', the others 'train'."""
    test = F.col("_r") <= F.floor(F.col("_n") * F.lit(share))
    return _ranked(df, group, seed).select(group, F.when(test, "test").otherwise("train").alias("split"))


def folds(df: DataFrame, group: str, k: int = 3, seed: int = 0) -> DataFrame:
    """group, fold (from 1): shuffled groups in k stretches, the first ones longer by one where they don't divide."""
    each, longer = F.floor(F.col("_n") / k), F.col("_n") % k
    first = longer * (each + 1)  # groups in the longer stretches
    fold = F.when(F.col("_r") <= first, F.ceil(F.col("_r") / (each + 1))).otherwise(longer + F.ceil((F.col("_r") - first) / F.greatest(each, F.lit(1))))
    return _ranked(df, group, seed).select(group, fold.cast("int").alias("fold"))


def split_statistics(df: DataFrame, split: DataFrame, group: str, category: str) -> DataFrame:
    """category, train, val, share: rows of each category on both sides of a split of groups."""
    both = df.join(split, group, "left")
    val = F.count_if(F.col("split") == "test")
    train = F.count_if(F.coalesce(F.col("split"), F.lit("train")) != "test")
    return both.groupBy(category).agg(train.alias("train"), val.alias("val"), (val / (val + train)).alias("share"))


def split_search(df: DataFrame, group: str, category: str, tries: int, take: int, wanted: float = 0.2, seed: int = 0) -> DataFrame:
    """try, deviation of all tried splits, best first: each takes `take` groups by a hash of its own; the deviation is the mean over
    categories of |share - wanted|. Counts by group and category are what is multiplied by the tries, not rows."""
    counts = df.groupBy(group, category).agg(F.count("*").alias("n"))
    groups = counts.select(group).distinct()
    tried = groups.select(group, F.explode(F.sequence(F.lit(seed), F.lit(seed + tries - 1))).alias("try"))
    place = F.sha1(F.concat(F.col(group).cast("string"), F.lit("-"), F.col("try").cast("string")).cast("binary"))
    chosen = tried.withColumn("_r", F.row_number().over(Window.partitionBy("try").orderBy(place, group))).withColumn("in", (F.col("_r") <= take).cast("int"))
    shares = chosen.join(counts, group).groupBy("try", category).agg((F.sum(F.col("n") * F.col("in")) / F.sum("n")).alias("share"))
    return shares.groupBy("try").agg(F.avg(F.abs(F.col("share") - wanted)).alias("deviation")).orderBy("deviation", "try")


def best_split(df: DataFrame, group: str, category: str, take: int, wanted: float = 0.2, parts: int | None = None, most: int = 20_000_000) -> DataFrame:
    """groups (sorted), deviation, proven of the best split: of all ways to take `take` groups, the one with the least mean over categories of
    |share - wanted| (to nine digits; then the least groups).

    Ways to take all but two groups have ranks, whose ranges are dealt to tasks. A task goes through its range in order and jumps over all ways that begin with
    groups after which even the best shares that the rest can reach are worse than a split known before; the last two groups are tried at once. A task that
    evaluated `most` splits stops; then the best one found is given as not proven. Counts by group and category, a small matrix, are what tasks get.
    """
    import numpy as np
    import pandas as pd

    spark = df.sparkSession
    counts = df.groupBy(F.col(group).cast("string").alias("g"), F.col(category).cast("string").alias("c")).agg(F.count("*").alias("n")).filter("g IS NOT NULL")
    found = counts.limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of group and category; split_search takes any number")
    names, kinds = sorted({r["g"] for r in found}), sorted({r["c"] or "" for r in found})
    n = np.zeros((len(names), len(kinds)))
    for r in found:
        n[names.index(r["g"]), kinds.index(r["c"] or "")] += r["n"]
    schema = "groups array<string>, deviation double, proven boolean"
    if not 0 < take <= len(names):
        return spark.createDataFrame([], schema)
    share = n / n.sum(axis=0)
    picks = np.random.default_rng(0).random((2000, len(names))).argsort(axis=1)[:, :take]
    tried = np.round(np.abs(share[picks].sum(axis=1) - wanted).mean(axis=1), 9)
    known = float(tried.min()), tuple(sorted(picks[tried.argmin()].tolist()))
    parts = parts or 4 * spark.sparkContext.defaultParallelism

    def run(batches):
        for batch in batches:
            for part in batch["id"].tolist():
                best = _searched(share, take, wanted, part, parts, known, most)
                yield pd.DataFrame({"groups": [[names[i] for i in best[1]]], "deviation": [best[0]], "proven": [best[2]]})

    every = spark.range(0, parts, 1, parts).mapInPandas(run, schema)
    least = every.agg(F.min(F.struct("deviation", "groups")).alias("b"), F.min("proven").alias("proven"))
    return least.select("b.groups", "b.deviation", "proven")


#: Pairs of group and category of an exact search.
MOST_CELLS = 100_000


def _searched(share, take: int, wanted: float, part: int, parts: int, known: tuple[float, tuple[int, ...]], most: int) -> tuple[float, tuple[int, ...], bool]:
    """The least deviation, its groups and whether nothing was left out, of the known split and those whose first groups' ranks are in one of the parts."""
    from math import comb

    import numpy as np

    n, ahead = len(share), max(0, take - 2)
    last = take - ahead  # groups that are tried at once: one or two
    total = comb(n, ahead)
    rank, end = total * part // parts, total * (part + 1) // parts
    low, high = {}, {}
    for i in range(n + 1):  # of the groups from i on: the least and the largest sums of r of them
        ordered = np.sort(share[i:], axis=0)
        sums = np.vstack([np.zeros(share.shape[1]), np.cumsum(ordered, axis=0)])
        for r in range(min(take, n - i) + 1):
            low[i, r], high[i, r] = sums[r], sums[-1] - sums[-1 - r] if r else sums[0]

    def bound(own, i: int, r: int) -> float:
        a, b = own + low[i, r] - wanted, own + high[i, r] - wanted
        return float(np.maximum(np.maximum(a, -b), 0).mean())

    (best, groups), tried = known, 0
    while rank < end:
        chosen, left, i, own, skip = [], rank, 0, np.zeros(share.shape[1]), None
        while len(chosen) < ahead:  # the rank's way, group by group
            below = comb(n - i - 1, ahead - len(chosen) - 1)
            if left < below:
                chosen.append(i)
                own = own + share[i]
                if n - i - 1 < take - len(chosen) or bound(own, i + 1, take - len(chosen)) > best + 1e-9:
                    skip = below - left  # all ways that begin so
                    break
            else:
                left -= below
            i += 1
        if skip is not None:
            rank += skip
            continue
        start = chosen[-1] + 1 if chosen else 0
        a, b = np.triu_indices(n - start, 1) if last == 2 else (np.arange(n - start), None)
        if len(a):
            sums = own + share[start + a] + (share[start + b] if last == 2 else 0)
            d = np.round(np.abs(sums - wanted).mean(axis=1), 9)
            k = int(d.argmin())
            if (d[k], (*chosen, start + a[k], *([start + b[k]] if last == 2 else []))) < (best, groups):
                best, groups = float(d[k]), (*chosen, int(start + a[k]), *([int(start + b[k])] if last == 2 else []))
            tried += len(a)
        rank += 1
        if tried > most and rank < end:
            return best, groups, False
    return best, groups, True


def named(df: DataFrame, text: str, size: int = 11) -> DataFrame:
    return df.withColumn("catalog_id", catalog_id(text, size))
