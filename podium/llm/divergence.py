"""How far the sources of a language lie apart, term by term: an audit of a corpus before its sources are mixed.

Each language keeps the terms that `least` of its documents or more have. A kept term is a sparse vector of counts by source. Terms of equal vectors are one:
each pair of sources is evaluated once for each different vector, times the number of terms that have it.
1. Tasks count terms and documents in dictionaries of bounded size; sums meet by (language, term), so a term's vector is made where its counts are.
2. Vectors are grouped and go, some CELLS cells together, to kernels that evaluate the pairs in which a vector has a count. Pairs of two absent sources have one
   value for a language; how often it counts is what is left of the number of kept terms.
3. The terms of a group that it uses more than its language does are ranked one by one; Spark limits a group's ranks in each task before they are shuffled.

Shares are integers: p = 1 + floor(10^9 (count + 1) / (N + V)), with V kept terms of the language and N their occurrences in the group or language;
f(p, q) = floor((p - q)^2 / q). All arithmetic is exact: products of counts are decimals, values are 64-bit integers (a sum of f is at most (10^9 + V)^2).

Null texts, languages and sources are ''. A group whose documents have no kept term has counts of 0; if its language keeps none, its pairs have value 0. Equal rows
count each for itself, ties are ranked by the item's UTF-8 bytes, a very long text is a batch of its own, an empty table gives no rows. Other columns are
ignored, whatever their names. A vector has an entry for each source at most.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import discard, materialise, small_batches
from podium.llm.tokens import slices

#: The scale of shares.
SCALE = 1_000_000_000
#: Entries of a task's dictionaries before they are given out, and cells (vectors times sources) that meet in a kernel.
ENTRIES, CELLS = 200_000, 100_000
#: Rows of a side that may be sent to all tasks (some 100 bytes each).
MOST_SENT = 100_000
#: Bytes of terms: letters of ASCII, the capitals as small ones, and all of other characters. All else parts terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), d (rows that have it), in partial sums."""

    def given(held: dict) -> pa.RecordBatch:
        rows = [(*group, term, c, held[1][group][term]) for group, terms in held[0].items() for term, c in terms.items()]
        lang, source, term, c, d = zip(*rows, strict=True)
        text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), text(term), pa.array(c, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "c", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = (defaultdict(Counter), defaultdict(Counter)), 0
        for batch in slices(batches):
            for lang, source, x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                found = Counter(x.as_buffer().to_pybytes().translate(LETTERS).split())
                occurrences, rows = held[0][lang, source], held[1][lang, source]
                n -= len(occurrences)
                occurrences.update(found)
                rows.update(found.keys())
                n += len(occurrences)
                if n > ENTRIES:
                    yield given(held)
                    held, n = (defaultdict(Counter), defaultdict(Counter)), 0
        if n:
            yield given(held)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, c long, d long")


def _sent(side: DataFrame) -> DataFrame:
    """side, marked to be broadcast if it is counted to be small; else rows meet it by a shuffle."""
    return F.broadcast(side) if side.count() <= MOST_SENT else side


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a count: an exact quotient of decimals; null where the language keeps no term."""
    scaled = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")).cast("decimal(31,0)")
    return 1 + F.call_function("div", scaled, F.nullif(n + v, F.lit(0)).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    """f: the squared difference over q, cut to an integer."""
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, vector: source and count of each source that has it, by source."""
    sums = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    terms = sums.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sort_array(F.collect_list(F.struct("source", "c"))).alias("vector"))
    return terms.filter(F.col("d") >= least).select("lang", "term", "vector")


def group_sizes(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """lang, source, s (its place in the language, from 0), v (kept terms), n, n_lang (their occurrences in the group, the language), p0 (share
    of a term that the group lacks) of every group that occurs."""
    each = vectors.select("lang", "m", F.explode("vector").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("e.c") * F.col("m")).alias("n"))
    v = vectors.groupBy("lang").agg(F.sum("m").alias("v"))
    rows = docs.select("lang", "source").distinct().join(each, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["n", "v"])
    in_lang = Window.partitionBy("lang")
    rows = rows.withColumn("n_lang", F.sum("n").over(in_lang)).withColumn("s", F.row_number().over(in_lang.orderBy("source")) - 1)
    return rows.withColumn("p0", share(F.lit(0), F.col("n"), F.col("v")))


def _evaluated(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of vectors (entries: id of the vector, times m, source s, share p) of a language whose sources' p0 are given: lang, a, b, total, met. For the pairs of which
    one at least is in a vector: the sum of f, and how many terms that is."""
    for part in parts:
        for lang, entries, p0 in zip(part["lang"], part["entries"], part["p0"], strict=True):
            p0 = np.asarray(p0, np.int64)
            vector, m, s, p = (np.array([e[k] for e in entries], np.int64) for k in ("id", "m", "s", "p"))
            _, row = np.unique(vector, return_inverse=True)
            shares = np.tile(p0, (row.max() + 1, 1))
            absent = np.ones(shares.shape, bool)
            shares[row, s], absent[row, s] = p, False
            order = np.argsort(s, kind="stable")
            every = np.arange(len(p0))
            for at in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
                a, own, times = s[at[0]], p[at][:, None], m[at][:, None]
                other, lacks = shares[row[at]], absent[row[at]]
                total = ((own - other) ** 2 // other * times).sum(axis=0)
                back = np.where(lacks, (p0 - own) ** 2 // own * times, 0).sum(axis=0)
                back_met = np.where(lacks, times, 0).sum(axis=0)
                yield pd.DataFrame({"lang": lang, "a": a, "b": every, "total": total, "met": times.sum()})
                yield pd.DataFrame({"lang": lang, "a": every, "b": a, "total": back, "met": back_met})[back_met > 0]


def pair_values(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value."""
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.transform(F.sort_array(F.collect_list(F.struct("s", "p0"))), lambda x: x["p0"]).alias("p0"))
    chunks = _sent(vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).join(sizes, "lang").select("lang", F.ceil(F.col("k") * F.col("sources") / CELLS).alias("chunks")))
    places = _sent(groups.select("lang", "source", "s", "n", "v"))
    dealt = vectors.join(chunks, "lang").withColumn("chunk", F.pmod(F.xxhash64("vector"), F.col("chunks")))
    entries = dealt.select("lang", "chunk", "id", "m", F.explode("vector").alias("e")).select("lang", "chunk", "id", "m", F.col("e.source").alias("source"), F.col("e.c").alias("c")).join(places, ["lang", "source"])
    entry = F.struct("id", "m", "s", share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    held = entries.groupBy("lang", "chunk").agg(F.collect_list(entry).alias("entries")).join(_sent(sizes.select("lang", "p0")), "lang")
    sums = held.select("lang", "entries", "p0").mapInPandas(_evaluated, "lang string, a int, b int, total long, met long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("met").alias("met"))
    a, b = (groups.select("lang", "v", F.col("source").alias(name), F.col("s").alias(k), F.col("p0").alias(f"p{k}")) for name, k in (("source", "a"), ("item", "b")))
    pairs = a.join(b.drop("v"), "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left").na.fill(0, ["total", "met"])
    rest = (F.col("v") - F.col("met")) * distance(F.col("pa"), F.col("pb"))
    return pairs.select("lang", "source", "item", F.coalesce(F.col("total") + rest, F.lit(0)).cast("long").alias("value"))


def term_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each kept term that the group has, and more than its language), value."""
    whole = F.aggregate("vector", F.lit(0).cast("long"), lambda x, e: x + e["c"])
    rows = terms.select("lang", F.col("term").alias("item"), whole.alias("all"), F.explode("vector").alias("e")).select("lang", "item", "all", F.col("e.source").alias("source"), F.col("e.c").alias("c"))
    rows = rows.join(_sent(groups.select("lang", "source", "n", "n_lang", "v")), ["lang", "source"])
    rows = rows.withColumn("p", share(F.col("c"), F.col("n"), F.col("v"))).withColumn("q", share(F.col("all"), F.col("n_lang"), F.col("v")))
    return rows.filter("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))


def ranked(values: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank (from 1, by falling value, then item)."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    rows = values.withColumn("rank", rank)
    rows = rows.filter(F.col("rank") <= most) if most else rows
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: of each group of a language and a source, the divergence from each other source of the language (part
    pair), and the terms that it uses more than its language, the `top` of greatest value (part term)."""
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = materialise(kept_terms(docs, least), "terms")
    vectors = materialise(terms.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("m")).withColumn("id", F.monotonically_increasing_id()), "vectors")
    groups = materialise(group_sizes(docs, vectors), "groups")
    pairs = materialise(pair_values(vectors, groups), "pairs")
    discard(vectors)
    return ranked(pairs, "pair").unionByName(ranked(term_values(terms, groups), "term", top))


def sql(documents: str = "documents", least: int = 3, top: int = 200) -> str:
    """The same in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = "1 + ({scale}::HUGEINT * ({c} + 1)) // ({n} + {v})"
    p = share.format(scale=SCALE, c="coalesce(t.c, 0)", n="g.n", v="g.v")
    q = share.format(scale=SCALE, c="k.total", n="g.n_lang", v="g.v")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM {documents}),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {least}),
t AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n, 0)::BIGINT AS n, coalesce(v, 0) AS v, (sum(coalesce(n, 0)) OVER (PARTITION BY lang))::BIGINT AS n_lang FROM (SELECT DISTINCT lang, source FROM d)
 LEFT JOIN (SELECT lang, source, sum(c) AS n FROM t GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(t.c, 0) AS c, ({p})::BIGINT AS p, ({q})::BIGINT AS q FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
s AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM r)
SELECT * FROM s WHERE part = 'pair' OR rank <= {top}"""
