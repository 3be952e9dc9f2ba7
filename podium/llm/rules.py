"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histograms of character classes and of its language's common words are compared with fixed references of that language by the
Jensen-Shannon distance (base 2, so 0 to 1). Short documents, whose histograms say little, are spared by minimum-length guards. A language
without a reference of its own, null too, is judged by character classes only, against the mean of all references. As references are
fixed, a document's verdict rests on that document alone: nothing is shuffled, and a language of few documents is judged like any other.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import materialise

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Character classes, by name; then come white space, bytes beyond one a character, and all other characters.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:]", "symbol": SYMBOLS, "mark": "[!?]"}
#: What the classes leave out, in runs.
PLAIN = r"[a-z\x{80}-\x{10FFFF}\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Repeated windows up to which a text's windows are looked up in their list; with more of them all windows are sorted.
FEW_REPEATS = 16
#: Frequent function words of each language, for the histogram of common words.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "was", "by", "be"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"),
}
#: How many per cent of a language's words are each of these, in their order, as word counts of running text have it.
COMMON_SHARES = {
    "en": (6.0, 3.2, 2.9, 2.7, 2.2, 2.2, 1.1, 1.1, 0.9, 0.9, 0.7, 0.7, 0.7, 0.7, 0.5, 0.6),
    "de": (2.9, 3.0, 2.6, 1.7, 1.1, 0.9, 0.9, 0.9, 0.8, 0.7, 0.7, 0.7, 0.7, 0.7, 0.6, 0.6),
    "fr": (5.0, 2.8, 2.0, 2.1, 1.9, 1.6, 1.4, 1.1, 1.1, 0.9, 0.9, 0.9, 0.7, 0.7, 0.8, 0.6),
    "es": (6.0, 3.7, 2.9, 2.8, 2.5, 2.4, 1.9, 1.6, 1.2, 1.1, 1.0, 0.9, 1.0, 0.7, 0.9, 0.8),
}
#: The same of characters: the classes, white space, bytes beyond one a character (per 100 characters).
CLASS_SHARES = {"en": (2.5, 0.8, 2.0, 0.1, 0.1, 17.0, 0.05), "de": (5.5, 0.8, 2.0, 0.1, 0.1, 14.3, 1.6), "fr": (2.5, 0.8, 2.0, 0.1, 0.1, 16.3, 3.5), "es": (2.5, 0.8, 2.0, 0.1, 0.1, 16.5, 2.2)}
#: Distances beyond which a document is rejected, and the sizes from which the distances count.
MOST_CLASS, MOST_WORD, LEAST_CHARS, LEAST_WORDS = 0.24, 0.29, 200, 100


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def words(text: Column) -> Column:
    """The white-space-separated words of a text that isn't null."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner != "", F.split(inner, SPACE, -1)).otherwise(F.array().cast("array<string>"))


def with_words(df: DataFrame, text: str = "_text") -> DataFrame:
    """Adds _words, n_words, word_chars and _signs, the text's characters that may be in a class."""
    df = df.withColumn("_words", words(F.col(text))).withColumn("_signs", F.regexp_replace(F.col(text), PLAIN, ""))
    return df.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.concat_ws("", "_words")).cast("long")).withColumn("n_symbols", _count(F.col("_signs"), SYMBOLS))


def with_base(df: DataFrame, text: str = "_text") -> DataFrame:
    """Adds n_dup_lines and n_repeat_words; with_words comes first."""
    df = df.withColumn("_lines", F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(WORD)))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    places = F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)
    df = df.withColumn("_hashes", F.when(F.col("n_words") > 3, F.transform(places, lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(3))))))
    df = df.withColumn("_sorted", F.sort_array("_hashes"))
    df = df.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, k: F.get("_sorted", k + 1) == x))).drop("_sorted")
    # starts of repeated windows: looked up where they are few, else from windows as (hash, start), sorted so that equal ones meet
    few = F.filter(places, lambda i: F.array_contains("_twice", F.get("_hashes", i)))
    df = df.withColumn("_pairs", F.when(F.size("_twice") > FEW_REPEATS, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    many = F.filter("_pairs", lambda x, k: F.get("_pairs", k - 1)["h"].eqNullSafe(x["h"]) | F.get("_pairs", k + 1)["h"].eqNullSafe(x["h"]))
    df = df.withColumn("_starts", F.when(F.size("_twice") > FEW_REPEATS, F.sort_array(F.transform(many, lambda x: x["i"]))).when(F.size("_twice") > 0, few)).drop("_pairs", "_twice", "_hashes")
    covered = F.aggregate(F.transform("_starts", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - x, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_starts")


def with_histograms(df: DataFrame, text: str = "_text", lang: str = "_lang") -> DataFrame:
    """Adds _classes and _common, arrays of counts; with_words comes first."""
    at, n = F.col(lang), F.length(text).cast("long")
    counts = [_count(F.col("_signs"), p) for p in CLASSES.values()]
    df = df.withColumn("_classes", F.concat(F.array(*counts), F.array(n - F.col("word_chars"))))
    rest = n - F.aggregate("_classes", F.lit(0).cast("long"), lambda a, b: a + b)
    df = df.withColumn("_classes", F.concat("_classes", F.array(F.octet_length(text).cast("long") - n, rest)))
    names = F.coalesce(*(F.when(at == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()), F.array().cast("array<string>"))
    every = sorted(functools.reduce(operator.or_, map(set, COMMON.values())))
    df = df.withColumn("_few", F.filter("_words", lambda w: w.isin(every))).withColumn("_names", names)
    df = df.withColumn("_common", F.transform("_names", lambda n: F.size(F.filter("_few", lambda w: w == n)).cast("long"))).drop("_few", "_names")
    return df.withColumn("_common", F.concat("_common", F.array(F.col("n_words") - F.aggregate("_common", F.lit(0).cast("long"), lambda a, b: a + b)))).drop("_signs")


def references() -> tuple[dict[str, list[float]], list[float], dict[str, list[float]]]:
    """Shares of characters and of words by language, each with what is left as its last, and the mean of the former."""
    whole = lambda x: [round(v / 100, 6) for v in (*x, 100 - sum(x))]
    classes, common = ({k: whole(v) for k, v in x.items()} for x in (CLASS_SHARES, COMMON_SHARES))
    return classes, [round(sum(x) / len(x), 6) for x in zip(*classes.values(), strict=True)], common


def of_language(lang: Column, values: dict[str, list[float]], other: list[float] | None) -> Column:
    """The language's array of numbers."""
    array = lambda x: F.array(*map(F.lit, x))
    return F.coalesce(*(F.when(lang == k, array(v)) for k, v in values.items()), array(other) if other else F.lit(None).cast("array<double>"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; null if either sums to nothing."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0)).cast("double"))
    share = lambda x: F.when(total(x) > 0, F.transform(x, lambda v: F.coalesce(v, F.lit(0)) / total(x)))
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    sums = F.aggregate(F.zip_with(share(p), share(q), lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.when(sums < 0, 0.0).otherwise(sums / 2))


def judged(features: DataFrame) -> DataFrame:
    """Adds class_distance, word_distance (null without a reference), base_failed and kept."""
    classes, mean, common = references()
    df = features.withColumn("class_distance", distance(F.col("_classes"), of_language(F.col("_lang"), classes, mean)))
    df = df.withColumn("word_distance", F.when(F.size("_common") > 1, distance(F.col("_common"), of_language(F.col("_lang"), common, None))))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    far = ((F.col("_chars") >= LEAST_CHARS) & (F.col("class_distance") > MOST_CLASS)) | ((F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > MOST_WORD))
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def _prepared(docs: DataFrame, *keep: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, text.alias("_text"), F.col("lang").cast("string").alias("_lang"), F.length(text).alias("_chars"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, class_distance, word_distance of every document.

    A null or empty text has no words and fails. Equal rows are judged alike. An empty table gives no rows; other columns are ignored.
    """
    features = with_histograms(with_base(with_words(_prepared(docs, F.col("doc_id").cast("long").alias("doc_id"))))).drop("_text", "_words")
    # written once: a filter on the result would else be pushed below the columns that it rests on, and each be computed wherever it is used
    out = judged(materialise(features, "rules"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(F.round(k, 9).alias(k) for k in ("class_distance", "word_distance")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names.

    A null or empty text has no words and goes; equal rows stay or go together; an empty table stays empty.
    """
    out = judged(with_histograms(with_base(with_words(_prepared(docs, F.struct("*").alias("_row"))))))
    # a column that is not deterministic keeps the filter above it, so that what it rests on is computed once; the rows that are kept do not
    # depend on it
    return out.withColumn("_at", F.monotonically_increasing_id()).filter(F.col("kept") & (F.col("_at") >= 0)).select("_row.*")


def _sql_distance(p: str, q: str) -> str:
    share = lambda x: f"list_transform({x}, lambda v: v::DOUBLE / nullif(list_sum({x}), 0)::DOUBLE)"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0.0, list_sum(list_transform(list_zip({share(p)}, {share(q)}), lambda z: {part('z[1]', 'z[2]')} + {part('z[2]', 'z[1]')})) / 2)) END"


def sql(documents: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    counts = ", ".join(f"len(regexp_extract_all(t, '{p}'))" for p in CLASSES.values())
    names = " ".join(f"WHEN '{k}' THEN {list(v)!r}" for k, v in COMMON.items())
    classes, mean, common = references()
    case = lambda x, other: f"(CASE lang {' '.join(f"WHEN '{k}' THEN {v!r}" for k, v in x.items())} ELSE {other} END)::DOUBLE[]"
    far = f"((n_chars >= {LEAST_CHARS} AND class_distance > {MOST_CLASS}) OR (n_words >= {LEAST_WORDS} AND word_distance > {MOST_WORD}))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM {documents}),
w AS (SELECT rid, doc_id, lang, t, length(t) AS n_chars, regexp_extract_all(t, '{WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
g AS (SELECT rid, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
g2 AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g2) GROUP BY rid),
c AS (SELECT *, len(words) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols, n_chars - length(regexp_replace(t, '{SPACE}', '', 'g')) AS n_space, len(lines) - len(list_distinct(lines)) AS n_dup_lines, [{counts}, n_space] AS cl, CASE lang {names} ELSE [] END AS names FROM w),
f AS (SELECT * EXCLUDE (cl), list_concat(cl, [strlen(t) - n_chars, n_chars - list_sum(cl)::BIGINT]) AS classes, list_transform(names, lambda n: len(list_filter(words, lambda x: x = n))) AS cm FROM c),
h AS (SELECT * EXCLUDE (cm), list_append(cm, n_words - coalesce(list_sum(cm), 0)::BIGINT) AS common FROM f),
l AS (SELECT h.*, {case(classes, mean)} AS rclasses, {case(common, 'NULL')} AS rcommon FROM h),
j AS (SELECT l.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words, {_sql_distance("classes", "rclasses")} AS class_distance, CASE WHEN len(common) > 1 THEN {_sql_distance("common", "rcommon")} END AS word_distance
FROM l LEFT JOIN r USING (rid)),
k AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({far}, false) AS kept, round(class_distance, 9) AS class_distance, round(word_distance, 9) AS word_distance FROM k"""
