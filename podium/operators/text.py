"""Text operators: sentences, tokens, TF-IDF in long form, ranking and selection, combining speech and slides, spelling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.functions.scalars import as_column
from podium.operators.ordered import top_restored
from podium.session import written

SENTENCE = r"[^.!?]+[.!?]*"
#: English function words that rankings leave out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "her", "his", "i", "if", "in", "is", "it", "its", "not", "of", "on", "or", "our", "she", "that", "the", "their", "them", "they", "this", "to", "was", "we", "were", "what", "when", "which", "who", "will", "with", "you")


def sentence_array(text: Column | str) -> Column:
    """The sentences of a text, trimmed; a null text has none."""
    found = F.transform(F.regexp_extract_all(as_column(text), F.lit(SENTENCE), F.lit(0)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda s: s != "")


def sentences(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, sent_idx (from 0), sentence."""
    return df.select(*keep, F.posexplode(sentence_array(text)).alias("sent_idx", "sentence"))


# learned sentence boundaries

#: Abbreviations that count without being learned.
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "cf", "dr", "mr", "mrs", "ms", "prof", "st", "fig", "no", "vol", "approx", "dept", "inc", "jr", "sr", "p", "pp", "bzw", "z.b", "d.h", "sra", "mme")
#: The least score of a learned abbreviation, how many the query learned_abbreviations lists, and how many the tasks hold at most (more are joined).
ABBREVIATION_SCORE, MOST_ABBREVIATIONS, HELD_ABBREVIATIONS = 0.3, 2000, 10_000
_TYPE = r"^[\"'(\[]*(.*?)\.?[\"')\],;:!?]*$"


def abbreviations(df: DataFrame, text: str, least: float = ABBREVIATION_SCORE, most: int | None = None) -> DataFrame:
    """term, score: words that a full stop belongs to, learned from unmarked texts; all of them, or the `most` best.

    A word (lower case, without the stop) is one if stops follow it more than by chance: by the log-likelihood of its counts with and without a stop
    against the rate of stops behind all words, scaled down for long words and for each time that it stands without a stop, up for stops inside. Words with
    digits are none. Words as they stand are counted first, so that expressions meet each different one once; only partial sums are shuffled.
    """
    word = F.explode(F.split(F.coalesce(as_column(text), F.lit("")), r"\s+")).alias("w")
    words = df.select(word).groupBy("w").agg(F.count(F.lit(1)).alias("m"))
    rows = words.select(F.lower(F.regexp_extract("w", _TYPE, 1)).alias("term"), F.col("w").rlike(r"\.[\"')\],;:!?]*$").cast("long").alias("stop"), "m").filter("term <> ''")
    counts = rows.groupBy("term").agg(F.sum("m").alias("n"), F.sum(F.col("stop") * F.col("m")).alias("k"))
    total = counts.agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))  # one row
    c = counts.crossJoin(F.broadcast(total)).filter(F.col("term").rlike(r"^[\p{L}.]+$") & F.col("term").rlike(r"\p{L}") & (F.col("k") > 0))
    rate = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("_k") / F.col("_n")))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    chance = k * F.log(rate) + (n - k) * F.log(1 - rate)
    belongs = k * F.log(F.lit(0.99)) + (n - k) * F.log(F.lit(0.01))
    inside = F.length(F.regexp_replace("term", r"[^.]", ""))
    letters = F.length("term") - inside
    score = 2 * (belongs - chance) * F.exp(-letters.cast("double")) * (inside + 1) * F.pow(letters.cast("double"), -(n - k))
    found = c.select("term", F.round(score, 9).alias("score")).filter(F.col("score") >= least).orderBy(F.col("score").desc(), "term")
    return found if most is None else found.limit(most)


def _pieces(text: Column | str) -> Column:
    """A text cut behind each . ! ? (and closing quotes or brackets) before white space, and before each blank line."""
    marked = F.regexp_replace(F.coalesce(as_column(text), F.lit("")), r"([.!?][\"')\]\u201d\u00bb]*)(?=\s)|(?=\n[ \t\r]*\n)", "$1\u0001")
    return F.split(marked, "\u0001")


def _last_word(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, r"(?<!\S)(\S++)$", 1))  # each word is tried once


def _stopped_word(piece: Column) -> Column:
    """The last word of a piece without its stop; empty where it has none."""
    return F.regexp_extract(_last_word(piece), r"^[\"'(\[]*(.*?)\.$", 1)


def bounded_sentences(text: Column | str, known: list[str] | tuple[str, ...] = ABBREVIATIONS, also: Column | None = None) -> Column:
    """The sentences of a text, trimmed, by native expressions: they end at . ! ? (and closing quotes or brackets) before white space, but not behind an abbreviation, an
    initial or a number of a list, nor before a small letter. Stops inside words, numbers and addresses end nothing. A blank line always ends one. `also`: an array of
    further abbreviations of the row."""

    def piece(p: Column, after: Column) -> Column:
        word = _stopped_word(p)
        is_known = word.isin(*known) if also is None else word.isin(*known) | F.array_contains(also, word)
        goes_on = (_last_word(p).endswith(".") & (is_known | word.rlike(r"^\p{L}$"))) | after.rlike(r"^\s+[\"'(\[]*\p{Ll}") | p.rlike(r"(^|\n)\s*\d{1,3}\.$")
        return F.concat(p, F.when(after.rlike(r"^\n[ \t\r]*\n") | ~F.coalesce(goes_on, F.lit(False)), F.lit("\u0002")).otherwise(F.lit("")))

    # the pieces are bound to a variable, so that they are made once and not for each of them
    joined = F.transform(F.array(_pieces(text)), lambda ps: F.array_join(F.zip_with(ps, F.slice(ps, 2, F.size(ps)), piece), ""))
    whole = F.split(F.get(joined, F.lit(0)), "\u0002")
    return F.filter(F.transform(whole, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def learned_sentences(df: DataFrame, text: str, keep: list[str], known: list[str] | None = None) -> DataFrame:
    """keep, sent_idx, sentence, with all the abbreviations that the texts themselves teach beside the fixed ones; `known` takes their place.

    Tasks hold HELD_ABBREVIATIONS of them at most; where there are more, each text is given those that it has, by a join. Texts meet theirs by a hash: those that
    share one share their abbreviations too, which are known ones all the same.
    """
    if known is None:
        known = [r["term"] for r in abbreviations(df, text, most=HELD_ABBREVIATIONS + 1).collect()]
        if len(known) > HELD_ABBREVIATIONS:
            words = df.select(F.xxhash64(text).alias("_of"), F.explode(F.array_distinct(F.transform(_pieces(text), _stopped_word))).alias("term"))
            own = words.join(abbreviations(df, text).select("term"), "term", "left_semi").groupBy("_of").agg(F.collect_set("term").alias("_also"))
            rows = df.withColumn("_of", F.xxhash64(text)).join(own, "_of", "left")
            also = F.coalesce("_also", F.array().cast("array<string>"))
            return rows.select(*keep, F.posexplode(bounded_sentences(text, ABBREVIATIONS, also)).alias("sent_idx", "sentence"))
    return df.select(*keep, F.posexplode(bounded_sentences(text, [*ABBREVIATIONS, *known])).alias("sent_idx", "sentence"))


def token_array(text: Column | str) -> Column:
    """Lower-case tokens of letters, digits and underscores."""
    return F.filter(F.split(F.lower(F.coalesce(as_column(text), F.lit(""))), r"\W+"), lambda t: t != "")


def word_array(text: Column | str) -> Column:
    """Lower-case words of letters and digits of any script and underscores, as summarise.keywords takes them."""
    return F.filter(F.split(F.lower(F.coalesce(as_column(text), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def token_counts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    tokens = token_array(text)
    return df.select(*keep, F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_terms"))


def term_counts(df: DataFrame, text: str, key: str, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """key, term, tf."""
    terms = df.select(key, F.explode(token_array(text)).alias("term"))
    if stop_words:
        terms = terms.filter(~F.col("term").isin(*stop_words))
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(df: DataFrame, text: str) -> DataFrame:
    """term, df: in how many rows each term is. Distinct terms of a row are found in the row, so one shuffle of partial counts is all."""
    return df.select(F.explode(F.array_distinct(token_array(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def tfidf(df: DataFrame, text: str, key: str, min_df: int = 2, max_df: float = 0.5, n_features: int | None = 10_000, stop_words: tuple[str, ...] = STOP_WORDS, use_idf: bool = True) -> DataFrame:
    """key, term, weight: smoothed TF-IDF, each row scaled to length 1, of the n_features most frequent terms within the limits."""
    counts = term_counts(df, text, key, stop_words)
    n = df.agg(F.count("*").alias("_n"))
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("_all")).join(F.broadcast(n), how="cross")  # one row
    terms = terms.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_n")))
    if n_features:
        terms = terms.orderBy(F.col("_all").desc(), "term").limit(n_features)
    idf = F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1 if use_idf else F.lit(1.0)
    weighted = counts.join(terms.select("term", idf.alias("_idf")), "term").withColumn("weight", F.col("tf") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("weight") / norm).alias("weight"))


def hashed_features(df: DataFrame, text: str, n_features: int = 10_000, use_idf: bool = True):
    """df with features: hashed term frequencies (with IDF) scaled to length 1, as MLlib vectors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    rows = df.withColumn("_tokens", F.filter(token_array(text), lambda t: ~t.isin(*STOP_WORDS)))
    stages = [HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=n_features)]
    if use_idf:
        stages.append(IDF(inputCol="_tf", outputCol="_w", minDocFreq=1))
    stages.append(Normalizer(inputCol="_w" if use_idf else "_tf", outputCol="features", p=2.0))
    return Pipeline(stages=stages).fit(rows).transform(rows).drop("_tokens", "_tf", "_w")


def latent_features(df: DataFrame, text: str, key: str, k: int = 100, n_features: int = 10_000, seed: int = 0, **options):
    """(k singular values, key and features of each row, directions of the hashed terms): TF-IDF rows hashed to n_features places, cut down to k of them by a
    truncated singular value decomposition. options are those of `tfidf`. A row without a term within its limits has no features."""
    from podium.operators.svd import truncated

    weights = tfidf(df, text, key, n_features=None, **options)
    return truncated(weights.select(key, F.pmod(F.xxhash64("term"), F.lit(n_features)).cast("int").alias("j"), F.col("weight").alias("x")), key, n_features, k, seed)


# ranking and selection


def keyword_vocabulary(df: DataFrame, text: str, n: int) -> DataFrame:
    """The n terms in most rows (ties by term), without function words."""
    found = document_frequency(df, text).filter(~F.col("term").isin(*STOP_WORDS))
    return found.orderBy(F.col("df").desc(), "term").limit(n).select("term")


def keyword_selection(transcripts: DataFrame, text: str, by: list[str], vocabulary: DataFrame, coverage: float = 0.70, tokens=token_array) -> DataFrame:
    """by, sent_idx, sentence, rating: of each part's sentences, int(n * coverage) best in their order; a sentence with a keyword rates 1, else 0.

    vocabulary: term, for all parts, or by and term, for each part its own.
    """
    rows = sentences(transcripts, text, by)
    on = [c for c in [*by, "term"] if c in vocabulary.columns]
    hits = rows.select(*by, "sent_idx", F.explode(F.array_distinct(tokens("sentence"))).alias("term")).join(vocabulary, on, "left_semi").select(*by, "sent_idx").distinct()
    rated = rows.join(hits.withColumn("_hit", F.lit(1.0)), [*by, "sent_idx"], "left").withColumn("rating", F.coalesce("_hit", F.lit(0.0))).drop("_hit")
    return top_restored(rated, "rating", "sent_idx", coverage, by).drop("rank_in_part")


def _frequent_terms(rows: DataFrame, tokens: Column, min_df: int, max_df: float, most: int) -> tuple[list[str], list[float]]:
    """(terms, smoothed IDF) as in `tfidf`, `most` at most. A batch's terms are counted in its task, so that sums of terms are shuffled and no token."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, terms = _codes(batch.column("t"))
            in_rows = np.bincount(np.unique(row * max(1, len(terms)) + code) % max(1, len(terms)), minlength=len(terms))
            yield pa.RecordBatch.from_arrays([terms, pa.array(in_rows, pa.int64()), pa.array(np.bincount(code, minlength=len(terms)), pa.int64())], ["term", "df", "_all"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([batch.num_rows]), pa.array([0])], ["term", "df", "_all"])  # the rows themselves

    counts = rows.select(tokens.alias("t")).mapInArrow(counted, "term string, df long, _all long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("_all").alias("_all"))
    counts = written(counts, "terms")
    n = sum(r["df"] for r in counts.filter("term IS NULL").collect())  # one row
    terms = counts.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n) & ~F.col("term").isin(*STOP_WORDS)).orderBy(F.col("_all").desc(), "term").limit(most)
    found = terms.select("term", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).collect()
    return [r[0] for r in found], [r[1] for r in found]


def _codes(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, place of its term) of each token of a batch, and the terms."""
    found = tokens.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
    return row, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def tfidf_selection(df: DataFrame, text: str, by: list[str], coverage: float = 0.70) -> DataFrame:
    """The same with the sum of a sentence's TF-IDF weights (those of `tfidf`) as its rating.

    The terms are 10,000 at most, so tasks hold them and rate each sentence where it lies; only the choice among a part's sentences moves them.
    """
    rows, tokens = sentences(df, text, by), token_array("sentence")
    terms, idf = _frequent_terms(rows, tokens, 2, 0.5, 10_000)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = pa.array([*terms, None], pa.string()), np.array([*idf, 0.0])
        for batch in batches:
            n = batch.num_rows
            row, code, words = _codes(batch.column("_tokens"))
            place = pc.index_in(words, value_set=known).fill_null(len(terms)).to_numpy().astype(np.int64)[code]
            cell, tf = np.unique(row * len(weight) + place, return_counts=True)
            w = tf * weight[cell % len(weight)]
            total, square = (np.bincount(cell // len(weight), x, minlength=n) for x in (w, w * w))
            rating = total / np.sqrt(np.where(square > 0, square, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(rating, pa.float64())], [*keys, "rating"])

    keys = rows.columns
    kinds = dict(rows.dtypes)
    found = rows.withColumn("_tokens", tokens).mapInArrow(rated, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "rating double"]))
    return top_restored(found.withColumn("rating", F.round("rating", 9)), "rating", "sent_idx", coverage, by).drop("rank_in_part")


# combining


def complete_sentences(df: DataFrame, text: str, by: list[str], tagger=None) -> DataFrame:
    """by, sent_idx, sentence: complete ones: a capital first, a sentence end last, two nouns and a verb.

    tagger: a function of a sentence column that gives its tags as an array (NOUN, PROPN, PRON, VERB, ...), a model's place. Without
    one, five words or more stand for nouns and verb.
    """
    rows = sentences(df, text, by)
    formal = F.col("sentence").rlike(r"^\p{Lu}") & F.col("sentence").rlike(r"[.!?]$")
    if tagger is None:
        return rows.filter(formal & (F.size(token_array("sentence")) >= 5))
    tags = tagger(F.col("sentence"))
    nouns = F.size(F.filter(tags, lambda t: t.isin("NOUN", "PROPN", "PRON")))
    return rows.filter(formal & (nouns >= 2) & (F.size(F.filter(tags, lambda t: t == "VERB")) >= 1))


def full_sentences(slides: DataFrame, speech: DataFrame, text: str, by: list[str], cut_off: float = 0.70, tagger=None) -> DataFrame:
    """by, ratio, combined: the slides' complete sentences before the speech if they make up more than cut_off of its tokens, else speech."""
    whole = complete_sentences(slides, text, by, tagger)
    joined = whole.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", "sentence"))), lambda x: x["sentence"]), " ").alias("_full"), F.sum(F.size(token_array("sentence"))).alias("_n_full"))
    every = slides.select(*by, F.size(token_array(text)).alias("_n"))
    both = speech.select(*by, F.col(text).alias("_speech")).join(every, by, "left").join(joined, by, "left")
    ratio = F.coalesce(F.col("_n_full") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0))
    return both.select(*by, ratio.alias("ratio"), F.when(ratio > cut_off, F.concat("_full", F.lit(" "), F.coalesce("_speech", F.lit("")))).otherwise(F.col("_speech")).alias("combined"))


def combine(slides: DataFrame, speech: DataFrame, text: str, by: list[str], how: str = "concat", **options) -> DataFrame:
    """by, combined, by one of the ways: only_asr, only_slides, concat (slides first), full_sents, keyword_based (speech rated by the TextRank
    keywords of its own part's slides)."""
    if how == "only_asr":
        return speech.select(*by, F.col(text).alias("combined"))
    if how == "only_slides":
        return slides.select(*by, F.col(text).alias("combined"))
    if how == "concat":
        both = slides.select(*by, F.col(text).alias("_a")).join(speech.select(*by, F.col(text).alias("_b")), by, "full")
        return both.select(*by, F.concat(F.coalesce("_a", F.lit("")), F.coalesce("_b", F.lit(""))).alias("combined"))
    if how == "full_sents":
        return full_sentences(slides, speech, text, by, **options).select(*by, "combined")
    if how == "keyword_based":
        from podium.operators.summarise import keywords

        kept = keyword_selection(speech, text, by, keywords(slides, text, by).select(*by, "term"), tokens=word_array, **options)
        return kept.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", "sentence"))), lambda x: x["sentence"]), " ").alias("combined"))
    raise ValueError(f"unknown way to combine: {how}")


def abstractive_bounds(text: Column | str, low: float = 0.10, most_low: int = 512, high: float = 0.60) -> Column:
    """Struct of the least and most words of an abstract: 10 % of the text's (512 at most), and 60 %."""
    n = F.size(F.filter(F.split(as_column(text), r"\s+"), lambda w: w != ""))
    return F.struct(F.least(F.floor(n * low).cast("int"), F.lit(most_low)).alias("min_length"), F.floor(n * high).cast("int").alias("max_length"))


def bag_of_words_rules(feature_extraction: str, cluster_summarizer: str, final_sort_by: str | None, title_generation: bool) -> None:
    """Raises where settings of cluster_summary don't go together."""
    if feature_extraction not in ("bow", "hash", "neural"):
        raise ValueError("feature_extraction must be bow, hash or neural")
    if cluster_summarizer not in ("extractive", "abstractive"):
        raise ValueError("cluster_summarizer must be extractive or abstractive")
    if cluster_summarizer == "extractive" and feature_extraction == "neural":
        raise ValueError("extractive summaries need bag-of-words features to rate sentences")
    if final_sort_by not in (None, "order", "rating"):
        raise ValueError("final_sort_by must be order or rating")
    if final_sort_by and title_generation:
        raise ValueError("sentences under titles stay in their clusters: final_sort_by must be None")


def _clustered(said: list[str], coverage: float, k: int, seed: int, width: int | None) -> list[tuple[int, int, float]]:
    """cluster, sent_idx, rating of the sentences that one text's summary keeps."""
    import re
    from collections import Counter
    from zlib import crc32

    import numpy as np

    from podium.operators.minibatch import Sparse, labels

    n = len(said)
    each = int(n * coverage) // k
    if not each:
        return []
    counts = [Counter(t for t in re.split(r"\W+", x.lower(), flags=re.ASCII) if t and t not in STOP_WORDS) for x in said]
    df = Counter(t for c in counts for t in c)
    place = {t: crc32(t.encode()) % width if width else i for i, t in enumerate(df)}
    row = np.repeat(np.arange(n), [len(c) for c in counts])
    terms = [t for c in counts for t in c]
    tf = np.array([v for c in counts for v in c.values()], float)
    often = np.array([df[t] for t in terms], float)

    def scaled(x: np.ndarray) -> np.ndarray:
        length = np.sqrt(np.bincount(row, x * x, n))[row]
        return np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    features = scaled(tf * np.log((n + 1) / (often + 1)))
    label = labels(Sparse(row, np.array([place[t] for t in terms], int), features, n, width or max(1, len(place))), k, seed)
    rated = scaled(np.where((often >= 2) & (often <= 0.5 * n), tf * (np.log((1 + n) / (1 + often)) + 1), 0))
    rating = np.round(np.bincount(row, rated, n), 9)
    order = np.lexsort((np.arange(n), -rating, label))
    rank = np.arange(n) - np.searchsorted(label[order], label[order])
    return [(int(label[i]), int(i), float(rating[i])) for i in order[rank < each]]


def cluster_summary(df: DataFrame, text: str, key: str, coverage: float = 0.70, k: int = 10, seed: int = 0, feature_extraction: str = "hash", final_sort_by: str | None = None, titles=None, summarise=None) -> DataFrame:
    """key, cluster, sent_idx, sentence, rating, title, final_order: each text's sentences grouped by mini-batch k-means, the best of each cluster.

    int(int(n * coverage) / k) sentences a cluster of a text of n, rated by the sum of their TF-IDF weights in the text (ties by order); clusters are compared by hashed (10,000
    places) or whole term weights. titles and summarise are functions of a column (a model's place); the order in a text is by cluster, or by sentence order
    or rating. Texts are summarised each by itself, one at a time in a worker; a null or empty one, or one of too few sentences, has no rows.
    """
    from podium.operators.rowwise import by_row

    bag_of_words_rules(feature_extraction, "abstractive" if summarise else "extractive", final_sort_by, titles is not None)
    width = None if feature_extraction == "bow" else 10_000

    def run(said: list[str]):
        return ((c, i, said[i], r) for c, i, r in _clustered(said, coverage, k, seed, width))

    rows = df.select(key, sentence_array(text).alias("_said"))
    kept = by_row(rows, [key], run, {"cluster": "int", "sent_idx": "int", "sentence": "string", "rating": "double"})
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", "sentence"))), lambda x: x["sentence"]), " ")
    same = [F.col(key).eqNullSafe(F.col("_k")), F.col("cluster") == F.col("_c")]
    if summarise is not None:
        kept = kept.groupBy(key, "cluster").agg(joined.alias("sentence"), F.min("sent_idx").alias("sent_idx"), F.max("rating").alias("rating")).withColumn("sentence", summarise(F.col("sentence")))
    if titles is not None:
        names = kept.groupBy(F.col(key).alias("_k"), F.col("cluster").alias("_c")).agg(titles(joined).alias("title"))
        kept = kept.join(names, same, "left").drop("_k", "_c")
    else:
        kept = kept.withColumn("title", F.lit(None).cast("string"))
    order = {None: ["cluster", "sent_idx"], "order": ["sent_idx"], "rating": [F.col("rating").desc(), "sent_idx"]}[final_sort_by]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return kept.select(key, "cluster", "sent_idx", "sentence", "rating", "title", place.alias("final_order"))


def titled(summary: DataFrame, key: str) -> DataFrame:
    """key, summary: 'Title: ...\\nContent: ...\\n\\n' for each cluster of a text's summary."""
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", "sentence"))), lambda x: x["sentence"]), " ")
    parts = summary.groupBy(key, "cluster").agg(F.max("title").alias("title"), content.alias("content"))
    text = F.format_string("Title: %s\nContent: %s\n\n", F.coalesce("title", F.lit("")), "content")
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cluster", text.alias("t")))), lambda x: x["t"]), "").alias("summary"))


# spelling


def deletes(word: Column) -> Column:
    """The word and what is left of it after one or two of its first seven characters go: equal ones mark words within two edits."""
    w = F.substring(word, 1, 7)
    less = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    one = less(w)
    return F.array_distinct(F.concat(F.array(w), one, F.flatten(F.transform(one, less))))


def corrected(words: DataFrame, word: str, dictionary: DataFrame) -> DataFrame:
    """word, suggestion, distance: the nearest entry of the dictionary (columns term and freq) within two edits, then the most frequent.

    A word without one stays as it is, with a null distance. Words meet entries by shared deletes, not in pairs of all.
    """
    asked = words.select(F.col(word).alias("word")).distinct()
    known = dictionary.select("term", "freq", F.explode(deletes(F.col("term"))).alias("_d"))
    pairs = asked.select("word", F.explode(deletes(F.col("word"))).alias("_d")).join(known, "_d").select("word", "term", "freq").distinct()
    near = pairs.withColumn("distance", F.levenshtein("word", "term")).filter("distance <= 2")
    best = near.groupBy("word").agg(F.min(F.struct("distance", (-F.col("freq")).alias("f"), "term")).alias("b"))
    return asked.join(best, "word", "left").select("word", F.coalesce("b.term", "word").alias("suggestion"), F.col("b.distance").alias("distance"))


def merged(words: DataFrame, by: list[str], dictionary: DataFrame) -> DataFrame:
    """words (by, pos, word) with neighbours put together where that is nearer to an entry: the edits of both together, and one for the
    blank, are fewer than those of each by itself (3 for a word without an entry). Of a row of such neighbours every other pair is taken."""
    w = Window.partitionBy(*by).orderBy("pos")
    rows = words.withColumn("_next", F.lead("word").over(w)).withColumn("_both", F.concat("word", "_next"))
    asked = rows.select("word").unionByName(rows.filter("_both IS NOT NULL").select(F.col("_both").alias("word")))
    edits = corrected(asked, "word", dictionary).select("word", F.coalesce("distance", F.lit(3)).alias("n"))
    for column, name in (("word", "_a"), ("_next", "_b"), ("_both", "_ab")):
        rows = rows.join(edits.select(F.col("word").alias(f"{name}w"), F.col("n").alias(name)), F.col(column) == F.col(f"{name}w"), "left").drop(f"{name}w")
    rows = rows.withColumn("_can", F.coalesce((F.col("_ab") < 3) & (F.col("_ab") + 1 < F.col("_a") + F.col("_b")), F.lit(False)))
    new = F.col("_can") & ~F.coalesce(F.lag("_can").over(w), F.lit(False))
    rows = rows.withColumn("_run", F.sum(new.cast("int")).over(w))
    at = F.row_number().over(Window.partitionBy(*by, "_run", "_can").orderBy("pos"))
    rows = rows.withColumn("_take", F.col("_can") & (at % 2 == 1))
    rows = rows.withColumn("_gone", F.coalesce(F.lag("_take").over(w), F.lit(False))).filter("NOT _gone")
    return rows.select(*by, "pos", F.when(F.col("_take"), F.col("_both")).otherwise(F.col("word")).alias("word"))


def corrected_text(df: DataFrame, text: str, by: list[str], dictionary: DataFrame) -> DataFrame:
    """by, corrected: whole texts in lower case, word by word; neighbours that are one entry are put together, a word that is no entry but
    splits into two entries is split."""
    words = merged(df.select(*by, F.posexplode(token_array(text)).alias("pos", "word")), by, dictionary)
    fixed = corrected(words, "word", dictionary)
    halves = words.select("word").distinct().select("word", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda i: F.struct(F.substring(F.col("word"), F.lit(1), i).alias("a"), F.substring(F.col("word"), i + 1, F.length("word")).alias("b")))).alias("h")).select("word", "h.a", "h.b")
    entry = lambda x: dictionary.select(F.col("term").alias(x), F.col("freq").alias(f"f{x}"))
    split = halves.join(entry("a"), "a").join(entry("b"), "b").groupBy("word").agg(F.max(F.struct(F.least("fa", "fb").alias("f"), F.concat_ws(" ", "a", "b").alias("t")))["t"].alias("_split"))
    best = fixed.join(split, "word", "left").select("word", F.when(F.col("distance").isNull() & F.col("_split").isNotNull(), F.col("_split")).otherwise(F.col("suggestion")).alias("_w"))
    return words.join(best, "word").groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_w"))), lambda x: x["_w"]), " ").alias("corrected"))


def with_full_stops(words: DataFrame, by: list[str], pos: str, word: str, is_boundary: Column, capitalise: bool = True) -> DataFrame:
    """by, pos2, word, start, end: a '.' (times 0) behind each boundary and at the end, the next word with a capital.

    is_boundary: a model's verdict on each word. Positions double, so the stops find room between.
    """
    w = Window.partitionBy(*by).orderBy(pos)
    last = F.lead(pos).over(w).isNull()
    rows = words.withColumn("_cut", F.coalesce(is_boundary, F.lit(False)) | last)
    after = F.coalesce(F.lag("_cut").over(w), F.lit(True))
    text = F.when(after, F.initcap(word)).otherwise(F.col(word)) if capitalise else F.col(word)
    rows = rows.withColumn("_t", text)
    parts = F.when(F.col("_cut"), F.array(F.struct((F.col(pos) * 2).alias("pos2"), F.col("_t").alias("word"), F.col("start"), F.col("end")), F.struct((F.col(pos) * 2 + 1).alias("pos2"), F.lit(".").alias("word"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))))
    parts = F.coalesce(parts, F.array(F.struct((F.col(pos) * 2).alias("pos2"), F.col("_t").alias("word"), F.col("start"), F.col("end"))))
    return rows.select(*by, F.explode(parts).alias("p")).select(*by, "p.*")
