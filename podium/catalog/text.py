"""Queries on texts: sentences, terms, selections, combinations, spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.catalog.registry import Registry, rounded, table
from podium.functions import scalars as S
from podium.operators import summarise, text

_R = Registry()

_SENTENCES = "list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[^.!?]+[.!?]*'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\\W+'), lambda t: t <> '')"
_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"


@_R.add("sentence_split", f"SELECT doc_id, count(*) AS n_sentences, sum(length(s))::BIGINT AS n_chars FROM (SELECT doc_id, unnest({_SENTENCES.format('text')}) AS s FROM documents) GROUP BY doc_id")
def sentence_split(spark, sf_dir):
    rows = text.sentences(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


@_R.add("sentence_rows", f"SELECT doc_id, i - 1 AS sent_idx, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES.format('text')} AS ss FROM documents))")
def sentence_rows(spark, sf_dir):
    rows = text.sentences(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return rows.withColumn("sent_idx", F.col("sent_idx").cast("long"))


@_R.add("learned_abbreviations", """WITH w AS (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '\\s+')) AS w FROM documents),
t AS (SELECT lower(regexp_extract(w, '^["''(\\[]*(.*?)\\.?["'')\\],;:!?]*$', 1)) AS term, regexp_matches(w, '\\.["'')\\],;:!?]*$')::INT AS stop FROM w),
c AS (SELECT term, count(*)::DOUBLE AS n, sum(stop)::DOUBLE AS k FROM t WHERE term <> '' GROUP BY term), a AS (SELECT sum(k) / sum(n) AS r FROM c),
s AS (SELECT term, n, k, r, length(regexp_replace(term, '[^.]', '', 'g')) AS i, length(term) AS l FROM c, a WHERE k > 0 AND regexp_matches(term, '^[\\p{L}.]+$') AND regexp_matches(term, '\\p{L}')),
x AS (SELECT term, round(2 * (k * ln(0.99) + (n - k) * ln(0.01) - k * ln(r) - (n - k) * ln(1 - r)) * exp(-(l - i)) * (i + 1) * pow(l - i, k - n), 9) AS score FROM s)
SELECT term, round(score, 6) AS score FROM x WHERE score >= 0.3 ORDER BY x.score DESC, term LIMIT 2000""")
def learned_abbreviations(spark, sf_dir):
    return rounded(text.abbreviations(table(spark, sf_dir, "documents"), "text", most=text.MOST_ABBREVIATIONS), "score")


@_R.add("learned_sentences")
def learned_sentences(spark, sf_dir):
    """Sentences by boundaries that the documents teach."""
    return text.learned_sentences(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@_R.add("token_counts", f"SELECT doc_id, len({_TOKENS.format('text')}) AS n_tokens, len(list_distinct({_TOKENS.format('text')})) AS n_terms FROM documents")
def token_counts(spark, sf_dir):
    return text.token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id"])


_TERMS = f"t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents)"


@_R.add("doc_frequency", f"WITH {_TERMS} SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term")
def doc_frequency(spark, sf_dir):
    return text.document_frequency(table(spark, sf_dir, "documents"), "text")


@_R.add("tfidf_weights", f"""WITH {_TERMS}, c AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term NOT IN {_STOP} GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.5 * (SELECT n FROM n) ORDER BY total DESC, term LIMIT 2000),
w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT n FROM n)) / (1 + df)) + 1) AS w FROM c JOIN d USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_weights(spark, sf_dir):
    return rounded(text.tfidf(table(spark, sf_dir, "documents"), "text", "doc_id", n_features=2000), "weight")


@_R.add("latent_features")
def latent_features(spark, sf_dir):
    """The documents' first 20 latent features, largest singular values first."""
    _, rows, _ = text.latent_features(table(spark, sf_dir, "documents"), "text", "doc_id", k=20)
    return rounded(rows.select("doc_id", F.posexplode("features").alias("dim", "value")), "value")


_KEYWORDS = f"k AS (SELECT term FROM (SELECT term, count(DISTINCT item_id) AS df FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) WHERE term NOT IN {_STOP} GROUP BY term) ORDER BY df DESC, term LIMIT 40)"


@_R.add("keyword_vocabulary", f"WITH {_KEYWORDS} SELECT term FROM k")
def keyword_vocabulary(spark, sf_dir):
    return text.keyword_vocabulary(table(spark, sf_dir, "benchmark"), "text", 40)


@_R.add("keyword_sentence_selection", f"""WITH {_KEYWORDS}, s AS (SELECT doc_id, ss[i] AS sentence, i - 1 AS sent_idx FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES.format('text')} AS ss FROM documents))),
r AS (SELECT *, list_has_any({_TOKENS.format('sentence')}, ks)::INT::DOUBLE AS rating FROM s, (SELECT list(term) AS ks FROM k)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rating DESC, sent_idx) AS n, floor(count(*) OVER (PARTITION BY doc_id) * 0.7::DOUBLE) AS k FROM r)
SELECT doc_id, sent_idx, sentence, rating FROM f WHERE n <= k""")
def keyword_sentence_selection(spark, sf_dir):
    words = text.keyword_vocabulary(table(spark, sf_dir, "benchmark"), "text", 40)
    rows = text.keyword_selection(table(spark, sf_dir, "documents"), "text", ["doc_id"], words)
    return rows.withColumn("sent_idx", F.col("sent_idx").cast("long"))


@_R.add("tfidf_sentence_selection")
def tfidf_sentence_selection(spark, sf_dir):
    return text.tfidf_selection(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def _sides(spark, sf_dir):
    """User turns stand for slides, assistant turns for speech."""
    turns = table(spark, sf_dir, "conversations")
    side = lambda role: turns.filter(F.col("role") == role).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    return side("user"), side("assistant")


_SIDES = "u AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1)"


@_R.add("combine_concat", f"WITH {_SIDES} SELECT conv_id, coalesce(u.text, '') || coalesce(a.text, '') AS combined FROM u FULL JOIN a USING (conv_id)")
def combine_concat(spark, sf_dir):
    return text.combine(*_sides(spark, sf_dir), "text", ["conv_id"], "concat")


@_R.add("combine_only_asr", f"WITH {_SIDES} SELECT conv_id, text AS combined FROM a")
def combine_only_asr(spark, sf_dir):
    return text.combine(*_sides(spark, sf_dir), "text", ["conv_id"], "only_asr")


@_R.add("combine_only_slides", f"WITH {_SIDES} SELECT conv_id, text AS combined FROM u")
def combine_only_slides(spark, sf_dir):
    return text.combine(*_sides(spark, sf_dir), "text", ["conv_id"], "only_slides")


@_R.add("combine_full_sents_ratio", f"""WITH {_SIDES}, s AS (SELECT conv_id, ss[i] AS s, i FROM (SELECT conv_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT conv_id, {_SENTENCES.format('text')} AS ss FROM u))),
f AS (SELECT conv_id, string_agg(s, ' ' ORDER BY i) AS t, sum(len({_TOKENS.format('s')})) AS n FROM s WHERE regexp_matches(s, '^\\p{{Lu}}') AND regexp_matches(s, '[.!?]$') AND len({_TOKENS.format('s')}) >= 5 GROUP BY 1),
r AS (SELECT a.conv_id, a.text AS speech, t, coalesce(n / nullif(len({_TOKENS.format('u.text')}), 0), 0) AS ratio FROM a LEFT JOIN u USING (conv_id) LEFT JOIN f USING (conv_id))
SELECT conv_id, round(ratio, 6) AS ratio, CASE WHEN ratio > 0.7 THEN t || ' ' || speech ELSE speech END AS combined FROM r""")
def combine_full_sents_ratio(spark, sf_dir):
    return rounded(text.full_sentences(*_sides(spark, sf_dir), "text", ["conv_id"]), "ratio")


@_R.add("combine_keyword_based")
def combine_keyword_based(spark, sf_dir):
    return text.combine(*_sides(spark, sf_dir), "text", ["conv_id"], "keyword_based")


@_R.add("abstractive_length_bounds", "SELECT doc_id, least(floor(n * 0.1)::INT, 512) AS min_length, floor(n * 0.6)::INT AS max_length FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents)")
def abstractive_length_bounds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.abstractive_bounds("text").alias("b")).select("doc_id", "b.*")


@_R.add("clean_text", "SELECT doc_id, replace(replace(text, chr(13), ''), chr(10), ' ') AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.cleaned("text").alias("cleaned"))


@_R.add("spell_check")
def spell_check(spark, sf_dir):
    """Rare terms of the benchmark corrected by the documents' frequent terms."""
    known = text.document_frequency(table(spark, sf_dir, "documents"), "text").filter("df >= 20").withColumnRenamed("df", "freq")
    asked = table(spark, sf_dir, "benchmark").select(F.explode(text.token_array("text")).alias("word"))
    return text.corrected(asked, "word", known)


@_R.add("punctuated_words")
def punctuated_words(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("word"), F.col("value").alias("start"), (F.col("value") + 1).alias("end"))
    return text.with_full_stops(events, ["user_id"], "pos", "word", F.col("word") == "error")


def _summary(method: str):
    def query(spark, sf_dir):
        return summarise.extractive(table(spark, sf_dir, "documents"), "text", "doc_id", method)

    return query


for _method in summarise.METHODS:
    _R.add(f"extractive_{_method}")(_summary(_method))


@_R.add("text_rank_keywords")
def text_rank_keywords(spark, sf_dir):
    return summarise.keywords(table(spark, sf_dir, "documents"), "text", "doc_id")


@_R.add("cluster_summary")
def cluster_summary(spark, sf_dir):
    """Each document's own summary of three clusters."""
    return text.cluster_summary(table(spark, sf_dir, "documents"), "text", "doc_id", k=3).drop("title")


QUERIES, ORACLE_SQL = _R.queries, _R.sql
