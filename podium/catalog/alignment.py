"""Queries on the alignment of slides and speech, and on slide content. Events stand for a word clock, conversations for slides."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.catalog.registry import Registry, table
from podium.operators import align

_R = Registry()


def _clock(spark, sf_dir):
    """Words (all events but sign-ups; purchases end sentences) and slides (sign-ups) of each user, in the nearest whole seconds."""
    events = table(spark, sf_dir, "events").withColumn("t", F.rint(F.col("ts").cast("timestamp").cast("double")).cast("long"))
    words = events.filter("event_type <> 'signup'").select("user_id", F.col("event_id").alias("pos"), F.col("t").cast("double").alias("start"), "event_type")
    slides = events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("slide"), "t")
    return slides, words


_ALIGN = """w AS (SELECT user_id, event_id AS pos, epoch(ts)::BIGINT AS t, event_type = 'purchase' AS e FROM events WHERE event_type <> 'signup'),
s AS (SELECT user_id, event_id AS slide, epoch(ts)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events WHERE event_type = 'signup'),
b AS (SELECT s.*, 1 + (SELECT count(*) FROM w WHERE w.user_id = s.user_id AND w.e AND w.t < s.t) AS b FROM s),
r AS (SELECT *, idx + max(b - idx) OVER (PARTITION BY user_id ORDER BY idx) AS reach FROM b),
r2 AS (SELECT *, lag(reach, 1, 0) OVER (PARTITION BY user_id ORDER BY idx) AS was FROM r),
n AS (SELECT user_id, pos, 1 + coalesce(sum(e::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM w)"""


@_R.add("structured_alignment", f"WITH {_ALIGN} SELECT r2.user_id, slide, idx, reach, count(n.pos) AS n_words, min(n.pos) AS first_word, max(n.pos) AS last_word FROM r2 LEFT JOIN n ON n.user_id = r2.user_id AND n.at > was AND n.at <= reach GROUP BY ALL")
def structured_alignment(spark, sf_dir):
    slides, words = _clock(spark, sf_dir)
    rows = align.timed(words, ["user_id"], "pos", "start", F.col("event_type") == "purchase")
    bounds = align.boundaries(slides, rows, ["user_id"], "slide", "t")
    spans = align.slide_of_words(rows, bounds, ["user_id"], "pos").groupBy("user_id", "idx").agg(F.count("*").alias("n_words"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"))
    return bounds.select("user_id", "slide", "idx", "reach").join(spans, ["user_id", "idx"], "left").withColumn("n_words", F.coalesce("n_words", F.lit(0).cast("long")))


@_R.add("structured_alignment_text", f"""WITH {_ALIGN},
x AS (SELECT n.user_id, n.pos, CASE WHEN e THEN n.pos || '.' ELSE n.pos || '' END AS word, n.at FROM n JOIN w USING (user_id, pos)),
t AS (SELECT r2.user_id, idx, string_agg(word, ' ' ORDER BY x.pos) AS transcript FROM r2 JOIN x ON x.user_id = r2.user_id AND x.at > was AND x.at <= reach GROUP BY ALL),
l AS (SELECT user_id, max(idx) AS last, max(reach) AS reach FROM r2 GROUP BY user_id),
c AS (SELECT l.user_id, last + 1 AS ord, string_agg(word, ' ' ORDER BY x.pos) AS transcript FROM l JOIN x ON x.user_id = l.user_id AND x.at > l.reach GROUP BY ALL),
e AS (SELECT user_id, count(*) FILTER (WHERE e) AS ends FROM w GROUP BY user_id)
SELECT r2.user_id, idx AS ord, 'slide' AS kind, coalesce(transcript, '') AS transcript FROM r2 LEFT JOIN t USING (user_id, idx)
UNION ALL SELECT l.user_id, last + 1, 'conclusion', coalesce(transcript, '') FROM l JOIN e USING (user_id) LEFT JOIN c ON c.user_id = l.user_id WHERE l.reach <= e.ends""")
def structured_alignment_text(spark, sf_dir):
    slides, words = _clock(spark, sf_dir)
    words = words.withColumn("word", F.concat(F.col("pos").cast("string"), F.when(F.col("event_type") == "purchase", ".").otherwise("")))
    return align.align(slides, words, ["user_id"], "slide", first_slide=False, time="t").select("user_id", "ord", "kind", "transcript")


_LINES = "SELECT conv_id, turn + (turn >= 3)::INT AS line_num, (turn % 4 = 0)::INT AS category, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS text FROM conversations"


def _lines(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", (F.col("turn") + (F.col("turn") >= 3).cast("int")).alias("line_num"), (F.col("turn") % 4 == 0).cast("int").alias("category"), F.regexp_replace("text", "[^A-Za-z ]", "").alias("text"))


@_R.add("paragraph_grouping", f"""WITH l AS ({_LINES}),
p AS (SELECT *, sum(CASE WHEN line_num = lag_line + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY line_num)::BIGINT AS paragraph FROM (SELECT *, lag(line_num) OVER (PARTITION BY conv_id ORDER BY line_num) AS lag_line FROM l)),
q AS (SELECT *, sum(CASE WHEN category IS NOT DISTINCT FROM lag_c THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, paragraph ORDER BY line_num) AS run FROM (SELECT *, lag(category) OVER (PARTITION BY conv_id, paragraph ORDER BY line_num) AS lag_c FROM p)),
r AS (SELECT conv_id, paragraph, run, category, string_agg(text, ' ' ORDER BY line_num) AS t FROM q GROUP BY ALL)
SELECT conv_id, paragraph, string_agg(CASE WHEN category = 1 THEN '**' || t || '**' ELSE t END, ' ' ORDER BY run) AS content FROM r GROUP BY ALL HAVING length(string_agg(CASE WHEN category = 1 THEN '**' || t || '**' ELSE t END, ' ' ORDER BY run)) > 3""")
def paragraph_grouping(spark, sf_dir):
    return align.paragraphs(_lines(spark, sf_dir), ["conv_id"])


@_R.add("figure_attachment", """SELECT o.o_orderkey, string_agg(l_partkey || '_figure_' || l_linenumber, ',' ORDER BY l_partkey || '_figure_' || l_linenumber) AS figure_paths
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l_quantity > 45 GROUP BY 1""")
def figure_attachment(spark, sf_dir):
    figures = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws("_figure_", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"))
    slides = table(spark, sf_dir, "orders").select("o_orderkey")
    return slides.join(align.attach(figures, ["o_orderkey"]), "o_orderkey", "left").select("o_orderkey", F.when(F.col("figure_paths").isNotNull(), F.array_join("figure_paths", ",")).alias("figure_paths"))


@_R.add("structured_summary")
def structured_summary(spark, sf_dir):
    slides, words = _clock(spark, sf_dir)
    words = words.withColumn("word", F.concat(F.col("pos").cast("string"), F.when(F.col("event_type") == "purchase", ".").otherwise("")))
    slides = slides.select("user_id", F.col("t").alias("frame_number"))
    # of each slide: a title line and two body lines
    number = F.explode(F.array(*(F.struct(F.lit(i).alias("line_num"), F.lit(c).alias("category")) for i, c in ((1, 2), (2, 1), (3, 0)))))
    lines = slides.select("*", number.alias("l")).select("user_id", "frame_number", "l.*", F.concat(F.lit("line "), F.col("l.line_num").cast("string"), F.lit(" of "), (F.col("frame_number") % 5).cast("string")).alias("text"))
    figures = slides.filter("frame_number % 2 = 0").select("user_id", "frame_number", F.concat(F.col("frame_number").cast("string"), F.lit("_figure_0.png")).alias("path"))
    return align.structured_summary(slides, lines, words, figures, ["user_id"])


QUERIES, ORACLE_SQL = _R.queries, _R.sql
