"""Queries on ordered rows: segments, duplicates, islands, restored ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.catalog.registry import Registry, rounded, table
from podium.functions import scalars as S
from podium.operators import matching, ordered

_R = Registry()

_DISTANCES = """d AS (SELECT vec_id, label, list_cosine_distance(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id)) AS distance FROM embeddings),
c AS (SELECT *, coalesce(distance > (SELECT avg(distance) FROM d) * 1.08, false) AS is_change FROM d)"""


@_R.add("segment_change_points", f"WITH {_DISTANCES} SELECT vec_id, round(distance, 6) AS distance, is_change FROM c WHERE is_change")
def segment_change_points(spark, sf_dir):
    rows = ordered.change_points(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").filter("is_change")
    return rounded(rows.select("vec_id", "distance", "is_change"), "distance")


@_R.add("segment_clusters", f"WITH {_DISTANCES} SELECT vec_id, sum(is_change::INT) OVER (ORDER BY vec_id)::BIGINT AS cluster_id, is_change AS is_best FROM c")
def segment_clusters(spark, sf_dir):
    return ordered.segment_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", "cluster_id", "is_best")


@_R.add("segment_best_samples", f"WITH {_DISTANCES}, s AS (SELECT vec_id, is_change, sum(is_change::INT) OVER (ORDER BY vec_id)::BIGINT AS cluster_id FROM c) SELECT cluster_id, vec_id AS best_sample FROM s WHERE is_change")
def segment_best_samples(spark, sf_dir):
    return ordered.segment_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").filter("is_best").select("cluster_id", F.col("vec_id").alias("best_sample"))


@_R.add("segment_clusters_by_label", """WITH d AS (SELECT vec_id, label, list_cosine_distance(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS distance FROM embeddings),
c AS (SELECT *, coalesce(distance > avg(distance) OVER (PARTITION BY label) * 1.08, false) AS is_change FROM d)
SELECT label, vec_id, sum(is_change::INT) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS cluster_id, is_change OR vec_id = max(vec_id) OVER (PARTITION BY label) AS is_best FROM c""")
def segment_clusters_by_label(spark, sf_dir):
    rows = ordered.segment_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", by=["label"], include_tail=True)
    return rows.select("label", "vec_id", "cluster_id", "is_best")


@_R.add("consecutive_movement_stats", """WITH d AS (SELECT list_cosine_distance(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id)) AS d FROM embeddings)
SELECT round(coalesce(avg((d > 1.0)::INT::DOUBLE), 0), 6) AS share_moved, round(coalesce(avg(d), 0), 6) AS mean_move, round(coalesce(max(d), 0), 6) AS max_move FROM d""")
def consecutive_movement_stats(spark, sf_dir):
    return rounded(ordered.movement_stats(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1.0), "share_moved", "mean_move", "max_move")


@_R.add("dedup_keep_last", "SELECT md5(coalesce(text, '')) AS hash, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_keep_last(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"), "doc_id")
    return ordered.keep_last_value(docs, ["hash"], "doc_id")


@_R.add("dedup_keep_first", "SELECT p_name, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def dedup_keep_first(spark, sf_dir):
    return ordered.keep_first(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_size"), ["p_name"], ["p_partkey"])


@_R.add("dedup_keep_last_rows", "SELECT p_name, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1")
def dedup_keep_last_rows(spark, sf_dir):
    return ordered.keep_last(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_size"), ["p_name"], ["p_partkey"])


@_R.add("hash_groups", "SELECT md5(p_name) AS hash, count(*) AS n_files, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS files FROM part GROUP BY 1")
def hash_groups(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.md5(F.col("p_name").cast("binary")).alias("hash"), "p_partkey")
    return ordered.hash_groups(parts, "hash", "p_partkey")


_TITLES = "CASE WHEN p_size % 7 = 0 THEN '  ' ELSE p_name END"


@_R.add("title_dedup_suffix", f"""WITH t AS (SELECT p_partkey, coalesce(nullif(trim({_TITLES}), ''), 'Slide ' || p_partkey) AS t FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p_partkey) - 1 AS n FROM t)
SELECT p_partkey, CASE WHEN n > 0 THEN t || ' (' || n || ')' ELSE t END AS unique_title FROM n""")
def title_dedup_suffix(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TITLES).alias("title"))
    return ordered.default_titles(parts, "title", "p_partkey").select("p_partkey", "unique_title")


@_R.add("run_islands_max_content", """WITH f AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run_id FROM f)
SELECT user_id, run_id, event_type, min(event_id) AS first_order, count(*) AS n_rows, arg_max(event_id, (value, event_id)) FILTER (WHERE value > 0) AS best FROM r GROUP BY ALL""")
def run_islands_max_content(spark, sf_dir):
    return ordered.best_of_runs(table(spark, sf_dir, "events"), "event_type", "event_id", ["user_id"], "value", "event_id")


@_R.add("first_slide_frame", "SELECT user_id, min(event_id) AS first_slide FROM events WHERE event_type = 'signup' GROUP BY user_id")
def first_slide_frame(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("first_slide"))


@_R.add("carry_forward_time", """SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN NULL ELSE nullif(value, 0) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS current_time_s FROM events""")
def carry_forward_time(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("start", F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")))
    return ordered.carried(events, "start", "event_id", ["user_id"], "current_time_s").select("user_id", "event_id", "current_time_s")


@_R.add("topn_restore_order", """SELECT conv_id, turn, rank_in_part FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank_in_part, floor(count(*) OVER (PARTITION BY conv_id) * 0.7::DOUBLE) AS k FROM conversations) WHERE rank_in_part <= k""")
def topn_restore_order(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("rating", F.length("text"))
    return ordered.top_restored(turns, "rating", "turn", 0.7, ["conv_id"]).select("conv_id", "turn", F.col("rank_in_part").cast("long").alias("rank_in_part"))


@_R.add("rlsa_fill", """WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS col, CASE WHEN event_type = 'view' THEN 0 ELSE 255 END AS v FROM events),
g AS (SELECT *, last_value(CASE WHEN v = 0 THEN col END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY col ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN v = 0 THEN col END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY col ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM c)
SELECT user_id, col, CASE WHEN v <> 0 AND b - a <= 4 THEN 0 ELSE v END AS filled FROM g""")
def rlsa_fill(spark, sf_dir):
    from pyspark.sql import Window

    cells = table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("col"), F.when(F.col("event_type") == "view", 0).otherwise(255).alias("v"))
    return ordered.run_filled(cells, "v", "col", ["user_id"], 4).select("user_id", "col", "filled")


@_R.add("frame_interval_by_length", "SELECT o_orderkey, greatest(1, round(CASE WHEN s < 1200 THEN s / 100 WHEN s > 4800 THEN s / 300 ELSE s / 200 END))::INT AS every_s, round(CASE WHEN s < 1200 THEN s / 100 WHEN s > 4800 THEN s / 300 ELSE s / 200 END, 6) AS exact_s FROM (SELECT o_orderkey, floor(o_totalprice / 50) AS s FROM orders)")
def frame_interval_by_length(spark, sf_dir):
    s = F.floor(F.col("o_totalprice") / 50).cast("double")
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", S.frame_interval(s).alias("every_s"), S.frame_interval_exact(s).alias("exact_s")), "exact_s")


_SCREENS = """f AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'slide' WHEN event_type IN ('error', 'purchase') THEN 'presenter_slide' ELSE 'other' END AS class FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run_id FROM (SELECT *, (class IS DISTINCT FROM lag(class) OVER (PARTITION BY user_id ORDER BY event_id))::INT AS new FROM f)),
r AS (SELECT user_id, run_id, class, min(event_id) AS first, max(event_id) AS last FROM i GROUP BY ALL),
n AS (SELECT *, lag(class) OVER w AS pc, lag(last) OVER w AS pl, lead(class) OVER w AS nc, lead(first) OVER w AS nf FROM r WINDOW w AS (PARTITION BY user_id ORDER BY run_id)),
q AS (SELECT user_id, run_id, coalesce(pc = 'slide', false) AS b, CASE WHEN pc = 'slide' THEN pl ELSE nf END AS query FROM n WHERE class = 'presenter_slide' AND (pc = 'slide' OR nc = 'slide')),
p AS (SELECT q.*, i.event_id AS frame, row_number() OVER (PARTITION BY user_id, run_id ORDER BY CASE WHEN b THEN i.event_id ELSE -i.event_id END) AS step FROM q JOIN i USING (user_id, run_id)),
g AS (SELECT * FROM (SELECT *, min(CASE WHEN (query + frame) % 3 = 0 THEN step END) OVER (PARTITION BY user_id, run_id) AS cut FROM p) WHERE cut IS NULL OR step < cut)"""


def _screens(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), "slide").when(F.col("event_type").isin("error", "purchase"), "presenter_slide").otherwise("other")
    return table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("class"))


@_R.add("screen_slide_matches", f"WITH {_SCREENS} SELECT user_id, run_id::BIGINT AS run_id, query, frame, step FROM g")
def screen_slide_matches(spark, sf_dir):
    pairs = matching.candidate_pairs(_screens(spark, sf_dir), ["user_id"], "event_id")
    return matching.matched_until(pairs, ["user_id"], (F.col("query") + F.col("frame")) % 3 != 0).withColumn("step", F.col("step").cast("long"))


@_R.add("unique_screen_frames", f"WITH {_SCREENS} SELECT user_id, event_id, class FROM f ANTI JOIN (SELECT user_id, frame AS event_id FROM g) USING (user_id, event_id)")
def unique_screen_frames(spark, sf_dir):
    return matching.unique_screens(_screens(spark, sf_dir), ["user_id"], "event_id", lambda _: (F.col("query") + F.col("frame")) % 3 != 0).select("user_id", "event_id", "class")


QUERIES, ORACLE_SQL = _R.queries, _R.sql
