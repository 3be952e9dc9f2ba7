"""Queries on evaluation: reports, word errors, uncertainty, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.catalog.registry import Registry, rounded, table
from podium.operators import evaluate

_R = Registry()

#: A rule's verdict on a document's quality: it is long enough.
_RULE = "(n_chars >= 800)::INT"


def _judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 800).cast("int").alias("found"), "source", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


_JUDGED = f"j AS (SELECT quality, {_RULE} AS found, doc_id, source, lang FROM labels JOIN documents USING (doc_id))"


@_R.add("confusion_matrix", f"WITH {_JUDGED} SELECT truth, found, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS share FROM (SELECT quality AS truth, found, count(*) AS n FROM j GROUP BY ALL)")
def confusion_matrix(spark, sf_dir):
    return rounded(evaluate.confusion(_judged(spark, sf_dir), "quality", "found"), "share")


_REPORT = f"""{_JUDGED}, k AS (SELECT DISTINCT quality AS k FROM j UNION SELECT DISTINCT found FROM j),
r AS (SELECT k::VARCHAR AS label, count(*) FILTER (WHERE quality = k) AS support, count(*) FILTER (WHERE found = k) AS said, count(*) FILTER (WHERE quality = k AND found = k) AS hit FROM k, j GROUP BY k),
c AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM r),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM c),
u AS (SELECT label, precision, recall, f1, support FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f
UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f)"""


@_R.add("classification_report", f"WITH {_REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM u")
def classification_report(spark, sf_dir):
    return rounded(evaluate.report(_judged(spark, sf_dir), "quality", "found"), "precision", "recall", "f1")


@_R.add("batch_mean_metrics", f"""WITH {_JUDGED}, b AS (SELECT *, doc_id // 64 AS batch FROM j), t AS (SELECT DISTINCT batch, quality AS k FROM b),
r AS (SELECT t.batch, k, count(*) FILTER (WHERE quality = k) AS support, count(*) FILTER (WHERE found = k) AS said, count(*) FILTER (WHERE quality = k AND found = k) AS hit FROM t JOIN b USING (batch) GROUP BY ALL),
c AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, hit / support AS r FROM r),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM c),
m AS (SELECT batch, sum(hit) / sum(support) AS accuracy, sum(p * support) / sum(support) AS precision, sum(r * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1 FROM f GROUP BY batch)
SELECT round(avg(accuracy), 6) AS accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) AS n_batches FROM m""")
def batch_mean_metrics(spark, sf_dir):
    rows = _judged(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 64))
    return rounded(evaluate.batch_means(rows, "quality", "found", "batch"), "accuracy", "precision", "recall", "f1")


@_R.add("running_average_meter", "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS avg, round(sum(l_quantity), 2) AS count FROM lineitem")
def running_average_meter(spark, sf_dir):
    return rounded(rounded(evaluate.running_meter(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity"), "avg"), "count", digits=2)


def _pairs(spark, sf_dir):
    """Neighbouring turns: the one is the truth, the other what was heard."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations")
    said = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.withColumn("said", said).filter("said IS NOT NULL")
    # the same text with every fifth word left out is heard too
    heard = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), "text", F.array_join(F.filter(evaluate.normal_tokens("text"), lambda t, i: i % 5 != 0), " ").alias("said"))
    return pairs.select((-F.col("conv_id") * 1000 - F.col("turn") - 1).alias("pair"), "text", "said").unionByName(heard)


@_R.add("wer_adjacent_turns")
def wer_adjacent_turns(spark, sf_dir):
    return rounded(evaluate.error_rates(evaluate.word_errors_kernel(_pairs(spark, sf_dir), "pair", "text", "said")), "wer", "mer", "wil")


@_R.add("wer_macro_average")
def wer_macro_average(spark, sf_dir):
    return rounded(evaluate.macro_rates(evaluate.error_rates(evaluate.word_errors_kernel(_pairs(spark, sf_dir), "pair", "text", "said"))), "mean_wer", "mean_mer", "mean_wil")


_DROPPED = """t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations)"""


@_R.add("wer_dropped_words", f"WITH {_DROPPED} SELECT conv_id * 1000 + turn AS pair, len(w) - (len(w) + 4) // 5 AS hits, 0::BIGINT AS subs, (len(w) + 4) // 5 AS dels, 0::BIGINT AS ins, round(((len(w) + 4) // 5) / nullif(len(w), 0), 6) AS wer FROM t")
def wer_dropped_words(spark, sf_dir):
    """On texts that lack every fifth word all errors are deletions, so SQL knows the counts."""
    heard = F.array_join(F.filter(evaluate.normal_tokens("text"), lambda t, i: i % 5 != 0), " ")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), "text", heard.alias("said"))
    return rounded(evaluate.error_rates(evaluate.word_errors_kernel(turns, "pair", "text", "said")).drop("mer", "wil"), "wer")


_CERTAIN = "c AS (SELECT source, avg((l.doc_id * 37 % 100) / 100.0) AS average_certainty, count(*) AS n_frames, count(*) FILTER (WHERE (l.doc_id * 37 % 100) / 100.0 < 0.7) AS num_incorrect FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY source)"


def _certain(spark, sf_dir):
    frames = _judged(spark, sf_dir).withColumn("prob", (F.col("doc_id") * 37 % 100) / 100.0)
    return evaluate.certainty(frames, "source", "prob")


@_R.add("certainty_by_video", f"WITH {_CERTAIN} SELECT source, round(average_certainty, 6) AS average_certainty, n_frames, num_incorrect, round(num_incorrect / n_frames, 6) AS percent_incorrect FROM c")
def certainty_by_video(spark, sf_dir):
    return rounded(_certain(spark, sf_dir), "average_certainty", "percent_incorrect")


@_R.add("uncertain_topk", f"WITH {_CERTAIN}, k AS (SELECT source FROM c ORDER BY average_certainty, source LIMIT 5) SELECT d.source, count(*) AS n_docs FROM documents d JOIN k USING (source) GROUP BY 1")
def uncertain_topk(spark, sf_dir):
    top = evaluate.most_uncertain(_certain(spark, sf_dir), "source", 5).select("source")
    return table(spark, sf_dir, "documents").join(top, "source").groupBy("source").agg(F.count("*").alias("n_docs"))


@_R.add("uncertain_anti", f"WITH {_CERTAIN}, k AS (SELECT source FROM c ORDER BY average_certainty, source LIMIT 5) SELECT source, n_frames FROM c WHERE source NOT IN (SELECT source FROM k)")
def uncertain_anti(spark, sf_dir):
    rows = _certain(spark, sf_dir)
    return rows.join(evaluate.most_uncertain(rows, "source", 5).select("source"), "source", "left_anti").select("source", "n_frames")


@_R.add("best_guess_class", "SELECT vec_id, label AS class, round(1.0 / (1 + label % 3), 6) AS probability FROM embeddings")
def best_guess_class(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    probs = F.map_from_arrays(F.array(F.lit(-1), F.col("label"), F.lit(99)), F.array(F.lit(0.01).cast("double"), (1.0 / (1 + F.col("label") % 3)).cast("double"), F.lit(0.02).cast("double")))
    return rounded(rows.select("vec_id", evaluate.best_guess(probs).alias("b")).select("vec_id", "b.class", "b.probability"), "probability")


_HASH = "sha1({0}::VARCHAR || '-{1}')"


@_R.add("group_split", f"WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY {_HASH.format('source', 0)}, source) AS r, floor(0.2::DOUBLE * count(*) OVER ()) AS k FROM g) SELECT source, CASE WHEN r <= k THEN 'test' ELSE 'train' END AS split FROM r")
def group_split(spark, sf_dir):
    return evaluate.group_split(table(spark, sf_dir, "documents"), "source", 0.2)


@_R.add("cv_folds", f"SELECT source, ntile(3) OVER (ORDER BY {_HASH.format('source', 0)}, source)::INT AS fold FROM (SELECT DISTINCT source FROM documents)")
def cv_folds(spark, sf_dir):
    return evaluate.folds(table(spark, sf_dir, "documents"), "source", 3)


@_R.add("group_split_stats", f"""WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY {_HASH.format('source', 0)}, source) AS r, floor(0.2::DOUBLE * count(*) OVER ()) AS k FROM g)
SELECT lang, count(*) FILTER (WHERE r > k) AS train, count(*) FILTER (WHERE r <= k) AS val, round(count(*) FILTER (WHERE r <= k) / count(*), 6) AS share FROM documents JOIN r USING (source) GROUP BY lang""")
def group_split_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rounded(evaluate.split_statistics(docs, evaluate.group_split(docs, "source", 0.2), "source", "lang"), "share")


@_R.add("split_search", """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT source, t AS try FROM (SELECT DISTINCT source FROM c), range(0, 200) AS x(t)),
r AS (SELECT *, (row_number() OVER (PARTITION BY try ORDER BY sha1(source || '-' || try), source) <= 4)::INT AS i FROM t),
s AS (SELECT try, lang, sum(n * i) / sum(n) AS share FROM r JOIN c USING (source) GROUP BY ALL)
SELECT try::INT AS try, round(avg(abs(share - 0.2)), 6) AS deviation FROM s GROUP BY try""")
def split_search(spark, sf_dir):
    return rounded(evaluate.split_search(table(spark, sf_dir, "documents"), "source", "lang", 200, 4), "deviation")


@_R.add("best_split", """WITH c AS (SELECT source AS g, coalesce(lang, '') AS c, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL), t AS (SELECT c, sum(n) AS t FROM c GROUP BY c), g AS (SELECT DISTINCT g FROM c),
s AS (SELECT [w.g, x.g, y.g, z.g] AS gs FROM g w JOIN g x ON w.g < x.g JOIN g y ON x.g < y.g JOIN g z ON y.g < z.g),
d AS (SELECT gs, c, sum(coalesce(n, 0)) / any_value(t) AS share FROM (SELECT gs, unnest(gs) AS g FROM s) CROSS JOIN t LEFT JOIN c USING (g, c) GROUP BY ALL)
SELECT array_to_string(gs, ',') AS groups, round(avg(abs(share - 0.2)), 9) AS deviation, true AS proven FROM d GROUP BY gs ORDER BY deviation, gs LIMIT 1""")
def best_split(spark, sf_dir):
    """The four sources that together hold most nearly a fifth of each language, of all ways to take four."""
    best = evaluate.best_split(table(spark, sf_dir, "documents").filter("source IS NOT NULL").withColumn("lang", F.coalesce("lang", F.lit(""))), "source", "lang", 4)
    return best.withColumn("groups", F.array_join("groups", ","))


@_R.add("random_row_split", "SELECT doc_id, CASE WHEN substr(sha1(doc_id::VARCHAR || '-1'), 1, 2) < '33' THEN 'val' ELSE 'train' END AS split FROM documents")
def random_row_split(spark, sf_dir):
    """80 to 20 by hash: the same rows on each run, whatever the partitions (0x33 of 0x100 is a fifth)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.substring(evaluate.by_hash(F.col("doc_id"), 1), 1, 2) < "33", "val").otherwise("train").alias("split"))


QUERIES, ORACLE_SQL = _R.queries, _R.sql
