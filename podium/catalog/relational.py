"""Additions: relational queries that the blueprint's operators rest on or that users of any engine expect."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.catalog.registry import Registry, rounded, table
from podium.functions import scalars as S

_R = Registry()


def _plain(name: str, sql: str, oracle: str | None = None):
    """A query that is SQL in both engines."""

    def query(spark, sf_dir):
        import re

        made = sql
        for t in ("lineitem", "orders", "customer", "nation", "region", "supplier", "part", "events", "documents", "labels"):
            if re.search(rf"\b{t}\b", made):
                made = re.sub(rf"\b(FROM|JOIN|,) {t}\b(?!\()", rf"\1 {{{t}}} {t}", made)
        used = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", made))}
        return spark.sql(made, **used)

    _R.add(name, oracle or sql)(query)


_plain("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
_plain("nation_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_plain("segment_rollup", "SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)")
_plain("status_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_plain("customers_without_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_plain("customers_with_orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 1000)")
_plain("common_nations", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_plain("nations_without_suppliers", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")


@_R.add("status_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def status_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return rows.na.fill(0).select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@_R.add("class_counts_pivot", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'es') AS es FROM documents GROUP BY 1")
def class_counts_pivot(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().na.fill(0)


@_R.add("asof_last_signup", """SELECT e.event_id, s.event_id AS signup FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts WHERE e.event_type = 'purchase'""")
def asof_last_signup(spark, sf_dir):
    """Each purchase with the last sign-up before it: both on one line, the last value carried on."""
    events = table(spark, sf_dir, "events").filter("event_type IN ('signup', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("signup", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(w))
    return rows.filter("event_type = 'purchase'").select("event_id", "signup")


@_R.add("top_orders_by_customer", "SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top_orders_by_customer(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w).cast("long")).filter("n <= 3").select("o_custkey", "o_orderkey", "n")


@_R.add("vector_functions", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT *, list_transform(e, lambda x: exp(x - list_max(e))) AS p FROM v)
SELECT vec_id, round(p[1] / list_sum(p), 6) AS softmax_first, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm, round(e[1] * ((exp(2 * ln(1 + exp(e[1]))) - 1) / (exp(2 * ln(1 + exp(e[1]))) + 1)), 6) AS mish_first FROM s""")
def vector_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding")[0].cast("double"))
    out = rows.select("vec_id", F.get(S.softmax("embedding"), F.lit(0)).alias("softmax_first"), F.sqrt(S.dot("embedding", "embedding")).alias("norm"), S.mish("x").alias("mish_first"))
    return rounded(out, "softmax_first", "norm", "mish_first")


@_R.add("class_entropy", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c) SELECT source, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY source")
def class_entropy(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return rounded(counts.groupBy("source").agg(F.collect_list("n").alias("c")).select("source", S.entropy("c").alias("entropy")), "entropy")


@_R.add("name_cases", "SELECT p_partkey, upper(p_name[1:1]) || lower(p_name[2:]) AS capitalized, lpad(p_partkey::VARCHAR, 8, '0') AS padded FROM part")
def name_cases(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.capitalized("p_name").alias("capitalized"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"))


QUERIES, ORACLE_SQL = _R.queries, _R.sql
