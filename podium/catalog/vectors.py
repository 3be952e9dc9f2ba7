"""Queries on feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from podium.catalog.registry import Registry, rounded, table
from podium.operators import minibatch, vectors

_R = Registry()

_CENTERS = "x AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL)"


@_R.add("label_centroids", f"WITH {_CENTERS} SELECT label, i::INT - 1 AS i, round(m, 6) AS m FROM c")
def label_centroids(spark, sf_dir):
    rows = vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return rounded(rows.select("label", F.posexplode("centroid").alias("i", "m")), "m")


@_R.add("nearest_sample_to_label_centroid", f"WITH {_CENTERS}, d AS (SELECT vec_id, label, round(sum((x - m) * (x - m)), 9) AS distance FROM x JOIN c USING (label, i) GROUP BY ALL) SELECT label, arg_min(vec_id, (distance, vec_id)) AS best, round(min(distance), 6) AS distance FROM d GROUP BY label")
def nearest_sample_to_label_centroid(spark, sf_dir):
    return rounded(vectors.nearest_to_centroid(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id"), "distance")


@_R.add("nearest_centroid_assignment", f"WITH {_CENTERS}, d AS (SELECT x.vec_id, c.label AS cluster, round(sum((x.x - m) * (x.x - m)), 9) AS distance FROM x JOIN c ON x.i = c.i GROUP BY ALL) SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, round(min(distance), 6) AS distance FROM d GROUP BY vec_id")
def nearest_centroid_assignment(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    centers = vectors.centroids(rows, "label", "embedding").withColumnRenamed("label", "cluster")
    return rounded(vectors.assigned(rows.select("vec_id", "embedding"), centers, "embedding", "vec_id"), "distance")


@_R.add("knn_ratio_test", """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id AS query, e.vec_id AS item, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, item) AS n FROM d)
SELECT a.query, a.item, round(a.d, 6) AS d1, round(b.d, 6) AS d2 FROM r a JOIN r b ON a.query = b.query AND a.n = 1 AND b.n = 2 WHERE a.d < 0.97 * b.d""")
def knn_ratio_test(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rounded(vectors.ratio_matches(rows.filter("vec_id % 50 = 0"), rows, "vec_id", "vec_id", "embedding", 0.97), "d1", "d2")


@_R.add("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    return vectors.kmeans(table(spark, sf_dir, "embeddings"), "embedding", 20)[0].select("vec_id", "cluster")


@_R.add("kmeans_best_samples")
def kmeans_best_samples(spark, sf_dir):
    clustered = vectors.kmeans(table(spark, sf_dir, "embeddings"), "embedding", 20)[0]
    return rounded(vectors.best_samples(clustered, "embedding", "vec_id"), "distance")


@_R.add("cluster_count")
def cluster_count(spark, sf_dir):
    return vectors.kmeans(table(spark, sf_dir, "embeddings"), "embedding", 20)[0].agg(F.countDistinct("cluster").alias("n_clusters"))


@_R.add("minibatch_clusters")
def minibatch_clusters(spark, sf_dir):
    """Clusters by one pass of mini-batches."""
    return minibatch.kmeans(table(spark, sf_dir, "embeddings"), "embedding", 20)[0].select("vec_id", "cluster")


@_R.add("cost_by_k")
def cost_by_k(spark, sf_dir):
    return rounded(vectors.cost_by_k(table(spark, sf_dir, "embeddings"), "embedding", [2, 4, 8]), "cost")


@_R.add("affinity_clusters")
def affinity_clusters(spark, sf_dir):
    return vectors.affinity(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id", preference=-1.0)


@_R.add("near_vector_pairs")
def near_vector_pairs(spark, sf_dir):
    return rounded(vectors.near_pairs(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", 1.0), "distance")


@_R.add("mean_vector_similarity", """WITH x AS (SELECT label, vec_id % 2 AS side, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, side, i, avg(x) AS m FROM x GROUP BY ALL)
SELECT a.label, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) AS similarity FROM c a JOIN c b ON a.label = b.label AND a.i = b.i AND a.side = 0 AND b.side = 1 GROUP BY a.label""")
def mean_vector_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rounded(vectors.document_similarity(rows.filter("vec_id % 2 = 0"), rows.filter("vec_id % 2 = 1"), "label", "embedding"), "similarity")


@_R.add("svm_match_threshold")
def svm_match_threshold(spark, sf_dir):
    """The share of small letters of a document's signs from which on its quality is labelled good."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality IS NOT NULL"), "doc_id")
    rows = labelled.filter("length(text) > 0").select((F.length(F.regexp_replace("text", "[^a-z]", "")) / F.length("text")).alias("v"), F.col("quality").alias("y"))
    return spark.createDataFrame([(round(vectors.svm_threshold(rows, "v", "y"), 4),)], "threshold double")


@_R.add("classifier_cross_validation")
def classifier_cross_validation(spark, sf_dir):
    """Accuracy of a logistic regression on the vectors by strength of regularisation, in three folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = table(spark, sf_dir, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(maxIter=20)
    grid = ParamGridBuilder().addGrid(model.regParam, [0.01, 0.1]).build()
    fitted = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=3, seed=1).fit(rows)
    return spark.createDataFrame([(0.01, float(fitted.avgMetrics[0])), (0.1, float(fitted.avgMetrics[1]))], "reg_param double, accuracy double")


QUERIES, ORACLE_SQL = _R.queries, _R.sql
