"""Nearest-neighbour queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pantrylake.operators import vectors as V
from pantrylake.plans.registry import query, table

COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT b.vec_id, round({COSINE}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {COSINE} DESC, b.vec_id LIMIT 10")
def knn_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    q = rows.filter("vec_id = 0").select("embedding").first()["embedding"]
    return V.top_k(rows, q, 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""
SELECT vec_id, other, round(s, 6) AS similarity, rank FROM (SELECT a.vec_id, b.vec_id AS other, {COSINE} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 9) DESC, b.vec_id) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 5
""")
def knn_join(spark, sf):
    """The five nearest of all rows for every fiftieth."""
    rows = table(spark, sf, "embeddings")
    got = V.knn(rows.filter("vec_id % 50 = 0"), rows.withColumnRenamed("vec_id", "other"), 5, "vec_id", "other")
    return got.select("vec_id", "other", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""
SELECT vec_id, other, round(s, 6) AS similarity FROM (SELECT a.vec_id, b.vec_id AS other, {COSINE} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 9) DESC, b.vec_id) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank = 1 AND s >= 0.3
""")
def knn_threshold(spark, sf):
    """The best match among all other rows, where there is one that is good enough."""
    rows = table(spark, sf, "embeddings")
    got = V.nearest_above(rows.filter("vec_id % 50 = 0"), rows.withColumnRenamed("vec_id", "other"), "vec_id", "other", 0.3, others=True)
    return got.select("vec_id", "other", F.round("similarity", 6).alias("similarity"))


@query(f"""
SELECT vec_id, other, round(s, 6) AS similarity, rank FROM (SELECT a.vec_id, b.vec_id AS other, {COSINE} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 9) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 5
""")
def label_pair_similarity(spark, sf):
    """The five nearest of all other rows of its label for every fiftieth."""
    rows = table(spark, sf, "embeddings")
    got = V.knn(rows.filter("vec_id % 50 = 0"), rows.withColumnRenamed("vec_id", "other"), 5, "vec_id", "other", others=True, within="label")
    return got.select("vec_id", "other", F.round("similarity", 6).alias("similarity"), "rank")


@query("SELECT label, count(*) AS n, round(avg(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS mean_square FROM embeddings GROUP BY label")
def vector_norms(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(V.dot(F.col("embedding"), F.col("embedding"))), 5).alias("mean_square"))
