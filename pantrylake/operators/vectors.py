"""Cosine similarity and nearest neighbours over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def top_k(rows: DataFrame, query: list[float], k: int, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows nearest to one query; the query is a literal and each task keeps only its own k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("similarity", cosine(F.col(embedding), q)).orderBy(F.desc("similarity"), key).limit(k)


def knn(queries: DataFrame, rows: DataFrame, k: int, query_key: str, row_key: str, threshold: float | None = None, others: bool = False, within: str | None = None) -> DataFrame:
    """query_key, row_key, similarity of the k best rows for each query, by blocks of queries.

    With `others` a query isn't its own neighbour; with `within` only rows that share that column's value are.

    A block is collected (at most QUERY_BLOCK vectors) and broadcast; every task multiplies its rows with the block and
    gives its own k best, which one aggregate by query merges.  Work is queries times rows, memory is a block.
    """
    import numpy as np
    import pandas as pd

    spark = rows.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    qt, rt = dict(queries.dtypes)[query_key], dict(rows.dtypes)[row_key]
    out = None
    group = [within] if within else []
    if within:
        queries, rows = queries.filter(F.col(within).isNotNull()), rows.filter(F.col(within).isNotNull())
    for b in range(blocks):
        part = queries.select(query_key, "embedding", *group).filter(F.col("embedding").isNotNull())
        if blocks > 1:
            part = part.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)
        got = part.collect()
        if not got:
            continue
        m = np.array([r["embedding"] for r in got], float)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        groups = np.array([r[within] for r in got]) if within else None
        shared = spark.sparkContext.broadcast(([r[query_key] for r in got], np.divide(m, norm, out=np.zeros_like(m), where=norm > 0), groups))

        def best(it, shared=shared):
            keys, q, of = shared.value
            for pdf in it:
                pdf = pdf[pdf["embedding"].notna()]
                if not len(pdf):
                    continue
                x = np.stack(pdf["embedding"].to_numpy()).astype(float)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                sim = q @ np.divide(x, size, out=np.zeros_like(x), where=size > 0).T
                ids = pdf[row_key].to_numpy()
                if others:
                    sim[np.array(keys)[:, None] == ids] = -np.inf
                if within:
                    sim[of[:, None] != pdf[within].to_numpy()] = -np.inf
                by_id = np.argsort(ids, kind="stable")
                order = by_id[np.argsort(-np.round(sim[:, by_id], 9), axis=1, kind="stable")[:, :k]]
                rows_ = np.repeat(np.arange(len(keys)), order.shape[1])
                s = sim[rows_, order.reshape(-1)]
                keep = s > -np.inf if threshold is None else s >= threshold
                yield pd.DataFrame({query_key: [keys[i] for i in rows_[keep]], "_r": ids[order.reshape(-1)][keep], "similarity": s[keep]})

        near = rows.select(row_key, "embedding", *group).mapInPandas(best, f"`{query_key}` {qt}, _r {rt}, similarity double")
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], f"`{query_key}` {qt}, `{row_key}` {rt}, similarity double")
    from pantrylake.operators.joins import top_per_key

    ranked = top_per_key(out.withColumn("_s", F.round("similarity", 9)), [query_key], [F.desc("_s"), "_r"], k, "rank")
    return ranked.select(query_key, F.col("_r").alias(row_key), "similarity", "rank")


def nearest_above(queries: DataFrame, rows: DataFrame, query_key: str, row_key: str, threshold: float, others: bool = False) -> DataFrame:
    """The single best row of each query, if it reaches the threshold."""
    return knn(queries, rows, 1, query_key, row_key, threshold, others).drop("rank")


def lsh_neighbours(df: DataFrame, key: str, k: int, planes: int = 8, tables: int = 12, dim: int = 64, seed: int = 5) -> DataFrame:
    """Approximate neighbours by signs of random projections: candidates share all signs of some table; scores are exact."""
    import random

    rng = random.Random(seed)
    hashes = []
    for t in range(tables):
        signs = [
            F.when(dot(F.col("embedding"), F.array(*[F.lit(rng.gauss(0, 1)) for _ in range(dim)])) >= 0, "1").otherwise("0") for _ in range(planes)
        ]
        hashes.append(F.concat(F.lit(f"{t}:"), *signs))
    hashed = df.select(key, "embedding", F.explode(F.array(*hashes)).alias("_h"))
    other = hashed.select(F.col(key).alias("other"), F.col("embedding").alias("_e"), "_h")
    pairs = hashed.join(other, "_h").filter(F.col(key) != F.col("other")).dropDuplicates([key, "other"])
    from pantrylake.operators.joins import top_per_key

    scored = pairs.select(key, "other", cosine(F.col("embedding"), F.col("_e")).alias("similarity"))
    return top_per_key(scored, [key], [F.desc("similarity"), "other"], k, "rank")
