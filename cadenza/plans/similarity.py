"""Similarity and recommendation queries over the vector table."""
from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators.similarity import block_pairs, knn_edges, similarity_topk
from cadenza.plans.registry import query
from cadenza.sources.tables import vectors

_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


@query("rec_raw_vector", sql=f"""
WITH {_E},
p AS (SELECT a.vec_id AS seed_id, b.vec_id AS rec_id, list_cosine_similarity(a.v, b.v) AS s
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY round(s, 9) DESC, rec_id) AS rank FROM p)
SELECT seed_id, rec_id, round(s, 6) AS score, rank FROM r WHERE rank <= 5
""")
def rec_raw_vector(spark, sf_dir, k=5):
    """Top-k cosine neighbours of every item, the seed excluded."""
    v = vectors(spark, sf_dir)
    r = similarity_topk(v, k=k, q_id="item_id", q_vec="vec", exclude_self=True)
    return r.select("seed_id", "rec_id", F.round("score", 6).alias("score"),
                    F.col("rank").cast("long").alias("rank"))


@query("join_all_pairs_similarity", sql=f"""
WITH {_E},
p AS (SELECT a.vec_id AS seed_id, b.vec_id AS rec_id, list_cosine_similarity(a.v, b.v) AS s
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY round(s, 9) DESC, rec_id) AS rank FROM p)
SELECT seed_id, rec_id, round(s, 6) AS score, rank FROM r WHERE rank <= 10
""")
def join_all_pairs_similarity(spark, sf, k=10):
    """A table of seeds (every vector) against every vector; the strategy follows the checked size of the seeds."""
    v = vectors(spark, sf)
    r = similarity_topk(v, v, k=k, q_id="item_id", q_vec="vec", c_id="item_id", c_vec="vec",
                        exclude_self=True, strategy="auto")
    return r.select("seed_id", "rec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("join_knn_indexed", sql=f"""
WITH {_E}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS rank FROM p)
SELECT src, dst, round(d, 6) AS dist, rank FROM r WHERE rank <= 10
""")
def join_knn_indexed(spark, sf, k=10, block_rows=1024):
    """J6 through the metric block index, as where neither side fits a broadcast."""
    e = knn_edges(vectors(spark, sf), k=k, id_col="item_id", vec_col="vec", strategy="block", block_rows=block_rows)
    return e.select("src", "dst", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query("idx_block_pairs")
def idx_block_pairs(spark, sf, k=10, block_rows=256):
    """How many pairs of blocks a k-nearest search could read, and how many the bounds leave to read."""
    return block_pairs(vectors(spark, sf), k=k, id_col="item_id", vec_col="vec", block_rows=block_rows)
