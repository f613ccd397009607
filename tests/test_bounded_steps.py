"""Steps whose share of one task or of the driver must not grow with the table."""
from pyspark.sql import functions as F

from cadenza.operators import manifold as M
from cadenza.operators import neighbour_graph as G
from cadenza.plans import ideation as I


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kmeans_reads_parts_of_bounded_size(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    df = spark.range(400).select(F.col("id").alias("item_id"), F.array(F.col("id") % 7, F.col("id") % 3).cast("array<double>").alias("vec")).coalesce(1)
    assert M.kmeans_labels(df, 3).count() == 400
    monkeypatch.setattr(M, "KMEANS_PART_BYTES", 400)
    assert M.kmeans_labels(df, 3).count() == 400
    assert seen[0] == 1 and seen[1] >= 16  # 400 x 2 x 8 bytes


def test_multiplication_does_not_broadcast_its_state(spark, monkeypatch):
    monkeypatch.setattr(G, "_written", lambda df, name: df)
    state = spark.createDataFrame([(i, bytearray(8)) for i in range(5)], "item long, v binary")
    edges = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, w double")
    assert "BroadcastHashJoin" not in _plan(G.multiply(state, edges, "x"))


def test_topk_per_genre_scores_the_library_once(spark, monkeypatch):
    searched, similar = [], I.similar
    monkeypatch.setattr(I, "similar", lambda s, *a: searched.append(s) or similar(s, *a))
    I.topk_per_genre(spark, "/root/testdata/sf0.001")
    assert "Join" not in _plan(searched[0]) and "MapInPandas" not in _plan(searched[0])
