"""Embedding-space quality: neighbour purity, neighbour matrix, cluster metrics.

All metrics work from two reusable intermediate tables: the kNN edge table
(one block similarity join, shared by purity / matrix / worst points) and
per-label centroids (a vector mean aggregate).  The metrics are single plans;
only the nearest-centroid assignment collects, one bounded block of centroids
at a time.
"""
from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.similarity import distance_sums_by_label, knn_edges

# Centroids that are broadcast at once (bytes of their values).
CENTROID_BYTES = 64 * 1024 * 1024
# Distances (items x centroids) that a task computes at once.
SCORE_CELLS = 4_000_000
# Vectors in one part of the input of k-means (bytes).
KMEANS_PART_BYTES = 32 * 1024 * 1024
# Hash blocks that pairs of labels or centroids are dealt to.
PAIR_BLOCKS = 16


def labelled_edges(items: DataFrame, *, k: int, id_col="item_id", vec_col="vec", label_col="label") -> DataFrame:
    """K nearest neighbours (Euclidean, self excluded) with both labels attached."""
    e = knn_edges(items, k=k, id_col=id_col, vec_col=vec_col, metric="euclidean")
    lab = items.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__l"))
    return (e.join(lab.withColumnRenamed("__id", "src").withColumnRenamed("__l", "src_label"), "src")
             .join(lab.withColumnRenamed("__id", "dst").withColumnRenamed("__l", "dst_label"), "dst"))


def point_purity(edges: DataFrame, k: int) -> DataFrame:
    """Per point: share of its k neighbours with its own label (denominator k)."""
    same = (F.col("src_label") == F.col("dst_label")).cast("int")
    return edges.groupBy("src", "src_label").agg((F.sum(same) / F.lit(float(k))).alias("purity"))


def mean_purity(items: DataFrame, edges: DataFrame, k: int, id_col="item_id") -> DataFrame:
    """Q1: mean purity over all points (a point without neighbours counts 0)."""
    pp = point_purity(edges, k)
    return (items.select(F.col(id_col).alias("src")).join(pp.select("src", "purity"), "src", "left")
                 .agg(F.avg(F.coalesce("purity", F.lit(0.0))).alias("purity")))


def neighbor_matrix(edges: DataFrame, labels: DataFrame, label_col="label") -> DataFrame:
    """Q2: directed neighbour-edge counts for every (anchor label, neighbour label), zeros included."""
    counts = edges.groupBy(F.col("src_label").alias("anchor_label"),
                           F.col("dst_label").alias("neighbor_label")).agg(F.count(F.lit(1)).alias("n"))
    la = labels.select(F.col(label_col).alias("anchor_label")).distinct()
    # the result has a row for each pair of labels: every anchor meets every block of neighbours
    blocks = F.sequence(F.lit(0).cast("long"), F.lit(PAIR_BLOCKS - 1).cast("long"))
    lb = la.select(F.col("anchor_label").alias("neighbor_label"), F.pmod(F.xxhash64("anchor_label"), F.lit(PAIR_BLOCKS)).alias("block"))
    grid = la.withColumn("block", F.explode(blocks)).join(lb, "block").drop("block")
    return (grid.join(counts, ["anchor_label", "neighbor_label"], "left")
                .select("anchor_label", "neighbor_label", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def centroids(items: DataFrame, vec_col="vec", label_col="label") -> DataFrame:
    """Per-label mean vector and size: (label, centroid array<double>, n)."""
    v = items.select(F.col(label_col).alias("label"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("__v"))
    s = v.groupBy("label").agg(Summarizer.mean(F.col("__v")).alias("__m"), F.count(F.lit(1)).alias("n"))
    return s.select("label", vector_to_array("__m").alias("centroid"), "n")


def sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _with_centroid(items, cents, vec_col, label_col):
    return items.select(F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("__x")) \
                .join(cents, "label")


def calinski_harabasz(items: DataFrame, vec_col="vec", label_col="label") -> DataFrame:
    """Q4: (B / (k - 1)) / (W / (n - k)); 1.0 when W is 0 (library rule), up to rounding."""
    x = F.col(vec_col).cast("array<double>")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)
    # one scan: the within and between sums follow from counts, means and sums of squares per label
    per = (items.select(F.col(label_col).alias("label"), array_to_vector(x).alias("v"), square(x).alias("q"))
                .groupBy("label").agg(Summarizer.mean(F.col("v")).alias("m"), F.count(F.lit(1)).alias("n"), F.sum("q").alias("q")))
    t = per.agg(Summarizer.mean(F.col("m"), F.col("n").cast("double")).alias("g"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
                F.sum("q").alias("q"), F.sum(F.col("n") * square(vector_to_array("m"))).alias("c"))
    within, between = F.col("q") - F.col("c"), F.col("c") - F.col("n") * square(vector_to_array("g"))
    value = F.when(within <= F.lit(1e-12) * F.col("q"), F.lit(1.0)).otherwise((between / (F.col("k") - 1)) / (within / (F.col("n") - F.col("k"))))
    return t.select(value.alias("calinski_harabasz"))


def davies_bouldin(items: DataFrame, vec_col="vec", label_col="label") -> DataFrame:
    """Q5: mean over clusters of max_j (s_i + s_j) / d(c_i, c_j)."""
    cents = centroids(items, vec_col, label_col)
    s = (_with_centroid(items, cents, vec_col, label_col)
         .groupBy("label").agg(F.avg(F.sqrt(sqdist(F.col("__x"), F.col("centroid")))).alias("s")))
    stats = cents.join(s, "label").select("label", "centroid", "s", F.pmod(F.xxhash64("label"), F.lit(PAIR_BLOCKS)).alias("block"))
    left = stats.select(F.col("label").alias("li"), F.col("centroid").alias("ci"), F.col("s").alias("si"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_BLOCKS - 1).cast("long"))).alias("block"))
    right = stats.select("block", F.struct(F.col("label").alias("lj"), F.col("centroid").alias("cj"), F.col("s").alias("sj")).alias("o"))
    a = left.join(right, "block").where(F.col("li") != F.col("o.lj"))
    d = F.sqrt(sqdist(F.col("ci"), F.col("o.cj")))
    ratio = F.when(d == 0, F.lit(0.0)).otherwise((F.col("si") + F.col("o.sj")) / d)
    per = a.groupBy("li").agg(F.max(ratio).alias("r"))
    return per.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("davies_bouldin"))


def silhouette(items: DataFrame, id_col="item_id", vec_col="vec", label_col="label") -> DataFrame:
    """Q3: mean silhouette (Euclidean); points of singleton clusters score 0."""
    sums = distance_sums_by_label(items, id_col=id_col, vec_col=vec_col, label_col=label_col)
    own = items.select(F.col(id_col).alias("item_id"), F.col(label_col).cast("string").alias("own"))
    sizes = items.groupBy(F.col(label_col).cast("string").alias("own")).agg(F.count(F.lit(1)).alias("own_n"))
    j = sums.join(own, "item_id")
    per = j.groupBy("item_id", "own").agg(
        F.max(F.when(F.col("label") == F.col("own"), F.try_divide(F.col("dsum"), F.col("cnt")))).alias("a"),
        F.min(F.when(F.col("label") != F.col("own"), F.try_divide(F.col("dsum"), F.col("cnt")))).alias("b"))
    per = own.join(per.drop("own"), "item_id", "left").join(sizes, "own")
    a = F.coalesce(F.col("a"), F.lit(0.0))
    sil = F.when((F.col("own_n") <= 1) | F.col("b").isNull(), F.lit(0.0)) \
           .otherwise(F.coalesce((F.col("b") - a) / F.greatest(a, F.col("b")), F.lit(0.0)))
    return per.agg(F.avg(sil).alias("silhouette"))


def assign_nearest(items: DataFrame, cents: DataFrame, id_col="item_id", vec_col="vec") -> DataFrame:
    """M8: nearest centroid by squared distance (rounded to 9 places, ties -> smallest label).

    Centroids are broadcast in blocks of at most ``CENTROID_BYTES``, in label
    order, and each Arrow batch of items is compared with a block by one
    matrix product; with several blocks the best so far travels along.  The
    items are never shuffled.
    """
    import numpy as np
    import pandas as pd

    label_type = dict(cents.dtypes)["label"]
    out = items.select(F.col(id_col).alias("item_id"), F.col(vec_col).cast("array<double>").alias("__v"),
                       F.lit(None).cast(label_type).alias("cluster"), F.lit(math.inf).alias("__d"))
    schema = out.schema

    def nearer(bc):
        def fn(it):
            labs, C = bc.value
            cn = (C * C).sum(axis=1)
            step = max(1, SCORE_CELLS // len(labs))
            for pdf in it:
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at:at + step]
                    X = np.stack([np.asarray(v, dtype=np.float64) for v in part["__v"].values])
                    d2 = np.round(np.maximum((X * X).sum(axis=1)[:, None] + cn[None, :] - 2.0 * X @ C.T, 0.0), 9)
                    best = np.argmin(d2, axis=1)
                    d = d2[np.arange(len(best)), best]
                    better = d < part["__d"].to_numpy()  # an earlier block has the smaller labels
                    cluster = [labs[b] if new else old for b, new, old in zip(best, better, part["cluster"])]
                    yield pd.DataFrame({"item_id": part["item_id"].to_numpy(), "__v": part["__v"].to_numpy(),
                                        "cluster": cluster, "__d": np.where(better, d, part["__d"].to_numpy())})
        return fn

    for block in _centroid_blocks(cents):
        out = out.mapInPandas(nearer(items.sparkSession.sparkContext.broadcast(block)), schema)
    return out.select("item_id", "cluster")


def _centroid_blocks(cents: DataFrame):
    """(labels, matrix) of centroids in label order, at most ``CENTROID_BYTES`` of values at a time."""
    import numpy as np

    labels, rows, size = [], [], 0
    for r in cents.orderBy("label").select("label", "centroid").toLocalIterator():
        if rows and size + 8 * len(r["centroid"]) > CENTROID_BYTES:
            yield labels, np.stack(rows)
            labels, rows, size = [], [], 0
        labels.append(r["label"])
        rows.append(np.asarray(r["centroid"], dtype=np.float64))
        size += 8 * len(r["centroid"])
    if rows:
        yield labels, np.stack(rows)


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Q6: adjusted Rand index between two labelings of the same rows."""
    comb2 = lambda c: c * (c - 1) / 2.0
    cont = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("nij"))
    # row sums, column sums and the total of the contingency table in one pass
    sums = cont.groupingSets([["a"], ["b"], []], "a", "b").agg(
        F.grouping_id().alias("g"), F.sum("nij").alias("s"), F.sum(comb2(F.col("nij"))).alias("pairs"))
    t = sums.agg(F.sum(F.when(F.col("g") == 1, comb2(F.col("s")))).alias("sa"), F.sum(F.when(F.col("g") == 2, comb2(F.col("s")))).alias("sb"),
                 F.max(F.when(F.col("g") == 3, F.col("s"))).alias("n"), F.max(F.when(F.col("g") == 3, F.col("pairs"))).alias("sij"))
    exp = F.col("sa") * F.col("sb") / comb2(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2.0
    value = F.when(F.coalesce("n", F.lit(0)) < 2, F.lit(1.0)).when(top == exp, F.lit(1.0)).otherwise((F.col("sij") - exp) / (top - exp))
    return t.select(value.alias("ari"))


def has_nan_inf(items: DataFrame, vec_col="vec") -> DataFrame:
    """Any NaN / any infinite value in the embedding."""
    v = F.col(vec_col).cast("array<double>")
    return items.agg(F.coalesce(F.bool_or(F.exists(v, lambda x: F.isnan(x))), F.lit(False)).alias("any_nan"),
                     F.coalesce(F.bool_or(F.exists(v, lambda x: F.abs(x) == F.lit(math.inf))), F.lit(False)).alias("any_inf"))


def kmeans_labels(items: DataFrame, k: int, vec_col: str = "vec", seed: int = 42, id_col: str = "item_id",
                  max_iter: int = 300) -> DataFrame:
    """M7 / Q7: k-means (k-means|| init, fixed seed) cluster of every item."""
    from pyspark.ml.clustering import KMeans
    v = items.select(F.col(id_col).alias("item_id"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    # the rows are kept in memory and read whole in every round: parts of bounded size
    n = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    parts = math.ceil(n["n"] * (n["d"] or 1) * 8 / KMEANS_PART_BYTES)
    if parts > 1 and v.rdd.getNumPartitions() < parts:
        v = v.repartition(max(parts, items.sparkSession.sparkContext.defaultParallelism))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(v)
    return model.transform(v).select("item_id", F.col("prediction").cast("int").alias("cluster"))


def settled(items: DataFrame, k: int, vec_col: str = "vec", id_col: str = "item_id", slack: float = 1e-3) -> DataFrame:
    """Items of a k-means clustering, and those no nearer (by ``slack``) to another cluster's mean than to their own's."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    own = rows.join(kmeans_labels(rows, k), "item_id")
    means = centroids(own, "vec", "cluster").select("label", "centroid")
    near = assign_nearest(rows, means).select("item_id", F.col("cluster").alias("near"))
    away = lambda c: F.sqrt(sqdist(F.col("vec"), F.col(c)))
    both = own.join(near, "item_id").join(means.select(F.col("label").alias("cluster"), F.col("centroid").alias("c_own")), "cluster") \
              .join(means.select(F.col("label").alias("near"), F.col("centroid").alias("c_near")), "near")
    return both.agg(F.count(F.lit(1)).alias("n_items"), F.count_if(away("c_own") <= away("c_near") + slack).alias("n_settled"))


def standardise_vectors(items: DataFrame, vec_col: str = "vec", out: str = "z") -> DataFrame:
    """A4 + V2 on vectors: per-position mean and population std (zero std -> 0)."""
    v = items.where(F.col(vec_col).isNotNull()).select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    st = v.agg(Summarizer.metrics("mean", "std", "count").summary(F.col("v")).alias("st")).select("st.*").first()  # one row
    if not st["count"]:
        return items.withColumn(out, F.col(vec_col).cast("array<double>"))
    pop = math.sqrt((st["count"] - 1) / st["count"])  # the summary has the sample deviation
    mean = F.array(*[F.lit(float(m)) for m in st["mean"]])
    std = F.array(*[F.lit(float(x) * pop or 1.0) for x in st["std"]])
    z = F.transform(F.col(vec_col).cast("array<double>"),
                    lambda x, i: (x - F.element_at(mean, i + 1)) / F.element_at(std, i + 1))
    return items.withColumn(out, z)


def reduce_dims(items: DataFrame, k: int, vec_col: str = "vec", out: str = "coords") -> DataFrame:
    """Q8: standardised features projected on the top-k principal components (PCA)."""
    from pyspark.ml.feature import PCA
    z = standardise_vectors(items, vec_col, "__z").withColumn("__f", array_to_vector("__z"))
    model = PCA(k=k, inputCol="__f", outputCol="__p").fit(z)
    return model.transform(z).withColumn(out, vector_to_array("__p")).drop("__z", "__f", "__p")


def sweep(items: DataFrame, dims_list, k_list, *, id_col="item_id", vec_col="vec", label_col="label") -> DataFrame:
    """Q9: one row of quality metrics per (dims, k).

    Per dims: one reduction and one kNN at max(k); every smaller k reuses the
    same edge table (rank <= k) instead of a new neighbour search.
    """
    spark = items.sparkSession
    rows = []
    kmax = max(k_list)
    n_labels = items.select(label_col).distinct().count()
    n = items.count()
    for d in dims_list:
        red = reduce_dims(items, d, vec_col, "coords").select(id_col, label_col, "coords").cache()
        edges = labelled_edges(red.withColumnRenamed(id_col, "item_id"), k=kmax, id_col="item_id",
                               vec_col="coords", label_col=label_col).cache()
        ren = red.withColumnRenamed(id_col, "item_id")
        sil = silhouette(ren, "item_id", "coords", label_col).first()[0]
        ch = calinski_harabasz(ren, "coords", label_col).first()[0]
        db = davies_bouldin(ren, "coords", label_col).first()[0]
        cl = kmeans_labels(ren, n_labels, "coords").join(ren.select("item_id", label_col), "item_id")
        ari = adjusted_rand(cl, label_col, "cluster").first()[0]
        # mean purity for every k in one pass over the edges: same-label edges up to rank k, over k and all points
        same = F.col("src_label") == F.col("dst_label")
        pur = edges.agg(*[F.count_if(same & (F.col("rank") <= k)).alias(f"k{k}") for k in k_list]).first()
        for k in k_list:
            rows.append((int(d), int(k), float(sil), float(ch), float(db), pur[f"k{k}"] / (k * n), float(ari)))
        edges.unpersist()
        red.unpersist()
    return spark.createDataFrame(rows, "dims int, k int, silhouette double, calinski_harabasz double, "
                                       "davies_bouldin double, purity double, kmeans_ari double")
