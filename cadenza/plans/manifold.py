"""Embedding-quality queries on the vector table (labels play the genres)."""
from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import manifold as M
from cadenza.operators.aggregates import vector_mean
from cadenza.plans.registry import REGISTRY, query
from cadenza.sources.tables import vectors

K = 10
_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_NB = (_E + ", p AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label AS sl, b.label AS dl, "
       "list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS rank FROM p), "
       f"nb AS (SELECT * FROM r WHERE rank <= {K})")
_PP = _NB + f", pp AS (SELECT src, sl, sum(CASE WHEN sl = dl THEN 1 ELSE 0 END) / {float(K)} AS purity FROM nb GROUP BY src, sl)"


#: The vectors of ``e``, standardised.
STANDARD_SQL = (
    _E.replace("e AS", "e0 AS") + ", x0 AS (SELECT vec_id, label, generate_subscripts(v, 1) AS pos, unnest(v) AS val FROM e0), "
    "s0 AS (SELECT pos, avg(val) AS m, stddev_pop(val) AS s FROM x0 GROUP BY pos), "
    "e AS (SELECT vec_id, list((val - m) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY x0.pos) AS v, label FROM x0 JOIN s0 ON x0.pos = s0.pos GROUP BY vec_id, label)"
)


def on_standardised(name: str) -> str:
    """The SQL of a query of this module over the standardised vectors."""
    return REGISTRY[name].sql.replace(_E, STANDARD_SQL)


def _edges(spark, sf):
    items = vectors(spark, sf)
    return items, M.labelled_edges(items, k=K)


@query("join_knn", sql=f"WITH {_NB} SELECT src, dst, round(d, 6) AS dist, rank FROM nb")
def join_knn(spark, sf):
    """K nearest neighbours (Euclidean) of every vector, itself excluded by id."""
    _, e = _edges(spark, sf)
    return e.select("src", "dst", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query("man_purity", sql=f"WITH {_PP} SELECT round(avg(purity), 6) AS purity FROM pp")
def man_purity(spark, sf):
    """Q1: mean share of the k neighbours carrying the point's own label."""
    items, e = _edges(spark, sf)
    return M.mean_purity(items, e, K).select(F.round("purity", 6).alias("purity"))


@query("man_neighbor_matrix", sql=f"""
WITH {_NB}, l AS (SELECT DISTINCT label FROM embeddings),
c AS (SELECT sl, dl, count(*) AS n FROM nb GROUP BY sl, dl)
SELECT a.label AS anchor_label, b.label AS neighbor_label, coalesce(c.n, 0) AS n
FROM l a, l b LEFT JOIN c ON c.sl = a.label AND c.dl = b.label
""")
def man_neighbor_matrix(spark, sf):
    """Q2: label x label counts of directed neighbour edges, zeros included."""
    items, e = _edges(spark, sf)
    return M.neighbor_matrix(e, items)


@query("topk_worst_purity", sql=f"""
WITH {_PP} SELECT src AS vec_id, sl AS label, round(purity, 6) AS purity FROM pp ORDER BY purity, src LIMIT 10
""")
def topk_worst_purity(spark, sf, n=10):
    """The n points with the lowest neighbour purity (ties by id)."""
    _, e = _edges(spark, sf)
    pp = M.point_purity(e, K)
    return (pp.orderBy(F.round("purity", 9), "src").limit(n)
              .select(F.col("src").alias("vec_id"), F.col("src_label").alias("label"), F.round("purity", 6).alias("purity")))


@query("man_silhouette", sql=f"""
WITH {_E},
p AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT i, li, lj, avg(d) AS md FROM p GROUP BY i, li, lj),
sz AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
per AS (SELECT i, li, max(CASE WHEN li = lj THEN md END) AS a, min(CASE WHEN li <> lj THEN md END) AS b FROM m GROUP BY i, li)
SELECT round(avg(CASE WHEN sz.n <= 1 OR b IS NULL THEN 0.0
  ELSE (b - coalesce(a, 0.0)) / greatest(coalesce(a, 0.0), b) END), 6) AS silhouette
FROM per JOIN sz ON per.li = sz.label
""")
def man_silhouette(spark, sf):
    """Q3: mean silhouette coefficient (Euclidean), from per-label distance sums."""
    items = vectors(spark, sf)
    return M.silhouette(items).select(F.round("silhouette", 6).alias("silhouette"))


_X = (_E + ", x AS (SELECT vec_id, label, generate_subscripts(v, 1) AS pos, unnest(v) AS val FROM e), "
      "c AS (SELECT label, pos, avg(val) AS cm FROM x GROUP BY label, pos), "
      "n AS (SELECT label, count(*) AS n FROM e GROUP BY label)")


@query("man_calinski_harabasz", sql=f"""
WITH {_X}, g AS (SELECT pos, avg(val) AS gm FROM x GROUP BY pos),
bb AS (SELECT sum(n.n * (cm - gm) * (cm - gm)) AS b FROM c JOIN g ON c.pos = g.pos JOIN n ON c.label = n.label),
ww AS (SELECT sum((val - cm) * (val - cm)) AS w FROM x JOIN c ON x.label = c.label AND x.pos = c.pos),
kk AS (SELECT count(*) AS k, sum(n) AS nn FROM n)
SELECT round(CASE WHEN w = 0 THEN 1.0 ELSE (b / (k - 1)) / (w / (nn - k)) END, 6) AS calinski_harabasz FROM bb, ww, kk
""")
def man_calinski_harabasz(spark, sf):
    """Q4: Calinski-Harabasz ratio of between- to within-label dispersion."""
    return M.calinski_harabasz(vectors(spark, sf)).select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query("man_davies_bouldin", sql=f"""
WITH {_X},
pd AS (SELECT x.vec_id, x.label, sqrt(sum((val - cm) * (val - cm))) AS dist FROM x JOIN c ON x.label = c.label AND x.pos = c.pos GROUP BY x.vec_id, x.label),
s AS (SELECT label, avg(dist) AS s FROM pd GROUP BY label),
cd AS (SELECT a.label AS li, b.label AS lj, sqrt(sum((a.cm - b.cm) * (a.cm - b.cm))) AS d
       FROM c a JOIN c b ON a.pos = b.pos AND a.label <> b.label GROUP BY a.label, b.label),
r AS (SELECT li, max(CASE WHEN d = 0 THEN 0.0 ELSE (si.s + sj.s) / d END) AS r
      FROM cd JOIN s si ON si.label = cd.li JOIN s sj ON sj.label = cd.lj GROUP BY li)
SELECT round(coalesce(avg(r), 0.0), 6) AS davies_bouldin FROM r
""")
def man_davies_bouldin(spark, sf):
    """Q5: Davies-Bouldin index over the labels."""
    return M.davies_bouldin(vectors(spark, sf)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


_ASSIGN = (_X + ", cl AS (SELECT label, list(cm ORDER BY pos) AS cv FROM c GROUP BY label), "
           "dd AS (SELECT e.vec_id, e.label, cl.label AS cluster, "
           "list_sum(list_transform(list_zip(e.v, cl.cv), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM e, cl), "
           "asg AS (SELECT vec_id, label, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id "
           "ORDER BY round(d, 9), cluster) AS rn FROM dd) WHERE rn = 1)")


@query("mod_assign_centroid", sql=f"WITH {_ASSIGN} SELECT vec_id, cluster FROM asg")
def mod_assign_centroid(spark, sf):
    """M8: nearest centroid (label means as centroids), ties to the smallest label."""
    items = vectors(spark, sf)
    cents = M.centroids(items)
    return M.assign_nearest(items, cents).select(F.col("item_id").alias("vec_id"), "cluster")


@query("man_ari", sql=f"""
WITH {_ASSIGN},
ct AS (SELECT label, cluster, count(*) AS nij FROM asg GROUP BY label, cluster),
sa AS (SELECT sum(ai * (ai - 1) / 2.0) AS sa FROM (SELECT sum(nij) AS ai FROM ct GROUP BY label)),
sb AS (SELECT sum(bj * (bj - 1) / 2.0) AS sb FROM (SELECT sum(nij) AS bj FROM ct GROUP BY cluster)),
s AS (SELECT sum(nij * (nij - 1) / 2.0) AS sij, sum(nij) AS n FROM ct),
q AS (SELECT sij, sa * sb / (n * (n - 1) / 2.0) AS ex, (sa + sb) / 2.0 AS mx FROM s, sa, sb)
SELECT round(CASE WHEN mx = ex THEN 1.0 ELSE (sij - ex) / (mx - ex) END, 6) AS ari FROM q
""")
def man_ari(spark, sf):
    """Q6: adjusted Rand index of nearest-centroid clusters against the labels."""
    items = vectors(spark, sf)
    asg = M.assign_nearest(items, M.centroids(items)).join(items.select("item_id", "label"), "item_id")
    return M.adjusted_rand(asg, "label", "cluster").select(F.round("ari", 6).alias("ari"))


@query("agg_vector_mean", sql=f"""
WITH {_X} SELECT label, pos - 1 AS pos, round(cm, 6) AS mean FROM c
""")
def agg_vector_mean(spark, sf):
    """Element-wise mean vector per label."""
    m = vector_mean(vectors(spark, sf), "vec", ["label"])
    return m.select("label", F.posexplode("vec_mean").alias("pos", "mean")).select(
        "label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query("aud_nan_inf", sql="""
SELECT coalesce(bool_or(list_bool_or(list_transform(CAST(embedding AS DOUBLE[]), lambda x: isnan(x)))), false) AS any_nan,
       coalesce(bool_or(list_bool_or(list_transform(CAST(embedding AS DOUBLE[]), lambda x: isinf(x)))), false) AS any_inf
FROM embeddings
""")
def aud_nan_inf(spark, sf):
    """Does any embedding hold a NaN or an infinite value."""
    return M.has_nan_inf(vectors(spark, sf))
