"""Training-data, training, clustering and reduction queries on the scored library."""
from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import manifold as M
from cadenza.operators import minibatch as MB
from cadenza.operators import neighbour_graph as G
from cadenza.operators import training as TR
from cadenza.operators.model import GatedModel, score
from cadenza.operators.similarity import knn_edges
from cadenza.plans.common import h_sql, song_items
from cadenza.plans.ideation import EMB, HID, IN, LIB_SQL, cos_sql
from cadenza.plans.manifold import K, STANDARD_SQL, on_standardised
from cadenza.plans.registry import query
from cadenza.session import cut_lineage, shared_path
from cadenza.sources import files as S
from cadenza.sources.tables import library, vectors

EPOCHS = [0, 1, 2]


def _pos_sql(base):
    return (
        f"tsb AS (SELECT song_id, genre, {h_sql(chr(39) + 'pos:' + chr(39) + ' || song_id')} % {TR.SALT_BUCKETS} AS sb FROM {base}), "
        "tr AS (SELECT *, row_number() OVER (PARTITION BY genre, sb ORDER BY song_id) - 1 AS r FROM tsb), "
        "tc AS (SELECT genre, sb, count(*) AS c FROM tsb GROUP BY genre, sb), "
        "tof AS (SELECT genre, sb, coalesce(sum(c) OVER (PARTITION BY genre ORDER BY sb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM tc), "
        "tpos AS (SELECT tr.song_id, tr.genre, CAST(tof.o + tr.r AS BIGINT) AS pos FROM tr JOIN tof ON tof.genre = tr.genre AND tof.sb = tr.sb)"
    )


def _triplet_sql(base):
    ep = ", ".join(map(str, EPOCHS))
    hp = h_sql("'p:42:' || epoch || ':' || song_id")
    hg = h_sql("'g:42:' || epoch || ':' || song_id")
    hn = h_sql("'n:42:' || epoch || ':' || song_id")
    return (
        _pos_sql(base) + ", "
        "tsz AS (SELECT genre, count(*) AS n_g FROM tpos GROUP BY genre), "
        "tgi AS (SELECT genre, n_g, row_number() OVER (ORDER BY genre) - 1 AS gi FROM tsz), "
        "tng AS (SELECT count(*) AS gg FROM tgi), "
        f"ta0 AS (SELECT tpos.*, tgi.n_g, tgi.gi, e.epoch FROM tpos JOIN tgi ON tgi.genre = tpos.genre, (SELECT unnest([{ep}]) AS epoch) e), "
        f"ta1 AS (SELECT epoch, song_id AS anchor, genre, pos, n_g, gi, {hp} % greatest(n_g - 1, 1) AS r1, "
        f"{hg} % (gg - 1) AS r2, {hn} AS hn FROM ta0, tng), "
        "ta2 AS (SELECT epoch, anchor, genre, CASE WHEN n_g = 1 THEN pos WHEN r1 >= pos THEN r1 + 1 ELSE r1 END AS ppos, "
        "CASE WHEN r2 >= gi THEN r2 + 1 ELSE r2 END AS ngi, hn FROM ta1), "
        "ta3 AS (SELECT ta2.*, hn % g2.n_g AS npos FROM ta2 JOIN tgi g2 ON g2.gi = ta2.ngi), "
        "tpg AS (SELECT tpos.*, tgi.gi FROM tpos JOIN tgi ON tgi.genre = tpos.genre), "
        "trip AS (SELECT CAST(ta3.epoch AS BIGINT) AS epoch, ta3.anchor, p1.song_id AS positive, p2.song_id AS negative "
        "FROM ta3 JOIN tpos p1 ON p1.genre = ta3.genre AND p1.pos = ta3.ppos JOIN tpg p2 ON p2.gi = ta3.ngi AND p2.pos = ta3.npos)"
    )


_BASE = "tl AS (SELECT e.vec_id AS song_id, p.p_type AS genre FROM embeddings e JOIN part p ON e.vec_id = p.p_partkey)"


@query("agg_ids_by_genre", sql=f"WITH {_BASE}, {_pos_sql('tl')} SELECT song_id, genre, pos FROM tpos")
def agg_ids_by_genre(spark, sf):
    """Every song numbered densely inside its genre (no per-genre list is collected)."""
    lib = library(spark, sf).select("song_id", "genre")
    return TR.dense_positions(lib, "genre", "song_id").select("song_id", "genre", "pos")


@query("mod_triplets", sql=f"WITH {_BASE}, {_triplet_sql('tl')} SELECT epoch, anchor, positive, negative FROM trip")
def mod_triplets(spark, sf):
    """M5: (anchor, positive, negative) per song and epoch drawn by hash."""
    lib = library(spark, sf).select("song_id", "genre")
    t = TR.triplets(lib, EPOCHS)
    return t.select(F.col("epoch").cast("long").alias("epoch"), "anchor", "positive", "negative")


def _dist_sql(a, b):
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2] + 1e-6) * (t[1] - t[2] + 1e-6))))"


_MONITOR_SQL = f"""
WITH {LIB_SQL}, tl AS (SELECT song_id, genre FROM lib), {_triplet_sql('tl')},
j AS (SELECT trip.epoch, a.fe AS ae, p.fe AS pe, n.fe AS ne FROM trip JOIN lib a ON a.song_id = trip.anchor
      JOIN lib p ON p.song_id = trip.positive JOIN lib n ON n.song_id = trip.negative)
SELECT epoch, round(avg({cos_sql('ae', 'pe')}), 6) AS pos_sim, round(avg({cos_sql('ae', 'ne')}), 6) AS neg_sim,
       round(avg(greatest({_dist_sql('ae', 'pe')} - {_dist_sql('ae', 'ne')} + 0.2, 0.0)), 6) AS loss FROM j GROUP BY epoch
"""


@query("mod_monitors", sql=_MONITOR_SQL)
def mod_monitors(spark, sf):
    """M4: per epoch mean positive / negative cosine and mean triplet loss of the scored library."""
    s = score(library(spark, sf), GatedModel.from_formula(IN, IN, EMB, HID)).select("song_id", "genre", "final_embedding").cache()
    t = TR.triplets(s.select("song_id", "genre"), EPOCHS)
    emb = s.select("song_id", "final_embedding")
    j = (t.join(emb.withColumnRenamed("song_id", "anchor").withColumnRenamed("final_embedding", "a_emb"), "anchor")
          .join(emb.withColumnRenamed("song_id", "positive").withColumnRenamed("final_embedding", "p_emb"), "positive")
          .join(emb.withColumnRenamed("song_id", "negative").withColumnRenamed("final_embedding", "n_emb"), "negative"))
    m = TR.monitors(j)
    return m.select(F.col("epoch").cast("long").alias("epoch"), *[F.round(c, 6).alias(c) for c in ("pos_sim", "neg_sim", "loss")])


def trip_vectors(spark, sf, epochs):
    lib = library(spark, sf)
    t = TR.triplets(lib.select("song_id", "genre"), epochs)
    v = lib.select("song_id", "audio", "text")
    for role, tag in (("anchor", "a"), ("positive", "p"), ("negative", "n")):
        t = t.join(v.select(F.col("song_id").alias(role), F.col("audio").alias(f"{tag}_audio"),
                            F.col("text").alias(f"{tag}_text")), role)
    return t


@query("mod_train")
def mod_train(spark, sf, epochs=500, dim=256, hidden=64, batch=32, lr=7e-4, ahead=5):
    """M6: mini-batch triplet training until the loss has settled; one row of monitors per epoch.

    The triplets and vectors of ``ahead`` epochs are drawn and written at a time.
    """
    drawn = {}

    def rows(e):
        if e not in drawn:
            drawn.clear()
            tv = cut_lineage(trip_vectors(spark, sf, list(range(e, e + ahead))))
            drawn.update({i: tv.where(F.col("epoch") == i) for i in range(e, e + ahead)})
        return drawn[e]

    _, hist = MB.train_minibatch(rows, GatedModel.from_formula(IN, IN, dim, hidden), epochs=epochs, batch=batch, lr=lr)
    return spark.createDataFrame([(int(h["epoch"]), int(h["steps"]), float(h["loss"]), float(h["pos_sim"]), float(h["neg_sim"]), float(h["lr"])) for h in hist],
                                 "epoch int, steps int, loss double, pos_sim double, neg_sim double, lr double")


@query("mod_train_epochs")
def mod_train_epochs(spark, sf, epochs=3, lr=0.01):
    """M6: data-parallel training by whole-epoch gradients; one row of monitors per epoch (loss should fall)."""
    # iterative: every epoch re-reads the triplet vectors, so they are written once to the
    # shared checkpoint folder (reliable checkpoint; survives executor loss without recompute)
    tv = cut_lineage(trip_vectors(spark, sf, list(range(epochs))))
    _, hist = TR.train(tv, GatedModel.from_formula(IN, IN, EMB, HID), epochs=epochs, lr=lr)
    return spark.createDataFrame([(int(h["epoch"]), float(h["loss"]), float(h["pos_sim"]), float(h["neg_sim"]),
                                   float(h["lr"])) for h in hist],
                                 "epoch int, loss double, pos_sim double, neg_sim double, lr double")


@query("mod_train_first_epoch", sql=f"SELECT * FROM ({_MONITOR_SQL}) WHERE epoch = 0")
def mod_train_first_epoch(spark, sf):
    """M6: monitors of the first epoch, before any step: those of the untrained model."""
    _, hist = TR.train(cut_lineage(trip_vectors(spark, sf, [0])), GatedModel.from_formula(IN, IN, EMB, HID), epochs=1)
    first = spark.createDataFrame([(int(h["epoch"]), float(h["pos_sim"]), float(h["neg_sim"]), float(h["loss"])) for h in hist],
                                  "epoch long, pos_sim double, neg_sim double, loss double")
    return first.select("epoch", *[F.round(c, 6).alias(c) for c in ("pos_sim", "neg_sim", "loss")])


@query("mod_kmeans")
def mod_kmeans(spark, sf, k=20):
    """M7: k-means (k = 20, seed 42) on the catalogue's audio vectors."""
    return M.kmeans_labels(song_items(spark, sf), k, "vec")


@query("mod_kmeans_settled", sql="SELECT count(*) AS n_items, count(*) AS n_settled FROM part")
def mod_kmeans_settled(spark, sf, k=20):
    """M7: items, and those as near to the mean of their own cluster as to any other's."""
    return M.settled(song_items(spark, sf), k)


@query("man_cluster_labels")
def man_cluster_labels(spark, sf):
    """Q7: k-means with as many clusters as labels on the embedding."""
    v = vectors(spark, sf)
    k = v.select("label").distinct().count()
    return M.kmeans_labels(v, k, "vec")


@query("man_cluster_settled", sql="SELECT count(*) AS n_items, count(*) AS n_settled FROM embeddings")
def man_cluster_settled(spark, sf):
    """Q7: the same of the clusters of the embedding."""
    v = vectors(spark, sf)
    return M.settled(v, v.select("label").distinct().count())


@query("man_reduce")
def man_reduce(spark, sf, k=2, n_neighbors=15, min_dist=0.1):
    """Q8: standardised embedding laid out by its neighbour graph in k dimensions."""
    v = vectors(spark, sf)
    z = M.standardise_vectors(v, "vec", "z").select("item_id", "label", "z")
    r = G.embed_graph(z, k, n_neighbors=n_neighbors, min_dist=min_dist, rounds=3, layout_rounds=3, vec_col="z")
    return r.join(v.select("item_id", "label"), "item_id").select("item_id", "label", *[F.col("coords")[i].alias(f"x{i + 1}") for i in range(k)])


_NEAR = 15


@query("man_graph_bandwidth", sql=f"""
WITH {STANDARD_SQL}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS rank FROM p) WHERE rank <= {_NEAR})
SELECT src AS item_id, round(min(d) FILTER (d > 0), 5) AS rho, count(*) AS neighbours, round(log2({_NEAR}), 4) AS total_weight FROM nb GROUP BY src
""")
def man_graph_bandwidth(spark, sf):
    """Q8's fuzzy graph: each item's nearest distance, and its weights, whose bandwidth makes them add up to log2(k)."""
    z = M.standardise_vectors(vectors(spark, sf), "vec", "z").select("item_id", "z")
    near = knn_edges(z, k=_NEAR, id_col="item_id", vec_col="z").select("src", "dst", "dist")
    w = G.neighbour_weights(near, _NEAR).groupBy(F.col("src").alias("item_id"))
    return w.agg(F.round(F.max("rho"), 5).alias("rho"), F.count(F.lit(1)).alias("neighbours"), F.round(F.sum("w"), 4).alias("total_weight"))


@query("man_layout_orthonormal", sql="""
SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS product FROM (SELECT unnest([1, 2, 3]) AS i) a, (SELECT unnest([1, 2, 3]) AS j) b
WHERE EXISTS (SELECT 1 FROM embeddings)
""")
def man_layout_orthonormal(spark, sf, k=3):
    """Q8's spectral layout: products of its vectors, which are orthonormal."""
    z = M.standardise_vectors(vectors(spark, sf), "vec", "z").select("item_id", "z")
    layout, _ = G.spectral_layout(G.fuzzy_graph(z, _NEAR, vec_col="z"), k, rounds=2)
    cells = [F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias("p")) for i in range(k) for j in range(k)]
    return layout.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.i", "c.j", F.abs(F.round("c.p", 6)).alias("product"))


@query("man_graph_sweep")
def man_graph_sweep(spark, sf):
    """Q9: quality metrics over n_neighbors x min_dist; one graph per n_neighbors."""
    z = M.standardise_vectors(vectors(spark, sf), "vec", "z").select("item_id", "label", "z")
    return G.sweep(z, [10, 30], [0.05, 0.5], dims=3, vec_col="z")


@query("man_reduce_pca")
def man_reduce_pca(spark, sf, k=2):
    """Q8, linear: standardised embedding reduced to k principal components."""
    r = M.reduce_dims(vectors(spark, sf), k, "vec", "coords")
    return r.select("item_id", "label", *[F.col("coords")[i].alias(f"pc{i + 1}") for i in range(k)])


@query("man_sweep")
def man_sweep(spark, sf):
    """Q9: quality metrics over 30 cells of (dimensions, k); one kNN per dimension setting."""
    return M.sweep(vectors(spark, sf), [2, 3, 5, 10, 20, 50], [5, 10, 15, 20, 30])


def _full_rank(spark, sf):
    v = vectors(spark, sf)
    return v, v.agg(F.max(F.size("vec"))).first()[0]


@query("man_reduce_full_rank", sql=f"""
WITH {STANDARD_SQL} SELECT vec_id AS item_id, label, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM e
""")
def man_reduce_full_rank(spark, sf):
    """Q8 with as many components as dimensions: lengths of the standardised vectors are kept."""
    v, dims = _full_rank(spark, sf)
    r = M.reduce_dims(v, dims, "vec", "coords")
    norm = F.sqrt(F.aggregate("coords", F.lit(0.0), lambda s, x: s + x * x))
    return r.select("item_id", "label", F.round(norm, 6).alias("norm"))


@query("man_sweep_full_rank", sql=f"""
SELECT (SELECT max(len(embedding)) FROM embeddings) AS dims, {K}::BIGINT AS k,
       ({on_standardised("man_silhouette")}) AS silhouette, ({on_standardised("man_calinski_harabasz")}) AS calinski_harabasz,
       ({on_standardised("man_davies_bouldin")}) AS davies_bouldin, ({on_standardised("man_purity")}) AS purity
""")
def man_sweep_full_rank(spark, sf):
    """Q9's cell with as many components as dimensions: a rotation, so the metrics are those of the standardised vectors."""
    v, dims = _full_rank(spark, sf)
    cell = M.sweep(v, [dims], [K])
    return cell.select(*[F.col(c).cast("long").alias(c) for c in ("dims", "k")], *[F.round(c, 6).alias(c) for c in ("silhouette", "calinski_harabasz", "davies_bouldin", "purity")])


@query("src_prepped", sql="""
WITH s AS (SELECT p_partkey AS song_id, p_type AS genre, list_concat(string_split(replace(p_name, ' ', ' - '), ' - '),
  string_split(lower(p_type) || ' - ' || p_brand, ' - ')) AS toks FROM part),
v AS (SELECT count(DISTINCT t) AS nv FROM (SELECT unnest(toks) AS t FROM s))
SELECT song_id AS item_id, genre, 2 + nv + 13 AS dim FROM s, v
""")
def src_prepped(spark, sf):
    """Prepared songs written as Parquet and read back."""
    path = shared_path(spark, "prepped-songs")
    song_items(spark, sf).write.parquet(path)
    r = S.read_prepped(spark, path)
    return r.select("item_id", "genre", F.size("vec").cast("long").alias("dim"))


@query("src_artifacts", sql=f"""
WITH s AS (SELECT list_concat(string_split(replace(p_name, ' ', ' - '), ' - '), string_split(lower(p_type) || ' - ' || p_brand, ' - ')) AS toks FROM part)
SELECT 'scaler_stats' AS artifact, 2::BIGINT AS n_rows UNION ALL
SELECT 'vocab', count(DISTINCT t) FROM (SELECT unnest(toks) AS t FROM s) UNION ALL
SELECT 'model_weights', {2 * len(GatedModel.from_formula(IN, IN, EMB, HID).params)}::BIGINT
""")
def src_artifacts(spark, sf):
    """Scaler stats, vocabulary and weights written, then loaded as artifacts (error if missing)."""
    from cadenza.operators import features as V
    from cadenza.sources import sinks as K
    from cadenza.sources.tables import catalogue
    songs = catalogue(spark, sf)
    vocab = V.fit_vocab(songs, "chord_progression")
    stats = V.fit_minmax(songs, ["size", "popularity"])
    st = spark.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in stats.items()], "col string, min double, max double")
    base = shared_path(spark, "artifacts")
    K.write_prepped(song_items(spark, sf), vocab, st, base)
    m = GatedModel.from_formula(IN, IN, EMB, HID)
    spark.createDataFrame([(k, j, m.params[k][j].ravel().tolist()) for k in m.params for j in (0, 1)],
                          "layer string, part int, values array<double>").write.parquet(f"{base}/model_weights")
    arts = S.read_artifacts(spark, base)
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("artifact"), "n_rows") for n, df in arts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
