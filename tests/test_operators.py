"""Edge cases and properties of single operators on small hand-written fixtures."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import evaluate as E
from cadenza.operators import features as V
from cadenza.operators import manifold as M
from cadenza.operators import reconcile as R
from cadenza.operators.recommend import item_cf
from cadenza.operators.similarity import similarity_topk


def test_minmax_constant_and_nan(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, float("nan")), (3, 5.0, 3.0)], "id int, c double, x double")
    st = V.fit_minmax(df, ["c", "x"])
    assert st["c"] == (5.0, 5.0) and st["x"] == (1.0, 3.0)  # NaN ignored
    out = {r["id"]: r for r in df.select("id", V.minmax_expr("c", *st["c"]).alias("c"),
                                         V.minmax_expr("x", *st["x"]).alias("x")).collect()}
    assert out[1]["c"] == 0.0 and out[3]["x"] == 1.0 and math.isnan(out[2]["x"])


def test_standard_population_std(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    st = V.fit_standard(df, ["x"])
    assert st["x"] == (2.0, 1.0)  # population std, not sample (1.414)
    const = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    m, s = V.fit_standard(const, ["x"])["x"]
    assert const.select(V.standard_expr("x", m, s).alias("z")).first()["z"] == 0.0


def test_cosine_zero_vector_and_self_exclusion(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])],
                               "id long, v array<double>")
    r = similarity_topk(df, k=3, q_id="id", q_vec="v", exclude_self=True, strategy="block").collect()
    got = {(x["seed_id"], x["rec_id"]): x["score"] for x in r}
    assert (1, 1) not in got and got[(1, 2)] == pytest.approx(1.0)  # identical vector kept, self dropped
    assert got[(3, 1)] == 0.0  # zero vector -> similarity 0
    ranks = sorted((x["rank"], x["rec_id"]) for x in r if x["seed_id"] == 3)
    assert [i for _, i in ranks] == [1, 2, 4]  # all ties -> by id


def test_strategies_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    a = similarity_topk(df, k=5, q_id="id", q_vec="v", exclude_self=True, strategy="block", block_rows=70)
    b = similarity_topk(df, k=5, q_id="id", q_vec="v", exclude_self=True, strategy="seeds")
    key = lambda d: sorted((r["seed_id"], r["rec_id"], r["rank"]) for r in d.collect())
    assert key(a) == key(b)
    # numpy brute force
    X = np.array([v for _, v in rows])
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = Xn @ Xn.T
    np.fill_diagonal(S, -np.inf)
    top = np.argsort(-S[0])[:5].tolist()
    assert [r[1] for r in key(a) if r[0] == 0] != [] and sorted(top) == sorted(r[1] for r in key(a) if r[0] == 0)


def test_keep_first_last_case_sensitive(spark):
    df = spark.createDataFrame([("A", "x", "a.json", 0, 1), ("a", "x", "a.json", 1, 2),
                                ("A", "x", "b.json", 0, 3), (None, "x", "a.json", 2, 4), (None, "x", "b.json", 0, 5)],
                               "title string, artist string, f string, seq int, id int")
    first = {(r["title"], r["id"]) for r in R.keep_first(df, ["title", "artist"], ["f", "seq"]).collect()}
    last = {(r["title"], r["id"]) for r in R.keep_last(df, ["title", "artist"], ["f", "seq"]).collect()}
    assert first == {("A", 1), ("a", 2), (None, 4)}
    assert last == {("A", 3), ("a", 2), (None, 5)}
    again = R.keep_first(R.keep_first(df, ["title", "artist"], ["f", "seq"]), ["title", "artist"], ["f", "seq"])
    assert {(r["title"], r["id"]) for r in again.collect()} == first  # idempotent


def test_chord_vocab_and_multihot_variants(spark):
    df = spark.createDataFrame([
        (1, {"main": "C - G", "bridge": "Am"}),
        (2, {"verse": "F"}),            # no main section
        (3, {"main": None}),            # null section text
        (4, {"main": ""}),              # empty section -> token ''
        (5, None),                      # non-dict progression
    ], "id int, prog map<string,string>")
    vocab = V.fit_vocab(df, "prog")
    words = [r["chord"] for r in vocab.orderBy("idx").collect()]
    assert words == sorted(["C", "G", "Am", "F", "None", ""])
    allv = {r["id"]: r["h"] for r in V.multihot(df, "prog", vocab, "h").collect()}
    main = {r["id"]: r["h"] for r in V.multihot(df, "prog", vocab, "h", sections=["main"]).collect()}
    idx = {w: i for i, w in enumerate(words)}
    assert allv[1][idx["Am"]] == 1 and main[1][idx["Am"]] == 0
    assert main[2][idx[""]] == 1  # missing main reads ''
    assert main[3][idx["None"]] == 1
    assert sum(allv[5]) == 0 and sum(main[5]) == 0
    new = spark.createDataFrame([(9, {"main": "C - Xm7"})], "id int, prog map<string,string>")
    assert sum(V.multihot(new, "prog", vocab, "h", sections=["main"]).first()["h"]) == 1  # unknown ignored


def test_slug_and_filename_rules(spark):
    df = spark.createDataFrame([("The The", "remix"), ("  Ünïcode Band ", "Song (Live)"), ("a", "b.")],
                               "artist string, title string")
    r = df.select(T.url_slug("artist").alias("a"), T.url_slug("title").alias("t"),
                  T.lyrics_url("artist", "title").alias("u"), T.safe_filename("title").alias("f"),
                  T.safe_filename(F.lit("")).alias("e")).collect()
    assert r[0]["a"] == "the" and r[0]["t"] == "" and r[0]["u"] is None
    assert r[1]["a"] == "ncodeband" and r[1]["t"] == "songlive"
    assert r[2]["f"] == "b" and r[0]["e"] == "unknown"


def test_capitalize_not_initcap(spark):
    df = spark.createDataFrame([("hip HOP-r&b",)], "g string")
    assert df.select(T.capitalize("g").alias("c")).first()["c"] == "Hip hop-r&b"


def test_metrics_empty_and_single(spark):
    items = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 1.0]),
                                   (4, "a", [1.0, 1.0])], "item_id long, genre string, vec array<double>")
    recs = spark.createDataFrame([("m", 1, 3, 1), ("m", 1, 2, 2), ("m", 2, 1, 1)],
                                 "model string, seed_id long, rec_id long, rank int")
    seeds = items.select(F.col("item_id").alias("seed_id"))
    per = {(r["model"], r["seed_id"]): r for r in E.per_seed_metrics(recs, items, seeds, ["m"]).collect()}
    s1 = per[("m", 1)]
    assert s1["precision"] == 0.5 and s1["recall"] == 0.5
    assert s1["average_precision"] == pytest.approx((1 / 2) / 2)
    assert s1["diversity"] == pytest.approx(1 - 1 / math.sqrt(2))
    assert per[("m", 2)]["diversity"] == 0.0  # list of one
    assert per[("m", 4)]["precision"] == 0.0 and per[("m", 4)]["average_precision"] == 0.0  # empty list
    assert ("m", 3) not in per  # seed without relevant items is skipped


@pytest.mark.parametrize("part_likes", [3, 512])
def test_item_cf_against_brute_force(spark, part_likes):
    rng = np.random.default_rng(1)
    likes = {(u, int(i)) for u in range(60) for i in rng.choice(40, size=8, replace=False)}
    likes |= {(u, 7) for u in range(0, 60, 3)} | {(5, i) for i in range(40)}  # a hot item and a heavy user
    df = spark.createDataFrame([*likes, *list(likes)[:50]], "user_id long, item_id long")
    got = {(r["seed_id"], r["rec_id"]): r["score"] for r in item_cf(df, k=5, part_likes=part_likes).collect()}
    A = np.zeros((60, 40))
    for u, i in likes:
        A[u, i] = 1
    co = A.T @ A
    deg = A.sum(axis=0)
    for (a, b), s in got.items():
        assert s == pytest.approx(co[a, b] / math.sqrt(deg[a] * deg[b]))
    for a in range(40):
        cand = [(-round(co[a, b] / math.sqrt(deg[a] * deg[b]), 9), b) for b in range(40) if b != a and co[a, b] > 0]
        want = [b for _, b in sorted(cand)[:5]]
        assert [b for (x, b), _ in sorted(got.items(), key=lambda t: (t[0][0], -round(t[1], 9), t[0][1])) if x == a] == want


def test_item_cf_bounds_and_split_seeds(spark):
    """Rare seeds stop forming pairs with hot items, split seeds are added up, and no row changes."""
    from cadenza.operators import recommend as REC
    rng = np.random.default_rng(5)
    likes = {(u, int(i)) for u in range(300) for i in rng.choice(60, size=5, replace=False)} | {(u, 1000) for u in range(300)}
    likes |= {(u, 1000 * j + u // 2) for u in range(300) for j in range(2, 5)}  # rare items, each next to other rare ones
    df = spark.createDataFrame([*likes], "user_id long, item_id long").repartition(4)
    rows = lambda **kw: sorted((r["seed_id"], r["rec_id"], round(r["score"], 9), r["rank"]) for r in item_cf(df, k=3, **kw).collect())
    whole = rows()
    assert rows(held=200) == whole == rows(seed_likes=50, held=100) == rows(part_likes=2, seed_likes=100)
    report = REC.co_like_report(df, k=3, held=200).first()
    assert report["left_out"] > 0 and report["formed"] + report["left_out"] == sum(c * (c - 1) for c in df.groupBy("user_id").count().toPandas()["count"])
    state = REC._CoLikes(2, 1)
    a = lambda *v: np.array(v, np.int64)
    state.add(a(1, 1, 5), a(2, 2, 50), a(2, 3, 9), a(2, 2, 100))
    state.add(a(1, 1, 5), a(2, 2, 50), a(9, 8, 9), a(100, 8, 100))  # 1 has two others of 2 likes: none of over 2 * 2 * 2 can be among its best
    assert state.left_out == 1 and state.formed == 5


def test_item_cf_splits_a_heavy_user(spark):
    df = spark.range(2000).selectExpr("1L AS user_id", "id AS item_id")
    out = item_cf(df, k=2, part_likes=100)
    assert out.count() == 4000 and out.agg({"score": "min"}).first()[0] == 1.0
    # a pair of items is formed once for each user that likes both
    assert item_cf(df.limit(50).union(df.limit(50).selectExpr("2L", "item_id")), k=49, part_likes=7).agg({"score": "max"}).first()[0] == 1.0


def test_manifold_metrics_against_numpy(spark):
    rng = np.random.default_rng(2)
    X = np.concatenate([rng.normal(0, 1, (20, 3)), rng.normal(3, 1, (20, 3)), rng.normal(-3, 1, (1, 3))])
    lab = [0] * 20 + [1] * 20 + [2]
    df = spark.createDataFrame([(i, X[i].tolist(), lab[i]) for i in range(len(lab))],
                               "item_id long, vec array<double>, label int")
    sil = M.silhouette(df).first()["silhouette"]
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    labs = np.array(lab)
    s = []
    for i in range(len(lab)):
        same = (labs == labs[i]) & (np.arange(len(lab)) != i)
        if same.sum() == 0:
            s.append(0.0)
            continue
        a = D[i, same].mean()
        b = min(D[i, labs == l].mean() for l in set(lab) if l != labs[i])
        s.append((b - a) / max(a, b))
    assert sil == pytest.approx(np.mean(s))
    ch = M.calinski_harabasz(df).first()["calinski_harabasz"]
    g = X.mean(0)
    B = sum((labs == l).sum() * ((X[labs == l].mean(0) - g) ** 2).sum() for l in set(lab))
    W = sum(((X[labs == l] - X[labs == l].mean(0)) ** 2).sum() for l in set(lab))
    assert ch == pytest.approx((B / 2) / (W / (len(lab) - 3)))
    ari_same = M.adjusted_rand(df.withColumn("c", F.col("label")), "label", "c").first()["ari"]
    assert ari_same == 1.0


def test_l2_normalise_unit_norm(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    r = df.select(V.l2_normalise("v").alias("u")).collect()
    assert r[0]["u"] == [0.6, 0.8] and r[1]["u"] == [0.0, 0.0]


def test_excerpt_short_and_long(spark):
    df = spark.createDataFrame([(list(range(5)),), (list(range(20)),)], "a array<int>")
    r = df.select(V.excerpt("a", 2).alias("e")).collect()
    assert r[0]["e"] == [0, 1, 2, 3, 4]
    assert r[1]["e"] == [0, 1, 9, 10, 18, 19]


def test_training_gradients_match_finite_differences():
    from cadenza.operators.model import GatedModel
    from cadenza.operators.training import triplet_loss_and_grads
    rng = np.random.default_rng(3)
    m = GatedModel.from_formula(5, 4, 6, 3)
    A = [rng.normal(size=(7, 5)) for _ in range(3)]
    T = [rng.normal(size=(7, 4)) for _ in range(3)]
    args = (A[0], T[0], A[1], T[1], A[2], T[2])
    margin = 1.5  # keep most triplets active
    _, grads, _, _ = triplet_loss_and_grads(m, *args, margin)
    for layer in ("audio", "text", "gate1", "gate2"):
        for j in (0, 1):
            w = m.params[layer][j]
            idx = tuple(rng.integers(0, s) for s in w.shape)
            h = 1e-6
            plus, minus = [list(m.params[layer]) for _ in range(2)]
            wp, wm = w.copy(), w.copy()
            wp[idx] += h
            wm[idx] -= h
            m.params[layer] = (wp, m.params[layer][1]) if j == 0 else (m.params[layer][0], wp)
            lp = triplet_loss_and_grads(m, *args, margin)[0]
            m.params[layer] = (wm, m.params[layer][1]) if j == 0 else (m.params[layer][0], wm)
            lm = triplet_loss_and_grads(m, *args, margin)[0]
            m.params[layer] = (w, m.params[layer][1]) if j == 0 else (m.params[layer][0], w)
            assert grads[layer][j][idx] == pytest.approx((lp - lm) / (2 * h), rel=1e-4, abs=1e-6)


def test_model_properties():
    from cadenza.operators.model import GatedModel
    rng = np.random.default_rng(4)
    m = GatedModel.from_formula(174, 387, 128, 64)  # the dimensions of the original self-test
    pa, pt, alpha, fe = m.forward(rng.normal(size=(4, 174)), rng.normal(size=(4, 387)))
    assert fe.shape == (4, 128) and alpha.shape == (4,)
    assert np.allclose(np.linalg.norm(fe, axis=1), 1.0)
    assert np.all((alpha >= 0) & (alpha <= 1))


def test_triplet_properties(spark):
    from cadenza.operators.training import dense_positions, triplets
    rows = [(i, "g%d" % (i % 3)) for i in range(30)] + [(100, "solo")]
    df = spark.createDataFrame(rows, "song_id long, genre string")
    pos = {r["song_id"]: r["pos"] for r in dense_positions(df, "genre", "song_id").collect()}
    for g in ("g0", "g1", "g2"):
        assert sorted(pos[i] for i, gg in rows if gg == g) == list(range(10))
    genre = dict(rows)
    t = triplets(df, [0, 1]).collect()
    assert len(t) == 2 * len(rows)
    for r in t:
        assert genre[r["positive"]] == genre[r["anchor"]]
        assert genre[r["negative"]] != genre[r["anchor"]]
        assert r["positive"] != r["anchor"] or r["anchor"] == 100  # alone -> itself
    with pytest.raises(ValueError):
        triplets(df.where("genre = 'g0'"), [0])


def test_training_loss_falls_on_fixed_triplets(spark):
    from cadenza.operators.model import GatedModel
    from cadenza.operators.training import train
    rng = np.random.default_rng(5)
    rows = []
    for ep in range(8):
        r2 = np.random.default_rng(6)  # the same triplets every epoch
        for _ in range(64):
            rows.append((ep, *[r2.normal(size=6).tolist() for _ in range(6)]))
    df = spark.createDataFrame(rows, "epoch int, a_audio array<double>, a_text array<double>, p_audio array<double>, "
                                     "p_text array<double>, n_audio array<double>, n_text array<double>")
    _, hist = train(df, GatedModel.from_formula(6, 6, 8, 4), epochs=8, lr=0.05, margin=0.5)
    assert hist[-1]["loss"] < hist[0]["loss"]


def test_bounded_collect_refuses_large_artifacts(spark):
    from cadenza.session import bounded_collect
    df = spark.range(10)
    assert len(bounded_collect(df, 10, "ids")) == 10
    with pytest.raises(ValueError):
        bounded_collect(df, 9, "ids")


def test_assign_nearest_matches_numpy(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(40, 3))
    lab = rng.integers(0, 4, size=40)
    items = spark.createDataFrame([(i, X[i].tolist(), int(lab[i])) for i in range(40)],
                                  "item_id long, vec array<double>, label int")
    cents = M.centroids(items)
    got = {r["item_id"]: r["cluster"] for r in M.assign_nearest(items, cents).collect()}
    C = {r["label"]: np.array(r["centroid"]) for r in cents.collect()}
    for i in range(40):
        d = {l: round(float(((X[i] - c) ** 2).sum()), 9) for l, c in C.items()}
        best = min(sorted(d), key=lambda l: d[l])
        assert got[i] == best


def test_assign_nearest_over_centroid_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    items = spark.createDataFrame([(i, rng.integers(-2, 3, size=2).astype(float).tolist()) for i in range(60)], "item_id long, vec array<double>")
    cents = spark.createDataFrame([(f"c{i}", rng.integers(-2, 3, size=2).astype(float).tolist()) for i in range(9)], "label string, centroid array<double>")
    whole = sorted(M.assign_nearest(items, cents).collect())
    monkeypatch.setattr(M, "CENTROID_BYTES", 50)  # three centroids a block; ties across blocks keep the smaller label
    monkeypatch.setattr(M, "SCORE_CELLS", 10)
    assert sorted(M.assign_nearest(items, cents).collect()) == whole


def test_rand_index_and_davies_bouldin_match_numpy(spark):
    rng = np.random.default_rng(9)
    X, lab, other = rng.normal(size=(50, 3)), rng.integers(0, 4, size=50), rng.integers(0, 3, size=50)
    df = spark.createDataFrame([(i, X[i].tolist(), int(lab[i]), int(other[i])) for i in range(50)], "item_id long, vec array<double>, label int, c int")
    two = lambda n: n * (n - 1) / 2
    table = np.array([[((lab == a) & (other == b)).sum() for b in range(3)] for a in range(4)])
    exp = two(table.sum(1)).sum() * two(table.sum(0)).sum() / two(50)
    ari = (two(table).sum() - exp) / ((two(table.sum(1)).sum() + two(table.sum(0)).sum()) / 2 - exp)
    assert M.adjusted_rand(df, "label", "c").first()["ari"] == pytest.approx(ari)
    assert M.adjusted_rand(df.limit(0), "label", "c").first()["ari"] == 1.0
    C = np.stack([X[lab == a].mean(0) for a in range(4)])
    s = np.array([np.sqrt(((X[lab == a] - C[a]) ** 2).sum(1)).mean() for a in range(4)])
    db = np.mean([max((s[i] + s[j]) / np.sqrt(((C[i] - C[j]) ** 2).sum()) for j in range(4) if j != i) for i in range(4)])
    assert M.davies_bouldin(df).first()["davies_bouldin"] == pytest.approx(db)


def test_random_draws_reach_the_whole_catalogue(spark):
    from cadenza.operators.sampling import random_recs
    items = spark.range(10_000).withColumnRenamed("id", "i")
    rows = random_recs(items, items, id_col="i", seed_col="i", k=10, salt=1).collect()
    per = {}
    for r in rows:
        per.setdefault(r["seed_id"], []).append(r["rec_id"])
    assert len(per) == 10_000 and all(len(set(v)) == 10 and s not in v for s, v in per.items())
    assert len({r["rec_id"] for r in rows}) > 9_990  # every part of the catalogue is drawn
    few = items.where("i < 5")
    got = random_recs(few, few, id_col="i", seed_col="i", k=10, salt=1).groupBy("seed_id").count().collect()
    assert all(r["count"] == 4 for r in got)


def test_nan_vector_takes_no_place(spark):
    from cadenza.operators.similarity import similarity_topk
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [float("nan"), 1.0]), (4, [0.0, 1.0]), (5, [0.5, 0.5])], "i long, v array<double>")
    out = {}
    for strategy in ("block", "seeds"):
        r = similarity_topk(df, df, k=2, q_id="i", q_vec="v", c_id="i", c_vec="v", exclude_self=True, strategy=strategy)
        out[strategy] = sorted((x["seed_id"], x["rec_id"]) for x in r.collect())
    assert out["block"] == out["seeds"] and sum(s == 1 for s, _ in out["block"]) == 2


def test_checkpoint_dir_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from cadenza.session import ensure_checkpoint_dir

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    def session(master):
        sc = SimpleNamespace(master=master, _dir=None)
        sc.getCheckpointDir = lambda: sc._dir
        sc.setCheckpointDir = lambda d: setattr(sc, "_dir", d)
        return SimpleNamespace(sparkContext=sc, conf=Conf())

    assert ensure_checkpoint_dir(session("local[2]"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(session(master))


def test_units_follow_memory_alone():
    from cadenza.operators import metric_index as MI
    from cadenza.operators.similarity import planned_partitions
    for n in (10**3, 10**6, 10**8):
        blocks = [MI.Block("all", i, str(i), MI.BLOCK_ROWS, np.zeros(1), 0.0, 1.0, False) for i in range(-(-n // MI.BLOCK_ROWS))]
        units = MI.units_of(MI.BlockIndex("", 64, blocks), MI.unit_rows_of(64))
        assert len(units) <= 1 + n * 64 * 8 / MI.UNIT_BYTES and sum(map(len, units)) == len(blocks)  # 200 copies of 1e8 candidates, on any number of cores
    assert planned_partitions(10**9, 4000) <= 64_000


def _clustered(spark, n=900, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    x = np.repeat(4 * rng.normal(size=(12, dim)), n // 12, 0) + 0.2 * rng.normal(size=(n, dim))
    x[::100] = x[0]  # copies: ties everywhere
    x[7] = 0.0
    order = rng.permutation(n)
    return spark.createDataFrame([(int(i), x[i].tolist(), "abc"[i % 3] if i % 50 else None) for i in order], "i long, v array<double>, g string"), x


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("grp", [None, "g"])
def test_metric_index_equals_brute_force(spark, metric, grp):
    df, x = _clustered(spark)
    run = lambda q, **kw: sorted(map(tuple, similarity_topk(q, df, k=6, q_id="i", q_vec="v", c_id="i", c_vec="v", metric=metric, exclude_self=True, q_group=grp, c_group=grp, **kw)
                                     .selectExpr("seed_id", "rec_id", "rank", "round(score, 7)").collect()))
    assert run(df, strategy="block", block_rows=64) == run(df, strategy="seeds")
    few = df.where("i % 7 = 0")
    assert run(few, strategy="block", block_rows=50) == run(few, strategy="seeds")  # an index of the seeds beside that of the candidates


def test_metric_index_discards_blocks(spark):
    from cadenza.operators.similarity import block_pairs
    df, _ = _clustered(spark)
    r = block_pairs(df, k=5, id_col="i", vec_col="v", block_rows=64).first()
    assert r["read"] < 0.5 * r["block_pairs"] and r["discarded_share"] > 0.5
    rng = np.random.default_rng(0)
    noise = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 64)))], "i long, v array<double>")
    assert block_pairs(noise, k=5, id_col="i", vec_col="v", block_rows=64).first()["discarded_share"] < 0.5  # no structure, nothing to discard: still exact


def test_bounds_hold(spark):
    from cadenza.operators import metric_index as MI
    rng = np.random.default_rng(1)
    for metric in ("cosine", "dot", "euclidean"):
        for spread_ in (0.1, 1.0, 5.0):
            c, q = rng.normal(size=4) + spread_ * rng.normal(size=(40, 4)), 2 * rng.normal(size=(30, 4))
            c[0] = 0.0
            if metric == "cosine":
                c, q = MI.unit_rows(c), MI.unit_rows(q)
            m = c.mean(0)
            norms = np.sqrt((c * c).sum(1))
            b = MI.Block("all", 0, "", 40, m, float(np.sqrt(((c - m) ** 2).sum(1).max())), float(norms.max()), True)
            assert (MI.best_possible(q, b, metric) >= MI.values(q, c, metric).max(1)).all()


def test_distance_sums_from_block_files(spark):
    from cadenza.operators.similarity import distance_sums_by_label
    df, x = _clustered(spark, 240)
    df = df.withColumn("l", F.coalesce("g", F.lit("none")))
    run = lambda **kw: {(r["item_id"], r["label"]): (round(r["dsum"], 6), r["cnt"]) for r in distance_sums_by_label(df, id_col="i", vec_col="v", label_col="l", **kw).collect()}
    assert run() == run(block_rows=50)



def test_broadcast_and_stream_ways_agree(spark, monkeypatch):
    from cadenza.operators import similarity as S
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, v array<double>, g string")
    for metric in ("cosine", "euclidean", "dot"):
        for grp in (None, "g"):
            run = lambda **kw: sorted(map(tuple, S.similarity_topk(df, k=7, q_id="i", q_vec="v", metric=metric, exclude_self=True, q_group=grp, **kw)
                                          .select("seed_id", "rec_id", "rank").collect()))
            monkeypatch.setattr(S, "SCORE_CELLS", 1000)
            monkeypatch.setattr(S.MI, "CELLS", 1000)
            assert run() == run(block_rows=40) == run(strategy="block", block_rows=300) == run(strategy="seeds") and len(run()) == 2100


def test_embedding_sink_and_valid_only_scaling_take_every_position(spark):
    from cadenza.plans.registry import load_all
    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    width, rows = max(len(r["embedding"]) for r in e.collect()), e.count()
    sink = load_all()["sink_embedding"].fn(spark, sf)
    assert [c for c in sink.columns if c.startswith("UMAP_")] == [f"UMAP_{i + 1}" for i in range(width)] and sink.count() == rows
    scaled = load_all()["vec_valid_only_scale"].fn(spark, sf)
    assert scaled.count() == rows * width and scaled.agg({"pos": "max"}).first()[0] == width - 1


def test_numbering_has_no_window_and_follows_the_order(spark):
    from cadenza.operators.aggregates import label_index, vector_mean
    from cadenza.operators.numbering import number_by_range
    rng = np.random.default_rng(4)
    rows = [(None if i % 50 == 0 else f"k{int(rng.integers(0, 400)):04d}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(5)
    out = number_by_range(df, ["k", "i"], "n")
    assert [(r["k"], r["i"]) for r in out.orderBy("n").collect()] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert sorted(r["n"] for r in out.collect()) == list(range(900))
    assert number_by_range(df.limit(0), ["k"], "n").count() == 0
    chords = spark.createDataFrame([(1, {"main": "C - G - Am"})], "id int, prog map<string,string>")
    for plan in (out, label_index(df, "k"), V.fit_vocab(chords, "prog")):
        assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", None), ("c", [5.0, 5.0])], "g string, v array<double>")
    assert {r["g"]: r["v_mean"] for r in vector_mean(v, "v", ["g"]).collect()} == {"a": [2.0, 4.0], "c": [5.0, 5.0]}
