"""Property tests: the distributed operators against numpy brute force on random inputs."""
import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.operators import evaluate as E
from cadenza.operators.similarity import similarity_topk

SETTINGS = dict(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _brute(X, ids, k, metric):
    out = {}
    for i, q in enumerate(X):
        if metric == "cosine":
            nq = np.linalg.norm(q)
            s = [0.0 if nq * np.linalg.norm(c) == 0 else float(q @ c / (nq * np.linalg.norm(c))) for c in X]
            key = [(-round(v, 9), ids[j]) for j, v in enumerate(s) if ids[j] != ids[i]]
        else:
            s = [float(np.sqrt(((q - c) ** 2).sum())) for c in X]
            key = [(round(v, 9), ids[j]) for j, v in enumerate(s) if ids[j] != ids[i]]
        out[ids[i]] = [j for _, j in sorted(key)[:k]]
    return out


@settings(**SETTINGS)
@given(n=st.integers(2, 60), d=st.integers(1, 5), k=st.integers(1, 6), metric=st.sampled_from(["cosine", "euclidean"]),
       seed=st.integers(0, 10_000), block=st.sampled_from([None, 7]))
def test_topk_equals_brute_force(spark, n, d, k, metric, seed, block):
    rng = np.random.default_rng(seed)
    X = rng.integers(-2, 3, size=(n, d)).astype(float)  # small integers: many exact ties and zero vectors
    ids = list(rng.permutation(1000)[:n])
    df = spark.createDataFrame([(int(i), X[j].tolist()) for j, i in enumerate(ids)], "id long, v array<double>")
    r = similarity_topk(df, k=k, q_id="id", q_vec="v", metric=metric, exclude_self=True, strategy="block",
                        block_rows=block).collect()
    got = {}
    for row in sorted(r, key=lambda x: (x["seed_id"], x["rank"])):
        got.setdefault(row["seed_id"], []).append(row["rec_id"])
    want = _brute(X, ids, k, metric)
    assert got == {i: v for i, v in want.items() if v}


@settings(**SETTINGS)
@given(n=st.integers(3, 40), genres=st.integers(1, 4), k=st.integers(1, 5), seed=st.integers(0, 10_000))
def test_metric_bounds(spark, n, genres, k, seed):
    rng = np.random.default_rng(seed)
    items = spark.createDataFrame([(i, f"g{rng.integers(genres)}", rng.normal(size=3).tolist()) for i in range(n)],
                                  "item_id long, genre string, vec array<double>")
    recs = similarity_topk(items, k=k, q_id="item_id", q_vec="vec", exclude_self=True, strategy="block") \
        .select(F.lit("m").alias("model"), "seed_id", "rec_id", "rank")
    per = E.per_seed_metrics(recs, items, items.select(F.col("item_id").alias("seed_id")), ["m"]).collect()
    for r in per:
        assert 0 <= r["precision"] <= 1 and 0 <= r["recall"] <= 1
        assert 0 <= r["average_precision"] <= 1 + 1e-12
        assert -1e-9 <= r["diversity"] <= 2 + 1e-9
