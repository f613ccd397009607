"""Leaves of the metric index: the exact neighbours from a small part of the pairs."""
import numpy as np
import pytest

from cadenza.operators import metric_index as MI
from cadenza.operators.similarity import similarity_topk


def _searched(x, ids, k, metric, monkeypatch, n_blocks=4):
    """Neighbours of the rows of the first block, and the score cells computed for them."""
    if metric == "cosine":
        x = MI.unit_rows(x)
    refs = MI.reference_points(x.copy(), n_blocks)
    of = MI.nearest(x, refs)
    parts = []
    for j in range(n_blocks):
        at = np.flatnonzero(of == j)
        order, leaf = MI.leaves_of(x[at])
        parts.append((ids[at][order], x[at][order], leaf))
    cells, real = [], MI.values
    monkeypatch.setattr(MI, "values", lambda q, c, m: cells.append(len(q) * len(c)) or real(q, c, m))
    qid, q, leaf = parts[0]
    state = MI.Running(qid, q, None, k, metric, True, leaf)
    for cid, c, cl in parts:
        state.offer(np.arange(len(qid)), cid, c, None, leaves=MI.Leaves.of(c, cl))
    val = real(q, x, metric)
    val[qid[:, None] == ids[None, :]] = -np.inf
    return state, MI.top_rows(val, ids, k), sum(cells) / (len(qid) * len(ids))


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_leaves_give_the_exact_neighbours_of_grouped_vectors(metric, monkeypatch):
    rng = np.random.default_rng(5)
    hot = np.eye(12)[rng.integers(0, 12, 6000)] + np.eye(12)[rng.integers(0, 12, 6000)]
    x = np.concatenate([rng.random((6000, 2)), hot], 1)
    x[::500] = 0.0
    x[1::7] = x[rng.integers(0, 60, len(x[1::7]))]  # copies: ties by id
    state, (val, best), share = _searched(x, rng.permutation(6000).astype(np.int64), 5, metric, monkeypatch)
    assert np.allclose(np.round(state.val, 9), np.round(val, 9), atol=2e-8)
    if metric != "euclidean":  # a distance of 0 is 0 up to 1e-8
        assert (state.best == best).all()
    if metric != "dot":
        assert share < 0.3  # every pair, before there were leaves


def test_leaves_without_structure(monkeypatch):
    rng = np.random.default_rng(6)
    state, (val, best), _ = _searched(rng.normal(size=(3000, 24)), np.arange(3000), 7, "cosine", monkeypatch)
    assert (state.best == best).all() and np.allclose(state.val, val)


def test_leaves_hold_every_row_once():
    x = np.concatenate([np.zeros((700, 3)), np.random.default_rng(1).random((900, 3))])
    order, leaf = MI.leaves_of(x, 64)
    assert sorted(order) == list(range(1600)) and np.bincount(leaf).max() <= 64 and (np.diff(leaf) >= 0).all()


def test_block_join_with_leaves_equals_the_broadcast_join(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random((1500, 2)), np.eye(5)[rng.integers(0, 5, 1500)]], 1)
    df = spark.createDataFrame([(i, [float(v) for v in r], "ab"[i % 2]) for i, r in enumerate(x)], "id long, vec array<double>, g string")
    for group in (None, "g"):
        a, b = (sorted(map(tuple, similarity_topk(df, k=4, q_id="id", q_vec="vec", exclude_self=True, q_group=group, strategy=s, block_rows=n)
                           .select("seed_id", "rec_id", "rank").collect())) for s, n in (("auto", None), ("block", 700)))
        assert a == b


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_no_pair_of_leaves_is_better_than_its_bound(metric):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(400, 5)), np.zeros((60, 5)), -3 * np.eye(5)[rng.integers(0, 5, 300)]])
    x = MI.unit_rows(x) if metric == "cosine" else x
    order, leaf = MI.leaves_of(x, 32)
    x, leaves = x[order], MI.Leaves.of(x[order], leaf)
    bound = MI.best_of_leaves(leaves, leaves, metric)
    val = MI.values(x, x, metric)
    assert all(val[leaf == i][:, leaf == j].max() <= bound[i, j] for i in range(leaf[-1] + 1) for j in range(leaf[-1] + 1))


def test_far_leaves_are_left_out_before_any_query_is_compared(monkeypatch):
    rng = np.random.default_rng(10)
    x = np.repeat(10 * rng.normal(size=(40, 6)), 100, axis=0) + 0.01 * rng.normal(size=(4000, 6))
    cells, real = [], MI.best_in_leaves
    monkeypatch.setattr(MI, "best_in_leaves", lambda q, b, m: cells.append(len(q) * len(b.starts)) or real(q, b, m))
    state, (val, best), _ = _searched(x, np.arange(4000), 5, "euclidean", monkeypatch)
    assert np.allclose(state.val, val, atol=1e-6)
    assert sum(cells) < 0.2 * len(state.ids) * 40  # every query with every leaf, before


def test_units_are_dealt_evenly(spark):
    df = spark.createDataFrame([(i, [float(i % 97), float(i % 89)]) for i in range(3000)], "id long, vec array<double>")
    rows = df.selectExpr("id", "vec", "cast(null as string) grp")
    index, _ = MI.block_index(rows, 3000, 2, metric="euclidean", block_rows=256)
    found = MI.search_index(spark, index, index, k=3, metric="euclidean", exclude_self=True, grouped=False, unit_rows_=256)
    units = len(MI.units_of(index, 256))
    tasks = found.where("qid is null").rdd.glom().map(len).collect()
    assert sum(tasks) == units * max(1, min(8 // units, len(index.blocks))) and max(tasks) == 1
