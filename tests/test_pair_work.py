"""Neighbours of many items come from the index instead of every pair."""
import numpy as np

from cadenza.operators import metric_index as MI
from cadenza.operators import similarity as S


def _items(spark, x, ids=None, labels="ab"):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), labels[n % len(labels)], [float(v) for v in r]) for n, (i, r) in enumerate(zip(ids, x))], "item_id long, label string, vec array<double>")


def test_many_pairs_go_through_the_index_and_give_the_same_neighbours(spark, monkeypatch):
    df, searched, real = _items(spark, np.random.default_rng(3).normal(size=(900, 4))), [], MI.search_index
    monkeypatch.setattr(MI, "search_index", lambda *a, **kw: searched.append(1) or real(*a, **kw))
    rows = lambda: sorted(tuple(r)[:2] + tuple(r)[3:] for r in S.knn_edges(df, k=6, id_col="item_id", vec_col="vec").collect())
    brute = rows()
    assert not searched
    monkeypatch.setattr(S, "BRUTE_ROWS", 899)
    assert rows() == brute and searched
