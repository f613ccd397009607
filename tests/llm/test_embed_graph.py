"""Embedding near-duplicates against brute force: balls, graph search, odd vectors."""
import numpy as np
import pytest

from cadenza.llm import embed_graph


def brute(rows, threshold=0.9):
    """rows: (vec_id, vector or None) -> [(vec_id, n_links, component_id, kept)]."""
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float64)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]):
                link[i, j] = link[j, i] = units[i] @ units[j] >= threshold
    u, v = np.nonzero(link)
    top = embed_graph.spanning(n, u, v)
    ids = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(top[i], []).append(key)
    least = {t: min((k for k in ks if k is not None), default=None) for t, ks in ids.items()}
    return sorted(((k, int(link[i].sum()), least[top[i]], k == least[top[i]]) for i, (k, _) in enumerate(rows)), key=repr)


def run(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, node int, vec int").repartition(3)
    out = embed_graph.embedding_groups(df, **kw)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=repr)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.1]), (3, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [-1.0, 0.0]), (12, [1.0])]
    assert run(spark, rows) == brute(rows)
    big = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1e300, -1e300])]
    assert run(spark, big, "double") == brute(big)
    assert run(spark, []) == []


def cloud(seed, groups, size, noise, lone, dim=24):
    """Groups of near copies and lone vectors."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([c + noise * rng.normal(size=(size, dim)) for c in rng.normal(size=(groups, dim))] + [rng.normal(size=(lone, dim))])
    return [(int(i), [float(np.float32(v)) for v in row]) for i, row in zip(rng.permutation(len(x)), x)]


@pytest.mark.parametrize("noise", [0.05, 0.2, 0.3])
def test_balls_and_graph_find_all_links(spark, noise, monkeypatch):
    """Tight groups fall into balls; the links of wider ones partly cross ball borders and shards."""
    rows = cloud(1, 6, 60, noise, 300)
    monkeypatch.setattr(embed_graph, "SHARD", 64)
    monkeypatch.setattr(embed_graph, "PART", 50)
    monkeypatch.setattr(embed_graph, "SHELL", 100)
    got, want = run(spark, rows), brute(rows)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))  # no link below the threshold
    if noise < 0.2:
        assert got == want


def test_graph_alone(spark, monkeypatch):
    """Without balls: small overlapping shards, tiles of several parts, edges between shards."""
    rows = cloud(2, 8, 30, 0.2, 400)
    monkeypatch.setattr(embed_graph, "MAX_BALLS", 0)
    monkeypatch.setattr(embed_graph, "SHARD", 128)
    monkeypatch.setattr(embed_graph, "PART", 60)
    got, want = run(spark, rows, beam=16), brute(rows)
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))


def test_a_third_are_copies(spark, monkeypatch):
    rows = cloud(3, 1, 150, 0.0, 150) + cloud(4, 1, 150, 0.08, 0)
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    monkeypatch.setattr(embed_graph, "PART", 40)
    assert run(spark, rows) == brute(rows)


def test_robust_prune_keeps_far_ones_and_drops_covered_ones():
    x = np.array([[1, 0], [0.999, 0.0447], [0.9995, 0.0316], [-1, 0.01]], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cand = np.array([[2, 1, 3]])
    sim = np.einsum("ijk,ik->ij", x[cand], x[:1])
    keep = embed_graph.robust_prune(x, cand, sim, 8, 1.0)[0]
    assert keep[0] and not keep[1]  # 1 lies behind 2
    far = np.array([[1, 0], [0.9, 0.436], [-0.9, 0.436]], np.float32)
    assert embed_graph.robust_prune(far, np.array([[1, 2]]), np.array([[0.9, -0.9]], np.float32), 8, 2.5)[0].all()  # a large factor keeps the far one


def test_range_search_on_a_chain():
    """A chain of rows, each near its neighbours: range expansion reaches all in range from the query itself."""
    t = np.linspace(0, 1.5, 60)
    x = np.stack([np.cos(t), np.sin(t)], 1).astype(np.float32)
    adjacent = np.stack([np.arange(60) - 1, np.r_[np.arange(1, 60), -1]], 1)
    seen = embed_graph.range_search(x, adjacent, np.array([0, 30, 59]), 10, 4, 0.9)
    full = x[[0, 30, 59]] @ x.T
    assert ((seen >= 0.9) == (full >= 0.9)).all()
