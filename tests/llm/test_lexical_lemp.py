"""Ranked lexical search against plain scoring, with buckets and query blocks of a few rows."""
import math
import random
import re

import brute
import pytest

from cadenza.llm import lexical_lemp

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def rank(docs, items, k=10):
    words = [(i, TERM.findall((t or "").translate(brute.UP))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, n_terms, df = len(words), sum(len(w) for _, w in words), {}
    for _, w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        asked, scored = sorted(set(TERM.findall((text or "").translate(brute.UP)))), []
        for i, w in words:
            m, s = 100 - 90 + 90 * len(w) * n_docs // n_terms, 0
            for x in asked:
                if tf := w.count(x):
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, qid int, ids string").repartition(4)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, qid int")
    out = lexical_lemp.rank_documents(d, q, **kw)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_edge_rows(spark):
    docs = [*brute.ROWS, (None, "alpha beta"), (None, "alpha beta"), (7, "one two three"), (7, "one two three")]
    items = [*brute.ITEMS, (5, "Naïve café 漢字かな交じり文"), (6, "the " * 50 + "fox")]
    assert run(spark, docs, items) == rank(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_buckets_and_query_blocks(spark, seed, monkeypatch):
    """Small buckets, a small head and several query blocks; a third of the documents are copies."""
    monkeypatch.setattr(lexical_lemp, "HEAD", 12)
    rng = random.Random(seed)
    vocabulary = [f"w{int(40 * rng.random() ** 3)}" for _ in range(200)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(240)]
    docs += [(1000 + i, docs[0][1]) for i in range(120)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 15)))) for i in range(12)]
    assert run(spark, docs, items, k=5, block_terms=30) == rank(docs, items, 5)


def test_bounds_prune_and_lose_nothing():
    """search_bucket passes over buckets and documents that cannot enter, and only those."""
    import numpy as np

    rng = np.random.default_rng(3)
    dense = np.where(rng.random((300, 40)) < 0.3, rng.integers(1, 1000, (300, 40)), 0) // (1 + np.arange(300)[:, None] // 20)
    queries = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(20)]
    dense = dense[np.argsort(-np.sqrt((dense**2.0).sum(1)), kind="stable")]
    best, alive, skipped = [lexical_lemp.Best(5, 0) for _ in queries], np.ones(20, bool), 0
    for s in range(0, 300, 25):
        part = dense[s : s + 25]
        row, ids = np.nonzero(part)
        cuts = np.concatenate([[0], np.cumsum((part > 0).sum(1))])
        lexical_lemp.search_bucket(np.arange(s, s + 25), np.sqrt((part**2.0).sum(1)), cuts, ids, part[row, ids], queries, best, alive)
        skipped += (~alive).sum()
    for q, b in zip(queries, best):
        score = dense[:, q].sum(1)
        order = np.lexsort((np.arange(300), -score))[:5]
        assert b.docs.tolist() == order.tolist() and b.scores.tolist() == score[order].tolist()
    assert skipped  # short buckets are never read
