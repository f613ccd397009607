"""Conversation prefix trie against a plain trie, with chunks and segments small enough to cut everything."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from cadenza.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, extra int, a string, _part int"


def brute(rows):
    """rows: (conv_id, turn, role, text) -> node tuples."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", md5(text or ""), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        seq = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append((c, len(seq) == d))
    kids, leaves, saved = {}, {}, {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c, e in sorted(m) if e)
        parent = min(c for c, _ in nodes[p[:-1]]) if p else None
        out.append((min(m)[0], len(p), parent, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(parts)
    out = prefix_trie.prefix_trie(df, **kw)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


EDGE = [
    (0, 1, "user", "hé"), (0, 2, "assistant", "b"), (0, 2, "assistant", "b"), (0, None, None, None), (1, 5, "user", "x"), (1, 5, "user", "a"), (1, 5, None, "zz"),
    (-3, 1, "user", "q"), (-7, 1, "u", "w"), (7, 1, "user", ""), (None, 1, "user", "lost"), (12, 1, "user", "y"), (13, 2, "user", "y"), (9223372036854775800, 1, "user", "far"),
]


@pytest.mark.parametrize("kw", [{}, {"segment": 2, "chunk_rows": 2}])
def test_edge_rows(spark, kw):
    assert run(spark, EDGE, **kw) == brute(EDGE)


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("seed,segment,chunk", [(1, 4096, 7), (2, 3, 5)])
def test_random_tries(spark, seed, segment, chunk):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, "user", rng.choice("ab") * rng.randrange(1, 3)))
    copies = [(c, t, "user", f"same {t}") for c in range(100, 200) for t in range(6)]  # a third and more are copies
    assert run(spark, rows + copies, 5, segment=segment, chunk_rows=chunk) == brute(rows + copies)


def test_one_long_conversation(spark):
    """Most rows in one conversation, and a copy of it that goes on."""
    rows = [(5, t, "user", f"t{t}") for t in range(300)] + [(10, t, "user", f"t{t}") for t in range(310)] + [(c, 1, "user", "t0") for c in range(20, 40)]
    assert run(spark, rows, 4, segment=64, chunk_rows=4) == brute(rows)


def test_extents_by_sparse_table():
    rng = np.random.default_rng(0)
    lcp = rng.integers(0, 4, 200)
    lcp[0] = -1
    row, depth = rng.integers(0, 200, 500), rng.integers(0, 5, 500)
    left, right = prefix_trie.extents(prefix_trie.minima(lcp), row, depth)
    for i, d, a, b in zip(row, depth, left, right):
        x = y = i
        while x > 0 and lcp[x] >= d:
            x -= 1
        while y + 1 < 200 and lcp[y + 1] >= d:
            y += 1
        assert (a, b) == (x, y)
