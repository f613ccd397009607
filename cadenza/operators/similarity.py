"""Vector similarity joins: exact top-k neighbours for whole tables of seeds.

Three exact ways share one interface, chosen by checked sizes:

* the seed matrix is small: it is broadcast, the candidate table streams
  through ``mapInPandas`` and each Arrow batch keeps its top-k per seed;
* the candidate matrix is small: it is broadcast and the seed table streams;
* both are large (``block``): both sides are written once as blocks of a metric
  index (``metric_index``); a task holds one unit of seeds and reads from the
  shared files only the blocks that its running k-th best leaves possible.
  Neither candidates nor pair rows are shuffled.

Ordering is ``(round(score, 9), id)`` so ties are deterministic.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import metric_index as MI
from cadenza.session import shared_path, spread

# Largest seed matrix we are willing to broadcast (bytes).
SEED_BROADCAST_BYTES = 16 * 1024 * 1024
# Rows of the smaller side beyond which not every pair is compared: the index leaves out what its bounds allow.
BRUTE_ROWS = 32_768
PARTITIONS_PER_CORE = 16

# Score cells computed at a time.
SCORE_CELLS = 4_000_000

_OUT_SCHEMA = "qid long, cid long, score double"


def _as_matrix(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.values])


def _unit_rows(X: np.ndarray) -> np.ndarray:
    n = np.sqrt((X * X).sum(axis=1, keepdims=True))
    return X / np.where(n > 0, n, 1.0)  # a zero vector stays zero -> similarity 0


def _scores(Q: np.ndarray, C: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return _unit_rows(Q) @ _unit_rows(C).T
    if metric == "dot":
        return Q @ C.T
    if metric == "euclidean":
        d2 = (Q * Q).sum(axis=1)[:, None] + (C * C).sum(axis=1)[None, :] - 2.0 * (Q @ C.T)
        return np.sqrt(np.clip(d2, 0.0, None))
    raise ValueError(f"unknown metric {metric!r}")


def _local_topk(qid, cid, S, k, metric, exclude_self, qgrp=None, cgrp=None):
    """Top-k per query row of one score block, exact tie rule (round(score, 9), cid).

    Vectorised: argpartition picks k candidates per row on the raw values and
    one lexsort orders all rows at once; a row whose k-th value has another
    value within rounding distance outside the pick is resolved exactly.
    """
    if S.size == 0:
        return None
    m, n_c = S.shape
    val = S if metric in ("cosine", "dot") else -S  # larger is better
    if (nan := np.isnan(val)).any():  # a NaN score is no neighbour and must not take a place
        val = np.where(nan, -np.inf, val)
    if exclude_self or qgrp is not None:
        if val is S:
            val = S.copy()
        if exclude_self:
            _, qi, ci = np.intersect1d(qid, cid, return_indices=True)
            val[qi, ci] = -np.inf
        if qgrp is not None:
            val[qgrp[:, None] != cgrp[None, :]] = -np.inf
    kk = min(k, n_c)
    if kk < n_c:
        part = np.argpartition(val, n_c - kk, axis=1)[:, n_c - kk:]
    else:
        part = np.broadcast_to(np.arange(n_c), (m, n_c))
    rows = np.arange(m)[:, None]
    pval = val[rows, part]
    kth = pval.min(axis=1)
    tied = (val >= (kth - 2e-9)[:, None]).sum(axis=1) > kk
    rr = np.repeat(np.arange(m), kk)
    pc = part.ravel()
    pv = pval.ravel()
    order = np.lexsort((cid[pc], -np.round(pv, 9), rr))
    sel_r, sel_c, sel_v = rr[order], pc[order], pv[order]
    keep = ~tied[sel_r] & np.isfinite(sel_v)
    out_q, out_c, out_s = [qid[sel_r[keep]]], [cid[sel_c[keep]]], [S[sel_r[keep], sel_c[keep]]]
    for i in np.flatnonzero(tied):  # near-ties across the boundary: exact rule on the whole row
        key = -np.round(val[i], 9)
        fin = np.flatnonzero(np.isfinite(key))
        o = fin[np.lexsort((cid[fin], key[fin]))[:kk]]
        out_q.append(np.full(o.size, qid[i]))
        out_c.append(cid[o])
        out_s.append(S[i, o])
    q = np.concatenate(out_q)
    if q.size == 0:
        return None
    return pd.DataFrame({"qid": q.astype(np.int64), "cid": np.concatenate(out_c).astype(np.int64),
                         "score": np.concatenate(out_s).astype(np.float64)})


def _best(qid, Q, qgrp, cid, C, cgrp, k, metric, exclude_self):
    """Top-k frames of some queries against some candidates, a few score rows at a time."""
    step = max(1, SCORE_CELLS // max(1, len(cid)))
    for a in range(0, len(qid), step):
        b = a + step
        res = _local_topk(qid[a:b], cid, _scores(Q[a:b], C, metric), k, metric, exclude_self,
                          None if qgrp is None else qgrp[a:b], cgrp)
        if res is not None:
            yield res


def _unit(X: np.ndarray, metric: str) -> tuple[np.ndarray, str]:
    """Rows and metric with cosine turned into a dot product."""
    return (_unit_rows(X), "dot") if metric == "cosine" else (X, metric)


def _broadcast_fn(bc, seeds, k, metric, exclude_self):
    """One side is the broadcast (ids, matrix, groups); the other one streams."""
    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mat, grp = bc.value
        mat, kind = _unit(mat, metric)
        for pdf in it:
            if pdf.empty:
                continue
            own, X = pdf["id"].to_numpy(np.int64), _unit(_as_matrix(pdf["vec"]), metric)[0]
            g = pdf["grp"].to_numpy() if grp is not None else None
            pair = (ids, mat, grp, own, X, g) if seeds else (own, X, g, ids, mat, grp)
            yield from _best(*pair, k, kind, exclude_self)
    return fn


def planned_partitions(n_pairs: int, parallelism: int) -> int:
    """Partitions of the block pairs: a few a core, however many pairs there are (each holds several pairs in turn)."""
    return max(parallelism, min(n_pairs, PARTITIONS_PER_CORE * parallelism))


def block_partitions(left: DataFrame, right: DataFrame, n_pairs: int):
    """Spread the (qb, cb) block pairs over their own partitions.

    Block tasks are CPU-heavy but small in bytes, so without an explicit
    partition count adaptive execution would coalesce them into a few tasks.
    Both sides get the same hash partitioning, so the cogroup adds no shuffle.
    """
    n = planned_partitions(n_pairs, left.sparkSession.sparkContext.defaultParallelism)
    return left.repartition(n, "qb", "cb"), right.repartition(n, "qb", "cb")


def similarity_topk(queries: DataFrame, candidates: DataFrame | None = None, *, k: int,
                    q_id: str, q_vec: str, c_id: str | None = None, c_vec: str | None = None,
                    metric: str = "cosine", exclude_self: bool = False,
                    q_group: str | None = None, c_group: str | None = None,
                    strategy: str = "auto", block_rows: int | None = None,
                    out_names=("seed_id", "rec_id", "score", "rank")) -> DataFrame:
    """Top-k most similar (cosine/dot) or nearest (euclidean) candidates per query.

    Returns ``(seed_id, rec_id, score, rank)`` with rank 1..k.  ``exclude_self``
    drops the candidate whose id equals the query id (ids share one space).
    ``q_group``/``c_group`` restrict candidates to the query's group.
    """
    if candidates is None:
        candidates = queries
        c_id = c_id or q_id
        c_vec = c_vec or q_vec
        c_group = c_group or q_group
    grouped = q_group is not None
    qsel = [F.col(q_id).cast("long").alias("qid"),
            F.col(q_vec).cast("array<double>").alias("qvec")]
    csel = [F.col(c_id).cast("long").alias("cid"),
            F.col(c_vec).cast("array<double>").alias("cvec")]
    if grouped:
        qsel.append(F.col(q_group).cast("string").alias("qgrp"))
        csel.append(F.col(c_group).cast("string").alias("cgrp"))
    q = queries.select(*qsel).where(F.col("qvec").isNotNull())
    c = candidates.select(*csel).where(F.col("cvec").isNotNull())
    spark = queries.sparkSession

    q = q.select(F.col("qid").alias("id"), F.col("qvec").alias("vec"), (F.col("qgrp") if grouped else F.lit(None).cast("string")).alias("grp"))
    c = c.select(F.col("cid").alias("id"), F.col("cvec").alias("vec"), (F.col("cgrp") if grouped else F.lit(None).cast("string")).alias("grp"))
    if strategy not in ("auto", "seeds", "block"):
        raise ValueError(f"unknown strategy {strategy!r}")
    n_c, dim_c = _shape(c)
    n_q, dim_q = (n_c, dim_c) if candidates is queries else _shape(q)
    small = lambda n, dim: n * max(dim, 1) * 8 <= SEED_BROADCAST_BYTES and n <= BRUTE_ROWS
    # the smaller side that fits is broadcast, the other one streams; both checked by count and width
    if strategy != "block" and n_q <= n_c and small(n_q, dim_q):
        side = "seeds"
    elif block_rows is None and small(n_c, dim_c):
        side = "candidates"
    else:
        side = None
    if side:
        rows = (q if side == "seeds" else c).collect()  # at most SEED_BROADCAST_BYTES of vectors
        if not rows:
            return _finish(spark.createDataFrame([], _OUT_SCHEMA), k, metric, out_names)
        bc = spark.sparkContext.broadcast((np.array([r["id"] for r in rows], dtype=np.int64),
                                           np.stack([np.asarray(r["vec"], dtype=np.float64) for r in rows]),
                                           np.array([r["grp"] for r in rows], dtype=object) if grouped else None))
        part = spread(c if side == "seeds" else q).mapInPandas(_broadcast_fn(bc, side == "seeds", k, metric, exclude_self), _OUT_SCHEMA)
        return _finish(part, k, metric, out_names)

    part = _indexed(q, c, n_q, n_c, dim_c, k, metric, exclude_self, grouped, block_rows, same=candidates is queries)
    return _finish(part.where("qid is not null").select("qid", "cid", "score"), k, metric, out_names)


def _indexed(q, c, n_q, n_c, dim, k, metric, exclude_self, grouped, block_rows, same):
    """Rows of ``metric_index.search_index`` over the blocks of both sides.

    The vectors are written first: indexing reads them several times, and its
    filters would else be pushed into the expression that makes them.
    """
    c = _stored(c)
    q = c if same else _stored(q)
    index, layout = MI.block_index(c, n_c, dim, metric=metric, grouped=grouped, block_rows=block_rows, name="candidates")
    own = index if same else MI.block_index(q, n_q, dim, metric=metric, layout=layout, grouped=grouped, block_rows=block_rows, name="seeds")[0]
    # a few units a core, so that none waits long for the last ones
    share = max(MI.LEAST_ROWS, -(-n_q // (4 * c.sparkSession.sparkContext.defaultParallelism)))
    return MI.search_index(c.sparkSession, own, index, k=k, metric=metric, exclude_self=exclude_self, grouped=grouped, unit_rows_=MI.unit_rows_of(dim, block_rows, share))


def _stored(rows: DataFrame) -> DataFrame:
    path = shared_path(rows.sparkSession, "vectors")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def block_pairs(items: DataFrame, *, k: int, id_col: str, vec_col: str, metric: str = "euclidean", block_rows: int | None = None) -> DataFrame:
    """How much of the index a k-nearest search of all ``items`` reads: (tasks, block_pairs, read, discarded_share)."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.lit(None).cast("string").alias("grp")).where("vec is not null")
    n, dim = _shape(rows)
    found = _indexed(rows, rows, n, n, dim, k, metric, True, False, block_rows, same=True).where("qid is null")
    return found.agg(F.count(F.lit(1)).alias("tasks"), F.sum("blocks").alias("block_pairs"), F.sum("read").alias("read"), (1 - F.sum("read") / F.sum("blocks")).alias("discarded_share"))


def _shape(df: DataFrame) -> tuple[int, int]:
    """Rows and longest vector."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    return r["n"], r["d"] or 1


def _finish(part: DataFrame, k: int, metric: str, out_names) -> DataFrame:
    r = F.round("score", 9)
    order = [r.desc(), F.col("cid")] if metric in ("cosine", "dot") else [r.asc(), F.col("cid")]
    w = Window.partitionBy("qid").orderBy(*order)
    s, c, sc, rk = out_names
    return (part.withColumn("rank", F.row_number().over(w))
                .where(F.col("rank") <= k)
                .select(F.col("qid").alias(s), F.col("cid").alias(c),
                        F.col("score").alias(sc), F.col("rank").alias(rk)))


def knn_edges(items: DataFrame, *, k: int, id_col: str, vec_col: str,
              metric: str = "euclidean", **kw) -> DataFrame:
    """k nearest neighbours of every item, itself excluded by id: (src, dst, dist, rank)."""
    return similarity_topk(items, k=k, q_id=id_col, q_vec=vec_col, metric=metric,
                           exclude_self=True, strategy=kw.pop("strategy", "auto"),
                           out_names=("src", "dst", "dist", "rank"), **kw)


_GSUM_SCHEMA = "qid long, clabel string, dsum double, cnt long"
# Sums kept by a block before they are handed on.
KEPT_SUMS = 4_000_000
# Items of one label run, and distances that are computed at a time (they stay in a core's cache).
RUN, RUN_CELLS = 1_024, 1 << 16


class _Labelled:
    """Items with labels, ready to be compared with: by label, in runs of ``RUN`` columns."""

    def __init__(self, cid, C, labels):
        self.names, of = np.unique(labels.astype(str), return_inverse=True)
        self.finite = bool(np.isfinite(C).all())
        order = np.argsort(of, kind="stable") if self.finite else np.arange(len(cid))
        self.cid, self.C, self.of = cid[order], C[order], of[order]
        self.many = np.bincount(of, minlength=len(self.names))
        by_id = np.argsort(self.cid, kind="stable")
        self.by_id, self.ids = by_id, self.cid[by_id]

    def runs(self, size: int):
        """First row, last row, first and last label, and a column a label of each run."""
        for s in range(0, len(self.cid), size):
            e = min(s + size, len(self.cid))
            low, high = self.of[s:e].min(), self.of[s:e].max() + 1
            yield s, e, low, high, (self.of[s:e, None] == np.arange(low, high)).astype(np.float64)


class _LabelSums:
    """Running distance sums of some items to each label."""

    def __init__(self, qid, Q):
        self.qid, self.Q, self.sums = qid, Q, {}
        self.finite = bool(np.isfinite(Q).all())

    def add(self, other: _Labelled) -> None:
        n, names = len(self.qid), other.names
        total, count = np.zeros((n, len(names))), np.zeros((n, len(names)), np.int64)
        # pairs of an item and itself (by id) do not count
        low, high = np.searchsorted(other.ids, self.qid), np.searchsorted(other.ids, self.qid, side="right")
        own_row = np.repeat(np.arange(n), high - low)
        own_col = other.by_id[np.arange(len(own_row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
        count += other.many[None, :]
        np.subtract.at(count, (own_row, other.of[own_col]), 1)
        # a distance that is not finite reaches every label: such items are not cut into runs
        run = RUN if self.finite and other.finite else max(1, len(other.cid))
        rows = max(1, RUN_CELLS // max(1, min(run, len(other.cid))))
        qq, cc = (self.Q * self.Q).sum(axis=1), (other.C * other.C).sum(axis=1)
        at = np.argsort(own_col, kind="stable")
        cut_row, cut_col = own_row[at], own_col[at]
        for s, e, first, last, one_hot in other.runs(run):
            C, square = np.ascontiguousarray(-2.0 * other.C[s:e].T), cc[s:e]
            i, j = np.searchsorted(cut_col, [s, e])
            mine = np.argsort(cut_row[i:j], kind="stable")
            same_row, same_col = cut_row[i:j][mine], cut_col[i:j][mine] - s
            D = np.empty((min(rows, n), e - s))
            for a in range(0, n, rows):
                b = min(a + rows, n)
                d = D[: b - a]
                np.matmul(self.Q[a:b], C, out=d)
                d += qq[a:b, None]
                d += square
                np.maximum(d, 0.0, out=d)
                np.sqrt(d, out=d)
                x, y = np.searchsorted(same_row, [a, b]) if len(same_row) else (0, 0)
                if x < y:
                    d[same_row[x:y] - a, same_col[x:y]] = 0.0
                total[a:b, first:last] += d @ one_hot
        for j, name in enumerate(names):
            had = self.sums.get(name)
            self.sums[name] = (total[:, j], count[:, j]) if had is None else (had[0] + total[:, j], had[1] + count[:, j])

    def handed(self, more: int = 0) -> Iterator[pd.DataFrame]:
        """The sums, if they are over ``more`` values."""
        if len(self.sums) * len(self.qid) > more:
            for name, (total, count) in self.sums.items():
                yield pd.DataFrame({"qid": self.qid, "clabel": name, "dsum": total, "cnt": count})
            self.sums.clear()


def _columns(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and groups of ``rows`` (at most SEED_BROADCAST_BYTES of vectors) on the driver, without a Python object a row or value."""
    t = rows.select("id", "vec", "grp").toArrow().combine_chunks()
    vec = t["vec"].combine_chunks()
    if len(t) and (vec.value_lengths().to_numpy(zero_copy_only=False) != dim).any():
        raise ValueError(f"vectors of several lengths, up to {dim}")
    grp = t["grp"].combine_chunks().dictionary_encode()
    names = np.array([*grp.dictionary.to_pylist(), None], dtype=object)  # one object a group
    of = grp.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
    x = vec.flatten().to_numpy(zero_copy_only=False)  # a null component is NaN
    return t["id"].to_numpy().astype(np.int64), x.reshape(len(t), -1) if len(t) else np.zeros((0, dim)), names[of]


def distance_sums_by_label(items: DataFrame, *, id_col: str, vec_col: str, label_col: str,
                           block_rows: int | None = None) -> DataFrame:
    """Per item and per label: sum and count of Euclidean distances to that label's items (self excluded by id).

    All items are broadcast if they fit; else they are written as blocks, and a
    unit of items reads all block files one after another.  A task emits one
    row per (item, label) it has met.  Output ``(item_id, label, dsum, cnt)``.
    """
    c = items.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                     F.col(label_col).cast("string").alias("grp")).where(F.col("vec").isNotNull())
    spark = items.sparkSession
    n, dim = _shape(c)
    if block_rows is None and n * max(dim, 1) * 8 <= SEED_BROADCAST_BYTES:
        bc = spark.sparkContext.broadcast(_columns(c, dim))

        def each(frames):
            other = _Labelled(*bc.value)
            for pdf in frames:
                if len(pdf):
                    sums = _LabelSums(pdf["id"].to_numpy(np.int64), _as_matrix(pdf["vec"]))
                    sums.add(other)
                    yield from sums.handed()

        part = spread(c).mapInPandas(each, _GSUM_SCHEMA)
    else:
        index, _ = MI.block_index(c, n, dim, metric="euclidean", block_rows=block_rows, name="labelled")
        # a task of its own for every unit, else each of its items is handed on once a task and label
        units = MI.units_of(index, MI.unit_rows_of(dim, block_rows, max(MI.LEAST_ROWS, -(-n // (2 * spark.sparkContext.defaultParallelism)))))
        shares = max(1, min(2 * spark.sparkContext.defaultParallelism // max(1, len(units)), len(index.blocks)))
        bc = spark.sparkContext.broadcast((index, units))

        def shared(frames):
            own, all_units = bc.value
            for pdf in frames:
                for u, s in zip(pdf["unit"], pdf["share"]):
                    ids, Q, _ = MI.read_unit(own, all_units[u])
                    sums = _LabelSums(ids, Q)
                    for b in own.blocks[s::shares]:
                        sums.add(_Labelled(*own.read(b.name)))
                        yield from sums.handed(KEPT_SUMS)
                    yield from sums.handed()

        tasks = [(u, s) for u in range(len(units)) for s in range(shares)]
        part = spark.createDataFrame(tasks, "unit int, share int").repartition(max(1, len(tasks)), "unit", "share").mapInPandas(shared, _GSUM_SCHEMA)
    return (part.groupBy("qid", "clabel").agg(F.sum("dsum").alias("dsum"), F.sum("cnt").alias("cnt"))
                .select(F.col("qid").alias("item_id"), F.col("clabel").alias("label"), "dsum", "cnt"))
