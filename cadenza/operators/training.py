"""Triplet sampling and data-parallel training of the gated model.

* ``dense_positions`` (A9) numbers the rows of every group 0..n-1 without a
  single-task window over a hot group: rows are salted into S sub-buckets,
  ranked inside each, and offset by the sizes of the earlier sub-buckets.
* ``triplets`` (M5) draws, per anchor and epoch, a positive from its own
  genre and a negative from a uniformly drawn other genre, by hash, joined
  on (genre, position) - no list of ids per genre is ever collected.
* ``train`` (M6): per epoch one pass over the triplets; every task
  adds up numpy gradients of the triplet margin loss, a ``Summarizer.sum``
  aggregate adds up the tasks, AdamW runs on the driver
  over the small weight set and the new weights are broadcast.
"""
from __future__ import annotations

import copy
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.vectors import cosine
from cadenza.operators.model import GatedModel
from cadenza.operators.numbering import number_by_range
from cadenza.operators.sampling import hash32

# Sub-buckets of every group, whatever its size: positions never depend on how many rows there are.
SALT_BUCKETS = 256
# Most genres whose sizes are broadcast (a name and two numbers each); more are joined with salt.
BROADCAST_GENRES = 100_000


def dense_positions(df: DataFrame, group: str, order: str, out: str = "pos", salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """Dense 0-based position of each row inside its group (skew-safe).

    A group is split into ``salt_buckets`` hashed sub-buckets, each ranked
    separately and offset by the sizes of the sub-buckets before it, so no
    task sorts a whole group and no join runs on the group alone.
    """
    d = df.withColumn("__s", F.pmod(hash32("pos", F.col(order)), F.lit(salt_buckets)))
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__s").orderBy(order)) - 1)
    cnt = d.groupBy(group, "__s").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(group).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("__o", F.coalesce(F.sum("__c").over(w), F.lit(0))).drop("__c")
    return d.join(off, [group, "__s"]).withColumn(out, (F.col("__o") + F.col("__r")).cast("long")) \
            .drop("__s", "__r", "__o")


def _join_genres(df: DataFrame, genres: DataFrame, on: list[str], n: int, salts: int = 64) -> DataFrame:
    """Join one row a genre to many: broadcast up to a checked count, else salted, as one genre may hold a third of ``df``."""
    if n <= BROADCAST_GENRES:
        return df.join(F.broadcast(genres), on)
    many = genres.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("__j", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")).join(many, [*on, "__j"]).drop("__j")


def triplets(items: DataFrame, epochs, *, id_col="song_id", genre="genre", seed: int = 42) -> DataFrame:
    """M5: (epoch, anchor, positive, negative) for every item and epoch.

    Positive: uniform other item of the same genre (itself when alone).
    Negative: uniform other genre first, then a uniform item of it.
    One genre only is an error.
    """
    pos = dense_positions(items.select(id_col, genre), genre, id_col)
    sizes = pos.groupBy(genre).agg(F.count(F.lit(1)).alias("n_g"))
    g_idx = number_by_range(sizes, [genre], "gi")
    n_genres = g_idx.count()  # one number (the genre table is small)
    if n_genres < 2:
        raise ValueError("triplets need at least two genres")
    a = _join_genres(pos, g_idx, [genre], n_genres)
    a = a.withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    key = lambda tag: hash32(tag, seed, F.col("epoch"), F.col(id_col))
    r = F.pmod(key("p"), F.greatest(F.col("n_g") - 1, F.lit(1)))
    ppos = F.when(F.col("n_g") == 1, F.col("pos")).otherwise(F.when(r >= F.col("pos"), r + 1).otherwise(r))
    r2 = F.pmod(key("g"), F.lit(n_genres - 1))
    ngi = F.when(r2 >= F.col("gi"), r2 + 1).otherwise(r2)
    a = a.select("epoch", F.col(id_col).alias("anchor"), genre, ppos.alias("ppos"), ngi.alias("ngi"),
                 key("n").alias("hn"))
    neg_sizes = g_idx.select(F.col("gi").alias("ngi"), F.col("n_g").alias("n_ng"))
    a = _join_genres(a, neg_sizes, ["ngi"], n_genres).withColumn("npos", F.pmod(F.col("hn"), F.col("n_ng")))
    by_pos = pos.select(F.col(genre), F.col("pos").alias("ppos"), F.col(id_col).alias("positive"))
    by_gi = _join_genres(pos, g_idx.select(genre, "gi"), [genre], n_genres).select(F.col("gi").alias("ngi"), F.col("pos").alias("npos"),
                                                               F.col(id_col).alias("negative"))
    return a.join(by_pos, [genre, "ppos"]).join(by_gi, ["ngi", "npos"]).select("epoch", "anchor", "positive", "negative")


def _dist(x, y, eps=1e-6):
    d = x - y + eps
    return np.sqrt((d * d).sum(axis=1)), d


def forward_cache(m: GatedModel, A: np.ndarray, T: np.ndarray, mask: np.ndarray | None = None) -> dict:
    """Forward pass and what the backward pass needs; ``mask`` scales the gate's hidden units (dropout)."""
    Wa, ba = m.params["audio"]
    Wt, bt = m.params["text"]
    W1, b1 = m.params["gate1"]
    W2, b2 = m.params["gate2"]
    za, zt = A @ Wa.T + ba, T @ Wt.T + bt
    pa, pt = np.maximum(za, 0), np.maximum(zt, 0)
    g = np.concatenate([pa, pt], axis=1)
    z1 = g @ W1.T + b1
    h = np.maximum(z1, 0) if mask is None else np.maximum(z1, 0) * mask
    al = 1.0 / (1.0 + np.exp(-(h @ W2.T + b2)))
    f = al * pa + (1 - al) * pt
    raw = np.sqrt((f * f).sum(axis=1, keepdims=True))
    nrm = np.maximum(raw, 1e-12)
    return dict(A=A, T=T, mask=mask, za=za, zt=zt, pa=pa, pt=pt, g=g, z1=z1, h=h, al=al, f=f, raw=raw, nrm=nrm, e=f / nrm)


def backward(m: GatedModel, c: dict, de: np.ndarray, grads: dict) -> None:
    e, nrm, raw = c["e"], c["nrm"], c["raw"]
    df = np.where(raw > 1e-12, (de - e * (de * e).sum(axis=1, keepdims=True)) / nrm, de / nrm)
    al, pa, pt = c["al"], c["pa"], c["pt"]
    dpa = al * df
    dpt = (1 - al) * df
    dal = (df * (pa - pt)).sum(axis=1, keepdims=True)
    dz2 = dal * al * (1 - al)
    W1, _ = m.params["gate1"]
    W2, _ = m.params["gate2"]
    grads["gate2"][0] += dz2.T @ c["h"]
    grads["gate2"][1] += dz2.sum(axis=0)
    dz1 = (dz2 @ W2) * (c["z1"] > 0)
    if c["mask"] is not None:
        dz1 = dz1 * c["mask"]
    grads["gate1"][0] += dz1.T @ c["g"]
    grads["gate1"][1] += dz1.sum(axis=0)
    dg = dz1 @ W1
    E = pa.shape[1]
    dpa = dpa + dg[:, :E]
    dpt = dpt + dg[:, E:]
    dza = dpa * (c["za"] > 0)
    dzt = dpt * (c["zt"] > 0)
    grads["audio"][0] += dza.T @ c["A"]
    grads["audio"][1] += dza.sum(axis=0)
    grads["text"][0] += dzt.T @ c["T"]
    grads["text"][1] += dzt.sum(axis=0)


def triplet_loss_and_grads(m: GatedModel, Aa, Ta, Ap, Tp, An, Tn, margin: float, masks=(None, None, None)):
    """Sum of triplet margin losses of a batch and the gradient sums of every parameter."""
    ca, cp, cn = (forward_cache(m, A, T, mask) for (A, T), mask in zip(((Aa, Ta), (Ap, Tp), (An, Tn)), masks))
    dap, vp = _dist(ca["e"], cp["e"])
    dan, vn = _dist(ca["e"], cn["e"])
    l = np.maximum(dap - dan + margin, 0.0)
    act = (l > 0)[:, None].astype(np.float64)
    gp = vp / np.maximum(dap, 1e-12)[:, None] * act
    gn = vn / np.maximum(dan, 1e-12)[:, None] * act
    grads = {k: [np.zeros_like(W), np.zeros_like(b)] for k, (W, b) in m.params.items()}
    backward(m, ca, gp - gn, grads)
    backward(m, cp, -gp, grads)
    backward(m, cn, gn, grads)
    cos = lambda x, y: (x * y).sum(axis=1)  # noqa: E731  (unit vectors)
    return float(l.sum()), grads, float(cos(ca["e"], cp["e"]).sum()), float(cos(ca["e"], cn["e"]).sum())


def _flat_names(m: GatedModel):
    return [(k, j) for k in m.params for j in (0, 1)]


def train(trip_vectors: DataFrame, model: GatedModel, *, epochs: int, lr: float = 7e-4, margin: float = 0.2,
          weight_decay: float = 0.01, patience: int = 3, factor: float = 0.2,
          betas=(0.9, 0.999), adam_eps: float = 1e-8, epoch_col: str = "epoch"):
    """M6: AdamW on full-epoch gradients computed on executors.

    ``trip_vectors``: (epoch, a_audio, a_text, p_audio, p_text, n_audio, n_text).
    Returns (trained model, list of per-epoch monitor dicts).
    """
    spark = trip_vectors.sparkSession
    m = copy.deepcopy(model)
    names = _flat_names(m)
    mom = {n: np.zeros_like(m.params[n[0]][n[1]]) for n in names}
    vel = {n: np.zeros_like(m.params[n[0]][n[1]]) for n in names}
    best, bad, history = np.inf, 0, []
    schema = "name string, g array<double>"
    for ep in range(epochs):
        bc = spark.sparkContext.broadcast(m)

        def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mm, total = bc.value, {}
            for pdf in it:
                if pdf.empty:
                    continue
                st = lambda c: np.stack([np.asarray(v, dtype=np.float64) for v in pdf[c].values])
                loss, grads, ps, ns = triplet_loss_and_grads(mm, st("a_audio"), st("a_text"), st("p_audio"),
                                                             st("p_text"), st("n_audio"), st("n_text"), margin)
                sums = {f"{k}:{j}": grads[k][j].ravel() for k in grads for j in (0, 1)}
                sums["__mon"] = np.array([loss, ps, ns, float(len(pdf))])
                total = {name: total[name] + g if name in total else g for name, g in sums.items()}
            if total:  # one gradient a task
                yield pd.DataFrame({"name": list(total), "g": [g.tolist() for g in total.values()]})

        batch = trip_vectors.where(F.col(epoch_col) == ep)
        part = batch.mapInPandas(fn, schema)
        summed = (part.select("name", array_to_vector("g").alias("v")).groupBy("name")
                      .agg(Summarizer.sum(F.col("v")).alias("s")).select("name", vector_to_array("s").alias("s")))
        got = {r["name"]: np.asarray(r["s"]) for r in summed.collect()}  # bounded by the model size
        bc.unpersist()
        loss_sum, pos_sum, neg_sum, n = got["__mon"]
        n = max(n, 1.0)
        t = ep + 1
        for k, j in names:
            g = got[f"{k}:{j}"].reshape(m.params[k][j].shape) / n
            w = m.params[k][j]
            mom[(k, j)] = betas[0] * mom[(k, j)] + (1 - betas[0]) * g
            vel[(k, j)] = betas[1] * vel[(k, j)] + (1 - betas[1]) * g * g
            mh = mom[(k, j)] / (1 - betas[0] ** t)
            vh = vel[(k, j)] / (1 - betas[1] ** t)
            w = w * (1 - lr * weight_decay)
            w = w - lr * mh / (np.sqrt(vh) + adam_eps)
            m.params[k] = tuple(w if jj == j else m.params[k][jj] for jj in (0, 1))
        avg = loss_sum / n
        history.append({"epoch": ep, "loss": avg, "pos_sim": pos_sum / n, "neg_sim": neg_sum / n, "lr": lr})
        if avg < best:
            best, bad = avg, 0
        else:
            bad += 1
            if bad > patience:
                lr, bad = lr * factor, 0
    return m, history


def monitors(trip_emb: DataFrame, margin: float = 0.2, eps: float = 1e-6) -> DataFrame:
    """M4: per epoch mean positive / negative cosine and mean triplet loss."""
    def dist(x, y):
        return F.sqrt(F.aggregate(F.zip_with(x, y, lambda u, v: (u - v + eps) * (u - v + eps)),
                                  F.lit(0.0), lambda s, z: s + z))
    a, p, n = F.col("a_emb"), F.col("p_emb"), F.col("n_emb")
    loss = F.greatest(dist(a, p) - dist(a, n) + F.lit(margin), F.lit(0.0))
    return trip_emb.groupBy("epoch").agg(F.avg(cosine(a, p)).alias("pos_sim"), F.avg(cosine(a, n)).alias("neg_sim"),
                                         F.avg(loss).alias("loss"))
