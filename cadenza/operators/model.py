"""Gated two-modality embedding: projection, gate, fusion; batch scoring.

Weights are a small artifact (a few thousand floats) held on the driver and
broadcast once; scoring is one ``mapInPandas`` pass over Arrow batches, so
a whole library (or a stream) is scored without any shuffle.

Default weights follow a closed formula, ``W[i][j] = sin(31 i + 17 j + o) /
sqrt(fan_in)`` and ``b[i] = 0.1 cos(13 i + o)`` with a per-layer offset o,
so any engine can rebuild the same model from ``range()``.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

LAYERS = ("audio", "text", "gate1", "gate2")
OFFSETS = {"audio": 1, "text": 2, "gate1": 3, "gate2": 4}


def formula_layer(n_out: int, n_in: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(n_out)[:, None]
    j = np.arange(n_in)[None, :]
    W = np.sin(31 * i + 17 * j + offset) / np.sqrt(n_in)
    b = 0.1 * np.cos(13 * np.arange(n_out) + offset)
    return W, b


@dataclass
class GatedModel:
    audio_dim: int
    text_dim: int
    embedding_dim: int = 16
    gate_hidden: int = 8
    params: dict = field(default_factory=dict)

    @classmethod
    def from_formula(cls, audio_dim, text_dim, embedding_dim=16, gate_hidden=8) -> "GatedModel":
        m = cls(audio_dim, text_dim, embedding_dim, gate_hidden)
        m.params = {
            "audio": formula_layer(embedding_dim, audio_dim, OFFSETS["audio"]),
            "text": formula_layer(embedding_dim, text_dim, OFFSETS["text"]),
            "gate1": formula_layer(gate_hidden, 2 * embedding_dim, OFFSETS["gate1"]),
            "gate2": formula_layer(1, gate_hidden, OFFSETS["gate2"]),
        }
        return m

    # ---- numpy forward pass (runs inside executor tasks) ----
    def project(self, X: np.ndarray, which: str) -> np.ndarray:
        W, b = self.params[which]
        return np.maximum(X @ W.T + b, 0.0)

    def forward(self, A: np.ndarray, T: np.ndarray):
        pa = self.project(A, "audio")
        pt = self.project(T, "text")
        W1, b1 = self.params["gate1"]
        W2, b2 = self.params["gate2"]
        h = np.maximum(np.concatenate([pa, pt], axis=1) @ W1.T + b1, 0.0)  # dropout is training-only
        alpha = 1.0 / (1.0 + np.exp(-(h @ W2.T + b2)))
        fused = alpha * pa + (1.0 - alpha) * pt
        norm = np.maximum(np.sqrt((fused * fused).sum(axis=1, keepdims=True)), 1e-12)
        return pa, pt, alpha[:, 0], fused / norm


def _stack(col: pd.Series, dim: int) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, dim))
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.values])


def score(df: DataFrame, model: GatedModel, audio: str = "audio", text: str = "text") -> DataFrame:
    """M1-M3: adds proj_audio, proj_text, alpha and final_embedding to every row.

    Works unchanged on a streaming DataFrame (stateless per batch).
    """
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(model)
    vec = ArrayType(DoubleType())
    out_schema = StructType(list(df.schema.fields) + [
        StructField("proj_audio", vec), StructField("proj_text", vec),
        StructField("alpha", DoubleType()), StructField("final_embedding", vec)])

    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = bc.value
        for pdf in it:
            if pdf.empty:
                continue
            A = _stack(pdf[audio], m.audio_dim)
            T = _stack(pdf[text], m.text_dim)
            pa, pt, alpha, fe = m.forward(A, T)
            pdf = pdf.copy()
            pdf["proj_audio"] = list(pa)
            pdf["proj_text"] = list(pt)
            pdf["alpha"] = alpha
            pdf["final_embedding"] = list(fe)
            yield pdf

    return df.mapInPandas(fn, out_schema)


def explode_vector(df: DataFrame, id_col: str, *vecs: str) -> DataFrame:
    """(id, pos, v1, v2, ...) long form of equal-length vectors."""
    z = F.arrays_zip(*[F.col(v) for v in vecs])
    e = df.select(id_col, F.posexplode(z).alias("pos", "z"))
    return e.select(id_col, F.col("pos").cast("long").alias("pos"),
                    *[F.col(f"z.{v}").alias(v) for v in vecs])
