"""Writers (K1-K6).  Outputs go to new paths; inputs are never overwritten or deleted."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> bool:
    """K1: CSV with header in the given column order; nothing is written for an empty table."""
    if df.limit(1).count() == 0:
        return False
    out = df.select(*(columns or df.columns))
    out.write.mode("errorifexists").option("header", True).csv(path)
    return True


def write_prepped(songs: DataFrame, vocab: DataFrame, scaler_stats: DataFrame, base: str) -> None:
    """K2: prepared songs, vocabulary and scaler statistics as Parquet tables."""
    songs.write.mode("errorifexists").parquet(f"{base}/songs_prepped")
    vocab.write.mode("errorifexists").parquet(f"{base}/vocab")
    scaler_stats.write.mode("errorifexists").parquet(f"{base}/scaler_stats")


def write_lyrics(df: DataFrame, path: str, fmt: str = "json") -> None:
    """K3: (artist, title, lyrics) rows."""
    df.select("artist", "title", "lyrics").write.mode("errorifexists").format(fmt).save(path)


def write_version(df: DataFrame, base: str, version: int) -> str:
    """K4: an updated catalogue goes to a new versioned path (Spark cannot overwrite what it reads)."""
    path = f"{base}/v{version:04d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def embedding_columns(df: DataFrame, vec: str, dim: int, prefix: str = "UMAP_") -> DataFrame:
    """K5: coordinates as columns ``UMAP_1..n`` next to label_id and label."""
    return df.select(*[F.col(vec)[i].alias(f"{prefix}{i + 1}") for i in range(dim)], "label_id", "label")


def write_embedding(df: DataFrame, vec: str, dim: int, path: str) -> None:
    embedding_columns(df, vec, dim).write.mode("errorifexists").option("header", True).csv(path)


def write_track_rows(df: DataFrame, path: str) -> int:
    """K6: track rows as JSON; returns the number of rows with parse problems."""
    df.write.mode("errorifexists").json(path)
    return df.agg(F.count_if(F.coalesce(F.col("parse_errors"), F.lit(False)))).first()[0]
