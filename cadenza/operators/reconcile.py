"""Catalogue reconciliation: ordered deduplication, unions and enrichment joins.

Keep-first / keep-last are written as ``min``/``max`` of a struct whose
leading fields are the order key.  That is a hash aggregate with a partial
(map-side) step, so a key holding a third of all rows is collapsed to one
row per input partition before the shuffle instead of being sorted in one
task, and the result does not depend on row arrival order.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import LYRICS_NOT_FOUND, match_key


def _keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    payload = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)],
                      *[F.col(c) for c in payload])
    out = df.groupBy(*keys).agg(pick(packed).alias("__r"))
    return out.select(*keys, *[F.col("__r")[c].alias(c) for c in payload]).select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ``order`` (ascending); null keys form one group."""
    return _keep_one(df, keys, order, F.min)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """D3: last row per key by ``order`` (later sources override earlier ones)."""
    return _keep_one(df, keys, order, F.max)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by column name, then distinct on every column."""
    return a.unionByName(b).distinct()


def union_all(*dfs: DataFrame) -> DataFrame:
    """Concatenate sources by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def semi_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key occurs in ``b`` (duplicates of ``a`` kept).

    ``b`` is reduced to its distinct keys first (partial aggregation before the
    shuffle), so a key repeated in a third of ``b`` is shuffled once per partition.
    """
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi")


def chord_merge(main: DataFrame, side: DataFrame, *, pair: str = "pair",
                title: str = "title", artist: str = "artist",
                prog: str = "chord_progression", side_order: Sequence[str] = ("seq",)) -> DataFrame:
    """Set the progression of main songs matched in the paired side input.

    Keys are ``(pair, lower(trim(title)), lower(trim(artist)))``; later side
    rows win; a matched null progression still overwrites; unmatched songs
    keep theirs.  Adds ``matched`` boolean.
    """
    s = side.select(F.col(pair).alias("__pair"),
                    match_key(title).alias("__tk"), match_key(artist).alias("__ak"),
                    *[F.col(c) for c in side_order],
                    F.col(prog).alias("__prog"))
    s = keep_last(s, ["__pair", "__tk", "__ak"], list(side_order)).drop(*side_order)
    m = main.withColumn("__tk", match_key(title)).withColumn("__ak", match_key(artist))
    j = m.join(s.withColumn("__hit", F.lit(True)),
               (m[pair] == s["__pair"]) & (m["__tk"] == s["__tk"]) & (m["__ak"] == s["__ak"]),
               "left")
    matched = F.coalesce(F.col("__hit"), F.lit(False))
    return (j.withColumn(prog, F.when(matched, F.col("__prog")).otherwise(m[prog]))
             .withColumn("matched", matched)
             .select(*main.columns, "matched"))


def enrich_lyrics(pairs: DataFrame, lyrics: DataFrame, keys=("artist", "title"),
                  text: str = "lyrics") -> DataFrame:
    """Every pair gets its lyrics or the not-found sentinel."""
    return (pairs.join(lyrics.select(*keys, text), list(keys), "left")
                 .withColumn(text, F.coalesce(F.col(text), F.lit(LYRICS_NOT_FOUND))))


def align(prepped: DataFrame, raw: DataFrame, key: str = "song_id") -> DataFrame:
    """Raw rows restricted to the prepared rows, matched by key (never by position)."""
    return raw.join(prepped.select(key), key, "inner")
