"""Sorts, limits and top-k per group with deterministic ties."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import last_word


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                    rank: str = "rank") -> DataFrame:
    """``row_number() <= n`` per group; planned as WindowGroupLimit (partial + final)."""
    w = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Global top-n (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def keyword_search(songs: DataFrame, prompt: str, *, title: str, order: str,
                   cap: int = 15, fallback_n: int = 5) -> DataFrame:
    """P5: songs whose title contains the prompt's last word (case-insensitive).

    When nothing matches, the first ``fallback_n`` songs are returned; at most
    ``cap`` rows.  Only the hit count (one number) reaches the driver.
    """
    kw = prompt.split(" ")[-1].lower()
    hits = songs.where(F.coalesce(F.lower(title).contains(kw), F.lit(False)))
    if hits.limit(1).count() > 0:
        return hits.orderBy(order).limit(cap)
    return songs.orderBy(order).limit(min(fallback_n, cap))


def limit_then_filter(df: DataFrame, order: Sequence[Column], first: int, cond: Column, final: int) -> DataFrame:
    """Global top ``first``, then the filter, then ``final`` (may return fewer)."""
    return df.orderBy(*order).limit(first).where(cond).orderBy(*order).limit(final)


def arg_extremes(df: DataFrame, value: str, id_col: str, group: Sequence[str] = ()) -> DataFrame:
    """T5: id with the lowest and the highest value (ties by smallest id).

    ``min``/``max`` over (value, id) structs: a partial aggregate, no sort.
    """
    lo = F.min(F.struct(F.col(value).alias("v"), F.col(id_col).alias("i")))
    hi = F.max(F.struct(F.col(value).alias("v"), (-F.col(id_col)).alias("i")))
    g = df.groupBy(*group) if group else df
    r = g.agg(lo.alias("__lo"), hi.alias("__hi"))
    return r.select(*group,
                    F.col("__lo.i").alias(f"min_{value}_id"), F.col("__lo.v").alias(f"min_{value}"),
                    (-F.col("__hi.i")).alias(f"max_{value}_id"), F.col("__hi.v").alias(f"max_{value}"))
