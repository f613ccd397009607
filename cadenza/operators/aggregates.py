"""Aggregations over catalogue and vector tables.

All are declarative aggregates (partial aggregation before the shuffle);
nothing is collected into one group.
"""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.numbering import number_by_range


def run_counts(df: DataFrame, key_cols: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """A10: total rows, distinct keys and one ``count_if`` per flag, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_total"),
                  F.count_distinct(F.struct(*key_cols)).alias("n_unique"),
                  *[F.count_if(c).alias(n) for n, c in flags.items()])


def top_values(df: DataFrame, col: str, n: int, count_name: str = "n") -> DataFrame:
    """The n most frequent values (ties by value)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
              .orderBy(F.col(count_name).desc(), F.col(col)).limit(n))


def nan_to_null(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def minmax_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A3: per-column min and max, NaN ignored (one row)."""
    aggs = []
    for c in cols:
        aggs += [F.min(nan_to_null(c)).alias(f"{c}_min"), F.max(nan_to_null(c)).alias(f"{c}_max")]
    return df.agg(*aggs)


def standard_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: per-column mean and population standard deviation (one row)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.agg(*aggs)


def label_index(df: DataFrame, label: str, out: str = "label_id") -> DataFrame:
    """A5: labels numbered 0..n-1 in alphabetical order (table of distinct labels).

    The labels are reduced by a partial aggregate first and numbered by ranges.
    """
    numbered = number_by_range(df.select(label).distinct(), [label], out)
    return numbered.withColumn(out, F.col(out).cast("int"))


def vector_mean(df: DataFrame, vec: str, group: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean of equal-length vectors, optionally per group.

    One ``Summarizer`` aggregate: partial sums of whole vectors, no row per position.
    """
    v = df.where(F.col(vec).isNotNull()).select(*group, array_to_vector(F.col(vec).cast("array<double>")).alias("__v"))
    return v.groupBy(*group).agg(Summarizer.mean(F.col("__v")).alias("__m")).select(*group, vector_to_array("__m").alias(f"{vec}_mean"))
