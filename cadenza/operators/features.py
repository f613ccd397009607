"""Per-item feature vectors: scaling, chord multi-hot, excerpts, assembly.

Fitting is a small aggregation whose result (a handful of numbers per
column, or the vocabulary) is a bounded artifact; applying it is a pure
projection, so transforming a table never shuffles it.
"""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.aggregates import nan_to_null
from cadenza.operators.numbering import number_by_range
from cadenza.session import bounded_collect

# Vocabularies up to this are tested word by word in generated code, larger ones in a loop (same result).
CODEGEN_WORDS = 2_000
MFCC_DIM = 13
# Longest vector whose per-position statistics are collected as literals.
MAX_DIM = 65_536


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- chords
def section_texts(prog, sections: Sequence[str] | None = None) -> Column:
    """Section strings of a progression map as ``str(value)`` would give them.

    ``sections=None``: every section, a null value reads 'None'.  With named
    sections a missing one reads '' and a null one 'None'.  A null map
    (non-dict progression) has no sections.
    """
    m = _c(prog)
    if sections is None:
        texts = F.transform(F.map_values(m), lambda x: F.coalesce(x, F.lit("None")))
    else:
        texts = F.array(*[F.when(F.map_contains_key(m, s), F.coalesce(m[s], F.lit("None")))
                            .otherwise(F.lit("")) for s in sections])
    return F.when(m.isNull(), F.array().cast("array<string>")).otherwise(texts)


def chord_tokens(prog, sections: Sequence[str] | None = None) -> Column:
    """All chords of the chosen sections, split on ' - ' (tokens are not trimmed).

    Splitting every section and concatenating equals splitting the sections
    joined by ' - ' (an empty section still yields one '' token), so this is
    written without lambdas and stays in generated code.
    """
    m = _c(prog)
    empty = F.array().cast("array<string>")
    if sections is None:
        vals = F.map_values(m)
        joined = F.array_join(vals, " - ", "None")  # a null section reads 'None'
        return F.when(m.isNull() | (F.size(vals) == 0), empty).otherwise(F.split(joined, " - ", -1))
    texts = section_texts(prog, sections)
    return F.when(m.isNull(), empty).otherwise(F.split(F.array_join(texts, " - "), " - ", -1))


def fit_vocab(df: DataFrame, prog: str, sections: Sequence[str] | None = None) -> DataFrame:
    """A2: distinct chords sorted by code point, numbered from 0: (chord, idx).

    The distinct set is reduced by a partial aggregate first and numbered by ranges.
    """
    toks = df.select(F.explode(chord_tokens(prog, sections)).alias("chord")).distinct()
    return number_by_range(toks, ["chord"], "idx")


def multihot(df: DataFrame, prog: str, vocab: DataFrame, out: str = "harmonic_vector",
             sections: Sequence[str] | None = None) -> DataFrame:
    """V3/V4: 0/1 vector over the vocabulary; chords outside it are ignored.

    ``sections=None`` uses every section (batch build); ``['main']`` the new-song rule.
    """
    # the vocabulary is as wide as every vector that is returned, so the driver can hold it
    words = [r["chord"] for r in vocab.select("chord", "idx").orderBy("idx").toLocalIterator()]
    d = df.withColumn("__toks", chord_tokens(prog, sections))  # computed once per row
    if not words:
        vec = F.array().cast("array<int>")
    elif len(words) <= CODEGEN_WORDS:  # the same test per word; only small vocabularies fit generated code
        vec = F.array(*[F.array_contains("__toks", F.lit(w)).cast("int") for w in words])
    else:
        vec = F.transform(F.lit(words), lambda w: F.array_contains("__toks", w).cast("int"))
    return d.withColumn(out, vec).drop("__toks")


# ---------------------------------------------------------------- scaling
def fit_minmax(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    """A3: {col: (min, max)} with NaN ignored; one small row reaches the driver."""
    aggs = []
    for c in cols:
        aggs += [F.min(nan_to_null(c)).alias(f"{c}__min"), F.max(nan_to_null(c)).alias(f"{c}__max")]
    r = df.agg(*aggs).first()
    return {c: (r[f"{c}__min"], r[f"{c}__max"]) for c in cols}


def minmax_expr(c, lo, hi) -> Column:
    """V1: (x - min) / (max - min); a constant column maps to 0 (range taken as 1)."""
    x = _c(c).cast("double")
    if lo is None or hi is None:
        return x
    rng = float(hi) - float(lo)
    return (x - F.lit(float(lo))) / F.lit(rng if rng != 0 else 1.0)


def apply_minmax(df: DataFrame, stats: Mapping[str, tuple], suffix: str = "") -> DataFrame:
    for c, (lo, hi) in stats.items():
        df = df.withColumn(c + suffix, minmax_expr(c, lo, hi))
    return df


def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    """A4: {col: (mean, population std)}."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
    r = df.agg(*aggs).first()
    return {c: (r[f"{c}__m"], r[f"{c}__s"]) for c in cols}


def standard_expr(c, mean, std) -> Column:
    """V2: (x - mean) / std; zero std -> x - mean (= 0)."""
    s = float(std) if std else 1.0
    return (_c(c).cast("double") - F.lit(float(mean))) / F.lit(s)


def fit_vector_minmax(df: DataFrame, vec: str) -> tuple[list, list]:
    """Per-position min/max over rows whose vector is present (bounded by the dimension)."""
    e = df.where(F.col(vec).isNotNull()).select(F.posexplode(vec).alias("pos", "x"))
    rows = bounded_collect(e.groupBy("pos").agg(F.min(nan_to_null("x")).alias("lo"),
                                                F.max(nan_to_null("x")).alias("hi")).orderBy("pos"),
                           MAX_DIM, "vector positions")
    return [r["lo"] for r in rows], [r["hi"] for r in rows]


def valid_only_scale(df: DataFrame, vec: str, dim: int = MFCC_DIM, out: str | None = None) -> DataFrame:
    """V5: min-max scale vectors over valid rows only; missing -> zeros; none valid -> zeros."""
    out = out or vec
    lo, hi = fit_vector_minmax(df, vec)
    zeros = F.array_repeat(F.lit(0.0), dim)
    if not lo:
        return df.withColumn(out, zeros)
    lo_a = F.array(*[F.lit(float(v)) for v in lo])
    rg_a = F.array(*[F.lit(float(h - l) if h != l else 1.0) for l, h in zip(lo, hi)])
    scaled = F.transform(F.col(vec).cast("array<double>"),
                         lambda x, i: (x - F.element_at(lo_a, i + 1)) / F.element_at(rg_a, i + 1))
    return df.withColumn(out, F.coalesce(scaled, zeros))


# ---------------------------------------------------------------- vectors
def excerpt(arr, n: int) -> Column:
    """V6: first, middle and last n elements; the whole sequence when shorter than 3n."""
    a = _c(arr)
    size = F.size(a)
    mid = F.floor((size - n) / 2).cast("int")
    parts = F.concat(F.slice(a, 1, n), F.slice(a, mid + 1, n), F.slice(a, size - n + 1, n))
    return F.when(size < 3 * n, a).otherwise(parts)


def l2_normalise(v, eps: float = 1e-12) -> Column:
    """Unit length, norm floored at eps."""
    v = _c(v).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(eps)))


def assemble(*parts) -> Column:
    """V9: concatenate vector parts (arrays or scalars) in order as array<double>."""
    cols = []
    for p in parts:
        cols.append(p if isinstance(p, Column) else F.col(p))
    return F.concat(*[c.cast("array<double>") for c in cols])


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def dot_checksum(v) -> Column:
    """sum(x_i * (i + 1)): a position-sensitive summary used for comparisons."""
    return F.aggregate(F.transform(_c(v), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def dims_report(df: DataFrame, vec: str) -> DataFrame:
    """V9 check: min and max vector length (equal when the table is consistent)."""
    return df.agg(F.min(F.size(vec)).alias("min_dim"), F.max(F.size(vec)).alias("max_dim"))
