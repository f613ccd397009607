"""Deterministic hash draws: seeds, random recommendations, weighted samples.

Every random number is a function of (salt, ids) through md5, so a draw
is reproducible, independent of partitioning, survives task retries, and
the same numbers can be produced by any SQL engine with md5.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.numbering import number_by_range
from cadenza.session import spread

# Draws beyond k, for positions drawn twice.
SPARE_DRAWS = 16


def hash32(*parts) -> Column:
    """Unsigned 32-bit draw from md5 of the parts joined by ':' (as bigint)."""
    s = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def uniform01(*parts) -> Column:
    """Uniform draw in (0, 1)."""
    return (hash32(*parts) + F.lit(1)).cast("double") / F.lit(4294967297.0)


def sample_seeds(items: DataFrame, id_col: str, n: int, salt: int = 42) -> DataFrame:
    """N seeds by hash order (the limit is the sampling operator itself)."""
    return items.orderBy(hash32("seed", salt, F.col(id_col)), F.col(id_col)).limit(n)


def weighted_sample(df: DataFrame, group: str, item: str, weight: Column, n: int,
                    salt: int = 42) -> DataFrame:
    """Per group, n items without replacement, probability proportional to weight.

    Efraimidis-Spirakis: key = -ln(u) / w, keep the n smallest keys per group.
    The per-group limit plans as WindowGroupLimit, so a hot group is cut to n
    rows inside every input partition before the shuffle.
    """
    u = uniform01("es", salt, F.col(group), F.col(item))
    keyed = df.withColumn("es_key", F.round(-F.log(u) / weight, 9))
    w = Window.partitionBy(group).orderBy("es_key", item)
    return keyed.withColumn("draw_rank", F.row_number().over(w)).where(F.col("draw_rank") <= n)


def dense_order(items: DataFrame, id_col: str, salt: int) -> DataFrame:
    """(rec_id, pos): positions 0 .. n-1 in a hashed order over the whole table."""
    it = items.select(F.col(id_col).alias("rec_id"), hash32("rk", salt, F.col(id_col)).alias("hk"))
    return number_by_range(it, ["hk", "rec_id"], "pos").select("rec_id", "pos")


def drawn_positions(seed: Column, own: Column, n: int, k: int, salt: int) -> Column:
    """array<long>: the first k distinct positions below n of a seed's draws, its own left out (fewer if n is smaller)."""
    draws = k + SPARE_DRAWS

    @F.arrow_udf("array<long>")
    def drawn(seeds: pa.Array, owns: pa.Array) -> pa.Array:
        h52 = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:13], 16)
        out = []
        for x, own in zip(seeds.to_pylist(), owns.to_pylist()):
            found: dict[int, None] = {own: None}
            for t in range(draws):
                found[h52(f"rd:{salt}:{x}:{t}") % n] = None
                if len(found) > k:
                    break
            else:
                start = h52(f"so:{salt}:{x}")
                for t in range(draws, draws + k + 1):
                    found[(start + t) % n] = None
                    if len(found) > k:
                        break
            out.append(list(found)[1 : k + 1])
        return pa.array(out, pa.list_(pa.int64()))

    return drawn(seed, own)


def random_recs(items: DataFrame, seeds: DataFrame, *, id_col: str, seed_col: str, k: int,
                salt: int = 42) -> DataFrame:
    """K random other items per seed, without replacement.

    Items are numbered in a hashed order; a seed draws ``k + SPARE_DRAWS``
    positions independently over the whole catalogue, then k + 1 consecutive
    ones from a random start, which fill up where draws coincide.  The first
    k distinct positions other than its own are looked up by an equi-join, so
    every seed gets min(k, n - 1) items and the work is linear in the seeds.
    """
    n = items.count()
    order = dense_order(items, id_col, salt)
    own = order.select(F.col("rec_id").alias("seed_id"), F.col("pos").alias("own"))
    s = spread(seeds.select(F.col(seed_col).alias("seed_id")).join(own, "seed_id", "left"))
    s = s.select("seed_id", F.posexplode(drawn_positions(F.col("seed_id").cast("string"), F.coalesce("own", F.lit(-1)), n, k, salt)).alias("t", "pos"))
    return s.join(order, "pos").select("seed_id", "rec_id", (F.col("t") + 1).alias("rank"))
