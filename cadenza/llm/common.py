"""Helpers shared by the training-data operators."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import shared_path, ship_package

#: Rows per Arrow batch.  Whole texts travel in these batches, so the record count is what bounds a Python worker's memory.
ARROW_ROWS = 512

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: `[\x20\x09-\x0D]`, the blanks of all word and line rules here.
BLANKS = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors and bound the Arrow batches of whole texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many leading underscores as no column of ``df`` has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    Cuts the lineage: the table is on shared storage, so a lost executor
    costs at most the tasks it was running.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body`` may use it many times without it being evaluated again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """Maximal runs of characters other than `[\\x20\\x09-\\x0D]`."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def join_skewed(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, total: int, share: int = 10_000) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row a key) where some keys hold a large part of the ``total`` rows.

    ``weight`` names the column of ``facts`` with the rows of a key; it is
    dropped.  Keys of over total / share rows are at most ``share`` and are
    broadcast; every other key is small, so its shuffle is even.
    """
    hot = F.col(weight) * share > total
    heavy, light = facts.where(hot).drop(weight), facts.where(~hot).drop(weight)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on)
    return rows.join(F.broadcast(heavy), on).unionByName(rest)


def tables_by_key(batches, keys: list[str]):
    """Arrow batches sorted by integer ``keys`` as one table a key, one after another."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ks = np.stack([b[k].to_numpy() for k in keys], 1)
        cuts = [0, *(np.flatnonzero((ks[1:] != ks[:-1]).any(1)) + 1).tolist(), b.num_rows]
        if held and any(held[0][k][0].as_py() != int(v) for k, v in zip(keys, ks[0])):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            held.append(b.slice(s, e - s))
            if e < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
