"""Records of delimited text files whose quoted fields may hold line feeds, read in splits.

A split does not know whether it begins inside a quoted field.  So every line is
read under both assumptions, in one pass that keeps two running states; the
split's effect (state at its end for each state at its start) is one row.
Composed in file order, these rows tell where each split really starts, and
with that which lines begin a record.  Only records of several lines are
gathered, by the place of their first line, also across a split border.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import shared_path

#: What is left of a quoted part, with its closing quote.
_CLOSE = re.compile(r'(?:[^"]|"")*+"')


def ends_quoted(line: str, sep: str, quoted: bool) -> bool:
    """Whether a line that starts inside or outside a quoted field ends inside one; a quote opens at the start of a field only."""
    at = 0
    if quoted:
        m = _CLOSE.match(line)
        if not m:
            return True
        at = m.end()
    elif line.startswith('"'):
        m = _CLOSE.match(line, 1)
        if not m:
            return True
        at = m.end()
    while (j := line.find(sep, at)) >= 0:
        at = j + len(sep)
        if line.startswith('"', at):
            m = _CLOSE.match(line, at + 1)
            if not m:
                return True
            at = m.end()
    return False


_LINES = "file string, block bigint, place bigint, value string, in0 boolean, in1 boolean, out0 boolean, out1 boolean, key0 bigint, key1 bigint"


def _scanned(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Lines with, for a split that starts outside (0) or inside (1) quotes: state before and after, and place of the record's first line (-1: before the split)."""
    def scan(batches):
        at, states, keys = None, (False, True), [-1, -1]
        for b in batches:
            rows = []
            for file, block, place, value in zip(*(b[c].to_pylist() for c in ("file", "block", "place", "value"))):
                if (file, block) != at:
                    at, states, keys = (file, block), (False, True), [-1, -1]
                keys = [k if q else place for k, q in zip(keys, states)]
                after = states if '"' not in value else tuple(ends_quoted(value, sep, q) for q in states)
                rows.append((file, block, place, value, *states, *after, *keys))
                states = after
            cols = list(zip(*rows)) if rows else [[]] * 10
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.bool_()] * 4, *[pa.int64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in _LINES.split(", ")])

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    out = shared_path(spark, "records")
    lines.mapInArrow(scan, _LINES).write.parquet(out)
    return spark.read.schema(_LINES).parquet(out)


def read_records(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """(file, first, value): one row a record, line feeds in quoted fields kept; ``first`` marks a file's first record."""
    lines = _scanned(spark, path, sep)
    ends = lines.groupBy("file", "block").agg(F.max_by(F.struct("out0", "out1", "key0", "key1"), "place").alias("e"), F.min("place").alias("first"))
    # one row a split: what each split starts with, and the record that is open there
    starts, now = [], {}
    for r in sorted(ends.collect(), key=lambda r: (r["file"], r["block"])):
        inside, key = now.get(r["file"], (False, -1))
        starts.append((r["file"], r["block"], inside, key, r["first"] if r["block"] == 0 else -1))
        last = r["e"]["key1"] if inside else r["e"]["key0"]
        now[r["file"]] = (r["e"]["out1"] if inside else r["e"]["out0"], last if last >= 0 else key)
    table = spark.createDataFrame(starts, "file string, block bigint, inside boolean, open bigint, head bigint")
    placed = lines.join(F.broadcast(table), ["file", "block"])
    key = F.when(F.col("inside"), F.col("key1")).otherwise(F.col("key0"))
    placed = placed.select("file", "block", "place", "value", "head", F.when(key >= 0, key).otherwise(F.col("open")).alias("key"),
                           F.when(F.col("inside"), F.col("out1")).otherwise(F.col("out0")).alias("goes_on"))
    # a record of one line begins and ends there; lines of others meet by the place of the first
    alone = placed.where("key = place and not goes_on").select("file", (F.col("place") == F.col("head")).alias("first"), "value")
    parts = placed.where("key <> place or goes_on").groupBy("file", "key").agg(F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("l"), F.max(F.col("key") == F.col("head")).alias("first"))
    return alone.unionByName(parts.select("file", "first", F.array_join("l.value", "\n").alias("value")))
