"""Dense numbers in sort order, without a window over the whole table.

Rows are dealt to ranges and sorted inside them; every task numbers its own
rows, and the sizes of the earlier ranges (one number a partition) are added.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import shared_path


def number_by_range(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """``df`` with ``out`` = 0, 1, 2 .. in the order of ``cols`` (ascending, nulls first).

    The locally numbered rows are written once to the shared folder, so sizes
    and numbers come from the same ranges whatever happens to an executor.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_part", F.spark_partition_id())

    def number(batches):
        at = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows), pa.int64())], names=[*b.schema.names, "_at"])
            at += b.num_rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", _at bigint"
    path = shared_path(spark, "numbered")
    dealt.mapInArrow(number, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    table = spark.createDataFrame(offsets, "_part int, _before bigint")
    return rows.join(F.broadcast(table), "_part").select(*df.columns, (F.col("_before") + F.col("_at")).alias(out))
