"""Structured Streaming scoring: the same stateless M1-M3 operator on a stream.

Vectors arriving as Parquet files are scored batch by batch with the
broadcast model (``mapInPandas`` works unchanged on a streaming DataFrame)
and appended to a sink.  The checkpoint lives in the shared folder named by
``spark.checkpoint.dir``, so a restarted query resumes where it stopped.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.model import GatedModel, score
from cadenza.session import shared_path

EMBEDDINGS_SCHEMA = "vec_id long, embedding array<float>, label int"


def embedding_stream(spark: SparkSession, folder: str, file_glob: str = "embeddings*.parquet",
                     max_files_per_trigger: int = 1) -> DataFrame:
    """Streaming read of vector files; audio = dims 1..32, text = dims 33..64."""
    s = (spark.readStream.schema(EMBEDDINGS_SCHEMA).option("pathGlobFilter", file_glob)
         .option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder))
    v = F.col("embedding").cast("array<double>")
    return s.select(F.col("vec_id").alias("song_id"), "label", F.slice(v, 1, 32).alias("audio"),
                    F.slice(v, 33, 32).alias("text"))


def score_stream(stream: DataFrame, model: GatedModel, sink: str = "memory", name: str = "scored",
                 path: str | None = None, checkpoint: str | None = None):
    """Start a query appending (song_id, alpha, final_embedding) for every arriving row."""
    spark = stream.sparkSession
    out = score(stream, model).select("song_id", "label", "alpha", "final_embedding")
    w = out.writeStream.outputMode("append").option("checkpointLocation",
                                                    checkpoint or shared_path(spark, f"stream-ckpt-{name}"))
    if sink == "memory":
        w = w.format("memory").queryName(name)
    else:
        w = w.format(sink).option("path", path or shared_path(spark, f"stream-out-{name}"))
    return w.trigger(availableNow=True).start()
