"""The streaming scorer gives the same rows as the batch scorer."""
from pyspark.sql import functions as F

from cadenza.operators.model import GatedModel, score
from cadenza.sources.tables import read_table
from cadenza.streaming.scoring import embedding_stream, score_stream
from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    m = GatedModel.from_formula(32, 32, 16, 8)
    q = score_stream(embedding_stream(spark, SF_SMALL), m, name="scored_test")
    q.awaitTermination(120)
    got = {r["song_id"]: round(r["alpha"], 9) for r in spark.sql("SELECT * FROM scored_test").collect()}
    e = read_table(spark, SF_SMALL, "embeddings")
    v = F.col("embedding").cast("array<double>")
    b = score(e.select(F.col("vec_id").alias("song_id"), F.slice(v, 1, 32).alias("audio"),
                       F.slice(v, 33, 32).alias("text")), m)
    want = {r["song_id"]: round(r["alpha"], 9) for r in b.collect()}
    assert got == want and len(got) == e.count()
