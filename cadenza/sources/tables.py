"""Driver tables and the catalogue roles they play.

Every role is a projection of a driver table, so Parquet column pruning and
filter pushdown reach the scan.  Roles (see SURVEY 7.3):

* vectors   - ``embeddings(vec_id, embedding, label)``
* catalogue - ``part``: title=p_name, artist=p_brand, genre=p_type,
              popularity=p_retailprice, lyrics from ``documents`` by id
* interactions - customer x part from ``orders`` + ``lineitem``
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, vec array<double>, label int, genre string)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"),
                    F.col("embedding").cast("array<double>").alias("vec"),
                    F.col("label"),
                    F.concat(F.lit("g"), F.col("label").cast("string")).alias("genre"))


def catalogue(spark: SparkSession, sf_dir: str, lyrics: bool = False) -> DataFrame:
    """Song-shaped view of ``part``.

    song_id, title, artist, genre, popularity, size, chord_progression
    (map section -> chords joined by ' - '); with ``lyrics=True`` also the
    lyrics (nullable) from ``documents`` - a left join Catalyst cannot drop,
    so it is only added when asked for.
    """
    p = read_table(spark, sf_dir, "part")
    d = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("song_id"), F.col("text").alias("lyrics"))
    songs = p.select(
        F.col("p_partkey").alias("song_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("genre"),
        F.col("p_retailprice").alias("popularity"),
        F.col("p_size").cast("double").alias("size"),
        F.create_map(
            F.lit("main"), F.regexp_replace("p_name", " ", " - "),
            F.lit("outro"), F.concat_ws(" - ", F.lower("p_type"), F.col("p_brand")),
        ).alias("chord_progression"),
    )
    return songs.join(d, "song_id", "left") if lyrics else songs


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user_id, item_id, rating=1.0): customers who bought a part."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
              .distinct()
              .withColumn("rating", F.lit(1.0)))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored-library input: vectors joined to the catalogue by id.

    song_id, title, artist, genre, popularity, raw scalar features
    (energy, valence, acousticness), chord_main, audio = dims 1..32 and
    text = dims 33..64 of the embedding.
    """
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type",
                                                 "p_retailprice", "p_size")
    v = F.col("embedding").cast("array<double>")
    return e.join(p, e.vec_id == p.p_partkey).select(
        F.col("vec_id").alias("song_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
        F.col("p_type").alias("genre"), F.col("p_retailprice").alias("popularity"),
        (F.col("p_size") / 50.0).alias("energy"),
        ((F.col("p_retailprice") - F.floor(F.col("p_retailprice") / 100) * 100) / 100.0).alias("valence"),
        F.least(F.lit(1.0), F.abs(F.element_at(v, 1)) * 5).alias("acousticness"),
        F.regexp_replace("p_name", " ", " - ").alias("chord_main"),
        F.slice(v, 1, 32).alias("audio"), F.slice(v, 33, 32).alias("text"))
