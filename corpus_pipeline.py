"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, line_dedup, piece_bpe, quality_rff, simhash
from cadenza.llm.common import free_name, prepare, read, text_of
from cadenza.session import shared_path


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, of the text as it now is."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    prepare(spark)
    return quality_rff.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share."""
    prepare(spark)
    return _with_length(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    prepare(spark)
    return simhash.keep_one(docs, shingle=4, radius=4)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly passages go."""
    prepare(spark)
    return _with_length(decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (end id included) and the text decoded from them."""
    prepare(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", "ids", "n_tokens")]
    name = free_name(docs, "_pieces")
    both = piece_bpe.round_trip_column(text_of(docs), public_tokenizers.path("piece_bpe_32k.model"))
    encoded = docs.select(*others, both.alias(name))
    return encoded.select(*others, f"{name}.text", F.size(f"{name}.ids").cast("bigint").alias("n_tokens"), f"{name}.ids")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("sentencepiece encoding and decoding", pieces),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"llm-stage-{i}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
