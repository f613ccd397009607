"""Line dedup with hash ranges and per-document keep bitmaps.

Every line is reduced to a key and the key to 128 bits of hash; texts do not
travel with them.  Hashes are range-partitioned and sorted by hash, document
and position: the range bounds include the document, so one very common line
spreads over many partitions.  That index is written to the shared folder.
Common keys are found by partial counts, each occurrence outside the largest
document is marked, and the marks are gathered to one bitmap a document: 64
lines a word, words without a dropped line left out.

Only DataFrame functions are used.

Defined results: a null or empty text is one empty line; rows without a doc_id
keep all their lines and count for no key; exactly repeated rows count as one
document and get the same result; rows that share a doc_id and differ in text
count as documents of their own, and the largest doc_id keeps its lines in all
of them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import BLANKS, LOWER, UPPER, free_name, let, materialise, text_of

MIN_CHARS = 20
MIN_DOCS = 3
#: Parts of every key in the join that marks its occurrences, so that one common line does not meet in one task.
SALTS = 8


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_index(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, th, positions): where each document (row identity: doc_id, text hash) has each key."""
    text = text_of(docs)
    folded = lines_of(F.translate(text, UPPER, LOWER))
    keys = F.transform(folded, lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(BLANKS)).alias("key")))
    keys = F.filter(keys, lambda k: F.char_length(k["key"]) >= min_chars)
    hashes = F.transform(keys, lambda k: F.struct(F.xxhash64(k["key"]).alias("h1"), F.xxhash64(F.lit(7), k["key"]).alias("h2"), k["pos"].alias("pos")))
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("th"), F.explode(hashes).alias("x")).select("x.h1", "x.h2", "doc_id", "th", "x.pos")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(n, "h1", "h2", "doc_id", "th").sortWithinPartitions("h1", "h2", "doc_id", "th", "pos")
    # same partitioning: no further exchange
    return ranged.groupBy("h1", "h2", "doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, th, n_dropped, keep): map from word number to the keep bits of 64 lines, for documents that lose lines."""
    index = materialise(line_index(docs, min_chars), "lines")
    common = index.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    salted = index.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    every = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = salted.join(every, ["h1", "h2", "salt"]).where("doc_id < keeper").select("doc_id", "th", F.explode("positions").alias("pos"))
    words = lost.groupBy("doc_id", "th", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos").bitwiseAND(63))).alias("bits"))
    return words.groupBy("doc_id", "th").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, n_lines: str = "_n_lines", n_dropped: str = "_n_dropped") -> DataFrame:
    """``docs`` with the kept text in place of text, and two columns of line counts."""
    th, bid, bth, lost, keep = (free_name(docs, c) for c in ("_th", "_bid", "_bth", "_lost", "_keep"))
    marked = docs.withColumn(th, F.xxhash64(text_of(docs)))
    maps = bitmaps.select(F.col("doc_id").alias(bid), F.col("th").alias(bth), F.col("n_dropped").alias(lost), F.col("keep").alias(keep))
    joined = marked.join(maps, (marked["doc_id"] == maps[bid]) & (marked[th] == maps[bth]), "left")
    lines = lines_of(text_of(docs))
    n_words = F.shiftright(F.size(lines) - 1, 6)
    dense = F.transform(F.sequence(F.lit(0), n_words), lambda w: F.coalesce(F.element_at(keep, w), F.lit(-1).cast("bigint")))
    kept = let(dense, lambda bits: F.filter(lines, lambda line, i: F.getbit(F.element_at(bits, F.shiftright(i, 6) + 1), i.bitwiseAND(63)) == 1))
    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    cols = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*cols, F.size(lines).cast("bigint").alias(n_lines), F.coalesce(lost, F.lit(0).cast("bigint")).alias(n_dropped))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` (all columns) without common lines."""
    counts = [free_name(docs, c) for c in ("_n_lines", "_n_dropped")]
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), *counts).drop(*counts)
