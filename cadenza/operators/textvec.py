"""Text vectors: hashed TF-IDF embedding and lexicon sentiment, for whole texts.

The pretrained sentence and sentiment networks of the original pipeline are
not available; these are honest, deterministic stand-ins with the same
shapes (``embedding ++ [neg, neu, pos]``).  Tokens are hashed into D buckets
with md5 (reproducible by any engine), document frequencies are one
aggregate, and each document's vector is assembled from at most D
(bucket, weight) pairs - no per-document list grows with the text.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import strip
from cadenza.operators.sampling import hash32
from cadenza.session import spread

DIM = 32
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"

# ---- fixed values (ours): sentiment lexicon, four languages ----
POSITIVE_WORDS = ["love", "good", "great", "happy", "joy", "beautiful", "amor", "bien", "bueno", "feliz",
                  "alegría", "bon", "heureux", "joie", "belle", "gut", "glücklich", "liebe", "schön", "freude"]
NEGATIVE_WORDS = ["hate", "bad", "sad", "pain", "cry", "alone", "odio", "mal", "triste", "dolor", "solo",
                  "haine", "mauvais", "douleur", "seul", "hass", "schlecht", "traurig", "schmerz", "allein"]
# -----------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-case word tokens of the whole text (empty pieces dropped)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), "")


def bucket(tok: Column, dim: int = DIM) -> Column:
    return F.pmod(hash32(tok), F.lit(dim)).cast("int")


def fit_idf(docs: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> dict:
    """Document frequency per bucket -> idf = ln((N + 1) / (df + 1)); a D-sized artifact."""
    n = docs.count()
    t = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc"), F.explode(tokens(F.col(text_col))).alias("tok"))
    b = t.select("doc", bucket(F.col("tok"), dim).alias("b")).distinct()
    rows = b.groupBy("b").agg(F.count(F.lit(1)).alias("df")).collect()  # at most `dim` rows (bucket ids)
    df = {r["b"]: r["df"] for r in rows}
    return {"n": n, "dim": dim, "idf": [math.log((n + 1) / (df.get(i, 0) + 1)) for i in range(dim)]}


def embed(docs: DataFrame, id_col: str, text_col: str, idf: dict, out: str = "embedding") -> DataFrame:
    """V7: (id, embedding) unit-length TF-IDF vector per document; blank text -> zeros."""
    dim = idf["dim"]
    t = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("__id"), F.explode(tokens(F.col(text_col))).alias("tok"))
    tf = t.select("__id", bucket(F.col("tok"), dim).alias("b")).groupBy("__id", "b").agg(F.count(F.lit(1)).alias("tf"))
    idf_arr = F.array(*[F.lit(float(x)) for x in idf["idf"]])
    w = tf.withColumn("w", F.col("tf") * F.element_at(idf_arr, F.col("b") + 1))
    per = w.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"),
                                F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                        lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0.0))
                        / F.greatest(F.col("nrm"), F.lit(1e-12)))
    vec = per.select("__id", dense.alias(out))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return (docs.select(F.col(id_col).alias("__id")).join(vec, "__id", "left")
                .select(F.col("__id").alias(id_col), F.coalesce(F.col(out), zeros).alias(out)))


def sentiment(docs: DataFrame, id_col: str, text_col: str, out: str = "sentiment") -> DataFrame:
    """V8: [neg, neu, pos] with only the winning label's score set.

    Lexicon hits are counted per document (a broadcast lexicon join);
    positive if pos > neg, negative if neg > pos, else neutral.  Score: share
    of the winning side among hits; neutral scores 1.0 without hits, 0.5 on a tie.
    """
    lex = docs.sparkSession.createDataFrame(
        [(w, 1) for w in POSITIVE_WORDS] + [(w, -1) for w in NEGATIVE_WORDS], "tok string, pol int")
    t = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("__id"), F.explode(tokens(F.col(text_col))).alias("tok"))
    hits = t.join(F.broadcast(lex), "tok").groupBy("__id").agg(
        F.count_if(F.col("pol") > 0).alias("p"), F.count_if(F.col("pol") < 0).alias("n"))
    d = docs.select(F.col(id_col).alias("__id")).join(hits, "__id", "left") \
            .select("__id", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    tot = F.col("p") + F.col("n")
    vec = (F.when(F.col("p") > F.col("n"), F.array(F.lit(0.0), F.lit(0.0), F.col("p") / tot))
            .when(F.col("n") > F.col("p"), F.array(F.col("n") / tot, F.lit(0.0), F.lit(0.0)))
            .otherwise(F.array(F.lit(0.0), F.when(tot == 0, F.lit(1.0)).otherwise(F.lit(0.5)), F.lit(0.0))))
    return d.select(F.col("__id").alias(id_col), vec.alias(out))


def text_vector(docs: DataFrame, id_col: str, text_col: str, idf: dict, blank_sentiment=(0.0, 1.0, 0.0),
                out: str = "text_vec") -> DataFrame:
    """Embedding ++ sentiment; a blank text gets zeros ++ ``blank_sentiment``.

    New songs use [0, 1, 0]; prompts use all zeros.
    """
    e = embed(docs, id_col, text_col, idf, "__e")
    s = sentiment(docs, id_col, text_col, "__s")
    blank = docs.select(F.col(id_col), (F.length(strip(F.coalesce(F.col(text_col), F.lit("")))) == 0).alias("__blank"))
    j = blank.join(e, id_col).join(s, id_col)
    bs = F.array(*[F.lit(float(x)) for x in blank_sentiment])
    vec = F.when(F.col("__blank"), F.concat(F.array_repeat(F.lit(0.0), idf["dim"]), bs)) \
           .otherwise(F.concat("__e", "__s"))
    return j.select(id_col, vec.alias(out))
