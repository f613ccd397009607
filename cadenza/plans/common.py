"""Shared inputs of the recommendation and evaluation queries (Spark + SQL)."""
from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import features as V
from cadenza.operators.sampling import weighted_sample
from cadenza.session import spread
from cadenza.sources.tables import catalogue, interactions

SALT = 42
# Songs beyond which vectors are built on all cores.
SPREAD_SONGS = 50_000


def song_items(spark, sf):
    """(item_id, genre, title, artist, popularity, popularity_score, lyrics, vec):
    catalogue songs with their assembled audio vector (V1 + V3 + zero MFCC slots)."""
    songs = catalogue(spark, sf)
    if songs.count() > SPREAD_SONGS:  # one file may hold them all
        songs = spread(songs)
    stats = V.fit_minmax(songs, ["size", "popularity"])
    vocab = V.fit_vocab(songs, "chord_progression")
    s = V.multihot(songs, "chord_progression", vocab, "hv")
    pop = V.minmax_expr("popularity", *stats["popularity"])
    vec = V.assemble(F.array(V.minmax_expr("size", *stats["size"]), pop), F.col("hv"), V.zeros(V.MFCC_DIM))
    return s.select(F.col("song_id").alias("item_id"), "genre", "title", "artist", "popularity",
                    pop.alias("popularity_score"), "chord_progression", vec.alias("vec"))


def popularity_scores(spark, sf):
    """(item_id, popularity_score): min-max scaled popularity of the catalogue."""
    songs = catalogue(spark, sf).select("song_id", "popularity")
    lo, hi = V.fit_minmax(songs, ["popularity"])["popularity"]
    return songs.select(F.col("song_id").alias("item_id"), V.minmax_expr("popularity", lo, hi).alias("popularity_score"))


def sampled_likes(spark, sf, per_user=40, items=None):
    """R7 on real purchases: per customer, 40 bought parts drawn with weight popularity_score + 0.01."""
    items = (items if items is not None else popularity_scores(spark, sf)).select("item_id", "popularity_score")
    likes = interactions(spark, sf).join(items, "item_id")
    return weighted_sample(likes, "user_id", "item_id", F.col("popularity_score") + F.lit(0.01), per_user, SALT)


def h_sql(expr: str) -> str:
    """DuckDB spelling of ``sampling.hash32``."""
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def random_sql(source: str, id_col: str, k: int, salt: int, name: str) -> str:
    """DuckDB spelling of ``sampling.random_recs`` as table ``name``(seed_id, rec_id, rank)."""
    from cadenza.operators.sampling import SPARE_DRAWS
    draws = k + SPARE_DRAWS
    h52 = lambda e: f"('0x' || substr(md5({e}), 1, 13))::BIGINT"
    rk = h_sql(f"'rk:{salt}:' || {id_col}")
    return (
        f"{name}_it AS (SELECT {id_col} AS rec_id, row_number() OVER (ORDER BY {rk}, {id_col}) - 1 AS pos FROM {source}), "
        f"{name}_n AS (SELECT count(*) AS n FROM {source}), "
        f"{name}_t AS (SELECT {id_col} AS seed_id, n, unnest(range(0, {draws + k + 1})) AS t FROM {source}, {name}_n), "
        f"{name}_d AS (SELECT seed_id, t, CASE WHEN t < {draws} THEN " + h52(f"'rd:{salt}:' || seed_id || ':' || t")
        + " % n ELSE (" + h52(f"'so:{salt}:' || seed_id") + f" + t) % n END AS pos FROM {name}_t), "
        f"{name}_u AS (SELECT seed_id, pos, min(t) AS t FROM {name}_d GROUP BY 1, 2), "
        f"{name}_j AS (SELECT u.seed_id, it.rec_id, u.t FROM {name}_u u JOIN {name}_it it ON u.pos = it.pos WHERE it.rec_id <> u.seed_id), "
        f"{name} AS (SELECT seed_id, rec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY t) AS rank FROM {name}_j) WHERE rank <= {k})")


# DuckDB: every purchase as a like
ALL_LIKES_SQL = ("likes AS (SELECT DISTINCT o.o_custkey AS user_id, l.l_partkey AS item_id FROM lineitem l JOIN orders o "
                 "ON l.l_orderkey = o.o_orderkey)")

# DuckDB: audio vectors of the catalogue songs, same construction as song_items
AV_SQL = (
    "s AS (SELECT p_partkey AS song_id, p_type AS genre, p_size, p_retailprice, "
    "list_concat(string_split(replace(p_name, ' ', ' - '), ' - '), string_split(lower(p_type) || ' - ' || p_brand, ' - ')) AS toks FROM part), "
    "v AS (SELECT chord, row_number() OVER (ORDER BY chord) - 1 AS idx FROM (SELECT DISTINCT unnest(toks) AS chord FROM s)), "
    "vl AS (SELECT list(chord ORDER BY idx) AS chords FROM v), "
    "st AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part), "
    "av AS (SELECT song_id, genre, (p_retailprice - st.c) / CASE WHEN st.d - st.c = 0 THEN 1 ELSE st.d - st.c END AS popularity_score, "
    "list_concat(list_concat([(p_size - st.a) / CASE WHEN st.b - st.a = 0 THEN 1 ELSE st.b - st.a END, "
    "(p_retailprice - st.c) / CASE WHEN st.d - st.c = 0 THEN 1 ELSE st.d - st.c END], "
    "list_transform(vl.chords, lambda c: CASE WHEN list_contains(toks, c) THEN 1.0 ELSE 0.0 END)), "
    "list_transform(range(13), lambda i: 0.0)) AS vec FROM s, st, vl)"
)

LIKES_SQL = (
    "inter AS (SELECT DISTINCT o.o_custkey AS user_id, l.l_partkey AS item_id FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey), "
    "keyed AS (SELECT i.user_id, i.item_id, round(-ln((" + h_sql("'es:42:' || i.user_id || ':' || i.item_id") +
    " + 1) / 4294967297.0) / (av.popularity_score + 0.01), 9) AS es_key FROM inter i JOIN av ON av.song_id = i.item_id), "
    "likes AS (SELECT user_id, item_id, draw_rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY es_key, item_id) AS draw_rank FROM keyed) WHERE draw_rank <= 40)"
)
