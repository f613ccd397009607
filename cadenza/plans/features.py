"""Feature-building queries: vocabulary, multi-hot, scaling, excerpts, assembly."""
from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import aggregates as A
from cadenza.operators import features as V
from cadenza.plans.registry import query
from cadenza.sources.tables import catalogue, read_table

# DuckDB: chord tokens of the catalogue's two sections
_TOKS = ("s AS (SELECT p_partkey AS song_id, list_concat(string_split(replace(p_name, ' ', ' - '), ' - '), "
         "string_split(lower(p_type) || ' - ' || p_brand, ' - ')) AS toks, p_name, p_size, p_retailprice FROM part), "
         "v AS (SELECT chord, row_number() OVER (ORDER BY chord) - 1 AS idx FROM (SELECT DISTINCT unnest(toks) AS chord FROM s)), "
         "vl AS (SELECT list(chord ORDER BY idx) AS chords FROM v)")


def _hot_str(vec):
    return F.array_join(F.transform(vec, lambda x: x.cast("string")), "")


@query("agg_vocab", sql=f"WITH {_TOKS} SELECT chord, idx FROM v")
def agg_vocab(spark, sf):
    """A2: chord vocabulary over every section, sorted, numbered from 0."""
    return V.fit_vocab(catalogue(spark, sf), "chord_progression")


@query("vec_chord_multihot", sql=f"""
WITH {_TOKS}
SELECT song_id, string_agg(CASE WHEN list_contains(toks, chord) THEN '1' ELSE '0' END, '' ORDER BY idx) AS multihot
FROM s, v GROUP BY song_id
""")
def vec_chord_multihot(spark, sf):
    """V3: 0/1 chord vector over all sections."""
    songs = catalogue(spark, sf)
    vocab = V.fit_vocab(songs, "chord_progression")
    return V.multihot(songs, "chord_progression", vocab, "hv").select("song_id", _hot_str(F.col("hv")).alias("multihot"))


@query("vec_chord_multihot_main", sql=f"""
WITH {_TOKS}, n AS (SELECT p_partkey AS song_id, string_split(replace(p_name, ' ', ' - ') || ' - X' || p_size, ' - ') AS mt FROM part)
SELECT song_id, string_agg(CASE WHEN list_contains(mt, chord) THEN '1' ELSE '0' END, '' ORDER BY idx) AS multihot
FROM n, v GROUP BY song_id
""")
def vec_chord_multihot_main(spark, sf):
    """V4: new songs vectorised on their 'main' section only; unknown chords ignored."""
    songs = catalogue(spark, sf)
    vocab = V.fit_vocab(songs, "chord_progression")
    p = read_table(spark, sf, "part")
    new = p.select(F.col("p_partkey").alias("song_id"),
                   F.create_map(F.lit("main"), F.concat(F.regexp_replace("p_name", " ", " - "),
                                                        F.lit(" - X"), F.col("p_size").cast("string"))).alias("prog"))
    return V.multihot(new, "prog", vocab, "hv", sections=["main"]).select(
        "song_id", _hot_str(F.col("hv")).alias("multihot"))


_MM = ("st AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, "
       "min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)")


@query("agg_minmax_fit", sql=f"WITH {_MM} SELECT a AS size_min, b AS size_max, c AS popularity_min, d AS popularity_max FROM st")
def agg_minmax_fit(spark, sf):
    """A3: column min and max (NaN ignored)."""
    s = catalogue(spark, sf)
    return A.minmax_stats(s, ["size", "popularity"])


@query("vec_minmax", sql=f"""
WITH {_MM}
SELECT p_partkey AS song_id,
       round((p_size - a) / CASE WHEN b - a = 0 THEN 1 ELSE b - a END, 6) AS size_scaled,
       round((p_retailprice - c) / CASE WHEN d - c = 0 THEN 1 ELSE d - c END, 6) AS popularity_score
FROM part, st
""")
def vec_minmax(spark, sf):
    """V1: min-max scaling fitted on the table, popularity -> popularity_score."""
    s = catalogue(spark, sf)
    stats = V.fit_minmax(s, ["size", "popularity"])
    return s.select("song_id",
                    F.round(V.minmax_expr("size", *stats["size"]), 6).alias("size_scaled"),
                    F.round(V.minmax_expr("popularity", *stats["popularity"]), 6).alias("popularity_score"))


@query("agg_standard_fit", sql="""
SELECT round(avg(c_acctbal), 6) AS acctbal_mean, round(stddev_pop(c_acctbal), 6) AS acctbal_std,
       round(avg(c_nationkey), 6) AS nation_mean, round(stddev_pop(c_nationkey), 6) AS nation_std FROM customer
""")
def agg_standard_fit(spark, sf):
    """A4: mean and population standard deviation."""
    c = read_table(spark, sf, "customer")
    return c.agg(F.round(F.avg("c_acctbal"), 6).alias("acctbal_mean"),
                 F.round(F.stddev_pop("c_acctbal"), 6).alias("acctbal_std"),
                 F.round(F.avg("c_nationkey"), 6).alias("nation_mean"),
                 F.round(F.stddev_pop("c_nationkey"), 6).alias("nation_std"))


@query("vec_standard", sql="""
WITH st AS (SELECT avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2 FROM customer)
SELECT c_custkey, round((c_acctbal - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS z_acctbal,
       round((c_nationkey - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS z_nation FROM customer, st
""")
def vec_standard(spark, sf):
    """V2: z-scores with population std; zero std -> 0."""
    c = read_table(spark, sf, "customer")
    st = V.fit_standard(c, ["c_acctbal", "c_nationkey"])
    return c.select("c_custkey",
                    F.round(V.standard_expr("c_acctbal", *st["c_acctbal"]), 6).alias("z_acctbal"),
                    F.round(V.standard_expr("c_nationkey", *st["c_nationkey"]), 6).alias("z_nation"))


@query("agg_label_encode", sql="""
SELECT p_partkey AS song_id, p_type AS genre, dense_rank() OVER (ORDER BY p_type) - 1 AS label_id FROM part
""")
def agg_label_encode(spark, sf):
    """A5: labels numbered 0..n-1 alphabetically, applied to every row."""
    s = catalogue(spark, sf).select("song_id", "genre")
    labels = A.label_index(s, "genre")
    return s.join(labels, "genre").select("song_id", "genre", F.col("label_id").cast("long").alias("label_id"))



@query("vec_valid_only_scale", sql="""
WITH v AS (SELECT vec_id, CASE WHEN label = 3 THEN NULL ELSE CAST(embedding AS DOUBLE[]) END AS vec FROM embeddings),
e AS (SELECT vec_id, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS x FROM v WHERE vec IS NOT NULL),
st AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM e GROUP BY pos),
grid AS (SELECT v.vec_id, r.pos, v.vec IS NULL AS miss, CASE WHEN v.vec IS NULL THEN 0.0 ELSE v.vec[r.pos + 1] END AS x
         FROM v, (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS pos) r)
SELECT g.vec_id, g.pos, round(CASE WHEN miss THEN 0.0 ELSE (x - lo) / CASE WHEN hi - lo = 0 THEN 1 ELSE hi - lo END END, 6) AS x
FROM grid g JOIN st ON g.pos = st.pos
""")
def vec_valid_only_scale(spark, sf):
    """V5: per-position min-max over present vectors only; missing vectors become zeros."""
    e = read_table(spark, sf, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    v = e.select("vec_id", F.when(F.col("label") == 3, F.lit(None))
                 .otherwise(F.col("embedding").cast("array<double>")).alias("vec"))
    s = V.valid_only_scale(v, "vec", width, "scaled")
    return s.select("vec_id", F.posexplode("scaled").alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("vec_excerpt", sql="""
WITH t AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents)
SELECT doc_id, array_to_string(CASE WHEN len(a) < 15 THEN a ELSE list_concat(list_concat(a[1:5],
  a[(len(a) - 5) // 2 + 1:(len(a) - 5) // 2 + 5]), a[len(a) - 4:len(a)]) END, ' ') AS excerpt FROM t
""")
def vec_excerpt(spark, sf, n=5):
    """V6: first, middle and last n tokens of every whole document."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(V.excerpt(F.split("text", " ", -1), n), " ").alias("excerpt"))


@query("vec_assemble", sql=f"""
WITH {_TOKS}, {_MM},
a AS (SELECT song_id, list_concat(list_concat(
        [(p_size - st.a) / CASE WHEN st.b - st.a = 0 THEN 1 ELSE st.b - st.a END,
         (p_retailprice - st.c) / CASE WHEN st.d - st.c = 0 THEN 1 ELSE st.d - st.c END],
        list_transform(vl.chords, lambda c: CASE WHEN list_contains(toks, c) THEN 1.0 ELSE 0.0 END)),
        list_transform(range(13), lambda i: 0.0)) AS vec FROM s, st, vl)
SELECT song_id, len(vec) AS audio_dim, round(list_sum(list_transform(vec, lambda x, i: x * i)), 6) AS audio_check FROM a
""")
def vec_assemble(spark, sf):
    """V9: audio vector = scaled scalars + chord multi-hot + 13 zero slots, with its dimension."""
    songs = catalogue(spark, sf)
    stats = V.fit_minmax(songs, ["size", "popularity"])
    vocab = V.fit_vocab(songs, "chord_progression")
    s = V.multihot(songs, "chord_progression", vocab, "hv")
    vec = V.assemble(F.array(V.minmax_expr("size", *stats["size"]),
                             V.minmax_expr("popularity", *stats["popularity"])),
                     F.col("hv"), V.zeros(V.MFCC_DIM))
    return s.select("song_id", vec.alias("vec")).select(
        "song_id", F.size("vec").cast("long").alias("audio_dim"),
        F.round(V.dot_checksum(F.col("vec")), 6).alias("audio_check"))


@query("vec_l2_normalise", sql="""
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * label) AS vec FROM embeddings),
n AS (SELECT vec_id, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS nrm FROM v),
e AS (SELECT vec_id, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS x, nrm FROM n)
SELECT vec_id, pos, round(x / greatest(nrm, 1e-12), 6) AS x FROM e
""")
def vec_l2_normalise(spark, sf):
    """Unit-length vectors (a zero vector stays zero)."""
    e = read_table(spark, sf, "embeddings")
    v = e.select("vec_id", F.transform(F.col("embedding").cast("array<double>"),
                                       lambda x: x * F.col("label")).alias("vec"))
    return v.select("vec_id", F.posexplode(V.l2_normalise("vec")).alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("prj_fill_defaults", sql="""
SELECT p.p_partkey AS song_id, coalesce(d.text, '') AS lyrics, coalesce(l.quality::DOUBLE, 0.5) AS energy,
       CAST(CASE WHEN p.p_size > 40 THEN 0 ELSE 2 END AS BIGINT) AS n_sections, coalesce(s.s_acctbal, 0.0) AS popularity
FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey LEFT JOIN labels l ON l.doc_id = p.p_partkey
LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey
""")
def prj_fill_defaults(spark, sf):
    """Null lyrics -> '', missing scalar -> 0.5, non-dict progression -> {}, popularity -> 0."""
    songs = catalogue(spark, sf, lyrics=True)
    lab = read_table(spark, sf, "labels").select(F.col("doc_id").alias("song_id"), F.col("quality").cast("double").alias("energy"))
    sup = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("song_id"), F.col("s_acctbal").alias("pop2"))
    s = (songs.join(lab, "song_id", "left").join(sup, "song_id", "left")
              .withColumn("chord_progression", F.when(F.col("size") > 40, F.lit(None)).otherwise(F.col("chord_progression"))))
    empty_map = F.create_map().cast("map<string,string>")
    return s.select("song_id",
                    F.coalesce("lyrics", F.lit("")).alias("lyrics"),
                    F.coalesce("energy", F.lit(0.5)).alias("energy"),
                    F.size(F.coalesce("chord_progression", empty_map)).cast("long").alias("n_sections"),
                    F.coalesce("pop2", F.lit(0.0)).alias("popularity"))


@query("prj_flatten_lyrics", sql="""
SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE array_to_string(string_split(text, chr(10)), ' ') END AS lyrics_text
FROM documents
""")
def prj_flatten_lyrics(spark, sf):
    """Lyrics given as a map of sections are joined with blanks; strings pass through."""
    d = read_table(spark, sf, "documents")
    lines = F.split("text", "\n", -1)
    sections = F.map_from_arrays(F.sequence(F.lit(1), F.size(lines)), lines)
    d = d.withColumn("sections", F.when(F.col("lang") != "en", sections))
    flat = F.when(F.col("sections").isNotNull(), F.array_join(F.map_values("sections"), " ")) \
            .otherwise(F.coalesce(F.col("text"), F.lit("")))
    return d.select("doc_id", flat.alias("lyrics_text"))
