"""Catalogue reconciliation, cleaning, filters and small aggregates (driver tables)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import aggregates as A
from cadenza.operators import reconcile as R
from cadenza.operators import topk as K
from cadenza.plans.registry import query
from cadenza.sources.tables import catalogue, read_table

# DuckDB spelling of Python's str.strip() on our whitespace set
_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def s_strip(x: str) -> str:
    return f"trim({x}, {_WS})"


_SONGS = ("songs AS (SELECT p_partkey AS song_id, p_name AS title, p_brand AS artist, "
          "p_type AS genre, p_retailprice AS popularity FROM part)")
_CHART = ("chart AS (SELECT p.p_brand AS artist, p.p_name AS title, l.l_partkey AS song_id, "
          "p.p_type AS genre, l.l_returnflag AS flag FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)")


def _songs(spark, sf, lyrics=False):
    return catalogue(spark, sf, lyrics=lyrics)


def _chart_rows(spark, sf):
    """Chart entries: one row per order line, (artist, title, song_id, genre, flag)."""
    li = read_table(spark, sf, "lineitem").select("l_partkey", "l_returnflag")
    p = read_table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    return (li.join(p, li.l_partkey == p.p_partkey)
              .select(F.col("p_brand").alias("artist"), F.col("p_name").alias("title"),
                      F.col("l_partkey").alias("song_id"), F.col("p_type").alias("genre"),
                      F.col("l_returnflag").alias("flag")))


def _sourced(spark, sf):
    """Catalogue rows with the file they came from and their position in it."""
    return _songs(spark, sf).select(
        "title", "artist", "song_id", "genre",
        F.concat(F.lower("genre"), F.lit(".json")).alias("source_file"),
        F.col("song_id").alias("seq"))


@query("dedup_keep_first", sql="""
SELECT title, artist, song_id, genre FROM (
  SELECT p_name AS title, p_brand AS artist, p_partkey AS song_id, p_type AS genre,
         row_number() OVER (PARTITION BY p_name, p_brand ORDER BY lower(p_type) || '.json', p_partkey) AS rn
  FROM part) WHERE rn = 1
""")
def dedup_keep_first(spark, sf):
    """First song per (title, artist) in (file, position) order."""
    d = R.keep_first(_sourced(spark, sf), ["title", "artist"], ["source_file", "seq"])
    return d.select("title", "artist", "song_id", "genre")


@query("dedup_keep_last", sql="""
SELECT title, artist, song_id, genre FROM (
  SELECT p_name AS title, p_brand AS artist, p_partkey AS song_id, p_type AS genre,
         row_number() OVER (PARTITION BY p_name, p_brand ORDER BY lower(p_type) || '.json' DESC, p_partkey DESC) AS rn
  FROM part) WHERE rn = 1
""")
def dedup_keep_last(spark, sf):
    """D3: last song per (title, artist): later sources override earlier ones."""
    d = R.keep_last(_sourced(spark, sf), ["title", "artist"], ["source_file", "seq"])
    return d.select("title", "artist", "song_id", "genre")


@query("dedup_full_row", sql=f"""
WITH {_CHART} SELECT DISTINCT artist, title, song_id FROM chart
""")
def dedup_full_row(spark, sf):
    """Distinct chart rows on the whole (artist, title, id) row."""
    return _chart_rows(spark, sf).select("artist", "title", "song_id").distinct()


@query("union_distinct_sources", sql=f"""
WITH {_CHART}
SELECT title, artist, genre FROM part_src UNION SELECT title, artist, genre FROM chart_src
""".replace("WITH " + _CHART, "WITH " + _CHART + ", part_src AS (SELECT p_name AS title, p_brand AS artist, p_type AS genre FROM part), chart_src AS (SELECT genre, artist, title FROM chart)"))
def union_distinct_sources(spark, sf):
    """Two sources with different column order, union by name, distinct on all columns."""
    a = _songs(spark, sf).select("title", "artist", "genre")
    b = _chart_rows(spark, sf).select("genre", "artist", "title")
    return R.union_distinct(a, b)


@query("union_all", sql=f"""
WITH {_CHART}
SELECT title, artist, genre, 'catalogue' AS source FROM (SELECT p_name AS title, p_brand AS artist, p_type AS genre FROM part)
UNION ALL SELECT title, artist, genre, 'chart' AS source FROM chart
""")
def union_all(spark, sf):
    """Concatenate every source."""
    a = _songs(spark, sf).select("title", "artist", "genre", F.lit("catalogue").alias("source"))
    b = _chart_rows(spark, sf).select("genre", "artist", "title", F.lit("chart").alias("source"))
    return R.union_all(a, b)


@query("join_semi_hits", sql=f"""
WITH {_SONGS}, {_CHART}
SELECT song_id, artist, title FROM songs s
WHERE EXISTS (SELECT 1 FROM chart c WHERE c.flag = 'R' AND c.artist = s.artist AND c.title = s.title)
""")
def join_semi_hits(spark, sf):
    """Catalogue songs present among the hits (returned-flag chart rows) on (artist, title)."""
    hits = _chart_rows(spark, sf).where(F.col("flag") == "R")
    return R.semi_join(_songs(spark, sf).select("song_id", "artist", "title"), hits, ["artist", "title"])


@query("agg_run_counts", sql=f"""
WITH {_SONGS}, {_CHART}
SELECT count(*) AS n_total,
       count(DISTINCT (title, artist)) AS n_unique,
       CAST(count_if(EXISTS (SELECT 1 FROM chart c WHERE c.flag = 'R' AND c.artist = s.artist AND c.title = s.title)) AS BIGINT) AS n_matched,
       CAST(count_if(EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = s.song_id)) AS BIGINT) AS n_found
FROM songs s
""")
def agg_run_counts(spark, sf):
    """A10: totals, unique totals, matched and found in one aggregation."""
    hits = (_chart_rows(spark, sf).where(F.col("flag") == "R")
            .select("artist", "title").distinct().withColumn("__m", F.lit(True)))
    # found means that there is a document: the ids tell, the texts need not be read
    found = read_table(spark, sf, "documents").select(F.col("doc_id").alias("song_id")).distinct().withColumn("__f", F.lit(True))
    s = _songs(spark, sf).join(hits, ["artist", "title"], "left").join(found, "song_id", "left")
    return A.run_counts(s, key_cols=["title", "artist"],
                        flags={"n_matched": F.col("__m").isNotNull(),
                               "n_found": F.col("__f").isNotNull()})


def _side(spark, sf):
    li = read_table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    p = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.lower("p_type").alias("pair"),
        F.concat(F.upper("p_name"), F.lit("  ")).alias("title"),
        F.concat(F.lit(" "), F.lower("p_brand")).alias("artist"),
        F.when(F.col("l_linestatus") == "O", F.lit(None).cast("string"))
         .otherwise(F.concat_ws(" - ", "l_returnflag", "l_linestatus")).alias("chord_progression"),
        "l_orderkey", "l_linenumber")


@query("join_chord_merge", sql=f"""
WITH side AS (
  SELECT lower(p.p_type) AS pair, lower({s_strip("upper(p.p_name) || '  '")}) AS tk,
         lower({s_strip("' ' || lower(p.p_brand)")}) AS ak,
         CASE WHEN l.l_linestatus = 'O' THEN NULL ELSE l.l_returnflag || ' - ' || l.l_linestatus END AS prog,
         l.l_orderkey, l.l_linenumber
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_returnflag = 'R'),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, tk, ak
         ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM side) WHERE rn = 1)
SELECT p.p_partkey AS song_id,
       CASE WHEN s.pair IS NOT NULL THEN s.prog ELSE replace(p.p_name, ' ', ' - ') END AS chord_progression,
       s.pair IS NOT NULL AS matched
FROM part p LEFT JOIN last s ON lower(p.p_type) = s.pair
  AND lower({s_strip("p.p_name")}) = s.tk AND lower({s_strip("p.p_brand")}) = s.ak
""")
def join_chord_merge(spark, sf):
    """Progressions from the paired side input override the catalogue's (later rows win)."""
    p = read_table(spark, sf, "part")
    main = p.select(F.col("p_partkey").alias("song_id"), F.lower("p_type").alias("pair"),
                    F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
                    F.regexp_replace("p_name", " ", " - ").alias("chord_progression"))
    m = R.chord_merge(main, _side(spark, sf), side_order=("l_orderkey", "l_linenumber"))
    return m.select("song_id", "chord_progression", "matched")


@query("agg_merge_counts", sql=f"""
WITH side AS (
  SELECT DISTINCT lower(p.p_type) AS pair, lower({s_strip("upper(p.p_name) || '  '")}) AS tk,
         lower({s_strip("' ' || lower(p.p_brand)")}) AS ak
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_returnflag = 'R')
SELECT lower(p.p_type) AS pair, count(*) AS n_songs, count(s.pair) AS n_matched
FROM part p LEFT JOIN side s ON lower(p.p_type) = s.pair
  AND lower({s_strip("p.p_name")}) = s.tk AND lower({s_strip("p.p_brand")}) = s.ak
GROUP BY 1
""")
def agg_merge_counts(spark, sf):
    """A10 for J2: matched songs per file pair."""
    p = read_table(spark, sf, "part").select(F.col("p_partkey").alias("song_id"),
                                             F.lower("p_type").alias("pair"))
    m = join_chord_merge(spark, sf)
    return (p.join(m, "song_id").groupBy("pair")
             .agg(F.count(F.lit(1)).alias("n_songs"), F.count_if("matched").alias("n_matched")))


def _lyrics_by_pair(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    p = read_table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    j = d.join(p, d.doc_id == p.p_partkey).select(
        F.col("p_brand").alias("artist"), F.col("p_name").alias("title"),
        "doc_id", F.col("text").alias("lyrics"))
    return R.keep_first(j, ["artist", "title"], ["doc_id"])


@query("join_lyrics_enrich", sql="""
WITH pairs AS (SELECT DISTINCT p_brand AS artist, p_name AS title FROM part),
lyr AS (SELECT artist, title, lyrics FROM (
  SELECT p.p_brand AS artist, p.p_name AS title, d.text AS lyrics,
         row_number() OVER (PARTITION BY p.p_brand, p.p_name ORDER BY d.doc_id) AS rn
  FROM documents d JOIN part p ON d.doc_id = p.p_partkey) WHERE rn = 1)
SELECT pairs.artist, pairs.title, coalesce(lyr.lyrics, 'LYRICS NOT FOUND') AS lyrics
FROM pairs LEFT JOIN lyr ON pairs.artist = lyr.artist AND pairs.title = lyr.title
""")
def join_lyrics_enrich(spark, sf):
    """Every distinct (artist, title) gets its lyrics or the sentinel."""
    pairs = _songs(spark, sf).select("artist", "title").distinct()
    return R.enrich_lyrics(pairs, _lyrics_by_pair(spark, sf))


@query("join_align_raw", sql="""
WITH prepped AS (SELECT p_partkey AS song_id FROM (
  SELECT p_partkey, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY lower(p_type) || '.json', p_partkey) AS rn
  FROM part) WHERE rn = 1)
SELECT p.p_partkey AS song_id, p.p_name, p.p_brand, p.p_size, p.p_retailprice
FROM part p JOIN prepped USING (p_partkey)
""".replace("USING (p_partkey)", "ON p.p_partkey = prepped.song_id"))
def join_align_raw(spark, sf):
    """Raw rows of the prepared (deduplicated) songs, matched by id."""
    prepped = dedup_keep_first(spark, sf)
    raw = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("song_id"), "p_name", "p_brand", "p_size", "p_retailprice")
    return R.align(prepped, raw)


@query("prj_standardise", sql=f"""
SELECT doc_id AS track_id, coalesce({s_strip("text")}, '') AS name,
       coalesce({s_strip("source")}, '') AS artist, coalesce({s_strip("lang")}, '') AS genre
FROM documents
""")
def prj_standardise(spark, sf):
    """Source columns renamed to the song schema, trimmed, '' for null."""
    d = read_table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("track_id"), T.standardise("text").alias("name"),
                    T.standardise("source").alias("artist"), T.standardise("lang").alias("genre"))


def _genre_input(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.when(F.col("lang") == "en", F.lit(None).cast("string"))
         .when(F.col("lang") == "de", F.lit("  "))
         .otherwise(F.concat(F.upper("lang"), F.lit(" ROCK-pop"))).alias("song_genre"),
        F.concat("source", F.lit("-cp.json")).alias("file_name"))


@query("prj_resolve_genre", sql=f"""
WITH g AS (SELECT doc_id,
  CASE WHEN lang = 'en' THEN NULL WHEN lang = 'de' THEN '  ' ELSE upper(lang) || ' ROCK-pop' END AS song_genre,
  source || '-cp.json' AS file_name FROM documents),
c AS (SELECT doc_id, CASE WHEN length({s_strip("song_genre")}) > 0 THEN song_genre
        ELSE replace(regexp_replace(file_name, '\\.[^.]*$', ''), '-cp', '') END AS x FROM g)
SELECT doc_id, upper(substr(x, 1, 1)) || lower(substr(x, 2)) AS main_genre FROM c
""")
def prj_resolve_genre(spark, sf):
    """Own genre if non-blank else file-name fallback, capitalised."""
    g = _genre_input(spark, sf)
    return g.select("doc_id", T.resolve_genre("song_genre", T.file_stem_genre("file_name")).alias("main_genre"))


@query("flt_genre", sql="SELECT p_partkey AS song_id, p_name AS title, p_brand AS artist FROM part WHERE p_type = 'PROMO'")
def flt_genre(spark, sf, genre="PROMO"):
    """Songs of one genre (None = all)."""
    s = _songs(spark, sf)
    if genre is not None:
        s = s.where(F.col("genre") == genre)
    return s.select("song_id", "title", "artist")


@query("flt_title_contains", sql="""
SELECT p_partkey AS song_id, p_name AS title FROM part WHERE contains(lower(p_name), lower('Bolt'))
""")
def flt_title_contains(spark, sf, q="Bolt"):
    """Case-insensitive literal substring on the title."""
    s = _songs(spark, sf)
    return s.where(F.coalesce(F.lower("title").contains(q.lower()), F.lit(False))).select("song_id", "title")


_PROMPT = "an anthem about a Red Widget"


@query("flt_last_keyword", sql=f"""
WITH {_SONGS}, kw AS (SELECT lower(string_split('{_PROMPT}', ' ')[-1]) AS k),
hits AS (SELECT song_id, title FROM songs, kw WHERE contains(lower(title), kw.k)),
n AS (SELECT count(*) AS c FROM hits)
SELECT * FROM (SELECT song_id, title FROM hits ORDER BY song_id LIMIT 15)
UNION ALL
SELECT * FROM (SELECT song_id, title FROM songs WHERE (SELECT c FROM n) = 0 ORDER BY song_id LIMIT 5)
""")
def flt_last_keyword(spark, sf, prompt=_PROMPT):
    """P5: last word of the prompt searched in titles; first 5 songs when nothing matches; cap 15."""
    return K.keyword_search(_songs(spark, sf).select("song_id", "title"), prompt,
                            title="title", order="song_id", cap=15, fallback_n=5)


@query("prj_match_key", sql=f"""
SELECT p_partkey AS song_id, lower({s_strip("p_name")}) AS title_key, lower({s_strip("p_brand")}) AS artist_key FROM part
""")
def prj_match_key(spark, sf):
    """Case- and blank-insensitive matching key."""
    s = _songs(spark, sf)
    return s.select("song_id", T.match_key("title").alias("title_key"), T.match_key("artist").alias("artist_key"))


def _slug_sql(x):
    s = f"lower({s_strip(x)})"
    s = f"regexp_replace({s}, '^[\\t\\n\\x0B\\f\\r ]*the[\\t\\n\\x0B\\f\\r ]+', '', 'i')"
    s = f"regexp_replace({s}, '[^a-z0-9_]', '', 'g')"
    words = "|".join(T.SLUG_STOP_WORDS)
    s = f"regexp_replace({s}, '\\b({words})\\b', '', 'g')"
    return f"coalesce({s}, '')"


_SLUG_INPUT = ("slug_in AS (SELECT p_partkey AS song_id, "
               "CASE WHEN p_type = 'PROMO' THEN 'The ' || p_brand ELSE p_brand END AS artist, "
               "CASE WHEN p_size < 5 THEN 'Remix' ELSE p_name || ' (' || p_type || ')' END AS title FROM part)")


def _slug_input(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("song_id"),
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("The "), "p_brand")).otherwise(F.col("p_brand")).alias("artist"),
        F.when(F.col("p_size") < 5, F.lit("Remix"))
         .otherwise(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("title"))


@query("prj_url_slug", sql=f"""
WITH {_SLUG_INPUT},
s AS (SELECT song_id, {_slug_sql("artist")} AS a, {_slug_sql("title")} AS t FROM slug_in)
SELECT song_id, CASE WHEN length(a) > 0 AND length(t) > 0
  THEN '{T.LYRICS_BASE_URL}' || a || '/' || t || '.html' END AS url FROM s
""")
def prj_url_slug(spark, sf):
    """Lyric page URL from artist and title slugs; null when a slug is empty."""
    s = _slug_input(spark, sf)
    return s.select("song_id", T.lyrics_url("artist", "title").alias("url"))


def _fname_sql(x):
    s = f"regexp_replace({x}, '[<>:\"/\\\\|?*]', '_', 'g')"
    s = f"trim(regexp_replace({s}, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), ' ')"
    s = f"regexp_replace({s}, '\\.$', '')"
    return f"coalesce(nullif({s}, ''), 'unknown')"


_FNAME_INPUT = ("fn_in AS (SELECT p_partkey AS song_id, p_brand || ': ' || p_type AS artist, "
                "CASE WHEN p_size < 5 THEN '  ' WHEN p_size < 10 THEN p_name || '?.' "
                "ELSE p_name || '  /  ' || p_type END AS title FROM part)")


def _fname_input(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("song_id"),
        F.concat("p_brand", F.lit(": "), "p_type").alias("artist"),
        F.when(F.col("p_size") < 5, F.lit("  "))
         .when(F.col("p_size") < 10, F.concat("p_name", F.lit("?.")))
         .otherwise(F.concat("p_name", F.lit("  /  "), "p_type")).alias("title"))


@query("sink_lyric_files", sql=f"""
WITH {_FNAME_INPUT}
SELECT song_id, {_fname_sql("artist")} || ' - ' || {_fname_sql("title")} || '.txt' AS lyrics_file_path FROM fn_in
""")
def sink_lyric_files(spark, sf):
    """K7 + P8: the per-song lyric file name stored on the row (no file per row)."""
    s = _fname_input(spark, sf)
    return s.select("song_id", T.lyric_file_name("artist", "title").alias("lyrics_file_path"))


@query("prj_safe_filename", sql=f"""
WITH {_FNAME_INPUT} SELECT song_id, {_fname_sql("title")} AS safe_title FROM fn_in
""")
def prj_safe_filename(spark, sf):
    """File-system safe title."""
    s = _fname_input(spark, sf)
    return s.select("song_id", T.safe_filename("title").alias("safe_title"))


@query("flt_required", sql=f"""
WITH s AS (SELECT coalesce(text, '') AS title, CASE WHEN n_chars < 200 THEN '' WHEN n_chars < 400 THEN ' ' ELSE coalesce(source, '') END AS artist FROM documents)
SELECT count(*) AS n_total, CAST(count_if(length(title) > 0 AND length(artist) > 0) AS BIGINT) AS n_kept,
       CAST(count_if(NOT (length(title) > 0 AND length(artist) > 0)) AS BIGINT) AS n_skipped FROM s
""")
def flt_required(spark, sf):
    """P20: rows with empty title or artist are skipped and counted."""
    d = read_table(spark, sf, "documents")
    artist = F.when(F.col("n_chars") < 200, F.lit("")).when(F.col("n_chars") < 400, F.lit(" ")).otherwise(F.coalesce("source", F.lit("")))
    s = d.select(F.coalesce("text", F.lit("")).alias("title"), artist.alias("artist"))  # as they stand: blanks are not empty
    ok = (F.length("title") > 0) & (F.length("artist") > 0)
    return s.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_kept"),
                 F.count_if(~ok).alias("n_skipped"))


@query("topk_popular", sql="""
SELECT genre, song_id, popularity, rank FROM (
  SELECT p_type AS genre, p_partkey AS song_id, p_retailprice AS popularity,
         row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rank
  FROM part) WHERE rank <= 3
""")
def topk_popular(spark, sf, n=3):
    """The n most popular songs of every genre."""
    s = _songs(spark, sf)
    return K.top_n_per_group(s, ["genre"], [F.col("popularity").desc_nulls_last(), F.col("song_id")], n) \
        .select("genre", "song_id", "popularity", F.col("rank").cast("long").alias("rank"))


@query("agg_genres", sql="SELECT DISTINCT p_type AS genre FROM part ORDER BY 1")
def agg_genres(spark, sf):
    """A1: sorted distinct genres."""
    return _songs(spark, sf).select("genre").distinct().orderBy("genre")


@query("agg_top_genres", sql="""
SELECT p_type AS genre, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, genre LIMIT 2
""")
def agg_top_genres(spark, sf, n=2):
    """The n most frequent genres (ties by name)."""
    return A.top_values(_songs(spark, sf), "genre", n)
