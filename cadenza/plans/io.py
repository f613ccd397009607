"""Sources, sinks and page/text projections.

Source and sink queries write a driver-table projection to a fresh folder
under the shared checkpoint directory in the format under test, read it
back through the operator and return what was read; the oracle is the same
projection computed directly on the tables.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import features as V
from cadenza.operators.reconcile import enrich_lyrics
from cadenza.plans.catalog import _lyrics_by_pair, join_chord_merge, s_strip
from cadenza.plans.common import song_items
from cadenza.plans.registry import REGISTRY, query
from cadenza.session import shared_path
from cadenza.sources import files as S
from cadenza.sources import sinks as K
from cadenza.sources import versions as VS
from cadenza.sources.tables import catalogue, read_table

_SONGS_SQL = ("SELECT p.p_name AS title, p.p_brand AS artist, p.p_type AS main_genre, p.p_retailprice AS popularity, "
              "p.p_size / 50.0 AS energy, 2 AS n_sections, coalesce(d.text, '') AS lyrics "
              "FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey")


def _write_song_json(spark, sf):
    s = catalogue(spark, sf, lyrics=True)
    out = s.select("title", "artist", "genre", "popularity", (F.col("size") / 50.0).alias("energy"),
                   "chord_progression", "lyrics")
    path = shared_path(spark, "songs-json")
    out.write.json(path)
    return path


@query("src_song_json", sql=_SONGS_SQL)
def src_song_json(spark, sf):
    """Song objects from a folder of JSON files, genre resolved and progressions parsed."""
    path = _write_song_json(spark, sf)
    r = S.read_song_json(spark, path, multiline=False)
    return r.select("title", "artist", F.upper("main_genre").alias("main_genre"), "popularity", "energy",
                    F.size("chord_progression").alias("n_sections"), "lyrics")


@query("src_title_artist_pairs", sql="SELECT DISTINCT p_brand AS artist, p_name AS title FROM part")
def src_title_artist_pairs(spark, sf):
    """Distinct (artist, title) pairs over all files."""
    path = _write_song_json(spark, sf)
    return S.read_title_artist_pairs(spark, path, multiline=False)


_CHART_ROWS_SQL = (
    "cr AS (SELECT lower(n.n_name) AS country, year(o.o_orderdate) AS year, p.p_brand AS artist, p.p_name AS title, "
    "CAST(l.l_partkey AS VARCHAR) AS song_id FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
    "JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey "
    "JOIN part p ON p.p_partkey = l.l_partkey)")


def _write_charts(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    p = read_table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    rows = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
              .join(n, c.c_nationkey == n.n_nationkey).join(p, li.l_partkey == p.p_partkey)
              .select(F.lower("n_name").alias("country"), F.year("o_orderdate").alias("year"),
                      F.lit("1").alias("rank"), F.col("l_partkey").cast("string").alias("song_id"),
                      F.concat(F.lit(" "), F.col("p_brand")).alias("artist"), F.col("p_name").alias("song_name")))
    root = shared_path(spark, "charts")
    rows.write.partitionBy("country", "year").option("header", True).option("sep", "\t").csv(root)
    return root


@query("src_weekly_charts", sql=f"WITH {_CHART_ROWS_SQL} SELECT DISTINCT artist, title, song_id, country, year FROM cr")
def src_weekly_charts(spark, sf):
    """S3 + D2: chart rows of every country and year, distinct within each chart."""
    r = S.read_charts(spark, _write_charts(spark, sf))
    return r.select("artist", "title", "song_id", "country", F.col("year").cast("long").alias("year")).distinct()


_YEARS, _COUNTRIES = [1996, 1997], ["nation_1", "nation_7", "nation_19"]


@query("src_chart_sweep", sql=f"""
WITH {_CHART_ROWS_SQL} SELECT DISTINCT artist, title, song_id FROM cr
WHERE year IN ({', '.join(map(str, _YEARS))}) AND country IN ({', '.join("'" + c + "'" for c in _COUNTRIES)})
""")
def src_chart_sweep(spark, sf):
    """S4 + D2: configured years x countries in one read, distinct across charts."""
    r = S.read_charts(spark, _write_charts(spark, sf), years=_YEARS, countries=_COUNTRIES)
    return r.select("artist", "title", "song_id").distinct()


def _hits_frame(spark, sf):
    p = read_table(spark, sf, "part")
    feats = [F.concat(F.lit(" "), (F.col("p_size") + F.lit(i)).cast("string")).alias(c)
             for i, c in enumerate(S.HIT_FEATURES)]
    return p.select(F.col("p_partkey").cast("string").alias("song_id"), F.lit("x").alias("extra"), *feats[::-1],
                    F.concat(F.lit(" "), F.col("p_name")).alias("song_name"),
                    F.concat(F.col("p_brand"), F.lit("  ")).alias("artist_name"))


@query("src_hits_tsv", sql="SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS artist, "
       + ", ".join(f"' ' || CAST(p_size + {i} AS VARCHAR) AS {c}" for i, c in enumerate(S.HIT_FEATURES)) + " FROM part")
def src_hits_tsv(spark, sf):
    """Hit-song TSV; id/title/artist trimmed, features left as written."""
    path = shared_path(spark, "hits")
    _hits_frame(spark, sf).write.option("header", True).option("sep", "\t").option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    return S.read_hits_tsv(spark, path)


@query("src_tracks_csv", sql=(
    "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' \"' || p_type || '\"' || chr(10) || p_brand AS title, "
    "p_brand AS artist, " + ", ".join(f"CAST(p_size + {i} AS VARCHAR) AS {c}" for i, c in enumerate(S.TRACK_COLS[3:]))
    + " FROM part"))
def src_tracks_csv(spark, sf):
    """Quoted, multi-line CSV fields read back whole and trimmed."""
    p = read_table(spark, sf, "part")
    out = p.select(F.col("p_partkey").cast("string").alias("id"),
                   F.concat(F.lit("  "), F.col("p_name"), F.lit(' "'), F.col("p_type"), F.lit('"\n'), F.col("p_brand")).alias("name"),
                   F.lit("an album").alias("album"), F.concat(F.col("p_brand"), F.lit(" ")).alias("artists"),
                   *[(F.col("p_size") + F.lit(i)).cast("string").alias(c) for i, c in enumerate(S.TRACK_COLS[3:])])
    path = shared_path(spark, "tracks")
    out.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    return S.read_tracks_csv(spark, path)


@query("src_mixed_delim", sql="""
SELECT CAST(p_partkey AS VARCHAR) AS spotify_id, p_name AS title,
       CASE WHEN p_size < 10 THEN '' ELSE p_brand END AS artist FROM part
""")
def src_mixed_delim(spark, sf):
    """Comma header, semicolon rows (short rows padded with '')."""
    p = read_table(spark, sf, "part")
    data = p.select(F.lit(1).alias("k"), F.col("p_partkey").alias("o"),
                    F.when(F.col("p_size") < 10, F.concat_ws(";", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))))
                     .otherwise(F.concat_ws(";", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), F.col("p_name"), F.lit('" ')),
                                            F.col("p_brand"), F.col("p_type"))).alias("value"))
    header = spark.createDataFrame([(0, -1, '"spotify_id","name","artist","extra"')], "k int, o long, value string")
    path = shared_path(spark, "mixed")
    header.unionByName(data).orderBy("k", "o").select("value").write.text(path)
    return S.read_mixed_delim(spark, path)


@query("src_feature_csv", sql="""
SELECT 'vec' || vec_id || '.wav' AS filename, 'g' || label AS label, 64 AS n_features,
       round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS f_sum FROM embeddings
""")
def src_feature_csv(spark, sf):
    """Labelled feature CSV; every column but filename/label/length is a feature."""
    e = read_table(spark, sf, "embeddings")
    v = F.col("embedding").cast("array<double>")
    out = e.select(F.concat(F.lit("vec"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("filename"),
                   F.concat(F.lit("g"), F.col("label").cast("string")).alias("label"), F.lit(30).alias("length"),
                   *[v[i].alias(f"f{i + 1}") for i in range(64)])
    path = shared_path(spark, "features")
    out.write.option("header", True).csv(path)
    r = S.read_feature_csv(spark, path)
    return r.select("filename", "label", F.size("features").cast("int").alias("n_features"),
                    F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("f_sum"))


@query("src_stored_lyrics", sql=f"""
SELECT page_id, url, {s_strip("regexp_extract(html, '(?is)^(.*?)<script[^>]*>', 1)")} AS lyrics FROM pages
""")
def src_stored_lyrics(spark, sf):
    """S11 + P9: lyric text of stored pages (marker region, else everything before the first script)."""
    p = read_table(spark, sf, "pages")
    return p.select("page_id", "url", T.html_lyrics_region("html").alias("lyrics"))


_AD_MARKER = r"<!--\s*ad [0-9]+"


@query("prj_html_region", sql=f"""
WITH r AS (SELECT page_id, {s_strip("regexp_extract(html, '(?is)<!--\\s*ad [0-9]+.*?-->(.*?)</article>', 1)")} AS x FROM pages)
SELECT page_id, nullif(replace(replace(x, '<br>', chr(10)), '<br/>', chr(10)), '') AS region FROM r
""")
def prj_html_region(spark, sf):
    """The text between a marker comment and the end tag, '<br>' as newline."""
    p = read_table(spark, sf, "pages")
    h = F.col("html")
    x = T.strip(F.regexp_extract(h, r"(?is)" + _AD_MARKER + r".*?-->(.*?)</article>", 1))
    x = F.replace(F.replace(x, F.lit("<br>"), F.lit("\n")), F.lit("<br/>"), F.lit("\n"))
    return p.select("page_id", F.nullif(x, F.lit("")).alias("region"))


_LINKS_SQL = ("lk AS (SELECT page_id, url, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS text FROM "
              "(SELECT page_id, url, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS ls FROM pages))")


def _links(spark, sf):
    p = read_table(spark, sf, "pages")
    ls = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), 1)
    hs = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">[^<]*</a>'), 1)
    return p.select("page_id", "url", F.posexplode(F.arrays_zip(ls.alias("text"), hs.alias("href"))).alias("pos", "z")) \
            .select("page_id", "url", F.col("pos").cast("long").alias("pos"), F.col("z.text").alias("text"),
                    F.col("z.href").alias("href"))


def _hkey_sql(x):
    s = f"replace(lower({s_strip(x)}), '#', 'rank')"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g')"
    s = f"regexp_replace({s}, '[-\\s]+', '_', 'g')"
    return f"coalesce(nullif({s}, ''), 'unknown_header')"


@query("prj_header_key", sql=f"WITH {_LINKS_SQL} SELECT page_id, pos, {_hkey_sql('text')} AS header_key FROM lk")
def prj_header_key(spark, sf):
    """P10: header text -> key (lower, '#' -> 'rank', punctuation dropped, blanks/hyphens -> '_')."""
    return _links(spark, sf).select("page_id", "pos", T.header_key("text").alias("header_key"))


@query("prj_url_encode", sql=f"""
WITH lk AS (SELECT page_id, url, generate_subscripts(hs, 1) - 1 AS pos, unnest(hs) AS href FROM
  (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hs FROM pages))
SELECT page_id, pos, url_encode(url) AS encoded,
  CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
       WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href
       WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
       ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS link
FROM lk
""")
def prj_url_encode(spark, sf):
    """Percent-encoded page URL and every link resolved against the page."""
    l = _links(spark, sf)
    return l.select("page_id", "pos", T.url_encode(F.col("url")).alias("encoded"),
                    S.resolve_link(F.col("url"), F.col("href")).alias("link"))


# fixed values: page diagnosis messages
ERR_RATE = "Rate limit likely hit on songdata.io."
ERR_NOT_FOUND = "Songdata.io reported: Could not find playlist."
ERR_TIMEOUT = "Timeout waiting for results table. Playlist might be invalid/private, or site issues."


def error_message(c):
    t = F.lower(c)
    return (F.when(t.contains("rate limit"), F.lit(ERR_RATE))
             .when(t.contains("could not find playlist"), F.lit(ERR_NOT_FOUND)).otherwise(F.lit(ERR_TIMEOUT)))


@query("prj_error_class", sql=f"""
SELECT doc_id, CASE WHEN contains(lower(text), 'rate limit') THEN '{ERR_RATE}'
  WHEN contains(lower(text), 'could not find playlist') THEN '{ERR_NOT_FOUND}' ELSE '{ERR_TIMEOUT}' END AS error FROM documents
""")
def prj_error_class(spark, sf):
    """Diagnosis of a failed page from its text."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", error_message(F.col("text")).alias("error"))


@query("prj_lyric_clean", sql=f"""
WITH s AS (SELECT p.p_partkey AS song_id, p.p_name || CASE p.p_type WHEN 'PROMO' THEN ' (Live)' WHEN 'SMALL' THEN ' (remix)' ELSE '' END AS title,
  d.text FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey)
SELECT song_id, title, coalesce(nullif({s_strip("regexp_replace(text, '\\[.*?\\]', '', 'g')")}, ''), 'LYRICS NOT FOUND') AS lyrics
FROM s WHERE NOT regexp_matches(title, '(?i)(\\(Remix\\)|\\(Live\\)|\\(Acoustic\\)|\\(Instrumental\\)|\\(Cover\\))')
""")
def prj_lyric_clean(spark, sf):
    """Version titles excluded, section headers removed, sentinel for missing lyrics."""
    p = read_table(spark, sf, "part")
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    title = F.concat(F.col("p_name"), F.when(F.col("p_type") == "PROMO", F.lit(" (Live)"))
                     .when(F.col("p_type") == "SMALL", F.lit(" (remix)")).otherwise(F.lit("")))
    s = p.join(d, p.p_partkey == d.doc_id, "left").select(F.col("p_partkey").alias("song_id"), title.alias("title"), "text")
    return s.where(~T.is_excluded_version(F.col("title"))).select("song_id", "title", T.clean_lyrics(F.col("text")).alias("lyrics"))


# ---- S12 / P12 / K6: stored track table ----
_HEADERS = ["#", "Track", "Artist", "Key", "BPM", "Duration", "Camelot", "Energy", "Valence", "Popularity", "Release-Date"]


def _track_table(spark, sf):
    li = read_table(spark, sf, "lineitem")
    cells = F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit(" Track "), F.col("l_partkey").cast("string")),
                    F.concat(F.lit("Artist "), F.col("l_suppkey").cast("string")), F.col("l_returnflag"),
                    F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"), F.col("l_linestatus"),
                    F.col("l_discount").cast("string"), F.col("l_tax").cast("string"), F.col("l_orderkey").cast("string"),
                    F.date_format("l_shipdate", "yyyy-MM-dd"))
    cells = F.when(F.col("l_linestatus") == "O", F.slice(cells, 1, 6)).otherwise(cells)
    return li.select("l_orderkey", "l_linenumber", cells.alias("cells"))


def _track_sql():
    cols = {"track": 2, "artist": 3, "key": 4, "bpm": 5, "duration": 6, "camelot": 7, "energy": 8, "valence": 9,
            "popularity": 10, "release_date": 11}
    cells = ("[CAST(l_linenumber AS VARCHAR), ' Track ' || l_partkey, 'Artist ' || l_suppkey, l_returnflag, "
             "CAST(l_quantity AS VARCHAR), CAST(l_extendedprice AS VARCHAR), l_linestatus, CAST(l_discount AS VARCHAR), "
             "CAST(l_tax AS VARCHAR), CAST(l_orderkey AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d')]")
    sel = []
    for name in S.TRACK_TABLE_COLUMNS:
        if name in cols:
            i = cols[name]
            sel.append(f"CASE WHEN len(c) < {i} THEN 'Missing Column' ELSE {s_strip(f'c[{i}]')} END AS {name}")
        else:
            sel.append(f"CAST(NULL AS VARCHAR) AS {name}")
    return (f"WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN ({cells})[1:6] ELSE {cells} END AS c FROM lineitem) "
            f"SELECT l_orderkey, l_linenumber, {', '.join(sel)}, CASE WHEN len(c) < 11 THEN true END AS parse_errors FROM t")


@query("src_stored_track_table", sql=_track_sql())
def src_stored_track_table(spark, sf):
    """S12 + P12: stored header list + cell arrays -> typed track rows by header name."""
    return S.columns_by_header(_track_table(spark, sf), _HEADERS)


@query("sink_track_rows", sql="SELECT CAST(count_if(l_linestatus = 'O') AS BIGINT) AS n_parse_errors FROM lineitem")
def sink_track_rows(spark, sf):
    """K6: track rows written as JSON; rows with parse problems counted."""
    rows = S.columns_by_header(_track_table(spark, sf), _HEADERS)
    n = K.write_track_rows(rows, shared_path(spark, "track-rows"))
    return spark.createDataFrame([(int(n),)], "n_parse_errors long")


@query("sink_csv", sql="SELECT p_name AS title, p_brand AS artist, p_type AS genre, CAST(p_partkey AS VARCHAR) AS spotify_id FROM part")
def sink_csv(spark, sf):
    """K1: combined songs written as CSV with header (first source's column order), read back."""
    s = catalogue(spark, sf).select("title", "artist", "genre", F.col("song_id").cast("string").alias("spotify_id"))
    path = shared_path(spark, "songs-csv")
    assert K.write_csv(s, path)
    assert not K.write_csv(s.limit(0), shared_path(spark, "empty-csv"))  # nothing written when empty
    return spark.read.option("header", True).schema("title string, artist string, genre string, spotify_id string").csv(path)


@query("sink_prepped", sql="""
WITH s AS (SELECT list_concat(string_split(replace(p_name, ' ', ' - '), ' - '), string_split(lower(p_type) || ' - ' || p_brand, ' - ')) AS toks FROM part)
SELECT chord, row_number() OVER (ORDER BY chord) - 1 AS idx FROM (SELECT DISTINCT unnest(toks) AS chord FROM s)
""")
def sink_prepped(spark, sf):
    """K2 + S9 + S10: prepared songs, vocabulary and scaler stats written, read back as artifacts."""
    songs = catalogue(spark, sf)
    vocab = V.fit_vocab(songs, "chord_progression")
    stats = V.fit_minmax(songs, ["size", "popularity"])
    st = spark.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in stats.items()], "col string, min double, max double")
    base = shared_path(spark, "prepped")
    K.write_prepped(song_items(spark, sf), vocab, st, base)
    spark.createDataFrame([(0,)], "version int").write.parquet(f"{base}/model_weights")
    arts = S.read_artifacts(spark, base)
    assert S.read_prepped(spark, f"{base}/songs_prepped").count() >= 0
    return arts["vocab"].select("chord", "idx")


@query("sink_lyrics", sql="""
WITH pairs AS (SELECT DISTINCT p_brand AS artist, p_name AS title FROM part),
lyr AS (SELECT artist, title, lyrics FROM (SELECT p.p_brand AS artist, p.p_name AS title, d.text AS lyrics,
  row_number() OVER (PARTITION BY p.p_brand, p.p_name ORDER BY d.doc_id) AS rn FROM documents d JOIN part p ON d.doc_id = p.p_partkey) WHERE rn = 1)
SELECT pairs.artist, pairs.title, coalesce(lyr.lyrics, 'LYRICS NOT FOUND') AS lyrics
FROM pairs LEFT JOIN lyr ON pairs.artist = lyr.artist AND pairs.title = lyr.title
""")
def sink_lyrics(spark, sf):
    """K3: (artist, title, lyrics) written as JSON and read back."""
    pairs = catalogue(spark, sf).select("artist", "title").distinct()
    path = shared_path(spark, "lyrics")
    K.write_lyrics(enrich_lyrics(pairs, _lyrics_by_pair(spark, sf)), path)
    return spark.read.schema("artist string, title string, lyrics string").json(path)


@query("sink_update_in_place", sql=REGISTRY["join_chord_merge"].sql)
def sink_update_in_place(spark, sf):
    """K4: the catalogue is committed, then its merged form as the next version, which readers resolve."""
    base = shared_path(spark, "catalogue")
    VS.update(spark, base, lambda old: catalogue(spark, sf))
    VS.update(spark, base, lambda old: join_chord_merge(spark, sf), consumed=["X-cp"])
    return VS.read_version(spark, base)


@query("sink_embedding", sql=f"""
SELECT {", ".join(f"round(CAST(embedding[{i}] AS DOUBLE), 6) AS UMAP_{i}" for i in range(1, 65))}, label AS label_id, 'g' || label AS label FROM embeddings
""")
def sink_embedding(spark, sf):
    """K5: coordinates as UMAP_1..n plus label_id and label, CSV with header, read back."""
    e = read_table(spark, sf, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("xy"), F.col("label").alias("label_id"),
        F.concat(F.lit("g"), F.col("label").cast("string")).alias("label"))
    names = [f"UMAP_{i + 1}" for i in range(e.agg(F.max(F.size("xy"))).first()[0] or 0)]
    path = shared_path(spark, "embedding-csv")
    K.write_embedding(e, "xy", len(names), path)
    schema = ", ".join([*(f"{c} double" for c in names), "label_id int", "label string"])
    r = spark.read.option("header", True).schema(schema).csv(path)
    return r.select(*[F.round(c, 6).alias(c) for c in names], "label_id", "label")


_ORDER_HEADERS = ["#", " Track ", "Artist", "Energy%", "Key", "Popularity", "Release Date", "Key"]


def _order_table(spark, sf):
    o = read_table(spark, sf, "orders")
    cells = F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")),
                    F.concat(F.lit(" Customer "), F.col("o_custkey").cast("string")), F.col("o_orderstatus"),
                    F.col("o_orderpriority"), F.col("o_totalprice").cast("string"),
                    F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("K"))
    cells = F.when(F.col("o_orderstatus") == "P", F.slice(cells, 1, 4)).otherwise(cells)
    return o.select("o_orderkey", cells.alias("cells"))


def _order_sql():
    # cleaned headers: rank, track, artist, energy, key, popularity, release_date, key (the last 'key' wins)
    cols = {"track": 2, "artist": 3, "energy": 4, "popularity": 6, "release_date": 7, "key": 8}
    cells = ("[CAST(o_orderkey AS VARCHAR), 'Order ' || o_orderkey, ' Customer ' || o_custkey, o_orderstatus, "
             "o_orderpriority, CAST(o_totalprice AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), 'K']")
    sel, errs = [], []
    for name in S.TRACK_TABLE_COLUMNS:
        if name in cols:
            i = cols[name]
            sel.append(f"CASE WHEN len(c) < {i} THEN 'Missing Column' ELSE {s_strip(f'c[{i}]')} END AS {name}")
            errs.append(f"len(c) < {i}")
        else:
            sel.append(f"CAST(NULL AS VARCHAR) AS {name}")
    return (f"WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN ({cells})[1:4] ELSE {cells} END AS c FROM orders) "
            f"SELECT o_orderkey, {', '.join(sel)}, CASE WHEN {' OR '.join(errs)} THEN true END AS parse_errors FROM t")


@query("prj_columns_by_header", sql=_order_sql())
def prj_columns_by_header(spark, sf):
    """Wanted columns located by cleaned header text; short rows marked 'Missing Column'."""
    return S.columns_by_header(_order_table(spark, sf), _ORDER_HEADERS)
