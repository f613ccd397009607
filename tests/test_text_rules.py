"""Edge rules of the text helpers and small search operators."""
from urllib.parse import quote

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import ideation as I
from cadenza.operators import topk as K


def test_keyword_search_fallback_and_trailing_blank(spark):
    songs = spark.createDataFrame([(i, f"song {i}") for i in range(30)], "song_id long, title string")
    none = K.keyword_search(songs, "idea about zebra", title="title", order="song_id").collect()
    assert [r["song_id"] for r in none] == [0, 1, 2, 3, 4]          # no hit -> first 5
    every = K.keyword_search(songs, "idea ", title="title", order="song_id").collect()
    assert len(every) == 15                                          # '' matches every title, capped at 15
    hit = K.keyword_search(songs, "about SONG 2", title="title", order="song_id").collect()
    assert [r["song_id"] for r in hit] == [2, 12, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29]


def test_html_region_primary_and_fallback(spark):
    page_a = "<html><!-- Usage of azlyrics.com content --> Line one<br>Line two <script>x</script></html>"
    page_b = "<p>intro</p><script src='a.js'></script><!-- other -->"
    page_c = "<p>no script at all</p>"
    df = spark.createDataFrame([(page_a,), (page_b,), (page_c,)], "h string")
    got = [r[0] for r in df.select(T.html_lyrics_region("h")).collect()]
    assert got == ["Line one\nLine two", "<p>intro</p>", None]


def test_header_keys_unicode_and_defaults(spark):
    df = spark.createDataFrame([("# ",), (" Énergie (%) ",), ("Release-Date",), ("",), ("!!",)], "h string")
    got = [r[0] for r in df.select(T.header_key("h")).collect()]
    assert got == ["rank", "énergie_", "release_date", "unknown_header", "unknown_header"]


def test_url_encode_matches_python_quote(spark):
    raw = ["https://x.y/p?q=a b&c=~*+é", "plain-text_1.0", "ü/ß"]
    df = spark.createDataFrame([(s,) for s in raw], "s string")
    got = [r[0] for r in df.select(T.url_encode("s")).collect()]
    assert got == [quote(s, safe="") for s in raw]


def test_excluded_versions_and_section_headers(spark):
    df = spark.createDataFrame([("Song (Live)", "[Chorus]\nla la"), ("Song", "[Intro]"), ("Song (cover)", None)],
                               "t string, l string")
    r = df.select(T.is_excluded_version("t").alias("x"), T.clean_lyrics("l").alias("c")).collect()
    assert [x["x"] for x in r] == [True, False, True]
    assert [x["c"] for x in r] == ["la la", "LYRICS NOT FOUND", "LYRICS NOT FOUND"]


def test_traits_thresholds_and_missing_means(spark):
    df = spark.createDataFrame([(0.8, 0.7, 0.9), (0.5, 0.5, 0.05), (0.1, 0.1, 0.5), (None, None, None)],
                               "e double, v double, a double")
    got = [r[0] for r in df.select(I.traits(F.col("e"), F.col("v"), F.col("a"))).collect()]
    assert got == ["Energetic, Upbeat & Happy, Primarily Acoustic",
                   "Mid-Energy, Neutral / Mixed-Mood, Highly Electronic/Electric",
                   "Calm / Mellow, Melancholic & Somber",
                   "Mid-Energy, Melancholic & Somber"]


def test_top_n_ties_broken_by_id(spark):
    df = spark.createDataFrame([(1, "g", 5.0), (2, "g", 5.0), (3, "g", 7.0), (4, "g", None)],
                               "song_id long, genre string, popularity double")
    r = K.top_n_per_group(df, ["genre"], [F.col("popularity").desc_nulls_last(), F.col("song_id")], 3).collect()
    assert [x["song_id"] for x in sorted(r, key=lambda x: x["rank"])] == [3, 1, 2]
