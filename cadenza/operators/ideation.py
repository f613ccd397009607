"""Ideation reports over result sets: traits sentence, progressions, popular songs.

A result set is a table with a grouping column (one report per group, e.g.
per prompt or per genre); every part is a bounded per-group aggregate
(at most 2 genres, 3 progressions, 3 songs), never a collected group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import capitalize, strip

# ---- fixed values: trait thresholds and wording of the profile sentence ----
ENERGY_HIGH, ENERGY_LOW = 0.7, 0.4
VALENCE_HIGH, VALENCE_MID = 0.6, 0.4
ACOUSTIC_HIGH, ACOUSTIC_LOW = 0.7, 0.1
T_ENERGETIC, T_CALM, T_MID_ENERGY = "Energetic", "Calm / Mellow", "Mid-Energy"
T_UPBEAT, T_NEUTRAL, T_MELANCHOLIC = "Upbeat & Happy", "Neutral / Mixed-Mood", "Melancholic & Somber"
T_ACOUSTIC, T_ELECTRONIC = "Primarily Acoustic", "Highly Electronic/Electric"
EMPTY_PROFILE = "A truly unique and uncharted sonic territory."
THEME_DISABLED = "Theme summarization is disabled (API key not found)."
THEME_FAILED = "Could not generate theme summary."
INSTRUMENTAL = "Instrumental"
# ----------------------------------------------------------------------------
# Our own request template for the theme summary (one request per song).
THEME_TEMPLATE = "Summarise the central theme of the song \"%s\" by %s in one sentence.\nLyrics:\n%s"


def traits(energy: Column, valence: Column, acoustic: Column) -> Column:
    """Trait words from mean raw features, joined by ', '."""
    e = (F.when(energy > ENERGY_HIGH, F.lit(T_ENERGETIC)).when(energy < ENERGY_LOW, F.lit(T_CALM))
          .otherwise(F.lit(T_MID_ENERGY)))
    v = (F.when(valence > VALENCE_HIGH, F.lit(T_UPBEAT)).when(valence > VALENCE_MID, F.lit(T_NEUTRAL))
          .otherwise(F.lit(T_MELANCHOLIC)))
    a = F.when(acoustic > ACOUSTIC_HIGH, F.lit(T_ACOUSTIC)).when(acoustic < ACOUSTIC_LOW, F.lit(T_ELECTRONIC))
    return F.concat_ws(", ", e, v, a)


def profile_means(res: DataFrame, group: str) -> DataFrame:
    """Mean of the three raw features per result set."""
    return res.groupBy(group).agg(F.avg("energy").alias("energy"), F.avg("valence").alias("valence"),
                                  F.avg("acousticness").alias("acousticness"))


def _ranked_strings(df: DataFrame, group: str, item: Column, order, n: int, name: str, sep: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    r = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    agg = r.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col("__r"), item.alias("__s")))).alias("__a"))
    return agg.select(group, F.array_join(F.transform("__a", lambda x: x["__s"]), sep).alias(name))


def top_genres_text(res: DataFrame, group: str, genre: str = "genre", n: int = 2) -> DataFrame:
    """A6 per result set: the n most frequent genres, capitalised and joined by ' & '."""
    c = res.groupBy(group, genre).agg(F.count(F.lit(1)).alias("__n"))
    return _ranked_strings(c, group, capitalize(genre), [F.col("__n").desc(), F.col(genre)], n, "genres", " & ")


def sonality(res: DataFrame, group: str, genre: str = "genre", n_genres: int = 2) -> DataFrame:
    """P17 + A11 + A6: 'A blend of X & Y styles, generally characterized as: ...'.

    Two chained aggregates, no join: per (group, genre) counts and feature
    sums, then per group the means and the n most frequent genres (ties by
    name).  The per-group genre list is bounded by the number of genres.
    """
    feats = ("energy", "valence", "acousticness")
    g1 = res.groupBy(group, genre).agg(F.count(F.lit(1)).alias("__n"),
                                       *[F.sum(c).alias(f"__s_{c}") for c in feats],
                                       *[F.count(c).alias(f"__c_{c}") for c in feats])
    g2 = g1.groupBy(group).agg(
        *[F.try_divide(F.sum(f"__s_{c}"), F.sum(f"__c_{c}")).alias(c) for c in feats],
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("k"), F.col(genre).alias("g")))),
                1, n_genres).alias("__top"))
    genres = F.array_join(F.transform("__top", lambda x: capitalize(x["g"])), " & ")
    return g2.select(group, F.concat(F.lit("A blend of "), genres, F.lit(" styles, generally characterized as: "),
                                     traits(F.col("energy"), F.col("valence"), F.col("acousticness")),
                                     F.lit(".")).alias("sonality"))


def common_progressions(res: DataFrame, group: str, prog: str = "chord_main", order: str = "rk",
                        n: int = 3) -> DataFrame:
    """The n most common non-empty progressions with counts, ties by first appearance."""
    c = (res.where(F.col(prog).isNotNull() & (F.length(prog) > 0))
            .groupBy(group, prog).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first")))
    item = F.concat(F.col(prog), F.lit(" ("), F.col("__n").cast("string"), F.lit(")"))
    return _ranked_strings(c, group, item, [F.col("__n").desc(), F.col("__first")], n, "progressions", "; ")


def popular_titles(res: DataFrame, group: str, n: int = 3) -> DataFrame:
    """T1 per result set: titles of the n most popular songs."""
    return _ranked_strings(res, group, F.col("title"),
                           [F.col("popularity").desc_nulls_last(), F.col("song_id")], n, "popular", "; ")


def alpha_extremes(res: DataFrame, group: str) -> DataFrame:
    """T5: the most lyric-driven (lowest alpha) and most audio-driven (highest alpha) song."""
    lo = F.min(F.struct(F.col("alpha"), F.col("song_id")))
    hi = F.max(F.struct(F.col("alpha"), (-F.col("song_id")).alias("nid")))
    return res.groupBy(group).agg(lo.alias("__lo"), hi.alias("__hi")).select(
        group, F.col("__lo.song_id").alias("most_lyrical_id"), (-F.col("__hi.nid")).alias("most_audio_id"))


def report(res: DataFrame, group: str) -> DataFrame:
    """One report row per result set."""
    return (sonality(res, group).join(common_progressions(res, group), group, "left")
            .join(popular_titles(res, group), group).join(alpha_extremes(res, group), group))


def theme_prompt(title: Column, artist: Column, lyrics: Column) -> Column:
    """One summary request per song; blank lyrics read as 'Instrumental'."""
    body = F.when(F.length(strip(F.coalesce(lyrics, F.lit("")))) > 0, lyrics).otherwise(F.lit(INSTRUMENTAL))
    return F.format_string(THEME_TEMPLATE, title, artist, body)
