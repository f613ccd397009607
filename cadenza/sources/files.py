"""File readers for the catalogue formats (S1-S9) and table-shaped re-aims.

Every reader declares its schema (no inference on the hot path), keeps the
file name from ``_metadata`` where provenance matters, and returns a
DataFrame; nothing is read on the driver.
"""
from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cadenza.functions import text as T
from cadenza.sources.records import read_records

SCALARS = ["bpm", "danceability", "energy", "acousticness", "instrumentalness", "liveness",
           "loudness", "speechiness", "valence"]

def read_by_header(spark: SparkSession, path: str, sep: str = ",", **options) -> DataFrame:
    """Delimited text with every column as text, named by the header line.

    The schema comes from the header of one file; a file whose header differs
    raises instead of binding its columns to other names.
    """
    reader = lambda: spark.read.option("header", True).option("sep", sep).options(**options)
    names = reader().csv(path).columns
    return reader().option("enforceSchema", False).schema(StructType([StructField(c, StringType()) for c in names])).csv(path)


def named(df: DataFrame, name: str) -> Column:
    """A column by its header name; '' where the header has no such name."""
    return F.col(f"`{name}`") if name in df.columns else F.lit("")


SONG_JSON_SCHEMA = StructType(
    [StructField(c, StringType()) for c in ("title", "artist", "genre", "popularity")]
    + [StructField(c, StringType()) for c in SCALARS]
    + [StructField("chord_progression", StringType()), StructField("lyrics", StringType()),
       StructField("audio_file_path", StringType()), StructField("_corrupt_record", StringType())])


def read_song_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """S1 + P2 + D5: every ``*.json`` file of a folder (arrays of song objects).

    Nested fields are read as text and parsed afterwards, so one odd value
    cannot turn a whole file into a corrupt record; unreadable files become a
    single corrupt row and are skipped.  Adds ``source_file``, ``seq`` (file
    order: a multi-line file is read by exactly one task) and ``main_genre``.
    """
    raw = (spark.read.schema(SONG_JSON_SCHEMA).option("multiLine", multiline)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
           .option("pathGlobFilter", "*.json").json(path))
    df = (raw.withColumn("source_file", F.col("_metadata.file_name"))
             .withColumn("seq", F.monotonically_increasing_id())
             # corrupt rows have no fields; naming a data column as well keeps the filter
             # valid when a query prunes everything else (e.g. a bare count)
             .where(F.col("_corrupt_record").isNull() | F.col("title").isNotNull()).drop("_corrupt_record"))
    prog = F.from_json(F.col("chord_progression"), "map<string,string>")
    return df.select(
        "title", "artist",
        T.resolve_genre("genre", T.file_stem_genre("source_file")).alias("main_genre"),
        F.col("popularity").try_cast("double").alias("popularity"),
        *[F.col(c).try_cast("double").alias(c) for c in SCALARS],
        F.coalesce(prog, F.create_map().cast("map<string,string>")).alias("chord_progression"),
        F.coalesce(F.col("lyrics"), F.lit("")).alias("lyrics"),
        "audio_file_path", "source_file", "seq")


def read_title_artist_pairs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Distinct (artist, title) of all objects having both keys; error when no file."""
    df = spark.read.schema("title string, artist string").option("multiLine", multiline) \
        .option("pathGlobFilter", "*.json").json(path)
    if not df.inputFiles():
        raise FileNotFoundError(f"no .json file in {path}")
    return df.where(F.col("title").isNotNull() & F.col("artist").isNotNull()) \
             .select("artist", "title").distinct()


def read_charts(spark: SparkSession, root: str, years: Iterable[int] | None = None,
                countries: Iterable[str] | None = None) -> DataFrame:
    """Tab-separated weekly charts under ``root/<country>/<year>/*``.

    Year and country come from the path.  Only the folders asked for are
    listed and read ('country=x/year=y' folders are accepted too); files
    elsewhere under ``root`` are no charts.  Columns
    are bound by header name.
    """
    glob = lambda xs: "{" + ",".join(f"{x},*={x}" for x in xs) + "}"
    country = glob(countries) if countries is not None else "*"
    pat = r"/(?:[A-Za-z_]+=)?([^/=]+)/(?:[A-Za-z_]+=)?([0-9]{4})/[^/]+$"
    df = read_by_header(spark, f"{root}/{country}/{glob(years if years is not None else ['[0-9][0-9][0-9][0-9]'])}", sep="\t", recursiveFileLookup=True)
    p = F.col("_metadata.file_path")
    return df.select(T.standardise(named(df, "artist")).alias("artist"), T.standardise(named(df, "song_name")).alias("title"),
                     T.standardise(named(df, "song_id")).alias("song_id"),
                     F.regexp_extract(p, pat, 1).alias("country"), F.regexp_extract(p, pat, 2).try_cast("int").alias("year")) \
             .where(F.col("year").isNotNull())


HIT_FEATURES = ["acousticness", "danceability", "energy", "instrumentalness", "liveness", "loudness",
                "speechiness", "tempo", "valence", "key", "mode"]


def read_hits_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Hit-song TSV; id/title/artist trimmed, the 11 features kept as text."""
    df = read_by_header(spark, path, sep="\t")
    return df.select(T.standardise(named(df, "song_id")).alias("id"), T.standardise(named(df, "song_name")).alias("title"),
                     T.standardise(named(df, "artist_name")).alias("artist"),
                     *[F.coalesce(named(df, c), F.lit("")).alias(c) for c in HIT_FEATURES])


TRACK_COLS = ["id", "name", "artists", "danceability", "energy", "key", "loudness", "mode", "speechiness",
              "acousticness", "instrumentalness", "liveness", "valence", "tempo"]


def read_tracks_csv(spark: SparkSession, path: str) -> DataFrame:
    """S6 + P1: comma CSV with quoted multi-line fields; 14 columns renamed and trimmed."""
    df = read_by_header(spark, path, quote='"', escape='"', multiLine=True)
    ren = {"name": "title", "artists": "artist"}
    return df.select(*[T.standardise(named(df, c)).alias(ren.get(c, c)) for c in TRACK_COLS])


_QUOTED = r'(?s)^"((?:[^"]|"")*)"(.*)$'


def csv_field(v: Column) -> Column:
    """A delimited field as Python's csv reader returns it: a leading quoted part is
    unquoted ('""' -> '"') and any characters after the closing quote are kept."""
    body = F.replace(F.regexp_extract(v, _QUOTED, 1), F.lit('""'), F.lit('"'))
    return F.when(v.rlike(_QUOTED), F.concat(body, F.regexp_extract(v, _QUOTED, 2))).otherwise(v)


def read_mixed_delim(spark: SparkSession, path: str,
                     wanted: Sequence[tuple[str, str]] = (("spotify_id", "spotify_id"), ("name", "title"),
                                                          ("artist", "artist"))) -> DataFrame:
    """Header line split on commas, data records on semicolons.

    Short rows keep only the columns they have ('' for the rest); quotes then
    blanks are stripped from every value.  A quoted field may hold line feeds,
    also across the border of two file splits.  The header is the first line of
    the first file; a file that begins with the same line has it too.
    """
    files = sorted(spark.read.text(path).inputFiles())  # a listing, nothing is read
    header = next((h for h in (spark.read.text(f).limit(1).first() for f in files) if h is not None), None)
    if header is None:
        raise ValueError(f"no lines in {path}")
    names = [h.strip('"') for h in header["value"].strip().split(",")]
    data = read_records(spark, path).where(~(F.col("first") & (F.col("value") == F.lit(header["value"]))))
    # a field that begins with a quote ends at the first ';' after its closing quote, any other at the next ';'
    parts = F.regexp_extract_all(F.concat(F.lit(";"), "value"), F.lit(r';("(?:[^"]|"")*+"[^;]*|[^;]*)'), F.lit(1))
    out = []
    for w, alias in wanted:
        if w in names:
            i = len(names) - 1 - names[::-1].index(w)  # a repeated name keeps the last column
            v = F.when(F.size(parts) > i, F.get(parts, i))
            v = T.strip(F.regexp_replace(csv_field(F.coalesce(v, F.lit(""))), '^"+|"+$', ""))
            out.append(F.coalesce(v, F.lit("")).alias(alias))
        else:
            out.append(F.lit("").alias(alias))
    return data.select(*out)


def read_feature_csv(spark: SparkSession, path: str, id_cols=("filename", "label", "length")) -> DataFrame:
    """Labelled feature CSV -> (filename, label, features array<double>)."""
    df = read_by_header(spark, path)
    feats = [c for c in df.columns if c not in id_cols]
    if not feats:
        raise ValueError("feature CSV has no feature columns")
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df.select("filename", "label", F.array(*[F.col(f"`{c}`").try_cast("double") for c in feats]).alias("features"))


def read_prepped(spark: SparkSession, path: str) -> DataFrame:
    """Prepared songs table."""
    return spark.read.parquet(path)


def read_artifacts(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Scaler stats, vocabulary and model weights; a clear error when one is missing."""
    out = {}
    for name in ("scaler_stats", "vocab", "model_weights"):
        try:
            out[name] = spark.read.parquet(f"{base}/{name}")
        except Exception as e:  # pragma: no cover - message path
            raise FileNotFoundError(f"artifact '{name}' missing under {base}; run the preparation step first") from e
    return out


# ---- S12 / P12: stored table (header list + cell arrays) -> typed track rows ----
# fixed values: the wanted columns and the placeholder for short rows
TRACK_TABLE_COLUMNS = ["track", "artist", "key", "bpm", "duration", "camelot", "acousticness", "danceability",
                       "energy", "instrumentalness", "liveness", "loudness", "speechiness", "valence",
                       "popularity", "release_date"]
MISSING_CELL = "Missing Column"


def columns_by_header(df: DataFrame, headers: Sequence[str], cells: str = "cells") -> DataFrame:
    """Pick the wanted columns by cleaned header; short rows give 'Missing Column'.

    The header -> position map is computed from the (small) header list;
    ``parse_errors`` is true for rows that were too short, else null.
    """
    hk = df.sparkSession.createDataFrame([(h,) for h in headers], "h string").select(T.header_key("h").alias("k")).collect()
    keys = [r["k"] for r in hk]
    pos = {}
    for i, k in enumerate(keys):
        pos[k] = i  # later duplicates win, as a dict build does
    sel, errs = [], []
    c = F.col(cells)
    for name in TRACK_TABLE_COLUMNS:
        if name in pos:
            i = pos[name]
            short = F.size(c) <= i
            sel.append(F.when(short, F.lit(MISSING_CELL)).otherwise(T.strip(F.coalesce(F.get(c, i), F.lit("")))).alias(name))
            errs.append(short)
        else:
            sel.append(F.lit(None).cast("string").alias(name))
    err = F.lit(False)
    for e in errs:
        err = err | e
    return df.select("*", *sel).withColumn("parse_errors", F.when(err, F.lit(True))).drop(cells)


def missing_headers(spark: SparkSession, headers: Sequence[str]) -> list[str]:
    """Wanted columns whose header is absent."""
    keys = {r["k"] for r in spark.createDataFrame([(h,) for h in headers], "h string")
            .select(T.header_key("h").alias("k")).collect()}
    return [c for c in TRACK_TABLE_COLUMNS if c not in keys]


def resolve_link(base_url: Column, href: Column) -> Column:
    """Absolute link from a page URL and an href (absolute, root- or path-relative)."""
    origin = F.regexp_extract(base_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path_base = F.regexp_replace(F.regexp_replace(base_url, r"[?#].*$", ""), r"[^/]*$", "")
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
             .when(href.startswith("//"), F.concat(F.regexp_extract(base_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
             .when(href.startswith("/"), F.concat(origin, href))
             .otherwise(F.concat(path_base, href)))
