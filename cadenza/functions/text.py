"""Column expressions for catalogue text: keys, slugs, file names, genres.

All helpers return ``Column`` objects built from JVM-side functions so they
stay inside whole-stage codegen.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the source behaviour for identical output) ----
# Characters removed by Python's str.strip() that matter for our inputs.
STRIP_CHARS = " \t\n\r\x0b\x0c"
# Words removed from URL slugs (only when the whole slug equals one of them).
SLUG_STOP_WORDS = ["remastered", "remaster", "remix", "version", "live", "acoustic", "feat", "ft"]
# Lyric page location and the comment that precedes the lyric body.
LYRICS_BASE_URL = "https://www.azlyrics.com/lyrics/"
LYRICS_MARKER = r"<!--\s*Usage of azlyrics\.com content"
# Characters not allowed in file names.
FILENAME_BAD_CHARS = r'[<>:"/\\|?*]'
# Sentinel for songs whose lyrics are not known.
LYRICS_NOT_FOUND = "LYRICS NOT FOUND"
# Version words that exclude a title from lyric lookup.
EXCLUDED_TERMS = ["(Remix)", "(Live)", "(Acoustic)", "(Instrumental)", "(Cover)"]
# -----------------------------------------------------------------------------

_WS = r"[\t\n\x0B\f\r ]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()`` for the whitespace set in ``STRIP_CHARS``."""
    return F.btrim(col_(c), F.lit(STRIP_CHARS))


def standardise(c) -> Column:
    """Trimmed text, '' for null."""
    return F.coalesce(strip(c), F.lit(""))


def capitalize(c) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    c = col_(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def resolve_genre(song_genre, fallback) -> Column:
    """The song's own genre if a non-blank string, else the file fallback; capitalised."""
    g = col_(song_genre)
    chosen = F.when(F.length(strip(g)) > 0, g).otherwise(col_(fallback))
    return capitalize(chosen)


def file_stem_genre(file_name) -> Column:
    """Fallback genre from a file name: stem without extension, every '-cp' removed."""
    stem = F.regexp_replace(col_(file_name), r"\.[^.]*$", "")
    return F.replace(stem, F.lit("-cp"), F.lit(""))


def match_key(c) -> Column:
    """Case- and blank-insensitive key."""
    return F.lower(strip(c))


def url_slug(c) -> Column:
    """Lyric-site slug of one name ('' when nothing is left)."""
    s = F.lower(strip(c))
    s = F.regexp_replace(s, r"(?i)^" + _WS + "*the" + _WS + "+", "")
    s = F.regexp_replace(s, r"[^a-z0-9_]", "")
    s = F.regexp_replace(s, r"\b(" + "|".join(SLUG_STOP_WORDS) + r")\b", "")
    return F.coalesce(s, F.lit(""))


def lyrics_url(artist, title, base: str = LYRICS_BASE_URL) -> Column:
    """Page URL, null when either slug is empty."""
    a, t = url_slug(artist), url_slug(title)
    return F.when((F.length(a) > 0) & (F.length(t) > 0),
                  F.concat(F.lit(base), a, F.lit("/"), t, F.lit(".html")))


def safe_filename(c) -> Column:
    """File-system safe name, 'unknown' when empty."""
    s = F.regexp_replace(col_(c), FILENAME_BAD_CHARS, "_")
    s = F.btrim(F.regexp_replace(s, _WS + "+", " "), F.lit(" "))
    s = F.regexp_replace(s, r"\.$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def lyric_file_name(artist, title) -> Column:
    """K7: ``artist - title.txt`` with both parts made safe."""
    return F.concat(safe_filename(artist), F.lit(" - "), safe_filename(title), F.lit(".txt"))


def html_lyrics_region(html) -> Column:
    """Text between the marker comment and the next script tag, '<br>' as newline.

    Falls back to everything before the first script tag; empty -> null.
    """
    h = col_(html)
    primary = F.regexp_extract(h, r"(?is)" + LYRICS_MARKER + r".*?-->(.*?)<script>", 1)
    primary = strip(primary)
    primary = F.replace(F.replace(primary, F.lit("<br>"), F.lit("\n")), F.lit("<br/>"), F.lit("\n"))
    fallback = strip(F.regexp_extract(h, r"(?is)^(.*?)<script[^>]*>", 1))
    return F.coalesce(F.nullif(primary, F.lit("")), F.nullif(fallback, F.lit("")))


def header_key(c) -> Column:
    """P10: table header text -> snake key."""
    s = F.lower(strip(c))
    s = F.replace(s, F.lit("#"), F.lit("rank"))
    s = F.regexp_replace(s, r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(s, r"(?U)[-\s]+", "_")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown_header"))


def error_class(c) -> Column:
    """Classify the text of a failed page."""
    t = F.lower(col_(c))
    return (F.when(t.contains("too many requests") | t.contains("rate limit"), F.lit("rate_limited"))
             .when(t.contains("not found") | t.contains("404"), F.lit("not_found"))
             .otherwise(F.lit("other")))


def last_word(c) -> Column:
    """Last blank-separated word (a trailing blank gives '')."""
    return F.element_at(F.split(col_(c), " "), -1)


def clean_lyrics(c) -> Column:
    """Drop bracketed section headers, sentinel for missing text."""
    s = F.regexp_replace(col_(c), r"\[.*?\]", "")
    return F.coalesce(F.nullif(strip(s), F.lit("")), F.lit(LYRICS_NOT_FOUND))


def is_excluded_version(title) -> Column:
    """Title carries one of the excluded version words (case-insensitive)."""
    pat = "|".join(t.replace("(", r"\(").replace(")", r"\)") for t in EXCLUDED_TERMS)
    return F.coalesce(col_(title).rlike("(?i)(" + pat + ")"), F.lit(False))


def url_encode(c) -> Column:
    """Percent-encoding as Python ``quote(s, safe='')``."""
    e = F.url_encode(col_(c))
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("%7E"), F.lit("~"))
    e = F.replace(e, F.lit("*"), F.lit("%2A"))
    return e
