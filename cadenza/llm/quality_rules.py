"""Quality rules: a threshold table compiled into one projection.

The table names a statistic, a bound and its side for each rule.  ``compile_rules``
turns it into one struct of booleans over the statistics; Spark evaluates
everything in a single pass over each text, without user functions, shuffles
or joins.

Defined results: a null or blank text has no words, all statistics 0, and
fails the length rule; repeated rows give repeated results.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import LOWER, UPPER, let, text_of, word_array

REPEAT_WINDOW = 8

#: Frequent short words of the languages of the corpus.
STOP_WORDS = (
    "a al and are as at au auf aus avec be been by con das de del dem den der des die du ein eine el elle en es est et for from "
    "für has he her his i il im in is ist it la las le les lo los mit ne nicht no of on or ou par pas por pour que qui se she sich sie "
    "sont su sur that the their they this to un una und une von was were which with y you zu"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails where the statistic is below ``least`` or above ``most``."""

    name: str
    stat: str
    least: float | None = None
    most: float | None = None


#: The production table.  The first two are the base rules; the others judge ratios.
RULES = (
    Rule("few_words", "n_words", least=20),
    Rule("repeated_words", "repeat_ratio", most=0.30),
    Rule("many_words", "n_words", most=5_000_000),
    Rule("short_words", "mean_word_chars", least=2.0),
    Rule("long_words", "mean_word_chars", most=14.0),
    Rule("symbols", "symbol_ratio", most=0.10),
    Rule("duplicate_lines", "dup_line_ratio", most=0.50),
    Rule("no_stop_words", "stop_word_ratio", least=0.005),
)
BASE = ("few_words", "repeated_words")


def repeated_window_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words that lie in a window found twice or more, the first occurrence included.

    Windows are compared by the 64-bit hash of their words' 64-bit hashes.
    Hashes are sorted with their positions only where one repeats.
    """
    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            hit = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, hit), lambda x: x["i"]))

        def span(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(-window).alias("last"), F.lit(0).cast("bigint").alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n")), lambda acc: acc["n"])

        return let(let(pairs, starts), span)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda hw: F.transform(F.sequence(F.lit(1), F.size(hw) - (window - 1)), lambda i: F.xxhash64(F.slice(hw, i, window))))
    repeated = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))
    return F.when(F.size(words) >= window, repeated).otherwise(F.lit(0).cast("bigint"))


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Counts of one text; ``words`` must be a plain column of its words."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    word_chars = F.char_length(F.array_join(words, ""))
    plain = F.transform(words, lambda w: F.regexp_replace(F.translate(w, UPPER, LOWER), r"^[^\p{L}]+|[^\p{L}]+$", ""))
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": word_chars.cast("bigint"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeated_window_words(words),
        "n_stop_words": F.size(F.filter(plain, lambda w: w.isin(STOP_WORDS))).cast("bigint"),
    }


def ratios() -> dict[str, Column]:
    """Ratios over the columns of ``statistics`` (0 where there is nothing to divide by)."""
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "repeat_ratio": over("n_repeat_words", "n_words"),
        "stop_word_ratio": over("n_stop_words", "n_words"),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """array<string>: names of the rules that fail, as one expression over statistics and ratios."""
    stats = {name: F.col(name) for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")} | ratios()
    # the base rule compares whole numbers: 100 * n > 30 * n_words
    exact = {"repeated_words": 100 * F.col("n_repeat_words") > 30 * F.col("n_words")}

    def fails(r: Rule) -> Column:
        low = stats[r.stat] < r.least if r.least is not None else F.lit(False)
        high = stats[r.stat] > r.most if r.most is not None else F.lit(False)
        return exact.get(r.name, low | high)

    return F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts, failed (names of failing rules) and kept for every document."""
    texts = docs.select("doc_id", text_of(docs).alias("text"))
    stats = texts.withColumn("words", word_array(F.col("text")))
    counted = stats.select("doc_id", *[c.alias(n) for n, c in statistics(F.col("text"), F.col("words")).items()])
    return counted.withColumn("failed", compile_rules(rules)).withColumn("kept", F.size("failed") == 0)
