"""Secret scans: named patterns and a randomness test battery.

Named patterns (assignments, access keys, long hexadecimal runs) are taken as
they are.  Beside them every run of 20 or more key characters that touches none
of them is a candidate: its encoding is inferred from its characters, and four
tests ask whether its symbols look drawn at random from that alphabet:

* chi-squared uniformity of the alphabet, standardised with the exact variance
  for the length, so that short runs over large alphabets stay calibrated;
* Wald-Wolfowitz runs above and below the middle of the alphabet;
* lag-one serial correlation of the symbol values;
* where letters come in both cases, as many capitals as small letters (words
  joined by capitals pass no such test).

The smallest p-value counts as often as there are tests (Bonferroni), so a
random run falls under t in a share t of cases at most.  What is reported is
controlled over all documents: p-values are counted by encoding, length class
and fortieth of the unit interval.  Random runs spread evenly there, so the
upper half tells how many to expect above any bound; the bound of a class is
the lowest one above which at most a share ``FALSE_DISCOVERY`` (and what chance
allows) is more than that.  A lone candidate is reported if p > 0.025.

All is SQL functions: one pass over the texts writes base spans and candidates,
and the tests work on one row a candidate.

Defined results: null and empty texts have no spans; repeated rows give
repeated results; rows that share a doc_id are texts of their own.  A text of
n matches costs time in proportion to n.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import let, materialise, text_of

#: The named patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits a run must be able to hold: under this the tests have too little power (20 hexadecimal symbols hold 80).
LEAST_BITS = 80
FALSE_DISCOVERY = 0.05
#: Bins of p-values, and matches that one fold goes through.
BINS, FOLD = 40, 256
#: Fixed values: (pattern of the whole run without padding, alphabet) of each encoding, narrowest first.
ENCODINGS = (
    ("^[0-9]+$", "0123456789"),
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, m>> of the leftmost non-overlapping matches, in code points.

    The text between matches gives their positions.  Folds go through ``FOLD``
    matches at a time, and one fold goes through their lengths, so the lists
    they append to stay short.
    """
    kind = "array<struct<start:int,stop:int,m:string>>"
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pairs: Column) -> Column:
        folds = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / FOLD).cast("int")), lambda i: F.slice(pairs, i * FOLD + 1, FOLD))
        length = lambda x: x["gap"] + F.coalesce(F.char_length(x["m"]), F.lit(0))

        def add(acc, x):
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("start"), (acc["at"] + length(x)).alias("stop"), x["m"].alias("m"))
            return F.struct((acc["at"] + length(x)).alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

        def joined(parts: Column) -> Column:
            sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + length(x)))
            first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            starts = F.aggregate(sums, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
            one = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), add, lambda acc: acc["out"])
            return F.flatten(F.zip_with(parts, starts, one))

        return let(folds, joined)

    pairs = F.arrays_zip(F.transform(gaps, lambda g: F.char_length(g)).alias("gap"), found.alias("m"))
    return F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(let(pairs, placed))


def _spans(kind: int, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop")))


# ------------------------------------------------------------------ the tests
def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by its logistic approximation."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _statistics(run: Column, alphabet: Column) -> Column:
    """struct<n, bits, p> of one run over its alphabet."""
    capitals, small = (F.char_length(F.regexp_replace(run, c, "")).cast("double") for c in ("[^A-Z]", "[^a-z]"))
    letters = capitals + small
    case = F.abs(capitals - letters / 2) / F.sqrt(F.greatest(letters, F.lit(1.0)) / 4)
    cased = F.position(F.lit("A"), alphabet) * F.position(F.lit("a"), alphabet) > 0
    k = F.char_length(alphabet).cast("double")
    values = F.transform(F.split(run, ""), lambda c: F.position(c, alphabet).cast("double"))

    def battery(v: Column) -> Column:
        n = F.size(v).cast("double")
        squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, a: acc + F.pow(F.char_length(run) - F.char_length(F.replace(run, a, F.lit(""))), 2))
        chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        high = lambda x: F.when(x > k / 2, 1.0).otherwise(0.0)
        n1 = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + high(x))
        after = F.slice(v, 2, F.size(v) - 1)
        turns = F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), after, lambda a, b: F.abs(high(a) - high(b))), F.lit(1.0), lambda acc, x: acc + x)
        expected = 2 * n1 * (n - n1) / n + 1
        runs = F.abs(turns - expected) / F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.25)))
        mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n

        def serial(m: Column) -> Column:
            spread = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.pow(x - m, 2))
            along = F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), after, lambda a, b: (a - m) * (b - m)), F.lit(0.0), lambda acc, x: acc + x)
            return F.when(spread <= 0, F.lit(99.0)).otherwise(F.abs(along / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n))

        three = F.least(_tail(chi), 2 * _tail(runs), 2 * _tail(let(mean, serial)))
        p = F.when(cased, 4 * F.least(three, 2 * _tail(case))).otherwise(3 * three)
        return F.struct(n.alias("n"), (n * F.log2(k)).alias("bits"), F.least(p, F.lit(1.0)).alias("p"))

    return let(values, battery)


def tested(runs: DataFrame) -> DataFrame:
    """``runs`` (with ``m``) that the tests have power for, with encoding, length class and p."""
    run = F.regexp_replace("m", "=", "")
    encoding = F.coalesce(*[F.when(run.rlike(pattern), F.lit(i)) for i, (pattern, _) in enumerate(ENCODINGS)])
    alphabet = F.get(F.array(*[F.lit(a) for _, a in ENCODINGS]), F.col("encoding"))
    able = runs.withColumn("run", run).where(F.char_length("run") >= 20).withColumn("encoding", encoding)
    able = able.withColumn("t", _statistics(F.col("run"), alphabet)).where(F.col("t.bits") >= LEAST_BITS)
    return able.drop("run", "m").select("*", F.floor(2 * F.log2("t.n")).cast("int").alias("size"), F.col("t.p").alias("p")).drop("t")


def bounds(runs: DataFrame) -> DataFrame:
    """(encoding, size, bound): the p above which a class is reported; at most a few hundred rows."""
    bins = runs.groupBy("encoding", "size", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    lists = bins.groupBy("encoding", "size").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("n"))
    above = lambda j: F.aggregate(F.sequence(j, F.lit(BINS - 1)), F.lit(0).cast("bigint"), lambda s, i: s + F.coalesce(F.try_element_at("n", i), F.lit(0)))
    even = above(F.lit(BINS // 2)) / (BINS - BINS // 2)  # random runs in a bin, by the upper half

    def holds(j: Column) -> Column:
        seen = above(j).cast("double")
        return seen - even * (BINS - j) <= FALSE_DISCOVERY * seen + 2 * F.sqrt(seen)

    least = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(BINS - 1)), holds))
    return lists.select("encoding", "size", (F.coalesce(least, F.lit(BINS - 1)) / BINS).alias("bound"))


# ------------------------------------------------------------------- operator
def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: array<struct<start, kind, stop>> (kind: place in ``KINDS``), by start and kind."""
    text = F.col("text")
    found = docs.select("doc_id", text_of(docs).alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.filter(matches(text, ASSIGN), lambda x: F.char_length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8).alias("assign"),
        F.filter(matches(text, ACCESS), lambda x: x["stop"] - x["start"] >= 16).alias("access"),
        matches(text, HEX).alias("hex"),
        matches(text, CANDIDATE).alias("candidates"),
    )
    base = F.array_sort(F.concat(_spans(0, F.col("assign")), _spans(1, F.col("access")), _spans(2, F.col("hex"))))
    found = materialise(found.select("row", "doc_id", base.alias("base"), "candidates"), "secrets")  # spans and candidates, not the texts

    some = found.where(F.size("candidates") > 0)
    runs = some.select("row", F.explode("candidates").alias("x")).select("row", "x.start", "x.stop", "x.m")
    named = some.select("row", F.explode("base").alias("x")).select("row", "x.start", "x.stop", F.lit(None).cast("string").alias("m"))
    w = Window.partitionBy("row").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # running values: a frame that looks ahead would be read anew for every row
    is_base = F.col("m").isNull()
    ended = F.max(F.when(is_base, F.col("stop"))).over(w.orderBy("start"))
    begins = F.min(F.when(is_base, F.col("start"))).over(w.orderBy(F.col("start").desc()))
    free = runs.unionByName(named).select("*", ended.alias("ended"), begins.alias("begins"))
    free = free.where("m is not null and coalesce(ended, 0) <= start and coalesce(begins, stop) >= stop").drop("ended", "begins")
    judged = materialise(tested(free), "candidates")
    random = judged.join(F.broadcast(bounds(judged)), ["encoding", "size"]).where("p > bound")
    random = random.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "stop")).alias("random"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    return found.join(random, "row", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("random", none))).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
