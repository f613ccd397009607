"""The registered queries of the training-data operators and their SQL.

Each applies its operator with production parameters to the whole table and
derives the digest columns of its result.  Queries without SQL are tested
against brute force in ``tests/llm``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, embed_graph, lexical_lemp, license_scan, line_dedup, pii_crf, piece_bpe, prefix_trie, quality_rff, quality_rules, secrets, simhash, token_files
from cadenza.llm.common import LOWER, UPPER, read


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"))
    counts = [secrets.count_kind(F.col("spans"), i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts[:3], _sha(secrets.span_text(F.col("base"))).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"), counts[3])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("mark.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    out = marked.select("doc_id", "mark.n_words", n_hit.alias("n_hit"), F.size("mark.items").cast("bigint").alias("n_items"), _sha(F.array_join("mark.items", ",")).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find_pii(read(spark, sf_dir, "documents"))
    counts = [pii_crf.count_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(pii_crf.KINDS)]
    return found.select("doc_id", *counts, _sha(pii_crf.span_text(F.col("base"))).alias("base_sha256"), pii_crf.span_text(F.col("spans")).alias("spans"))


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.piece_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), _sha(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rff.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read(spark, sf_dir, "documents"), shingle=4, radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.quality_rules(read(spark, sf_dir, "documents"))
    base_failed = F.arrays_overlap("failed", F.array(*[F.lit(x) for x in quality_rules.BASE]))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", F.array_join("failed", ",").alias("failed"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summarise(license_scan.scan_licenses(read(spark, sf_dir, "documents")))


def op11_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_graph.embedding_groups(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_lemp.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


# ------------------------------------------------------------------------ SQL
_STRIP = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

LINE_SQL = rf"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM texts),
keyed AS (SELECT *, translate(regexp_replace(line, '{_STRIP}', '', 'g'), '{UPPER}', '{LOWER}') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {line_dedup.MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
marked AS (SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id < keeper AS lost FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _rules_sql() -> str:
    w = quality_rules.REPEAT_WINDOW
    value = {
        "n_words": "n_words", "mean_word_chars": "word_chars / n", "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "stop_word_ratio": "n_stop_words / n",
    }
    fails = []
    for r in quality_rules.RULES:
        test = "100 * n_repeat_words > 30 * n_words" if r.name == "repeated_words" else " OR ".join([f"{value[r.stat]} < {r.least}"] * (r.least is not None) + [f"{value[r.stat]} > {r.most}"] * (r.most is not None))
        fails.append(f"CASE WHEN {test} THEN '{r.name}' END")
    stops = ", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {w - 1}], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {w - 2})) AS i FROM texts WHERE len(ws) >= {w})),
again AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT doc_id, sum(least({w}, coalesce(j - i, {w}))) AS r FROM again GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
         len(list_filter(ws, lambda x: regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g') IN ({stops}))) AS n_stop_words
  FROM texts),
stats AS (
  SELECT counted.doc_id, n_words, word_chars, n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(r, 0)::BIGINT AS n_repeat_words, n_stop_words, greatest(n_words, 1) AS n
  FROM counted LEFT JOIN repeated ON counted.doc_id = repeated.doc_id),
judged AS (SELECT *, list_filter([{', '.join(fails)}], lambda x: x IS NOT NULL) AS f FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, len(f) = 0 AS kept, array_to_string(f, ',') AS failed
FROM judged
"""


def _license_sql() -> str:
    t = license_scan.THRESHOLD
    rows = [(i, name, g) for i, (name, text) in enumerate(license_scan.TEMPLATES) for g in license_scan.template_bigrams(text)]
    values = ", ".join(f"({i}, '{name}', '{g}')" for i, name, g in rows)
    sizes = ", ".join(f"({i}, {len(license_scan.template_words(text)) - 1})" for i, (_, text) in enumerate(license_scan.TEMPLATES))
    words = f"list_filter(string_split_regex(translate(u, '{UPPER}', '{LOWER}'), '{license_scan.SPLIT}'), lambda x: x <> '')"
    return rf"""
WITH grams(tid, license, g) AS (VALUES {values}),
sizes(tid, n) AS (VALUES {sizes}),
templates AS (SELECT tid, license, n, list(g) AS tg, count(*) AS b FROM grams JOIN sizes USING (tid) GROUP BY ALL),
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
units AS (SELECT doc_id, unnest(list_distinct([t] || string_split(t, chr(10)) || string_split(regexp_replace(t, '([.!?])\x20+', '\1' || chr(10), 'g'), chr(10)) || string_split_regex(t, '{license_scan.PARAGRAPH}'))) AS u FROM texts),
words AS (SELECT doc_id, row_number() OVER () AS uid, {words} AS w FROM units),
pairs AS (SELECT DISTINCT doc_id, uid, w[i] || ' ' || w[i + 1] AS g FROM (SELECT *, unnest(range(1, len(w))) AS i FROM words)),
unit AS (SELECT uid, count(*) AS a FROM pairs GROUP BY uid),
found AS (
  SELECT doc_id, license, 2.0::DOUBLE * count(*) / (any_value(a) + any_value(b)) AS dice
  FROM pairs JOIN grams USING (g) JOIN unit USING (uid) JOIN templates USING (tid, license) GROUP BY doc_id, uid, tid, license),
seqs AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS gs FROM (SELECT doc_id, {words} AS w FROM (SELECT doc_id, t AS u FROM texts))),
hits AS (SELECT doc_id, tid, i FROM (SELECT doc_id, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM seqs) JOIN grams USING (g)),
starts AS (SELECT DISTINCT doc_id, tid, unnest(range(greatest(i - n + 1, 1), i + 1)) AS s FROM hits JOIN templates USING (tid)),
windows AS (SELECT doc_id, tid, license, s, n, b, list_distinct(gs[s:s + n - 1]) AS a, tg FROM starts JOIN templates USING (tid) JOIN seqs USING (doc_id) WHERE s + n - 1 <= len(gs)),
scored AS (SELECT doc_id, tid, license, s, n, 2.0::DOUBLE * len(list_intersect(a, tg)) / (len(a) + b) AS dice FROM windows),
heads AS (SELECT *, coalesce(2 * (s - lag(s) OVER (PARTITION BY doc_id, tid ORDER BY s)) > n, true)::INT AS head FROM scored WHERE dice >= {t}),
passages AS (
  SELECT doc_id, license, max(dice) AS dice FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id, tid ORDER BY s) AS p FROM heads)
  GROUP BY doc_id, tid, license, p),
kept AS (SELECT doc_id, license, dice FROM found WHERE dice >= {t} UNION ALL SELECT doc_id, license, dice FROM passages)
SELECT doc_id, count(dice) AS n_matches, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses,
       first(license ORDER BY dice DESC, license) AS best_license, max(dice) AS best_dice
FROM texts LEFT JOIN kept USING (doc_id) GROUP BY doc_id
"""


_TERMS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')"

LEXICAL_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents),
items AS (SELECT row_number() OVER () AS qid, item_id, list_distinct({_TERMS}) AS ts FROM benchmark),
asked AS (SELECT qid, unnest(ts) AS term FROM items),
known AS (SELECT count(*) AS nd, sum(len(ws))::BIGINT AS nt FROM docs WHERE len(ws) > 0),
postings AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, known GROUP BY term),
lengths AS (SELECT rid, doc_id, 100 - 90 + (90 * len(ws) * nd) // nt AS m FROM docs, known WHERE len(ws) > 0),
scores AS (
  SELECT qid, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (rid) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scores WHERE score > 0)
SELECT item_id, r::INT AS rank, doc_id, score FROM ranked JOIN items USING (qid) WHERE r <= 10
"""


#: A list of steps for each character of the decimal conv_id: its byte plus 1 is mixed in, each 0 shifts one bit out.
_CRC_STEPS = "[4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x) + 1, 0, 0, 0, 0, 0, 0, 0, 0]))"
_CRC = f"xor(list_reduce({_CRC_STEPS}, lambda c, s: CASE WHEN s > 0 THEN xor(c, s - 1) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"

TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS piece, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE pos <= h
  UNION ALL SELECT t.conv_id, 1, pos, role, text FROM turns t JOIN convs c ON t.conv_id = c.conv_id WHERE pos > h),
seqs AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY piece, pos) AS k, list(strlen(text) ORDER BY piece, pos) AS b FROM rebuilt GROUP BY conv_id),
whole AS (SELECT convs.conv_id, coalesce(k, []) AS k, coalesce(b, []) AS b FROM convs LEFT JOIN seqs ON convs.conv_id = seqs.conv_id),
prefixes AS (SELECT conv_id, d, array_to_string(k[1:d], '') AS key, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS size, len(k) = d AS ends FROM (SELECT *, unnest(range(len(k) + 1)) AS d FROM whole)),
nodes AS (
  SELECT d, key, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, key),
kids AS (SELECT d - 1 AS d, substr(key, 1, 32 * (d - 1)) AS key, count(*) AS c FROM nodes WHERE d > 0 GROUP BY ALL),
sized AS (SELECT nodes.*, coalesce(c, 0) AS c FROM nodes LEFT JOIN kids USING (d, key)),
above AS (SELECT u, substr(key, 1, 32 * u) AS key, (n - 1) * size AS saved, (c = 0)::INT AS leaf FROM (SELECT *, unnest(range(d + 1)) AS u FROM sized)),
sums AS (SELECT u AS d, key, sum(saved)::BIGINT AS saved, sum(leaf)::BIGINT AS leaves FROM above GROUP BY ALL)
SELECT s.conv_id, s.d AS depth, p.conv_id AS parent_conv_id, s.n AS n_convs, s.c AS n_children, leaves AS n_leaves, saved AS saved_tokens, s.ends_sha256
FROM sized s JOIN sums USING (d, key) LEFT JOIN nodes p ON p.d = s.d - 1 AND p.key = substr(s.key, 1, 32 * (s.d - 1))
"""


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_decontaminate, op3_token_files, op4_personal_data, op5_piece_bpe, op6_line_dedup, op7_quality, op8_simhash, op9_quality_rules, op10_license_scan, op11_embedding_groups, op12_lexical_search, op13_prefix_trie)}
ORACLES = {"op6_line_dedup": LINE_SQL, "op9_quality_rules": _rules_sql(), "op10_license_scan": _license_sql(), "op12_lexical_search": LEXICAL_SQL, "op13_prefix_trie": TRIE_SQL}
