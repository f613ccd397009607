"""Model scoring, similar-song recommendation and ideation queries on the scored library."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import ideation as I
from cadenza.operators.aggregates import vector_mean
from cadenza.operators.model import GatedModel, explode_vector, score
from cadenza.operators.similarity import similarity_topk
from cadenza.operators.topk import keyword_search, top_n_per_group
from cadenza.plans.catalog import s_strip
from cadenza.plans.registry import query
from cadenza.session import shared_path
from cadenza.sources.tables import library, read_table

K = 10
EMB, HID, IN = 16, 8, 32


def _lyr(o, d):
    return (f"list_transform(range({o}), lambda i: greatest(0.0, list_sum(list_transform(range({d}), "
            f"lambda j: sin(31*i + 17*j + {{off}}) / sqrt({d}) * {{x}}[j+1])) + 0.1*cos(13*i + {{off}})))")


LIB_SQL = (
    "lib0 AS (SELECT e.vec_id AS song_id, p.p_name AS title, p.p_brand AS artist, p.p_type AS genre, "
    "p.p_retailprice AS popularity, CAST(e.embedding AS DOUBLE[]) AS v, p.p_size / 50.0 AS energy, "
    "(p.p_retailprice - floor(p.p_retailprice / 100) * 100) / 100.0 AS valence, "
    "least(1.0, abs(CAST(e.embedding[1] AS DOUBLE)) * 5) AS acousticness, replace(p.p_name, ' ', ' - ') AS chord_main "
    "FROM embeddings e JOIN part p ON e.vec_id = p.p_partkey), "
    "lib1 AS (SELECT *, v[1:32] AS a, v[33:64] AS t FROM lib0), "
    f"lib2 AS (SELECT *, {_lyr(EMB, IN).format(off=1, x='a')} AS pa, {_lyr(EMB, IN).format(off=2, x='t')} AS pt FROM lib1), "
    "lib3 AS (SELECT *, list_concat(pa, pt) AS g FROM lib2), "
    f"lib4 AS (SELECT *, {_lyr(HID, 2 * EMB).format(off=3, x='g')} AS h FROM lib3), "
    f"lib5 AS (SELECT *, 1.0 / (1.0 + exp(-(list_sum(list_transform(range({HID}), lambda j: sin(17*j + 4) / sqrt({HID}) * h[j+1])) "
    "+ 0.1*cos(4)))) AS alpha FROM lib4), "
    "lib6 AS (SELECT *, list_transform(range(16), lambda i: alpha * pa[i+1] + (1 - alpha) * pt[i+1]) AS fu FROM lib5), "
    "lib AS (SELECT *, list_transform(fu, lambda x: x / greatest(sqrt(list_sum(list_transform(fu, lambda y: y*y))), 1e-12)) AS fe FROM lib6)"
)


def cos_sql(a, b):
    na, nb = f"sqrt(list_inner_product({a}, {a}))", f"sqrt(list_inner_product({b}, {b}))"
    return f"(CASE WHEN {na} * {nb} = 0 THEN 0.0 ELSE list_inner_product({a}, {b}) / ({na} * {nb}) END)"


def pct_sql(x):
    return f"CAST(round_even(({x}) * 100, 0) AS BIGINT) || '%'"


def scored(spark, sf):
    lib = library(spark, sf)
    return score(lib, GatedModel.from_formula(IN, IN, EMB, HID))


@query("mod_project", sql=f"""
WITH {LIB_SQL}
SELECT song_id, generate_subscripts(pa, 1) - 1 AS pos, round(unnest(pa), 6) AS proj_audio, round(unnest(pt), 6) AS proj_text FROM lib
""")
def mod_project(spark, sf):
    """M1: relu(W x + b) projection of each modality."""
    s = scored(spark, sf)
    e = explode_vector(s, "song_id", "proj_audio", "proj_text")
    return e.select("song_id", "pos", F.round("proj_audio", 6).alias("proj_audio"), F.round("proj_text", 6).alias("proj_text"))


@query("mod_gate", sql=f"WITH {LIB_SQL} SELECT song_id, round(alpha, 6) AS alpha FROM lib")
def mod_gate(spark, sf):
    """M2: gate alpha = sigmoid(W2 relu(W1 [a; t] + b1) + b2)."""
    return scored(spark, sf).select("song_id", F.round("alpha", 6).alias("alpha"))


@query("mod_fuse_score", sql=f"""
WITH {LIB_SQL} SELECT song_id, generate_subscripts(fe, 1) - 1 AS pos, round(unnest(fe), 6) AS final_embedding FROM lib
""")
def mod_fuse_score(spark, sf):
    """M3: normalize(alpha a + (1 - alpha) t) for the whole library."""
    e = explode_vector(scored(spark, sf), "song_id", "final_embedding")
    return e.select("song_id", "pos", F.round("final_embedding", 6).alias("final_embedding"))


_MODES = {"balanced": "fe", "audio_focus": "pa", "lyric_focus": "pt"}
_MODE_COL = {"balanced": "final_embedding", "audio_focus": "proj_audio", "lyric_focus": "proj_text"}


def _rec_sql(mode, k, seeds="lib"):
    col = _MODES[mode]
    return (f"SELECT * FROM (SELECT '{mode}' AS mode, s.song_id AS seed_id, c.song_id AS rec_id, {cos_sql('s.' + col, 'c.' + col)} AS score, "
            f"row_number() OVER (PARTITION BY s.song_id ORDER BY round({cos_sql('s.' + col, 'c.' + col)}, 9) DESC, c.song_id) AS rank "
            f"FROM {seeds} s JOIN lib c ON s.song_id <> c.song_id) WHERE rank <= {k}")


def similar(lib_scored, mode, k, seeds=None):
    """Top-k similar songs per seed in one mode (unknown mode = balanced)."""
    col = _MODE_COL.get(mode, "final_embedding")
    q = lib_scored if seeds is None else seeds
    r = similarity_topk(q, lib_scored, k=k, q_id="song_id", q_vec=col, c_id="song_id", c_vec=col,
                        exclude_self=True)
    return r.withColumn("mode", F.lit(mode if mode in _MODE_COL else "balanced"))


@query("rec_similar", sql=f"WITH {LIB_SQL}, r AS ({_rec_sql('balanced', K)} UNION ALL {_rec_sql('audio_focus', K)} "
                          f"UNION ALL {_rec_sql('lyric_focus', K)}) SELECT mode, seed_id, rec_id, round(score, 6) AS score, rank FROM r")
def rec_similar(spark, sf):
    """Top-10 similar songs for every song in the three modes."""
    s = scored(spark, sf).cache()
    out = None
    for m in _MODES:
        r = similar(s, m, K)
        out = r if out is None else out.unionByName(r)
    return out.select("mode", "seed_id", "rec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# ---- fixed values: explanation wording ----
EXPLAIN_INTRO = "  - Overall Match Score: {o}\n"
EXPLAIN_SONIC = "    - Reason: This song is recommended primarily for its **sonic similarity** ({a})."
EXPLAIN_LYRIC = "    - Reason: This song is recommended primarily for its **lyrical theme** ({t})."
EXPLAIN_BALANCED = ("    - Reason: This is a strong **balanced match**, with both sonic ({a}) and lyrical ({t}) "
                    "elements contributing.")
EXPLAIN_INSIGHT = ("\n    - Insight: Your song is {alpha} audio-driven, showing how its identity is balanced "
                   "between sound and lyrics.")
MARGIN = 0.1
# -------------------------------------------


def _pct(c):
    return F.concat(F.bround(c * 100, 0).cast("long").cast("string"), F.lit("%"))


def _fill(template, **cols):
    parts, rest = [], template
    while "{" in rest:
        i = rest.index("{")
        j = rest.index("}", i)
        parts += [F.lit(rest[:i]), cols[rest[i + 1:j]]]
        rest = rest[j + 1:]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def explanation(mode: str, overall, audio_sim, text_sim, seed_alpha):
    """Reason text from overall, raw-audio and raw-text cosine and the seed's alpha."""
    o, a, t, al = _pct(overall), _pct(audio_sim), _pct(text_sim), _pct(seed_alpha)
    if mode == "audio_focus":
        reason = _fill(EXPLAIN_SONIC, a=a)
    elif mode == "lyric_focus":
        reason = _fill(EXPLAIN_LYRIC, t=t)
    elif mode != "balanced":
        reason = _fill(EXPLAIN_BALANCED, a=a, t=t)
    else:
        reason = (F.when(audio_sim > text_sim + MARGIN, _fill(EXPLAIN_SONIC, a=a))
                   .when(text_sim > audio_sim + MARGIN, _fill(EXPLAIN_LYRIC, t=t))
                   .otherwise(_fill(EXPLAIN_BALANCED, a=a, t=t)))
    return F.concat(_fill(EXPLAIN_INTRO, o=o), reason, _fill(EXPLAIN_INSIGHT, alpha=al))


def _explain_sql(mode):
    o, a, t, al = pct_sql("score"), pct_sql("asim"), pct_sql("tsim"), pct_sql("s_alpha")
    sonic = f"'{EXPLAIN_SONIC.split('{')[0]}' || {a} || ').'"
    lyric = f"'{EXPLAIN_LYRIC.split('{')[0]}' || {t} || ').'"
    bal = (f"'    - Reason: This is a strong **balanced match**, with both sonic (' || {a} || ') and lyrical (' || {t} || "
           "') elements contributing.'")
    if mode == "audio_focus":
        reason = sonic
    elif mode == "lyric_focus":
        reason = lyric
    elif mode != "balanced":
        reason = bal
    else:
        reason = f"CASE WHEN asim > tsim + {MARGIN} THEN {sonic} WHEN tsim > asim + {MARGIN} THEN {lyric} ELSE {bal} END"
    return (f"'  - Overall Match Score: ' || {o} || chr(10) || {reason} || chr(10) || '    - Insight: Your song is ' || {al} || "
            "' audio-driven, showing how its identity is balanced between sound and lyrics.'")


_TITLE_Q = "bolt"


@query("rec_explained", sql=f"""
WITH {LIB_SQL},
seed AS (SELECT * FROM lib WHERE contains(lower(title), lower('{_TITLE_Q}')) ORDER BY song_id LIMIT 1),
r AS ({_rec_sql('balanced', 5, 'seed')}),
x AS (SELECT r.*, c.title, c.artist, c.genre, {cos_sql('s.a', 'c.a')} AS asim, {cos_sql('s.t', 'c.t')} AS tsim, s.alpha AS s_alpha
      FROM r JOIN seed s ON s.song_id = r.seed_id JOIN lib c ON c.song_id = r.rec_id)
SELECT rank, title, artist, genre, {_explain_sql('balanced')} AS explanation FROM x
""")
def rec_explained(spark, sf, title_query=_TITLE_Q, mode="balanced", top_n=5):
    """R2: seed found by title (first match), top 5 in the mode, each with its explanation."""
    s = scored(spark, sf).cache()
    seed = (s.where(F.coalesce(F.lower("title").contains(title_query.lower()), F.lit(False)))
             .orderBy("song_id").limit(1))
    r = similar(s, mode, top_n, seeds=seed)
    sv = seed.select(F.col("song_id").alias("seed_id"), F.col("audio").alias("sa"), F.col("text").alias("st"),
                     F.col("alpha").alias("s_alpha"))
    cv = s.select(F.col("song_id").alias("rec_id"), "title", "artist", "genre",
                  F.col("audio").alias("ca"), F.col("text").alias("ct"))
    j = r.join(sv, "seed_id").join(cv, "rec_id")
    from cadenza.functions.vectors import cosine
    j = j.withColumn("asim", cosine(F.col("sa"), F.col("ca"))).withColumn("tsim", cosine(F.col("st"), F.col("ct")))
    return j.select(F.col("rank").cast("long").alias("rank"), "title", "artist", "genre",
                    explanation(mode, F.col("score"), F.col("asim"), F.col("tsim"), F.col("s_alpha")).alias("explanation"))


@query("arg_alpha_extremes", sql=f"""
WITH {LIB_SQL}
SELECT genre, arg_min(song_id, (alpha, song_id)) AS most_lyrical_id, arg_max(song_id, (alpha, -song_id)) AS most_audio_id FROM lib GROUP BY genre
""")
def arg_alpha_extremes(spark, sf):
    """T5: per genre, the song with the lowest and with the highest alpha."""
    return I.alpha_extremes(scored(spark, sf), "genre")


_THEME_SQL = (f"CASE WHEN length({s_strip('coalesce(d.text, ' + chr(39) + chr(39) + ')')}) > 0 THEN d.text ELSE 'Instrumental' END")


@query("prj_theme_prompt", sql=f"""
SELECT p.p_partkey AS song_id,
  'Summarise the central theme of the song \"' || p.p_name || '\" by ' || p.p_brand || ' in one sentence.' || chr(10) || 'Lyrics:' || chr(10) || {_THEME_SQL} AS prompt
FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey
""")
def prj_theme_prompt(spark, sf):
    """One theme request per song; blank lyrics read 'Instrumental'."""
    p = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    j = p.join(d, p.p_partkey == d.doc_id, "left")
    return j.select(F.col("p_partkey").alias("song_id"), I.theme_prompt(F.col("p_name"), F.col("p_brand"), F.col("text")).alias("prompt"))


@query("idea_inspire", sql=f"""
SELECT genre, rank, title, artist, popularity, '{I.THEME_DISABLED}' AS theme FROM (
  SELECT p_type AS genre, p_name AS title, p_brand AS artist, CAST(trunc(p_retailprice) AS BIGINT) AS popularity,
         row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rank FROM part) WHERE rank <= 3
""")
def idea_inspire(spark, sf, themes=None):
    """The 3 most popular songs of every genre with their theme.

    ``themes`` is an optional stored (song_id, theme) table; without it the
    fixed 'disabled' text stands in for the summary service.
    """
    p = read_table(spark, sf, "part").select(F.col("p_partkey").alias("song_id"), F.col("p_type").alias("genre"),
                                             F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
                                             F.col("p_retailprice").alias("popularity"))
    t = top_n_per_group(p, ["genre"], [F.col("popularity").desc_nulls_last(), F.col("song_id")], 3)
    if themes is not None:
        t = t.join(themes, "song_id", "left")
    else:
        t = t.withColumn("theme", F.lit(None).cast("string"))
    return t.select("genre", F.col("rank").cast("long").alias("rank"), "title", "artist",
                    F.col("popularity").cast("long").alias("popularity"),
                    F.coalesce("theme", F.lit(I.THEME_DISABLED)).alias("theme"))


_CROSS_SQL = (
    "src AS (SELECT genre AS sg, song_id, t, row_number() OVER (PARTITION BY genre ORDER BY popularity DESC NULLS LAST, song_id) AS r FROM lib), "
    "cnt AS (SELECT genre, count(*) AS n FROM lib GROUP BY genre), "
    "x AS (SELECT sg, generate_subscripts(t, 1) AS pos, unnest(t) AS val FROM src WHERE r <= 3), "
    "mv AS (SELECT sg, list(m ORDER BY pos) AS q FROM (SELECT sg, pos, avg(val) AS m FROM x GROUP BY sg, pos) GROUP BY sg), "
    "mvq AS (SELECT mv.* FROM mv JOIN cnt ON cnt.genre = mv.sg WHERE cnt.n >= 3), "
    f"sim AS (SELECT mvq.sg, l.song_id, l.genre, {cos_sql('mvq.q', 'l.t')} AS s FROM mvq, lib l), "
    "top20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sg ORDER BY round(s, 9) DESC, song_id) AS sr FROM sim) WHERE sr <= 20), "
    "t3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sg ORDER BY sr) AS r5 FROM top20 WHERE genre <> sg) WHERE r5 <= 5), "
    "t4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sg, genre ORDER BY sr) AS gr FROM t3) WHERE gr <= 2)"
)


def _cross(spark, sf):
    lib = library(spark, sf)
    cnt = lib.groupBy("genre").agg(F.count(F.lit(1)).alias("n"))
    top3 = top_n_per_group(lib, ["genre"], [F.col("popularity").desc_nulls_last(), F.col("song_id")], 3)
    theme = vector_mean(top3.join(cnt.where(F.col("n") >= 3), "genre"), "text", ["genre"])
    seeds = theme.select(F.col("genre").alias("sg"), F.xxhash64("genre").alias("sid"), F.col("text_mean").alias("q"))
    r = similarity_topk(seeds, lib, k=20, q_id="sid", q_vec="q", c_id="song_id", c_vec="text", metric="cosine",
                        strategy="auto")
    r = r.join(seeds.select(F.col("sid").alias("seed_id"), "sg"), "seed_id") \
         .join(lib.select(F.col("song_id").alias("rec_id"), "genre"), "rec_id")
    return r


@query("topk_then_exclude", sql=f"WITH {LIB_SQL}, {_CROSS_SQL} SELECT sg AS source_genre, song_id, genre, sr AS sim_rank, r5 AS rank FROM t3")
def topk_then_exclude(spark, sf):
    """Global top 20 by theme similarity, then other genres only, then 5 (may be fewer)."""
    r = _cross(spark, sf).where(F.col("genre") != F.col("sg"))
    t = top_n_per_group(r, ["sg"], [F.col("rank")], 5, rank="r5")
    return t.select(F.col("sg").alias("source_genre"), F.col("rec_id").alias("song_id"), "genre",
                    F.col("rank").cast("long").alias("sim_rank"), F.col("r5").cast("long").alias("rank"))


@query("idea_cross_genre", sql=f"WITH {LIB_SQL}, {_CROSS_SQL} SELECT sg AS source_genre, genre, song_id, sr AS sim_rank, gr AS genre_rank FROM t4")
def idea_cross_genre(spark, sf):
    """R10 + T4: every genre's popular theme searched across the others, 2 songs per other genre."""
    t3 = topk_then_exclude(spark, sf)
    t4 = top_n_per_group(t3, ["source_genre", "genre"], [F.col("sim_rank")], 2, rank="genre_rank")
    return t4.select("source_genre", "genre", "song_id", "sim_rank", F.col("genre_rank").cast("long").alias("genre_rank"))


@query("topk_per_genre", sql=f"""
WITH {LIB_SQL}, r AS ({_rec_sql('balanced', K)}),
g AS (SELECT r.seed_id, c.genre, r.rec_id, r.rank, row_number() OVER (PARTITION BY r.seed_id, c.genre ORDER BY r.rank) AS genre_rank
      FROM r JOIN lib c ON c.song_id = r.rec_id)
SELECT seed_id, genre, rec_id, rank AS sim_rank, genre_rank FROM g WHERE genre_rank <= 2
""")
def topk_per_genre(spark, sf):
    """T4: first 2 recommendations per genre in similarity order, for every seed."""
    # the join and the model run once; the search reads the vectors several times
    path = shared_path(spark, "scored")
    scored(spark, sf).select("song_id", "genre", "final_embedding").write.parquet(path)
    s = spark.read.parquet(path)
    r = similar(s, "balanced", K).join(s.select(F.col("song_id").alias("rec_id"), "genre"), "rec_id")
    t = top_n_per_group(r, ["seed_id", "genre"], [F.col("rank")], 2, rank="genre_rank")
    return t.select("seed_id", "genre", "rec_id", F.col("rank").cast("long").alias("sim_rank"),
                    F.col("genre_rank").cast("long").alias("genre_rank"))


# ---- idea search: prompt vectors given per genre, results reported ----
_SEARCH_SQL = (
    "pr AS (SELECT genre AS pg, list(m ORDER BY pos) AS q FROM (SELECT genre, pos, avg(val) AS m FROM "
    "(SELECT genre, generate_subscripts(t, 1) AS pos, unnest(t) AS val FROM lib) GROUP BY genre, pos) GROUP BY genre), "
    f"res AS (SELECT * FROM (SELECT pr.pg, l.*, row_number() OVER (PARTITION BY pr.pg ORDER BY round({cos_sql('pr.q', 'l.t')}, 9) DESC, l.song_id) AS rk "
    "FROM pr JOIN lib l ON l.genre = pr.pg) WHERE rk <= 15)"
)


def _traits_sql(e, v, a):
    return (f"concat_ws(', ', CASE WHEN {e} > 0.7 THEN 'Energetic' WHEN {e} < 0.4 THEN 'Calm / Mellow' ELSE 'Mid-Energy' END, "
            f"CASE WHEN {v} > 0.6 THEN 'Upbeat & Happy' WHEN {v} > 0.4 THEN 'Neutral / Mixed-Mood' ELSE 'Melancholic & Somber' END, "
            f"CASE WHEN {a} > 0.7 THEN 'Primarily Acoustic' WHEN {a} < 0.1 THEN 'Highly Electronic/Electric' END)")


def _report_sql(res, grp):
    return (
        f"m AS (SELECT {grp} AS grp, avg(energy) AS e, avg(valence) AS v, avg(acousticness) AS a FROM {res} GROUP BY {grp}), "
        f"gc AS (SELECT {grp} AS grp, genre, row_number() OVER (PARTITION BY {grp} ORDER BY count(*) DESC, genre) AS r FROM {res} GROUP BY {grp}, genre), "
        "gs AS (SELECT grp, string_agg(upper(substr(genre, 1, 1)) || lower(substr(genre, 2)), ' & ' ORDER BY r) AS genres FROM gc WHERE r <= 2 GROUP BY grp), "
        f"son AS (SELECT m.grp, 'A blend of ' || genres || ' styles, generally characterized as: ' || {_traits_sql('e', 'v', 'a')} || '.' AS sonality FROM m JOIN gs ON m.grp = gs.grp), "
        f"pc AS (SELECT {grp} AS grp, chord_main, count(*) AS n, min(rk) AS f FROM {res} WHERE chord_main IS NOT NULL AND length(chord_main) > 0 GROUP BY {grp}, chord_main), "
        "pcr AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) AS r FROM pc), "
        "ps AS (SELECT grp, string_agg(chord_main || ' (' || n || ')', '; ' ORDER BY r) AS progressions FROM pcr WHERE r <= 3 GROUP BY grp), "
        f"pp AS (SELECT {grp} AS grp, title, row_number() OVER (PARTITION BY {grp} ORDER BY popularity DESC NULLS LAST, song_id) AS r FROM {res}), "
        "pps AS (SELECT grp, string_agg(title, '; ' ORDER BY r) AS popular FROM pp WHERE r <= 3 GROUP BY grp), "
        f"ax AS (SELECT {grp} AS grp, arg_min(song_id, (alpha, song_id)) AS most_lyrical_id, arg_max(song_id, (alpha, -song_id)) AS most_audio_id FROM {res} GROUP BY {grp})"
    )


_REPORT_SELECT = ("SELECT son.grp AS {name}, sonality, progressions, popular, most_lyrical_id, most_audio_id "
                  "FROM son LEFT JOIN ps ON ps.grp = son.grp JOIN pps ON pps.grp = son.grp JOIN ax ON ax.grp = son.grp")


def _search_results(spark, sf, k=15):
    s = scored(spark, sf).cache()
    prompts = vector_mean(s, "text", ["genre"]).select(
        F.col("genre").alias("pg"), F.xxhash64("genre").alias("pid"), F.col("text_mean").alias("q"))
    r = similarity_topk(prompts, s, k=k, q_id="pid", q_vec="q", c_id="song_id", c_vec="text",
                        q_group="pg", c_group="genre", strategy="auto")
    r = r.join(prompts.select(F.col("pid").alias("seed_id"), "pg"), "seed_id")
    return r.join(s.withColumnRenamed("song_id", "rec_id"), "rec_id") \
            .select("pg", F.col("rec_id").alias("song_id"), F.col("rank").alias("rk"), "title", "artist", "genre",
                    "popularity", "energy", "valence", "acousticness", "chord_main", "alpha")


@query("idea_search", sql=f"WITH {LIB_SQL}, {_SEARCH_SQL} SELECT pg AS prompt_genre, song_id, rk AS rank FROM res")
def idea_search(spark, sf):
    """Per genre, the 15 songs whose text vector is nearest the genre's prompt vector."""
    r = _search_results(spark, sf)
    return r.select(F.col("pg").alias("prompt_genre"), "song_id", F.col("rk").cast("long").alias("rank"))


@query("idea_report", sql=f"WITH {LIB_SQL}, {_SEARCH_SQL}, {_report_sql('res', 'pg')} " + _REPORT_SELECT.format(name="prompt_genre"))
def idea_report(spark, sf):
    """Traits sentence, top progressions, popular 3 and alpha extremes per result set."""
    r = _search_results(spark, sf)
    return I.report(r, "pg").withColumnRenamed("pg", "prompt_genre")


@query("prj_genre_traits", sql=f"""
WITH {LIB_SQL}, m AS (SELECT genre, avg(energy) AS e, avg(valence) AS v, avg(acousticness) AS a FROM lib GROUP BY genre)
SELECT genre, {_traits_sql('e', 'v', 'a')} AS traits FROM m
""")
def prj_genre_traits(spark, sf):
    """Trait words of every genre from its raw feature means."""
    m = I.profile_means(library(spark, sf), "genre")
    return m.select("genre", I.traits(F.col("energy"), F.col("valence"), F.col("acousticness")).alias("traits"))


@query("agg_profile_means", sql=f"""
WITH {LIB_SQL} SELECT genre, round(avg(energy), 6) AS energy, round(avg(valence), 6) AS valence,
  round(avg(acousticness), 6) AS acousticness FROM lib GROUP BY genre
""")
def agg_profile_means(spark, sf):
    """Mean raw energy, valence and acousticness per genre."""
    m = I.profile_means(library(spark, sf), "genre")
    return m.select("genre", *[F.round(c, 6).alias(c) for c in ("energy", "valence", "acousticness")])


@query("agg_common_progressions", sql=f"""
WITH {LIB_SQL}, res AS (SELECT *, song_id AS rk FROM lib),
pc AS (SELECT genre, chord_main, count(*) AS n, min(rk) AS f FROM res WHERE chord_main IS NOT NULL AND length(chord_main) > 0 GROUP BY genre, chord_main),
pcr AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY n DESC, f) AS r FROM pc)
SELECT genre, string_agg(chord_main || ' (' || n || ')', '; ' ORDER BY r) AS progressions FROM pcr WHERE r <= 3 GROUP BY genre
""")
def agg_common_progressions(spark, sf):
    """Three most common main progressions per genre, ties by first appearance."""
    lib = library(spark, sf).withColumn("rk", F.col("song_id"))
    return I.common_progressions(lib, "genre")


_KW = "a tune about a Blue Widget"


@query("idea_keyword_search", sql=f"""
WITH {LIB_SQL}, kw AS (SELECT lower(string_split('{_KW}', ' ')[-1]) AS k),
hits AS (SELECT lib.* FROM lib, kw WHERE contains(lower(title), kw.k)),
n AS (SELECT count(*) AS c FROM hits),
res0 AS (SELECT * FROM (SELECT * FROM hits ORDER BY song_id LIMIT 15) UNION ALL
         SELECT * FROM (SELECT * FROM lib WHERE (SELECT c FROM n) = 0 ORDER BY song_id LIMIT 5)),
res AS (SELECT *, 'q' AS q, song_id AS rk FROM res0), {_report_sql('res', 'q')}
SELECT sonality, popular FROM son JOIN pps ON pps.grp = son.grp
""")
def idea_keyword_search(spark, sf, prompt=_KW):
    """Last-word title search, then the traits sentence and the 3 most popular results."""
    s = scored(spark, sf)
    res = keyword_search(s, prompt, title="title", order="song_id").withColumn("q", F.lit("q")) \
        .withColumn("rk", F.col("song_id"))
    # one result set (constant group): combine the two one-row parts by union + aggregate, not by a join
    parts = (I.sonality(res, "q").select("q", F.lit("sonality").alias("k"), F.col("sonality").alias("v"))
             .unionByName(I.popular_titles(res, "q").select("q", F.lit("popular").alias("k"), F.col("popular").alias("v"))))
    return parts.groupBy("q").agg(F.max(F.when(F.col("k") == "sonality", F.col("v"))).alias("sonality"),
                                  F.max(F.when(F.col("k") == "popular", F.col("v"))).alias("popular")) \
                .select("sonality", "popular")


@query("topk_similar", sql=f"""
WITH {LIB_SQL},
p AS (SELECT s.song_id AS seed_id, c.song_id AS rec_id, {cos_sql('s.t', 'c.t')} AS sc FROM lib s JOIN lib c ON s.song_id <> c.song_id)
SELECT seed_id, rec_id, round(sc, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY round(sc, 9) DESC, rec_id) AS rank FROM p) WHERE rank <= 15
""")
def topk_similar(spark, sf, k=15):
    """Best k by text-vector similarity per seed (row_number <= k, ties by id)."""
    lib = library(spark, sf)
    r = similarity_topk(lib, k=k, q_id="song_id", q_vec="text", exclude_self=True)
    return r.select("seed_id", "rec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("prj_explain", sql=f"""
WITH {LIB_SQL}, r AS ({_rec_sql('balanced', 5)}),
x AS (SELECT r.*, {cos_sql('s.a', 'c.a')} AS asim, {cos_sql('s.t', 'c.t')} AS tsim, s.alpha AS s_alpha
      FROM r JOIN lib s ON s.song_id = r.seed_id JOIN lib c ON c.song_id = r.rec_id)
SELECT seed_id, rec_id, {_explain_sql('balanced')} AS explanation FROM x
""")
def prj_explain(spark, sf, mode="balanced"):
    """Explanation text for every seed's top-5 from overall, raw audio and raw text cosine and alpha."""
    from cadenza.functions.vectors import cosine
    s = scored(spark, sf).cache()
    r = similar(s, mode, 5)
    sv = s.select(F.col("song_id").alias("seed_id"), F.col("audio").alias("sa"), F.col("text").alias("st"),
                  F.col("alpha").alias("s_alpha"))
    cv = s.select(F.col("song_id").alias("rec_id"), F.col("audio").alias("ca"), F.col("text").alias("ct"))
    j = r.join(sv, "seed_id").join(cv, "rec_id")
    return j.select("seed_id", "rec_id", explanation(mode, F.col("score"), cosine(F.col("sa"), F.col("ca")),
                                                     cosine(F.col("st"), F.col("ct")), F.col("s_alpha")).alias("explanation"))


# ---- E7 over the scored library: all seven recommenders of the comparison ----
ALL_MODELS = ["Random", "Simple Audio", "SOTA Text (Cross-Encoder)", "Item-Based CF",
              "Our Model (Audio Focus)", "Our Model (Lyric Focus)", "Our Model (Balanced)"]


def _all_models_sql():
    from cadenza.plans.common import ALL_LIKES_SQL, AV_SQL, random_sql
    from cadenza.plans.evaluation import _CF_SQL, _METRICS_SQL
    from cadenza.plans.text import _SPLIT
    q = lambda s: "'" + s + "'"

    def rnd(k, salt, name):
        return random_sql("lib", "song_id", k, salt, name)

    tok = (f"SELECT song_id AS doc, unnest(list_filter(regexp_split_to_array(lower(coalesce(lyrics, '')), '{_SPLIT}'), "
           f"lambda t: length(t) > 0)) AS tok FROM ldocs")
    text = (
        "ldocs AS (SELECT l.song_id, coalesce(d.text, '') AS lyrics FROM lib l LEFT JOIN documents d ON d.doc_id = l.song_id), "
        f"ltk AS (SELECT DISTINCT doc, tok FROM ({tok})), "
        "lnd AS (SELECT count(*) AS n FROM ldocs), "
        "lidf AS (SELECT tok, ln(lnd.n / count(*)) AS idf FROM ltk, lnd GROUP BY tok, lnd.n), "
        "lst AS (SELECT ltk.doc, ltk.tok, lidf.idf FROM ltk JOIN lidf USING (tok)), "
        "lsc AS (SELECT c.seed_id, c.rec_id, sum(a.idf) AS score FROM tcand c JOIN lst a ON a.doc = c.seed_id "
        "JOIN ltk b ON b.doc = c.rec_id AND b.tok = a.tok GROUP BY 1, 2), "
        "lall AS (SELECT c.seed_id, c.rec_id, coalesce(lsc.score, 0.0) AS score FROM tcand c LEFT JOIN lsc USING (seed_id, rec_id)), "
        "txt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY round(score, 9) DESC, rec_id) AS rank "
        "FROM lall) WHERE rank <= 10)")
    aud = (f"aud AS (SELECT * FROM (SELECT s.song_id AS seed_id, c.song_id AS rec_id, row_number() OVER (PARTITION BY s.song_id "
           f"ORDER BY round({cos_sql('s.a', 'c.a')}, 9) DESC, c.song_id) AS rank FROM lib s JOIN lib c ON s.song_id <> c.song_id) "
           f"WHERE rank <= 10)")
    cf = _CF_SQL.replace("FROM likes", "FROM likes_l")
    recs = ("recs AS (SELECT 'Random' AS model, seed_id, rec_id, rank FROM rnd UNION ALL "
            "SELECT 'Simple Audio', seed_id, rec_id, rank FROM aud UNION ALL "
            "SELECT 'SOTA Text (Cross-Encoder)', seed_id, rec_id, rank FROM txt UNION ALL "
            "SELECT 'Item-Based CF', seed_id, rec_id, rank FROM cf UNION ALL "
            "SELECT 'Our Model (Audio Focus)', seed_id, rec_id, rank FROM ma UNION ALL "
            "SELECT 'Our Model (Lyric Focus)', seed_id, rec_id, rank FROM ml UNION ALL "
            "SELECT 'Our Model (Balanced)', seed_id, rec_id, rank FROM mb)")
    models = "(VALUES " + ", ".join(f"({q(m)})" for m in ALL_MODELS) + ") AS mv(model)"
    metrics = (_METRICS_SQL.format(models=models)
               .replace("JOIN av a ON", "JOIN iv a ON").replace("JOIN av b ON", "JOIN iv b ON")
               .replace("JOIN av va ON", "JOIN iv va ON").replace("JOIN av vb ON", "JOIN iv vb ON")
               .replace("FROM av)", "FROM iv)"))
    return (
        f"WITH {LIB_SQL}, {AV_SQL}, {ALL_LIKES_SQL}, "
        "likes_l AS (SELECT * FROM likes WHERE item_id IN (SELECT song_id FROM lib)), "
        "iv AS (SELECT song_id, genre, a AS vec FROM lib), "
        f"{rnd(10, 42, 'rnd')}, {rnd(100, 7, 'tcand')}, {text}, {aud}, {cf}, "
        f"ma AS ({_rec_sql('audio_focus', 10)}), ml AS ({_rec_sql('lyric_focus', 10)}), mb AS ({_rec_sql('balanced', 10)}), "
        f"{recs}, {metrics} "
        "SELECT model, round(avg(average_precision), 6) AS map, round(avg(precision), 6) AS precision, "
        "round(avg(recall), 6) AS recall, round(avg(diversity), 6) AS diversity, count(*) AS n_seeds FROM ps GROUP BY model")


@query("eva_compare_all_models", sql=_all_models_sql())
def eva_compare_all_models(spark, sf):
    """E7 on the scored library: all seven recommenders on every seed, macro-averaged metrics.

    Random, raw-audio cosine, shared-token text re-rank of 100 random candidates, item CF
    on all purchases, and the model's audio / lyric / balanced modes.
    """
    from cadenza.operators import evaluate as E
    from cadenza.operators.recommend import item_cf, text_rerank
    from cadenza.operators.sampling import random_recs
    from cadenza.sources.tables import interactions
    s = scored(spark, sf).cache()
    items = s.select(F.col("song_id").alias("item_id"), "genre", F.col("audio").alias("vec"))
    ids = items.select("item_id")
    cols = ["seed_id", "rec_id", "rank"]
    parts = [("Random", random_recs(ids, ids, id_col="item_id", seed_col="item_id", k=10, salt=42)),
             ("Simple Audio", similarity_topk(items, k=10, q_id="item_id", q_vec="vec", exclude_self=True))]
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("song_id"), F.col("text").alias("lyrics"))
    docs = s.select("song_id").join(d, "song_id", "left").withColumn("lyrics", F.coalesce("lyrics", F.lit("")))
    cands = random_recs(ids, ids, id_col="item_id", seed_col="item_id", k=100, salt=7).select("seed_id", "rec_id")
    parts.append(("SOTA Text (Cross-Encoder)", text_rerank(cands, docs, k=10, id_col="song_id", text_col="lyrics")))
    likes = interactions(spark, sf).join(ids, "item_id", "left_semi")
    parts.append(("Item-Based CF", item_cf(likes, k=10)))
    for name, mode in (("Our Model (Audio Focus)", "audio_focus"), ("Our Model (Lyric Focus)", "lyric_focus"),
                       ("Our Model (Balanced)", "balanced")):
        parts.append((name, similar(s, mode, 10)))
    recs = None
    for name, r in parts:
        r = r.select(F.lit(name).alias("model"), *cols)
        recs = r if recs is None else recs.unionByName(r)
    per = E.per_seed_metrics(recs, items, ids.withColumnRenamed("item_id", "seed_id"), ALL_MODELS)
    out = E.compare_models(per)
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("map", "precision", "recall", "diversity")],
                      F.col("n_seeds").cast("long").alias("n_seeds"))
