"""Registered queries: one per operator group of the inventory.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` over the whole
driver tables (or tables Spark derives from them), plus the matching
DuckDB SQL in ``ORACLE`` when the result is SQL-expressible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions import rating as R
from ratewise.functions import severity as V
from ratewise.functions import sqlfuncs
from ratewise.functions import text as X
from ratewise.operators import quality, rate, reports
from ratewise.operators.partitioning import spread
from ratewise.operators.scoring import LexiconScorer
from ratewise.session import write_table
from ratewise.plans import jobs
from ratewise.plans import oracle as O
from ratewise.plans import oracle_rules as S
from ratewise.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _rated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate.rate_scores(tables.order_scores(spark, sf_dir))


SCORES = ["violence_score", "sexual_score", "language_score", "substance_score"]

# ---------------------------------------------------------------------------
# Rating operators (R*, G1-G3, K1-K2) on F7 scores
# ---------------------------------------------------------------------------


@register("rating_histogram", O.RATED_F7 + """
SELECT MCR_rating AS rating, count(*) AS n,
       round(CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS pct
FROM rated GROUP BY MCR_rating ORDER BY rating""")
def q_rating_histogram(spark, sf_dir):
    """G1 + G2 + K1 (step 0 of the build plan)."""
    return reports.rating_histogram(_rated_orders(spark, sf_dir))


@register("rating_rows", O.RATED_F7 + """
SELECT song_index, violence_score, sexual_score, language_score, substance_score,
       MCR_rating, MCR_max_score, MCR_highest_concern FROM rated""")
def q_rating_rows(spark, sf_dir):
    """R1-R6, R15 per row."""
    return _rated_orders(spark, sf_dir).select(
        "song_index", *SCORES, "MCR_rating", "MCR_max_score", "MCR_highest_concern")


@register("descriptor_counts", O.RATED_F7 + """
SELECT descriptor, count(*) AS n
FROM (SELECT unnest(string_split(MCR_descriptors, '; ')) AS descriptor
      FROM rated WHERE MCR_descriptors <> 'None')
GROUP BY descriptor""")
def q_descriptor_counts(spark, sf_dir):
    """G3 + P9 + U5."""
    return reports.descriptor_counts(_rated_orders(spark, sf_dir))


@register("descriptor_top10", O.RATED_F7 + """
SELECT descriptor, count(*) AS n
FROM (SELECT unnest(string_split(MCR_descriptors, '; ')) AS descriptor
      FROM rated WHERE MCR_descriptors <> 'None')
GROUP BY descriptor ORDER BY n DESC, descriptor LIMIT 10""")
def q_descriptor_top10(spark, sf_dir):
    """K2: top-10 descriptors (the limit is the feature)."""
    return reports.descriptor_top(_rated_orders(spark, sf_dir), 10)


@register("final_rating_rows", O.RATED_F7 + """
SELECT song_index, MCR_rating, MCR_descriptors, MCR_final_rating FROM rated""")
def q_final_rating_rows(spark, sf_dir):
    """R7-R12, R14."""
    return _rated_orders(spark, sf_dir).select(
        "song_index", "MCR_rating", "MCR_descriptors", "MCR_final_rating")


@register("highest_concern_counts", O.RATED_F7 + """
SELECT MCR_highest_concern AS highest_concern, count(*) AS n FROM rated GROUP BY 1""")
def q_highest_concern_counts(spark, sf_dir):
    """R15 aggregated."""
    rated = _rated_orders(spark, sf_dir)
    return rated.groupBy(F.col("MCR_highest_concern").alias("highest_concern")).agg(
        F.count(F.lit(1)).alias("n"))


@register("rating_lookup", O.RATED_F7 + f"""
SELECT song_index, MCR_rating,
       {S.explanation('MCR_rating')} AS explanation,
       MCR_recommendation AS recommendation,
       {S.long_name('MCR_rating')} AS long_name
FROM rated""")
def q_rating_lookup(spark, sf_dir):
    """R16-R18."""
    rated = _rated_orders(spark, sf_dir)
    r = F.col("MCR_rating")
    return rated.select("song_index", "MCR_rating", R.explanation(r).alias("explanation"),
                        R.recommendation(r).alias("recommendation"), R.long_name(r).alias("long_name"))


def _struct_sql() -> str:
    v, s, l, d = (S.clip01(c) for c in SCORES)
    r = S.rating(v, s, l, d)
    descs = S.descriptors(v, s, l, d)
    n = " + ".join(f"CAST({x} IS NOT NULL AS INTEGER)" for x in descs)
    return O.with_(O.F7) + f"""
SELECT song_index, {r} AS rating, {v} AS violence, {s} AS sexual, {l} AS language, {d} AS substance,
       CAST({n} AS INTEGER) AS descriptor_count, concat_ws('; ', {', '.join(descs)}) AS descriptor_list,
       {S.max_score(v, s, l, d)} AS max_score, {S.explanation(r)} AS rating_explanation,
       {S.highest_concern(v, s, l, d)} AS highest_concern, {S.recommendation(r)} AS recommendation
FROM f7"""


@register("rating_struct_flat", _struct_sql())
def q_rating_struct_flat(spark, sf_dir):
    """The nested result struct, flattened for comparison."""
    f7 = tables.order_scores(spark, sf_dir)
    st = f7.select("song_index", R.rating_struct(*SCORES).alias("r"))
    return st.select(
        "song_index", F.col("r.rating").alias("rating"),
        F.col("r.scores.violence").alias("violence"), F.col("r.scores.sexual").alias("sexual"),
        F.col("r.scores.language").alias("language"), F.col("r.scores.substance").alias("substance"),
        F.size("r.descriptors").cast("int").alias("descriptor_count"),
        F.array_join("r.descriptors", "; ").alias("descriptor_list"),
        F.col("r.max_score").alias("max_score"),
        F.col("r.details.rating_explanation").alias("rating_explanation"),
        F.col("r.details.highest_concern").alias("highest_concern"),
        F.col("r.details.recommendation").alias("recommendation"))


@register("batch_export_18", O.RATED_F7 + """
SELECT song_index, '' AS song, '' AS text, sexual_score, violence_score, substance_score, language_score,
       '' AS sexual, '' AS violence, '' AS substance, '' AS language, '' AS explicit_edit,
       MCR_rating, MCR_descriptors, MCR_max_score, MCR_highest_concern, MCR_recommendation, MCR_final_rating
FROM rated""")
def q_batch_export_18(spark, sf_dir):
    """J1 shape: P5-P7, R20, U4 (18 columns in export order)."""
    return rate.rate_table(tables.order_scores(spark, sf_dir))


@register("rating_screen_teen", O.RATED_F7 + """
SELECT song_index, MCR_rating FROM rated WHERE MCR_rating IN ('M-E', 'M-P', 'M-T')""")
def q_rating_screen_teen(spark, sf_dir):
    """Catalogue screened to M-T and below, with the score predicate
    (prunable by Parquet statistics) instead of a filter on the rating."""
    f7 = tables.order_scores(spark, sf_dir)
    kept = f7.filter(R.rating_filter("M-T", *SCORES))
    return kept.select("song_index", R.mcr_rating(*SCORES).alias("MCR_rating"))


def _sqlfunc_sql() -> str:
    return O.RATED_F7 + """
SELECT song_index, MCR_rating AS rating, MCR_descriptors AS descriptor_text,
       MCR_final_rating AS final_rating, MCR_highest_concern AS highest_concern,
       MCR_recommendation AS recommendation FROM rated"""


@register("indexed_export", """
SELECT count(*) AS n, count(*) AS n_distinct, CAST(0 AS BIGINT) AS lowest, count(*) - 1 AS highest FROM orders""")
def q_indexed_export(spark, sf_dir):
    """The export of a table without an index column, read after a shuffle:
    every row is there and has a number of its own."""
    f7 = tables.order_scores(spark, sf_dir).drop("song_index")
    out = rate.rate_table(f7.repartition(F.col("violence_score")))
    i = F.col("song_index")
    return out.agg(F.count(i).alias("n"), F.count_distinct(i).alias("n_distinct"), F.min(i).alias("lowest"), F.max(i).alias("highest"))


@register("sql_function_rating", _sqlfunc_sql())
def q_sql_function_rating(spark, sf_dir):
    """The same rules through the registered SQL functions."""
    sqlfuncs.register(spark)
    return spark.sql("""
        SELECT song_index,
               mcr_rating(violence_score, sexual_score, language_score, substance_score) AS rating,
               mcr_descriptor_text(violence_score, sexual_score, language_score, substance_score) AS descriptor_text,
               mcr_final_rating(violence_score, sexual_score, language_score, substance_score) AS final_rating,
               mcr_highest_concern(violence_score, sexual_score, language_score, substance_score) AS highest_concern,
               mcr_recommendation(mcr_rating(violence_score, sexual_score, language_score, substance_score))
                   AS recommendation
        FROM {scores}""", scores=tables.order_scores(spark, sf_dir))


# ---------------------------------------------------------------------------
# Score cleaning and quality (P1-P4, G4, G5) on F10 text scores
# ---------------------------------------------------------------------------


@register("cleaned_scores", O.with_(O.F10) + f"""
SELECT song_index, {O.clean('violence_score')} AS violence_score, {O.clean('sexual_score')} AS sexual_score,
       {O.clean('language_score')} AS language_score, {O.clean('substance_score')} AS substance_score
FROM f10""")
def q_cleaned_scores(spark, sf_dir):
    """P1-P3."""
    return rate.clean_scores(tables.order_raw_scores(spark, sf_dir), SCORES)


def _quality_sql() -> str:
    parts = ["count(*) AS n_rows"]
    for c in SCORES:
        missing = f"({c} IS NULL OR {c} IN ({O.NA_LIST}))"
        coerced = O.coerce(c)
        filled = f"coalesce(CASE WHEN isnan({coerced}) THEN NULL ELSE {coerced} END, 0.0)"
        parts += [
            f"count(*) FILTER (WHERE NOT {missing} AND {coerced} IS NULL) AS {c}_non_numeric",
            f"count(*) FILTER (WHERE {missing}) AS {c}_missing",
            f"count(*) FILTER (WHERE {filled} < 0 OR {filled} > 1) AS {c}_out_of_range",
        ]
    return O.with_(O.F10) + "\nSELECT " + ",\n       ".join(parts) + "\nFROM f10"


@register("score_quality", _quality_sql())
def q_score_quality(spark, sf_dir):
    """G4 + G5."""
    return quality.score_quality(tables.order_raw_scores(spark, sf_dir), SCORES)


# ---------------------------------------------------------------------------
# Severity and safety (V1-V12) on F8 probabilities
# ---------------------------------------------------------------------------


def _f8_analysis(spark, sf_dir) -> DataFrame:
    f8 = tables.embedding_probabilities(spark, sf_dir)
    cats = V.category_percentages("probs")
    out = f8.withColumns(cats).withColumn("raw_probabilities", F.col("probs"))
    return jobs.with_classification(out)


def _classify_cte(src, p0, p1, p2, p3, name, raw: bool = False) -> str:
    units = (p1, p0, p3, p2) if raw else ("violence / 100.0", "sexual_content / 100.0", "explicit / 100.0", "substance_use / 100.0")
    cv, cs, cl, cd = (S.clip01(x) for x in units)
    r = S.rating(cv, cs, cl, cd)
    descs = S.descriptors(cv, cs, cl, cd)
    high = "(explicit > 30 OR violence > 35 OR sexual_content > 30 OR substance_use > 30)"
    mid = "(explicit > 10 OR violence > 15 OR sexual_content > 10 OR substance_use > 10)"
    return f"""
{name} AS (
  SELECT *, least(100.0, explicit * 0.25 + violence * 0.25 + sexual_content * 0.25 + substance_use * 0.25) AS severity,
         100.0 * ({p0} + {p1} + {p2} + {p3}) / 4.0 AS csi_probability,
         {r} AS mcr_rating,
         concat_ws('; ', {', '.join(descs)}) AS mcr_descriptors,
         NOT {mid} AS kid_safe,
         CASE WHEN {high} THEN 'Explicit' WHEN {mid} THEN 'Moderate' ELSE 'Clean' END AS safety_level,
         CASE WHEN {high} THEN '#E81123' WHEN {mid} THEN '#FF8C00' ELSE '#1DB954' END AS rating_color
  FROM {src})"""


def _f8_sql_cte() -> str:
    e, v, s, u = (O.rescale_sql(p) for p in ("p3", "p1", "p0", "p2"))
    cat = f"""
f8c AS (
  SELECT vec_id, label, p0, p1, p2, p3,
         {e} AS explicit, {v} AS violence, {s} AS sexual_content, {u} AS substance_use
  FROM f8)"""
    cls = _classify_cte("f8c", "p0", "p1", "p2", "p3", "f8r")
    return O.with_(O.F8, cat, cls)


@register("severity_rows", _f8_sql_cte() + """
SELECT vec_id, round(explicit, 6) AS explicit, round(violence, 6) AS violence,
       round(sexual_content, 6) AS sexual_content, round(substance_use, 6) AS substance_use,
       round(severity, 6) AS severity, mcr_rating, mcr_descriptors FROM f8r""")
def q_severity_rows(spark, sf_dir):
    """V1-V4, V6 + rating in rescaled space."""
    a = _f8_analysis(spark, sf_dir)
    return a.select("vec_id", *[F.round(c, 6).alias(c) for c in
                                ("explicit", "violence", "sexual_content", "substance_use", "severity")],
                    "mcr_rating", F.array_join("mcr_descriptors", "; ").alias("mcr_descriptors"))


@register("severity_documented", _f8_sql_cte() + """
SELECT vec_id, round(csi_probability, 6) AS csi_probability, round(severity, 6) AS severity FROM f8r""")
def q_severity_documented(spark, sf_dir):
    """V5 beside V4."""
    a = _f8_analysis(spark, sf_dir)
    return a.select("vec_id", F.round("csi_probability", 6).alias("csi_probability"),
                    F.round("severity", 6).alias("severity"))


@register("safety_levels", _f8_sql_cte() + """
SELECT safety_level, rating_color, kid_safe, count(*) AS n FROM f8r GROUP BY ALL""")
def q_safety_levels(spark, sf_dir):
    """V7-V9."""
    a = _f8_analysis(spark, sf_dir)
    return a.groupBy("safety_level", "rating_color", "kid_safe").agg(F.count(F.lit(1)).alias("n"))


@register("category_bands", _f8_sql_cte() + """
SELECT vec_id,
       CASE WHEN explicit > 30 THEN 'high' WHEN explicit > 10 THEN 'mid' ELSE '' END AS explicit_band,
       CASE WHEN violence > 35 THEN 'high' WHEN violence > 15 THEN 'mid' ELSE '' END AS violence_band,
       CASE WHEN sexual_content > 30 THEN 'high' WHEN sexual_content > 10 THEN 'mid' ELSE '' END AS sexual_band,
       CASE WHEN substance_use > 30 THEN 'high' WHEN substance_use > 10 THEN 'mid' ELSE '' END AS substance_band
FROM f8r""")
def q_category_bands(spark, sf_dir):
    """V10."""
    a = _f8_analysis(spark, sf_dir)
    return a.select("vec_id", V.category_band("explicit").alias("explicit_band"),
                    V.violence_band("violence").alias("violence_band"),
                    V.category_band("sexual_content").alias("sexual_band"),
                    V.category_band("substance_use").alias("substance_band"))


def _display_sql() -> str:
    sv, ss, sl, sd = ("violence / 100.0", "sexual_content / 100.0", "explicit / 100.0", "substance_use / 100.0")
    cv, cs, cl, cd = (S.clip01(x) for x in (sv, ss, sl, sd))
    rec = S.recommendation("mcr_rating")
    return _f8_sql_cte() + f"""
SELECT vec_id, mcr_rating, {S.long_name('mcr_rating')} AS long_name,
       {S.descriptor_text(cv, cs, cl, cd, 'mcr_rating', display=True)} AS descriptors_display,
       CASE WHEN lower({rec}) LIKE '%adults only%' OR lower({rec}) LIKE '%not suitable for minors%'
            THEN '' ELSE {rec} END AS recommendation_display,
       CASE WHEN kid_safe THEN 'SAFE' ELSE 'UNSAFE' END AS badge,
       round(p0, 4) AS p_sexual, round(p1, 4) AS p_violence, round(p2, 4) AS p_substance,
       round(p3, 4) AS p_language
FROM f8r"""


@register("display_report", _display_sql())
def q_display_report(spark, sf_dir):
    """R13, R18, V11, V12, P10."""
    a = _f8_analysis(spark, sf_dir)
    r = F.col("mcr_rating")
    return a.select(
        "vec_id", "mcr_rating", R.long_name(r).alias("long_name"),
        R.display_descriptor_text_from(r, F.col("mcr_descriptors")).alias("descriptors_display"),
        V.display_recommendation(F.col("mcr_recommendation")).alias("recommendation_display"),
        V.safety_badge("kid_safe").alias("badge"),
        *[F.round(V.prob("probs", i + 1), 4).alias(f"p_{lab}") for i, lab in
          enumerate(["sexual", "violence", "substance", "language"])])


@register("kid_safe_catalogue", _f8_sql_cte() + """
SELECT vec_id, round(severity, 6) AS severity, mcr_rating FROM f8r WHERE kid_safe""")
def q_kid_safe_catalogue(spark, sf_dir):
    """Kid-safe screening."""
    a = _f8_analysis(spark, sf_dir)
    return a.filter("kid_safe").select("vec_id", F.round("severity", 6).alias("severity"), "mcr_rating")


@register("severity_topk", _f8_sql_cte() + """
SELECT vec_id, round(severity, 6) AS severity FROM f8r ORDER BY severity DESC, vec_id LIMIT 10""")
def q_severity_topk(spark, sf_dir):
    """K3: ten most severe rows (the limit is the feature)."""
    a = _f8_analysis(spark, sf_dir).select("vec_id", "severity")
    return reports.top_k(a, 10, "severity", "vec_id").select(
        "vec_id", F.round("severity", 6).alias("severity"))


# ---------------------------------------------------------------------------
# Text operators (T1-T20, P8) on documents / conversations
# ---------------------------------------------------------------------------


def _docs(spark, sf_dir) -> DataFrame:
    """Documents, spread over the partitions asked for
    (text cleaning is CPU-bound; a no-op when the input has many files).
    For queries that clean text directly; the jobs spread their own input."""
    return spread(tables.table(spark, sf_dir, "documents"))


def _docs_table(spark, sf_dir) -> DataFrame:
    """Documents as scanned (input of jobs that spread it themselves)."""
    return tables.table(spark, sf_dir, "documents")


@register("contraction_expand", f"""
SELECT doc_id, {O.expand_sql('coalesce(text, ' + chr(39) * 2 + ')')} AS expanded FROM documents""")
def q_contraction_expand(spark, sf_dir):
    """T1 + T5 over whole texts."""
    return _docs(spark, sf_dir).select(
        "doc_id", X.expand_contractions(X.null_to_empty("text")).alias("expanded"))


@register("clean_text_rows", f"""
SELECT doc_id, {O.clean_token_sql('text')} AS cleaned FROM documents""")
def q_clean_text_rows(spark, sf_dir):
    """T1-T9, T13, T15-T18 (token mode)."""
    return _docs(spark, sf_dir).select("doc_id", X.clean_text("text").alias("cleaned"))


@register("regex_tokens", f"""
SELECT doc_id, {O.clean_regex_sql('text')} AS cleaned FROM documents""")
def q_regex_tokens(spark, sf_dir):
    """T14-T17 (regex mode)."""
    return _docs(spark, sf_dir).select("doc_id", X.clean_text("text", "regex").alias("cleaned"))


@register("conversation_clean", f"""
SELECT conv_id, turn, role, {O.clean_token_sql('text')} AS cleaned,
       {O.word_count_sql('text')} AS total_words FROM conversations""")
def q_conversation_clean(spark, sf_dir):
    """S8 on a second text table: cleaned text and word count per turn."""
    c = tables.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", X.clean_text("text").alias("cleaned"),
                    X.word_count("text").alias("total_words"))


@register("word_char_counts", f"""
SELECT doc_id, {O.word_count_sql('text')} AS total_words,
       CAST(length(coalesce(text, '')) AS INTEGER) AS total_chars,
       length(coalesce(text, '')) = n_chars AS chars_match FROM documents""")
def q_word_char_counts(spark, sf_dir):
    """T19 + T20."""
    d = _docs(spark, sf_dir)
    chars = X.char_count("text")
    return d.select("doc_id", X.word_count("text").alias("total_words"), chars.alias("total_chars"),
                    (chars == F.col("n_chars")).alias("chars_match"))




@register("nonblank_texts", f"""
SELECT conv_id, turn FROM conversations
WHERE regexp_matches(coalesce(text, ''), '[^{X.WS_CHARS}]')""")
def q_nonblank_texts(spark, sf_dir):
    """Rows whose text is not blank."""
    c = tables.table(spark, sf_dir, "conversations")
    return c.filter(~X.is_blank("text")).select("conv_id", "turn")


@register("sql_function_safety", _f8_sql_cte() + """
SELECT vec_id, round(severity, 6) AS severity, kid_safe, safety_level, mcr_descriptors AS descriptors FROM f8r""")
def q_sql_function_safety(spark, sf_dir):
    """Severity, safety and descriptors through SQL functions."""
    sqlfuncs.register(spark)
    e = tables.embedding_probabilities(spark, sf_dir)
    return spark.sql("""
        SELECT vec_id, round(mcr_severity(explicit, violence, sexual_content, substance_use), 6) AS severity,
               mcr_kid_safe(explicit, violence, sexual_content, substance_use) AS kid_safe,
               mcr_safety_level(explicit, violence, sexual_content, substance_use) AS safety_level,
               array_join(mcr_descriptors(violence / 100, sexual_content / 100, explicit / 100, substance_use / 100), '; ')
                 AS descriptors
        FROM {e}""", e=e.select("vec_id", *[c.alias(n) for n, c in V.category_percentages("probs").items()]))


@register("sql_function_text", f"""
SELECT doc_id, {O.clean_token_sql('text')} AS cleaned, {O.word_count_sql('text')} AS total_words FROM documents""")
def q_sql_function_text(spark, sf_dir):
    """The text cleaner and word count through SQL functions."""
    sqlfuncs.register(spark)
    return spark.sql("SELECT doc_id, mcr_clean_text(text) AS cleaned, mcr_word_count(text) AS total_words FROM {d}", d=_docs(spark, sf_dir))


def _lemma_sql() -> str:
    return f"""
WITH tok AS (SELECT doc_id, {O.token_list_sql('text')} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM tok),
vocabulary AS (SELECT DISTINCT word FROM w),
lemma AS (SELECT a.word, b.word AS lemma FROM vocabulary a JOIN vocabulary b ON a.word = b.word || 's' WHERE length(a.word) > 3),
j AS (SELECT doc_id, string_agg(coalesce(lemma, word), ' ' ORDER BY i) AS s FROM w LEFT JOIN lemma USING (word) GROUP BY doc_id)
SELECT doc_id, {O.finish_sql("coalesce(s, '')")} AS cleaned FROM tok LEFT JOIN j USING (doc_id)"""


@register("lemma_clean_rows", _lemma_sql())
def q_lemma_clean_rows(spark, sf_dir):
    """Cleaning with a lemma table that the documents' own words give:
    a word of more than three letters that ends in s and also occurs without
    it has the shorter word as its lemma."""
    from ratewise.operators import lemma
    d = _docs(spark, sf_dir)
    words = X.word_tokens(X.expand_contractions(X.null_to_empty("text")))
    tokens = write_table(d.select("doc_id", words.alias("tokens")), "tokens")
    words = write_table(tokens.select(F.explode("tokens").alias("token")).distinct(), "words")
    longer = words.select("token", F.expr("left(token, length(token) - 1)").alias("lemma")).filter(
        (F.length("token") > 3) & F.col("token").endswith("s"))
    lemmas = longer.join(words.select(F.col("token").alias("lemma")), "lemma").select("token", F.lit("n").alias("pos"), "lemma")
    return lemma.clean_tokens_lemmatized(tokens, "doc_id", "tokens", write_table(lemmas, "lemmas"))


# ---------------------------------------------------------------------------
# Scoring (M1, M5, M8, M10) and the composite jobs
# ---------------------------------------------------------------------------

LABELS = ["sexual", "violence", "substance", "language"]


def _docs_scored_sql(source: str = "documents", keys: str = "doc_id, lang, source", raw: bool = False) -> str:
    ps = O.probs_sql("cleaned")
    pcols = ",\n         ".join(
        f"CASE WHEN cleaned = '' THEN 0.0 ELSE {p} END AS p_{lab}" for p, lab in zip(ps, LABELS))
    dc = f"""
dc AS (
  SELECT {keys}, {O.clean_token_sql('text')} AS cleaned,
         {O.word_count_sql('text')} AS total_words
  FROM {source})"""
    dp = f"""
dp AS (
  SELECT *, {pcols}
  FROM dc)"""
    dcat = f"""
dcat AS (
  SELECT *, {O.rescale_sql('p_language')} AS explicit, {O.rescale_sql('p_violence')} AS violence,
         {O.rescale_sql('p_sexual')} AS sexual_content, {O.rescale_sql('p_substance')} AS substance_use
  FROM dp)"""
    return O.with_(dc, dp, dcat, _classify_cte("dcat", "p_sexual", "p_violence", "p_substance", "p_language", "dr", raw))


def _lexicon_sql() -> str:
    ps = O.probs_sql("cleaned")
    cols = ", ".join(f"round({p}, 9) AS p_{lab}" for p, lab in zip(ps, LABELS))
    return f"""
WITH dc AS (SELECT doc_id, {O.clean_token_sql('text')} AS cleaned FROM documents)
SELECT doc_id, {cols} FROM dc"""


@register("lexicon_scores", _lexicon_sql())
def q_lexicon_scores(spark, sf_dir):
    """M10 + M5: lexicon logits -> sigmoid (inline, map-only)."""
    d = _docs(spark, sf_dir).select("doc_id", X.clean_text("text").alias("cleaned"))
    p = d.select("doc_id", LexiconScorer()(F.col("cleaned")).alias("p"))
    return p.select("doc_id", *[F.round(F.col("p")[i], 9).alias(f"p_{lab}") for i, lab in enumerate(LABELS)])


@register("lexicon_scores_table", _lexicon_sql())
def q_lexicon_scores_table(spark, sf_dir):
    """M10 through the general path: explode, join a lexicon table,
    partial-aggregate, pivot (for lexicons too large to inline)."""
    from ratewise.operators.scoring import lexicon_scores_join
    d = _docs(spark, sf_dir).select("doc_id", X.clean_text("text").alias("cleaned"))
    lex = LexiconScorer().table(spark)
    p = lexicon_scores_join(d, "doc_id", "cleaned", lex)
    return p.select("doc_id", *[F.round(F.col("probs")[i], 9).alias(f"p_{lab}") for i, lab in enumerate(LABELS)])


def _scored_select_sql(raw: bool = False) -> str:
    return _docs_scored_sql(raw=raw) + """
SELECT doc_id, round(explicit, 6) AS explicit, round(violence, 6) AS violence,
       round(sexual_content, 6) AS sexual_content, round(substance_use, 6) AS substance_use,
       total_words, round(severity, 6) AS severity, round(csi_probability, 6) AS csi_probability,
       mcr_rating, mcr_descriptors, kid_safe, safety_level, rating_color,
       CASE WHEN cleaned = '' THEN NULL ELSE 'original_default' END AS scaling_method
FROM dr"""


def _scored_output(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", *[F.round(c, 6).alias(c) for c in ("explicit", "violence", "sexual_content", "substance_use")],
        "total_words", F.round("severity", 6).alias("severity"),
        F.round("csi_probability", 6).alias("csi_probability"), "mcr_rating",
        F.array_join("mcr_descriptors", "; ").alias("mcr_descriptors"),
        "kid_safe", "safety_level", "rating_color", "scaling_method")


@register("score_and_rate", _scored_select_sql())
def q_score_and_rate(spark, sf_dir):
    """Text -> clean -> lexicon probabilities -> severity, rating,
    safety (one map-only stage)."""
    return _scored_output(jobs.score_and_rate(_docs_table(spark, sf_dir), "text"))


@register("dedup_score_and_rate", _scored_select_sql())
def q_dedup_score_and_rate(spark, sf_dir):
    """Same result, each distinct cleaned text scored once."""
    d = _docs_table(spark, sf_dir).select("doc_id", "text")
    return _scored_output(jobs.dedup_score_and_rate(d, "doc_id", "text"))


@register("dedup_score_and_rate_raw", _scored_select_sql(raw=True))
def q_dedup_score_and_rate_raw(spark, sf_dir):
    """J2 rated in raw probability space."""
    d = _docs_table(spark, sf_dir).select("doc_id", "text")
    return _scored_output(jobs.dedup_score_and_rate(d, "doc_id", "text", score_space="raw"))


@register("severity_topk_by_group", _docs_scored_sql() + """
SELECT lang, doc_id, round(severity, 6) AS severity, rank FROM (
  SELECT lang, doc_id, severity,
         row_number() OVER (PARTITION BY lang ORDER BY severity DESC, doc_id) AS rank FROM dr)
WHERE rank <= 3""")
def q_severity_topk_by_group(spark, sf_dir):
    """K3 per group: three most severe documents per language."""
    s = jobs.score_and_rate(_docs_table(spark, sf_dir), "text").select("lang", "doc_id", "severity")
    top = reports.top_k_by_group(s, 3, "lang", "severity", "doc_id")
    return top.select("lang", "doc_id", F.round("severity", 6).alias("severity"),
                      F.col("rank").cast("bigint").alias("rank"))


def _rollup_sql(scored: str, group: str) -> str:
    return f"""{scored},
agg AS (
  SELECT {group}, mcr_rating, count(*) AS n, round(avg(severity), 6) AS avg_severity,
         CAST(GROUPING({group}, mcr_rating) AS INTEGER) AS level
  FROM dr GROUP BY ROLLUP ({group}, mcr_rating))
SELECT {group}, mcr_rating, n, avg_severity, level,
       round(CASE WHEN level = 0 THEN CAST(n AS DOUBLE) * 100.0 /
                       CAST(sum(CASE WHEN level = 0 THEN n END) OVER (PARTITION BY {group}) AS DOUBLE)
                  WHEN level = 1 THEN CAST(n AS DOUBLE) * 100.0 /
                       CAST((SELECT n FROM agg WHERE level = 3) AS DOUBLE)
                  ELSE 100.0 END, 6) AS share_pct
FROM agg"""


@register("compliance_rollup", _rollup_sql(_docs_scored_sql(), "lang"))
def q_compliance_rollup(spark, sf_dir):
    """Counts, mean severity and shares by language x rating with
    subtotals (ROLLUP)."""
    s = jobs.score_and_rate(_docs_table(spark, sf_dir), "text")
    out = reports.compliance_rollup(s, "lang", "mcr_rating", "severity")
    return out.withColumn("level", F.col("level").cast("int"))


@register("compliance_rollup_source", _rollup_sql(_docs_scored_sql(), "source"))
def q_compliance_rollup_source(spark, sf_dir):
    """J5 by source x rating; one source holds a third of the rows."""
    s = jobs.score_and_rate(_docs_table(spark, sf_dir), "text")
    out = reports.compliance_rollup(s, "source", "mcr_rating", "severity")
    return out.withColumn("level", F.col("level").cast("int"))


@register("label_check", _docs_scored_sql() + """
SELECT count(*) AS n,
       count(*) FILTER (WHERE p_language > 0.5 AND toxic = 1) AS tp,
       count(*) FILTER (WHERE p_language > 0.5 AND toxic <> 1) AS fp,
       count(*) FILTER (WHERE NOT p_language > 0.5 AND toxic = 1) AS fn,
       count(*) FILTER (WHERE NOT p_language > 0.5 AND toxic <> 1) AS tn
FROM dr JOIN labels USING (doc_id)""")
def q_label_check(spark, sf_dir):
    """Language probability against the toxic label at 0.5."""
    labels = tables.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    s = jobs.score_and_rate(_docs_table(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id"), "text")
    return reports.label_check(s.select("toxic", V.prob("raw_probabilities", 4).alias("p_language")), "p_language", "toxic", 0.5)


# ---------------------------------------------------------------------------
# Event time and streams (J3, J4) on events
# ---------------------------------------------------------------------------

_EVENTS_RATED = f"""
WITH ev AS (
  SELECT event_id, ts, event_type,
         x1*x1*x1 AS violence_score, x2*x2*x2 AS sexual_score,
         x3*x3*x3 AS language_score, x4*x4*x4 AS substance_score
  FROM (SELECT event_id, ts, event_type,
               ((event_id*7919)%1009)/CAST(1008 AS DOUBLE) AS x1,
               ((event_id*6133)%1013)/CAST(1012 AS DOUBLE) AS x2,
               ((event_id*3571)%1019)/CAST(1018 AS DOUBLE) AS x3,
               ((event_id*2749)%1021)/CAST(1020 AS DOUBLE) AS x4
        FROM events)),{O.rated_cte('ev')}"""


@register("windowed_rating_counts", _EVENTS_RATED + """
SELECT CAST(date_trunc('day', ts) AS DATE) AS window_start,
       CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS DATE) AS window_end,
       MCR_rating, count(*) AS n
FROM rated GROUP BY ALL""")
def q_windowed_rating_counts(spark, sf_dir):
    """J4 batch twin: rating counts per one-day event-time window."""
    from ratewise.streaming import rate_stream
    rated = rate_stream.rating_stream(tables.table(spark, sf_dir, "events"))
    return (rated.groupBy(F.window("ts", "1 day").alias("w"), "MCR_rating")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(tables.utc_date(F.col("w.start")).alias("window_start"),
                    tables.utc_date(F.col("w.end")).alias("window_end"), "MCR_rating", "n"))


@register("stream_rating", _EVENTS_RATED + """
SELECT event_id, event_type, MCR_rating, MCR_descriptors, MCR_max_score FROM rated""")
def q_stream_rating(spark, sf_dir):
    """Events rated by a Structured Streaming query (file source ->
    stateless rating -> Parquet sink); equals the batch rating."""
    from ratewise.streaming import rate_stream
    stream = rate_stream.rating_stream(rate_stream.event_stream(spark, sf_dir))
    out = rate_stream.run_to_parquet(stream, rate_stream.new_base(spark, "stream_rating"))
    return spark.read.parquet(out).select("event_id", "event_type", "MCR_rating",
                                          "MCR_descriptors", "MCR_max_score")


@register("stream_windowed_counts", _EVENTS_RATED + """
SELECT CAST(w AS DATE) AS window_start, CAST(w + INTERVAL 1 DAY AS DATE) AS window_end, MCR_rating, count(*) AS n
FROM (SELECT date_trunc('day', ts) AS w, MCR_rating FROM rated)
WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
GROUP BY w, MCR_rating""")
def q_stream_windowed_counts(spark, sf_dir):
    """Watermarked windowed counts in append mode; only windows the
    watermark (max event time - 1 hour) has closed are emitted."""
    from ratewise.streaming import rate_stream
    counts = rate_stream.windowed_rating_counts(rate_stream.event_stream(spark, sf_dir))
    out = rate_stream.run_to_parquet(counts, rate_stream.new_base(spark, "stream_windowed_counts"), output_mode="append")
    return spark.read.parquet(out)


# ---------------------------------------------------------------------------
# J1 end to end: CSV in, 18-column CSV out, statistics observed on the way
# ---------------------------------------------------------------------------


@register("rate_catalogue_csv", O.RATED_F7 + """
SELECT song_index, MCR_rating, MCR_descriptors, MCR_highest_concern, MCR_final_rating FROM rated""")
def q_rate_catalogue_csv(spark, sf_dir):
    """The orders-derived scores as a CSV file in the
    scratch folder, rated by the batch job and read back from its export."""
    from ratewise.sources import csv_io
    src = _catalogue_folder(spark, "catalogue") + "/scores.csv"
    csv_io.write_csv(tables.order_scores(spark, sf_dir), src)
    res = jobs.rate_catalogue(spark, src)
    return res.frame.select(F.col("song_index").cast("bigint").alias("song_index"), "MCR_rating",
                            "MCR_descriptors", "MCR_highest_concern", "MCR_final_rating")


def _export_documents_sql() -> str:
    return _docs_scored_sql("documents LEFT JOIN labels USING (doc_id)", "doc_id, source, text, toxic, quality") + """,
sc AS (
  SELECT doc_id AS song_index, source AS song, text, p_sexual AS sexual_score, p_violence AS violence_score,
         p_substance AS substance_score, p_language AS language_score,
         CAST(NULL AS VARCHAR) AS sexual, CAST(NULL AS VARCHAR) AS violence, CAST(NULL AS VARCHAR) AS substance,
         CAST(toxic AS VARCHAR) AS language, CAST(quality AS VARCHAR) AS explicit_edit
  FROM dr),""" + O.rated_cte("sc") + """
SELECT song_index, song, text, round(sexual_score, 9) AS sexual_score, round(violence_score, 9) AS violence_score,
       round(substance_score, 9) AS substance_score, round(language_score, 9) AS language_score,
       sexual, violence, substance, language, explicit_edit, MCR_rating, MCR_descriptors,
       round(MCR_max_score, 9) AS MCR_max_score, MCR_highest_concern, MCR_recommendation, MCR_final_rating
FROM rated"""


def _catalogue_folder(spark, name: str) -> str:
    import uuid
    from ratewise.session import checkpoint_path
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


@register("catalogue_export_documents", _export_documents_sql())
def q_catalogue_export_documents(spark, sf_dir):
    """J1 on whole texts: documents with their labels and lexicon scores, through
    CSV (quotes, commas and line breaks inside the text), rated, and read back:
    all 18 columns."""
    from ratewise.sources import csv_io
    d = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.withColumn("cleaned", X.clean_text("text")).withColumn("p", LexiconScorer()(F.col("cleaned")))
    p = dict(zip(LABELS, (F.when(F.col("cleaned") == "", 0.0).otherwise(F.col("p")[i]) for i in range(4))))
    src = _catalogue_folder(spark, "documents") + "/scores.csv"
    csv_io.write_csv(d.select(F.col("doc_id").alias("song_index"), F.col("source").alias("song"), "text",
                              *[p[c].alias(f"{c}_score") for c in LABELS], F.col("toxic").alias("language"),
                              F.col("quality").alias("explicit_edit")), src)
    out = jobs.rate_catalogue(spark, src).frame
    number = lambda c: F.round(F.col(c).cast("double"), 9).alias(c)
    return out.select(F.col("song_index").cast("bigint").alias("song_index"), "song", "text",
                      *[number(f"{c}_score") for c in LABELS], "sexual", "violence", "substance", "language", "explicit_edit",
                      "MCR_rating", "MCR_descriptors", number("MCR_max_score"), "MCR_highest_concern", "MCR_recommendation",
                      "MCR_final_rating")


def _catalogue_stats_sql() -> str:
    cleaned = ", ".join(f"{O.clean(c)} AS {c}" for c in O.SCORE_COLS)
    return O.with_(O.F10, f"\nf10c AS (SELECT song_index, {cleaned} FROM f10)", O.rated_cte("f10c")) + """
SELECT 'rows' AS metric, count(*) AS n FROM rated
UNION ALL SELECT 'rating:' || MCR_rating, count(*) FROM rated GROUP BY ALL
UNION ALL SELECT 'descriptor:' || d, count(*)
  FROM (SELECT unnest(string_split(MCR_descriptors, '; ')) AS d FROM rated WHERE MCR_descriptors <> 'None') GROUP BY ALL"""


@register("catalogue_stats", _catalogue_stats_sql())
def q_catalogue_stats(spark, sf_dir):
    """The statistics observed while the export was written, metric by
    metric (G1, G3), on scores that arrive as text without an index."""
    from ratewise.sources import csv_io
    src = _catalogue_folder(spark, "stats") + "/scores.csv"
    csv_io.write_csv(tables.order_raw_scores(spark, sf_dir).drop("song_index"), src)
    seen = jobs.rate_catalogue(spark, src).stats["ratings"]  # at most 20 numbers
    return spark.createDataFrame([(k, v) for k, v in seen.items() if v], "metric string, n long")


# ---------------------------------------------------------------------------
# The text pipeline on a stream, and the model plug-in contract
# ---------------------------------------------------------------------------


@register("stream_score_and_rate", _scored_select_sql())
def q_stream_score_and_rate(spark, sf_dir):
    """J3 on text: documents arriving on a file stream are cleaned, scored
    and rated by the same stateless columns as the batch job."""
    from ratewise.streaming import rate_stream
    stream = rate_stream.table_stream(spark, sf_dir, "documents")
    out = rate_stream.run_to_parquet(_scored_output(jobs.score_and_rate(stream, "text")),
                                     rate_stream.new_base(spark, "stream_score_and_rate"))
    return spark.read.parquet(out)


@register("model_plugin_rating", _docs_scored_sql() + """
SELECT doc_id, mcr_rating, safety_level, kid_safe, round(severity, 2) AS severity FROM dr""")
def q_model_plugin_rating(spark, sf_dir):
    """Scores from a model behind the plug-in contract (iterator
    pandas UDF, Arrow batches, float32 output, one evaluation per row).  The
    model here is the Python twin of the lexicon, so the rating must equal
    the native path; severity is compared at two decimals (float32)."""
    from ratewise.operators.scoring import ModelSpec, lexicon_model_loader, model_scorer
    scorer = model_scorer(ModelSpec("lexicon-twin", lexicon_model_loader))
    s = jobs.score_and_rate(_docs_table(spark, sf_dir), "text", scorer=scorer)
    return s.select("doc_id", "mcr_rating", "safety_level", "kid_safe",
                    F.round("severity", 2).alias("severity"))


@register("conversation_rollup", _rollup_sql(_docs_scored_sql("conversations", "conv_id, turn, role"), "role"))
def q_conversation_rollup(spark, sf_dir):
    """J5 on the second text table: every conversation turn scored and
    rated, rolled up by speaker role x rating."""
    c = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    s = jobs.score_and_rate(c, "text")
    out = reports.compliance_rollup(s, "role", "mcr_rating", "severity")
    return out.withColumn("level", F.col("level").cast("int"))


# ---------------------------------------------------------------------------
# The trained scorer (M4, M8): fitted on the labels, tested on held-out rows
# ---------------------------------------------------------------------------

TRAINED_LABELS = ["quality", "toxic"]


def _labelled_documents(spark, sf_dir):
    labels = tables.table(spark, sf_dir, "labels").select("doc_id", *TRAINED_LABELS)
    return _docs_table(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id")


def _trained(spark, sf_dir):
    from ratewise.operators import trained
    rows = _labelled_documents(spark, sf_dir).filter(~trained.held_out("doc_id"))
    return trained.train(rows, TRAINED_LABELS, categories={"language": "toxic"})


@register("trained_scorer_metrics")
def q_trained_scorer_metrics(spark, sf_dir):
    """The trained scorer on the labelled rows it has not seen."""
    from ratewise.operators import trained
    held = _labelled_documents(spark, sf_dir).filter(trained.held_out("doc_id")).withColumn("cleaned", X.clean_text("text"))
    return trained.held_out_metrics(_trained(spark, sf_dir).probabilities(held, "cleaned"), TRAINED_LABELS)


@register("trained_score_and_rate")
def q_trained_score_and_rate(spark, sf_dir):
    """V13 / M8 with the trained scorer: every document rated, the language
    probability from the model of the toxic label."""
    s = jobs.score_and_rate(_docs_table(spark, sf_dir).select("doc_id", "text"), "text", scorer=_trained(spark, sf_dir))
    return s.select("doc_id", F.round(V.prob("raw_probabilities", 4), 6).alias("p_language"), "mcr_rating", "mcr_descriptors",
                    F.round("severity", 6).alias("severity"), "safety_level", "kid_safe")


# ---------------------------------------------------------------------------
# Sentences (T7): statistics over all documents, then boundaries per document
# ---------------------------------------------------------------------------

_SENTENCE_STATS = r"""
WITH piece AS (
  SELECT r, doc_id, text, unnest(ps) AS p, unnest(range(len(ps))) AS tok_no
  FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+[ \t-\r]*') AS ps FROM documents)),
tok AS (
  SELECT r, doc_id, tok_no, p, contains(p, chr(10)) AS line,
         regexp_replace(regexp_replace(regexp_extract(p, '^[^ \t-\r]+'), '^["''(\[]+', ''), '["'')\]]+$', '') AS core FROM piece),
typed AS (
  SELECT *, CASE WHEN regexp_matches(w, '^\p{L}[\p{L}.]*$') THEN w END AS type
  FROM (SELECT *, translate(regexp_replace(core, '\.$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM tok)),
followed AS (SELECT *, lead(core) OVER o AS next, lead(type) OVER o AS next_type FROM typed WINDOW o AS (PARTITION BY r ORDER BY tok_no)),
whole AS (SELECT count(*)::DOUBLE AS total, count(*) FILTER (WHERE suffix(core, '.')) / count(*)::DOUBLE AS share FROM typed),
types AS (
  SELECT type, count(*) FILTER (WHERE suffix(core, '.')) AS c_period, count(*) FILTER (WHERE NOT suffix(core, '.')) AS c_plain
  FROM typed WHERE type IS NOT NULL GROUP BY type),
scored AS (
  SELECT type, c_period, c_plain,
         2 * (c_period * ln(0.99) + c_plain * ln(0.01)
              - (c_period * ln(share) + CASE WHEN c_plain > 0 THEN c_plain * ln(1 - share) ELSE 0 END))
         * exp(-length(replace(type, '.', ''))::DOUBLE) * (length(type) - length(replace(type, '.', '')) + 1)
         * pow(length(replace(type, '.', ''))::DOUBLE, -c_plain) AS score
  FROM types, whole WHERE c_period > 0),
abbr AS (SELECT type FROM scored WHERE score >= 0.3),
sure AS (
  SELECT next_type AS type FROM followed
  WHERE next IS NOT NULL AND NOT line AND regexp_matches(core, '[.!?]$')
    AND NOT (suffix(core, '.') AND type IS NOT NULL AND type IN (SELECT type FROM abbr))),
n_ends AS (SELECT count(*)::DOUBLE AS ends FROM sure),
counted AS (
  SELECT s.type, s.k, t.c_period + t.c_plain AS w, ends, total,
         (t.c_period + t.c_plain) / total AS p, s.k / ends AS p1, (t.c_period + t.c_plain - s.k) / (total - ends) AS p2
  FROM (SELECT type, count(*) AS k FROM sure WHERE type IS NOT NULL GROUP BY type) s JOIN types t USING (type), n_ends, whole),
g AS (
  SELECT type, k AS c_after, w AS c_total,
         2 * (CASE WHEN k > 0 THEN k * ln(p1) ELSE 0 END + CASE WHEN ends > k THEN (ends - k) * ln(1 - p1) ELSE 0 END
              + CASE WHEN w > k THEN (w - k) * ln(p2) ELSE 0 END + CASE WHEN total - ends > w - k THEN (total - ends - (w - k)) * ln(1 - p2) ELSE 0 END
              - CASE WHEN w > 0 THEN w * ln(p) ELSE 0 END - CASE WHEN total > w THEN (total - w) * ln(1 - p) ELSE 0 END) AS g2
  FROM counted WHERE p1 > p),
starters AS (SELECT * FROM g WHERE g2 >= 30)"""


@register("sentence_statistics", _SENTENCE_STATS + """
SELECT 'period' AS kind, type, c_period AS a, c_plain AS b, round(score, 6) + 0.0 AS score, score >= 0.3 AS chosen FROM scored
UNION ALL SELECT 'starter', type, c_after, c_total, round(g2, 4), true FROM starters""")
def q_sentence_statistics(spark, sf_dir):
    """What the texts say about abbreviations and sentence starters."""
    from ratewise.operators import sentences
    s = sentences.statistics(_docs_table(spark, sf_dir))
    a = s.types.select(F.lit("period").alias("kind"), "type", F.col("c_period").alias("a"), F.col("c_plain").alias("b"),
                       F.round("score", 6).alias("score"), F.col("is_abbreviation").alias("chosen"))
    return a.unionByName(s.starters.select(F.lit("starter").alias("kind"), "type", F.col("c_after").alias("a"), F.col("c_total").alias("b"),
                                           F.round("g2", 4).alias("score"), F.lit(True).alias("chosen")))


@register("sentence_spans", _SENTENCE_STATS + r""",
ended AS (
  SELECT r, doc_id, tok_no, p, line OR regexp_matches(core, '[!?]$')
         OR (suffix(core, '.') AND NOT (type IS NOT NULL AND type IN (SELECT type FROM abbr)
             AND NOT (coalesce(regexp_matches(next, '^\p{Lu}'), false) AND coalesce(next_type IN (SELECT type FROM starters), false)))) AS stop
  FROM followed),
placed AS (
  SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY r ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n,
         sum(length(p)) OVER (PARTITION BY r ORDER BY tok_no) - length(p) AS b FROM ended),
lead_ AS (SELECT row_number() OVER () AS r, length(regexp_extract(coalesce(text, ''), '^[ \t-\r]*')) AS skip FROM documents)
SELECT doc_id, n::INT AS n, (skip + min(b))::BIGINT AS "start", (skip + max(b + length(regexp_extract(p, '^[^ \t-\r]+'))))::BIGINT AS "end"
FROM placed JOIN lead_ USING (r) GROUP BY r, doc_id, n, skip""")
def q_sentence_spans(spark, sf_dir):
    """The sentences of every document as spans of its text."""
    from ratewise.operators import sentences
    return sentences.sentences(_docs_table(spark, sf_dir))


# ---------------------------------------------------------------------------
# Lemmas learned from the corpus
# ---------------------------------------------------------------------------

_LEARNED_LEMMAS = r"""
WITH types AS (
  SELECT w, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\p{L}+')) AS w
    FROM documents) GROUP BY w),
split AS (
  SELECT w, left(w, (length(w) - k)::INT) AS stem, CASE WHEN k = 0 THEN '' ELSE right(w, k::INT) END AS ending
  FROM types, range(5) AS s(k) WHERE length(w) >= 3 AND length(w) - k >= 3),
productive AS (
  (SELECT ending FROM split WHERE ending <> '' GROUP BY ending ORDER BY count(*) * length(ending) DESC, ending LIMIT 64)
  UNION ALL SELECT ''),
held AS (SELECT * FROM split SEMI JOIN productive USING (ending)),
stems AS (
  SELECT stem, list_sort(list(ending)) AS endings, array_to_string(list_sort(list(ending)), '|') AS paradigm
  FROM held GROUP BY stem HAVING count(*) > 1),
paradigm AS (
  SELECT paradigm, count(*) AS stems, len(any_value(endings)) AS e, sum(length(stem)) AS letters, any_value(endings) AS endings
  FROM stems GROUP BY paradigm),
good AS (
  SELECT paradigm, stems, (e - 1) * letters + (stems - 1) * length(array_to_string(endings, '')) - 3 * (stems + e) AS saved,
         (SELECT x FROM (SELECT unnest(endings) AS x) ORDER BY length(x), x LIMIT 1) AS base
  FROM paradigm WHERE stems >= 5),
best AS (
  SELECT held.w, held.stem, held.ending, good.base FROM held JOIN stems USING (stem) JOIN good USING (paradigm)
  WHERE saved > 0
  QUALIFY row_number() OVER (PARTITION BY held.w ORDER BY saved DESC, length(held.stem) DESC, held.stem DESC) = 1),
pair AS (
  SELECT types.w, n, coalesce(stem || base, types.w) AS lemma,
         CASE WHEN ending <> base THEN length(ending) ELSE 0 END AS cut, CASE WHEN ending <> base THEN base ELSE '' END AS add_
  FROM types LEFT JOIN best ON best.w = types.w),
vote AS (
  SELECT right(w, k::INT) AS suffix, cut, add_, count(*) AS n FROM pair, range(1, 6) AS s(k) WHERE k < length(w) GROUP BY ALL),
node AS (
  SELECT suffix, cut, add_, sum(n) OVER (PARTITION BY suffix) AS n FROM vote
  QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY vote.n DESC, cut, add_ DESC) = 1 AND sum(n) OVER (PARTITION BY suffix) >= 5),
rule AS (
  SELECT node.* FROM node LEFT JOIN node AS up ON up.suffix = CASE WHEN length(node.suffix) > 1 THEN right(node.suffix, (length(node.suffix) - 1)::INT) END
  WHERE NOT (node.cut = coalesce(up.cut, 0) AND node.add_ = coalesce(up.add_, ''))
  ORDER BY node.n DESC, node.suffix LIMIT 2000),
hit AS (
  SELECT pair.w, rule.cut, rule.add_ FROM pair, range(1, 6) AS s(k), rule
  WHERE k < length(pair.w) AND rule.suffix = right(pair.w, k::INT)
  QUALIFY row_number() OVER (PARTITION BY pair.w ORDER BY k DESC) = 1)
SELECT pair.w AS token, pair.n::BIGINT AS n, pair.lemma,
       CASE WHEN length(pair.w) - coalesce(hit.cut, 0) >= 3 THEN left(pair.w, (length(pair.w) - coalesce(hit.cut, 0))::INT) || coalesce(hit.add_, '')
            ELSE pair.w END AS rule_lemma
FROM pair LEFT JOIN hit ON hit.w = pair.w"""


@register("learned_lemmas", _LEARNED_LEMMAS)
def q_learned_lemmas(spark, sf_dir):
    """Every word of the documents with the lemma learned for it, and the
    one that the suffix rules alone would give."""
    from ratewise.operators import paradigms
    d = _docs_table(spark, sf_dir)
    model = paradigms.learn(d)
    found = paradigms.lemmas(paradigms.word_types(d), model)
    return paradigms.apply_rules(found, model.rules, "w", "rule_lemma").select(F.col("w").alias("token"), "n", "lemma", "rule_lemma")


# ---------------------------------------------------------------------------
# Scores against labels: exact ROC, isotonic calibration
# ---------------------------------------------------------------------------

_SCORE_LABEL_SQL = _docs_scored_sql() + """,
pairs AS (
""" + "\n  UNION ALL ".join(f"SELECT '{c}/{l}' AS pair, round(p_{c}, 6) + 0.0 AS p, {l} AS y FROM dr JOIN labels USING (doc_id) WHERE {l} IS NOT NULL"
                            for c in LABELS for l in ("quality", "toxic")) + """),
grp AS (SELECT pair, p, count(*) FILTER (WHERE y > 0) AS pos, count(*) FILTER (WHERE y <= 0) AS neg FROM pairs GROUP BY pair, p)"""


def _score_label_pairs(spark, sf_dir):
    """One row per labelled document, category and label."""
    labels = tables.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    s = jobs.score_and_rate(_docs_table(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id"), "text")
    s = s.select("quality", "toxic", *[V.prob("raw_probabilities", i + 1).alias(f"p_{c}") for i, c in enumerate(LABELS)])
    rows = F.array(*[F.struct(F.lit(f"{c}/{l}").alias("pair"), F.col(f"p_{c}").alias("p"), F.col(l).alias("y")) for c in LABELS for l in ("quality", "toxic")])
    return s.select(F.explode(rows).alias("r")).select("r.*")


@register("label_roc", _SCORE_LABEL_SQL + """,
run AS (
  SELECT *, sum(pos) OVER up AS tp, sum(neg) OVER up AS fp, sum(pos) OVER (PARTITION BY pair) AS n_pos, sum(neg) OVER (PARTITION BY pair) AS n_neg
  FROM grp WINDOW up AS (PARTITION BY pair ORDER BY p DESC)),
area AS (SELECT pair, sum(neg * (2 * tp - pos)) / (2.0 * any_value(n_pos) * any_value(n_neg)) AS auc FROM run GROUP BY pair),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY pair ORDER BY tp * n_neg - fp * n_pos DESC, p DESC) = 1)
SELECT pair, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auc, 9) AS auc, p AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp
FROM best JOIN area USING (pair)""")
def q_label_roc(spark, sf_dir):
    """Exact area under the ROC curve and best threshold of every category
    against every label."""
    from ratewise.operators import calibration
    out = calibration.roc(_score_label_pairs(spark, sf_dir), "pair", "p", "y")
    return out.withColumn("auc", F.round("auc", 9))


_ISOTONIC_SQL = _SCORE_LABEL_SQL + """,
seq AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY p) AS i FROM grp),
span AS (
  SELECT a.pair, a.i AS a, b.i AS b, sum(m.pos) / sum(m.pos + m.neg) AS mean
  FROM seq a JOIN seq b ON a.pair = b.pair AND a.i <= b.i JOIN seq m ON m.pair = a.pair AND m.i BETWEEN a.i AND b.i GROUP BY a.pair, a.i, b.i),
fit AS (  -- the largest over beginnings of the least mean over ends
  SELECT pair, i, max(least_) AS calibrated FROM (
    SELECT s.pair, s.i, x.a, min(x.mean) AS least_ FROM seq s JOIN span x ON x.pair = s.pair AND x.a <= s.i AND x.b >= s.i GROUP BY s.pair, s.i, x.a)
  GROUP BY pair, i),
fitted AS (SELECT seq.*, round(calibrated, 9) AS calibrated FROM seq JOIN fit USING (pair, i))"""


@register("isotonic_calibration", _ISOTONIC_SQL + """
SELECT pair, min(p) AS low, max(p) AS high, sum(pos + neg)::BIGINT AS n, sum(pos)::BIGINT AS pos, calibrated
FROM fitted GROUP BY pair, calibrated""")
def q_isotonic_calibration(spark, sf_dir):
    """The isotonic fit of every label on every category's score."""
    from ratewise.operators import calibration
    out = calibration.isotonic(_score_label_pairs(spark, sf_dir), "pair", "p", "y")
    return out.withColumn("calibrated", F.round("calibrated", 9))


@register("calibration_error", _ISOTONIC_SQL + """
SELECT pair, sum(pos + neg)::BIGINT AS n, round(sum(pos * (1 - p) * (1 - p) + neg * p * p) / sum(pos + neg), 7) AS brier,
       round(sum(pos * (1 - calibrated) * (1 - calibrated) + neg * calibrated * calibrated) / sum(pos + neg), 7) AS brier_calibrated
FROM fitted GROUP BY pair""")
def q_calibration_error(spark, sf_dir):
    """Brier score before and after calibration."""
    from ratewise.operators import calibration
    pairs = write_table(calibration.tie_groups(_score_label_pairs(spark, sf_dir), "pair", "p", "y"), "tie-groups")
    blocks = calibration.isotonic(_score_label_pairs(spark, sf_dir), "pair", "p", "y")
    out = calibration.errors(pairs, blocks, "pair")
    return out.select("pair", "n", F.round("brier", 7).alias("brier"), F.round("brier_calibrated", 7).alias("brier_calibrated"))


# ---------------------------------------------------------------------------
# Long texts by overlapping windows
# ---------------------------------------------------------------------------


def _windowed_sql() -> str:
    ps = ", ".join(f"{p} AS p_{c}" for p, c in zip(O.probs_sql("cleaned"), LABELS))
    best = ", ".join(f"round(max(CASE WHEN cleaned = '' THEN 0.0 ELSE p_{c} END), 9) AS p_{c}" for c in LABELS)
    return f"""
WITH c AS (SELECT row_number() OVER () AS r, doc_id, string_split({O.clean_token_sql('text')}, ' ') AS ws FROM documents),
win AS (
  SELECT r, doc_id, unnest(list_transform(range(0, greatest(0, ceil((len(ws) - 200) / 100.0))::BIGINT + 1), lambda i: array_to_string(ws[i * 100 + 1:i * 100 + 200], ' '))) AS cleaned
  FROM c),
scored AS (SELECT r, doc_id, cleaned, {ps} FROM win)
SELECT doc_id, count(*) AS n_windows, {best} FROM scored GROUP BY r, doc_id"""


@register("windowed_scores", _windowed_sql())
def q_windowed_scores(spark, sf_dir):
    """Every document scored by windows of 200 words, 100 apart, and
    pooled; no word of a long text is cut off."""
    from ratewise.operators.scoring import WindowedScorer
    scorer = WindowedScorer(LexiconScorer(), 200, 100)
    d = _docs_table(spark, sf_dir).select("doc_id", X.clean_text("text").alias("cleaned"))
    # the texts stay behind: only these columns are joined with the scores
    d = d.withColumns({"n_windows": scorer.n_windows(F.col("cleaned")).cast("bigint"), "empty": F.col("cleaned") == ""})
    out = scorer.score_frame(d, "cleaned", "p")
    p = [F.round(F.when(F.col("empty"), 0.0).otherwise(F.col("p")[i]), 9).alias(f"p_{c}") for i, c in enumerate(LABELS)]
    return out.select("doc_id", "n_windows", *p)
