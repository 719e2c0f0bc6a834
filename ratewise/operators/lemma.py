"""Lemmatisation through a lemma table.

A WordNet-style lemmatiser becomes data: a table ``(token, pos, lemma)``.
Tokens are written once.  Each row's different tokens are joined to the table
(the optimiser picks the join from the table's size; skewed tokens are split by
adaptive execution), and only those with another lemma go back to their row,
where they replace the tokens in place.  A document is one row already, so its
group is bounded by the document itself.
Without tags every token is looked up as a noun ('n').
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.functions import text as X
from ratewise.session import write_table


def lemmatize(df: DataFrame, id_col: str, tokens_col: str, lemmas: DataFrame,
              tags_col: str | None = None, out_col: str = "lemmas") -> DataFrame:
    """Replace each token of ARRAY<STRING> ``tokens_col`` by its lemma
    (token itself when the table has none).  ``tags_col``: optional array of
    Penn tags aligned with the tokens.  Returns (id_col, out_col) where
    ``out_col`` is ARRAY<STRING> in the original order."""
    lem = lemmas.select(F.col("token").alias("__tok"), F.col("pos").alias("__pos"),
                        F.col("lemma").alias("__lemma"))
    tok = F.col(tokens_col)
    rows = write_table(df.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"), tok.alias("__t"),
                                 *([F.transform(tags_col, lambda g: X.lemma_pos(g)).alias("__g")] if tags_col else [])), "lemma-rows")
    pair = F.arrays_zip("__t", "__g") if tags_col else F.col("__t")
    ex = rows.select("__row", F.explode(F.array_distinct(pair)).alias("k"))
    ex = ex.select("__row", "k", *([F.col("k.__t").alias("__tok"), F.col("k.__g").alias("__pos")] if tags_col else [F.col("k").alias("__tok"), F.lit("n").alias("__pos")]))
    found = ex.join(lem, ["__tok", "__pos"]).filter("__lemma <> __tok").groupBy("__row").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "__lemma"))).alias("__m"))
    joined = rows.join(found, "__row", "left")
    word = lambda k: F.coalesce(F.try_element_at(F.col("__m"), k), k["__t"] if tags_col else k)
    lemmas_of = F.when(F.col("__m").isNull(), F.col("__t")).otherwise(F.transform(pair, word))
    return joined.select(F.col("__id").alias(id_col), F.coalesce(lemmas_of, F.array().cast("array<string>")).alias(out_col))


def clean_tokens_lemmatized(df: DataFrame, id_col: str, tokens_col: str, lemmas: DataFrame) -> DataFrame:
    """The lemma step and the end of T18 for rows of tokens: (id_col, cleaned)."""
    lem = lemmatize(df, id_col, tokens_col, lemmas)
    return lem.select(id_col, X._finish(F.array_join("lemmas", " ")).alias("cleaned"))


def clean_text_lemmatized(df: DataFrame, id_col: str, text_col: str, lemmas: DataFrame) -> DataFrame:
    """T18 with the lemma step: tokens -> lemmas -> ASCII letters ->
    collapsed text.  Returns (id_col, cleaned)."""
    toks = df.select(id_col, X.word_tokens(X.expand_contractions(X.null_to_empty(text_col))).alias("toks"))
    return clean_tokens_lemmatized(toks, id_col, "toks", lemmas)
