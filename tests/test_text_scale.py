"""Steps on whole texts that must stay cheap: cleaning, lemmas, word lists, windows."""

import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ratewise.functions import text as X
from ratewise.operators.lemma import lemmatize
from ratewise.operators.scoring import LexiconScorer
from ratewise.plans import catalog


def test_rows_of_one_id_keep_their_own_tokens(spark):
    rows = spark.createDataFrame([(1, ["dogs", "dogs"]), (1, ["cats"]), (2, None), (3, [])], "id long, t array<string>")
    lemmas = spark.createDataFrame([("dogs", "n", "dog")], "token string, pos string, lemma string")
    got = sorted((r.id, r.lemmas) for r in lemmatize(rows, "id", "t", lemmas).collect())
    assert got == [(1, ["cats"]), (1, ["dog", "dog"]), (2, []), (3, [])]


def test_tokens_stay_in_their_row_unless_their_lemma_differs(spark):
    """Few words have another lemma; nothing is regrouped token by token."""
    rows = spark.createDataFrame([(1, ["a", "b"])], "id long, t array<string>")
    lemmas = spark.createDataFrame([("a", "n", "a"), ("b", "n", "c")], "token string, pos string, lemma string")
    plan = lemmatize(rows, "id", "t", lemmas)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "posexplode" not in plan


def test_windows_leave_the_texts_behind(spark):
    plan = catalog.QUERIES["windowed_scores"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: (struct<.*?>)", plan)
    assert any("n_windows" in r and "cleaned" not in r for r in read)


def test_contractions_do_not_swell_the_generated_method(spark):
    """38 replacements inlined made it too long for the JVM to compile."""
    out = spark.range(1).select(X.clean_text(F.lit("x").substr(F.lit(1), F.col("id").cast("int"))).alias("c"))
    code = out._jdf.queryExecution().debug().codegenToSeq().toString()
    assert len(code) < 60_000 and code.count("appendReplacement") < 10


def test_words_off_the_list_are_dropped_first(spark):
    got = spark.range(1).select(LexiconScorer().hits(F.split(F.lit("a gun and a damn gun"), " ")).alias("h")).first().h
    assert got == ["gun", "damn", "gun"]
