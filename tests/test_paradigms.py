"""The learned lemmatiser on hand-labelled English words."""

import pytest

from ratewise.functions import text as X
from ratewise.operators import paradigms
from pyspark.sql import functions as F

PLAIN = "walk talk jump play call look turn open work help show paint kick pull push wash lift learn climb cook".split()
WITH_E = "love move bake dance smile change wave shave carve hike".split()
WITH_Y = "carry study hurry worry marry tidy empty bury copy vary".split()
NOUNS = "house table river window garden bottle doctor letter number village apple orange bridge island".split()
OTHER = "this glass grass bring thing spring during nothing morning hundred sacred bus gas always perhaps focus".split()


def forms():
    """word -> its lemma, written by hand as lists of stems."""
    out = {}
    for w in PLAIN:
        out.update({w + e: w for e in ("", "s", "ed", "ing")})
    for w in WITH_E:
        out.update({w[:-1] + e: w for e in ("e", "es", "ed", "ing")})
    for w in WITH_Y:
        out.update({w[:-1] + e: w for e in ("y", "ies", "ied", "ying")})
    out.update({w + e: w for w in NOUNS for e in ("", "s")})
    out.update({w: w for w in OTHER})
    return out


@pytest.fixture(scope="module")
def docs(spark):
    words = sorted(forms())
    rows = [(i, " ".join(words[i::7]).upper() if i % 2 else ", ".join(words[i::7])) for i in range(7)]
    return spark.createDataFrame([*rows, (50, None), (51, ""), (52, "12 !?")], "doc_id long, text string").repartition(2)


def test_precision_and_recall(spark, docs):
    gold = forms()
    model = paradigms.learn(docs)
    got = {r.w: r.lemma for r in paradigms.lemmas(paradigms.word_types(docs), model).collect()}
    assert set(got) == set(gold)
    changed = [w for w in got if got[w] != w]
    right = [w for w in changed if got[w] == gold[w]]
    wanted = [w for w in gold if gold[w] != w]
    assert len(right) / len(changed) >= 0.95
    assert len(right) / len(wanted) >= 0.9


def test_rules_reach_words_never_seen(spark, docs):
    model = paradigms.learn(docs)
    new = {"golfed": "golf", "golfing": "golf", "tarries": "tarry", "tarried": "tarry", "ab": "ab", "é": "é"}
    frame = spark.createDataFrame([(w,) for w in new], "w string")
    got = {r.w: r.lemma for r in paradigms.lemmas(frame, model).collect()}
    assert sum(got[w] == lemma for w, lemma in new.items()) >= 5, got


def test_exceptions_come_first(spark, docs):
    given = spark.createDataFrame([("walked", "stroll"), ("grass", "weed")], "token string, lemma string")
    got = {r.w: r.lemma for r in paradigms.lemmas(paradigms.word_types(docs), paradigms.learn(docs, given=given)).collect()}
    assert got["walked"] == "stroll" and got["grass"] == "weed" and got["walks"] == "walk"
    # a word that the rules get wrong keeps the lemma of its own paradigm
    model = paradigms.learn(docs)
    known = {r.w: r.lemma for r in paradigms.pairs(paradigms.word_types(docs)).collect()}
    assert {r.w: r.lemma for r in paradigms.lemmas(paradigms.word_types(docs), model).collect()} == known


def test_texts(spark, docs):
    model = paradigms.learn(docs)
    rows = spark.createDataFrame([(1, "She walked, walks and CARRIED houses"), (2, None), (2, ""), (3, "don't walk walking")], "doc_id long, text string")
    got = sorted((r.doc_id, r.cleaned) for r in paradigms.lemmatised_text(rows, model).collect())
    assert got == [(1, "she walk walk and carry house"), (2, ""), (2, ""), (3, "do not walk walk")]
    plain = sorted((r.doc_id, r.c) for r in rows.select("doc_id", X.clean_text("text").alias("c")).collect())
    assert [i for i, _ in plain] == [i for i, _ in got]


def test_nothing_to_learn(spark, docs):
    model = paradigms.learn(docs.limit(0))
    assert model.rules.count() == 0 and model.exceptions.count() == 0
    assert paradigms.lemmas(docs.select(F.lit("walks").alias("w")), model).first().lemma == "walks"


def test_saving_of_a_paradigm(spark):
    words = [w + e for w in ("walk", "talk", "jump", "play", "call") for e in ("", "ed")]
    types = spark.createDataFrame([(w, 1) for w in words], "w string, n long")
    got = {r.w: r for r in paradigms.paradigms(types).collect()}
    assert set(got) == set(words)
    # (2 - 1) * 20 letters of stems + (5 - 1) * 2 letters of endings - 3 * (5 + 2)
    assert all((r.paradigm, r.stems, r.saved, r.base) == ("|ed", 5, 7, "") for r in got.values())
