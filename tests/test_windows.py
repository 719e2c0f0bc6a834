"""Scores of long texts by overlapping windows."""

import math

import pytest

from ratewise.functions import text as X
from ratewise.operators.scoring import DEFAULT_LEXICON, LexiconScorer, ModelSpec, WindowedScorer, lexicon_model_loader, model_scorer
from ratewise.plans import jobs


@pytest.fixture(scope="module")
def docs(spark):
    quiet = "la " * 95
    rows = [(1, "kill gun " + quiet), (2, quiet + "kill gun"), (3, quiet * 3 + "gun " + quiet + "kill murder blood"), (4, "kill"), (5, ""), (6, None),
            (7, "gun " * 2000), (8, quiet + "x " * 5), (9, "kill gun"), (9, "kill gun")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def pooled(text, width, stride):
    words = text.split(" ")
    out = [0.0] * 4
    at = 0
    while True:
        window = words[at:at + width]
        for i, label in enumerate(("sexual", "violence", "substance", "language")):
            weights = dict(DEFAULT_LEXICON[label])
            out[i] = max(out[i], 1 / (1 + math.exp(3.0 - sum(weights.get(w, 0.0) for w in window))))
        if at + width >= len(words):
            return out
        at += stride


@pytest.mark.parametrize("width, stride", [(100, 50), (100, 100), (7, 3), (5000, 1)])
def test_pooled_windows(docs, width, stride):
    held = docs.withColumn("cleaned", X.clean_text("text"))
    got = WindowedScorer(LexiconScorer(), width, stride).score_frame(held, "cleaned", "p").collect()
    assert len(got) == 10
    for r in got:
        assert max(abs(a - b) for a, b in zip(r.p, pooled(r.cleaned, width, stride))) < 1e-12


def test_windows_of_a_model_and_in_a_job(docs):
    model = WindowedScorer(model_scorer(ModelSpec("twin", lexicon_model_loader), max_batch=8), 50, 25)
    native = WindowedScorer(LexiconScorer(), 50, 25)
    a, b = ({(r.doc_id, r.mcr_rating, round(r.severity, 2)) for r in jobs.score_and_rate(docs, "text", scorer=s).collect()} for s in (model, native))
    assert a == b and len(a) == 9
    severity = {r.doc_id: r.raw_probabilities[1] for r in jobs.score_and_rate(docs, "text", scorer=native).collect()}
    assert severity[1] == severity[2] > severity[8]  # the end of a text counts like its beginning


def test_every_word_is_covered():
    with pytest.raises(ValueError):
        WindowedScorer(LexiconScorer(), 10, 11)
