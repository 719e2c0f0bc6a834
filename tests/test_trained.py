"""The trained scorer against numpy, and on rows it has not seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.functions import text as X
from ratewise.operators import scoring, trained
from ratewise.plans import catalog, jobs
from ratewise.session import write_table

BUCKETS = 512
BAD = ["trash", "scum", "moron"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(300):
        toxic, spam = int(rng.random() < 0.3), int(rng.random() < 0.5)
        w = [f"w{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}" for _ in range(rng.integers(1, 40))]
        w += ["the"] + [BAD[rng.integers(3)]] * toxic * 2 + ["buy", "now"] * spam
        data.append((i, " ".join(rng.permutation(w).tolist()), toxic, spam if i % 3 else None))
    data += [(900, None, 1, 0), (901, "", 0, 1), (902, "the end", None, None), (903, "... 123", 1, 1), (904, "the end", 0, None), (904, "the end", 0, None)]
    return spark.createDataFrame(data, "doc_id long, text string, toxic int, spam int")


def in_memory(rows, labels, buckets, penalty, steps):
    """The same objective on one machine, without Spark's partitions."""
    held = rows.select(trained.word_buckets(X.clean_text("text"), buckets).alias("at"), *labels).collect()
    held = [r for r in held if r["at"] and any(r[c] is not None for c in labels)]
    x = np.zeros((len(held), buckets + 1))
    x[:, -1] = 1
    for i, r in enumerate(held):
        x[i, r["at"]] = 1
    y = np.array([[np.nan if r[c] is None else float(r[c]) for c in labels] for r in held])
    known = ~np.isnan(y)
    free = np.r_[np.ones(buckets), 0][:, None]
    n = known.sum(axis=0).max()

    def evaluate(w):
        z = x @ w
        t = np.nan_to_num(y)
        loss = np.where(known, np.logaddexp(0, z) - t * z, 0).sum() / n + penalty / 2 * (free * w ** 2).sum()
        return loss, x.T @ np.where(known, 1 / (1 + np.exp(-z)) - t, 0) / n + penalty * free * w

    return trained.minimise(evaluate, np.zeros((buckets + 1, len(labels))), steps), evaluate


def test_fit_equals_numpy(rows):
    model = trained.train(rows, ["toxic", "spam"], buckets=BUCKETS, penalty=1e-2, steps=25)
    expect, evaluate = in_memory(rows, ["spam", "toxic"], BUCKETS, 1e-2, 25)
    assert model.labels == ["spam", "toxic"]
    assert np.abs(model.weights - expect).max() < 1e-3
    loss, gradient = evaluate(model.weights)
    assert np.abs(gradient).max() < 1e-3 and abs(loss - evaluate(expect)[0]) < 1e-6


def test_fit_does_not_depend_on_partitions(rows, monkeypatch):
    features = trained.feature_table(rows, ["toxic", "spam"], buckets=BUCKETS)
    one = trained.fit(features.coalesce(1), 2, BUCKETS, steps=6)
    assert (trained.fit(features.repartition(9), 2, BUCKETS, steps=6) == one).all()
    monkeypatch.setattr(trained, "FAN", 2)  # three levels of the tree
    assert (trained.fit(features.repartition(7), 2, BUCKETS, steps=6) == one).all()


def test_steps_descend_to_the_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    b = np.array([[1.0], [2.0], [3.0]])
    x = trained.minimise(lambda x: (float(0.5 * (x * (a @ x)).sum() - (b * x).sum()), a @ x - b), np.zeros((3, 1)), 60, tolerance=1e-9)
    assert np.allclose(a @ x, b, atol=1e-6)


def test_native_scores_equal_numpy(spark, rows, tmp_path):
    model = trained.train(rows, ["toxic"], categories={"language": "toxic"}, buckets=BUCKETS, steps=10)
    held = rows.withColumn("cleaned", X.clean_text("text"))
    got = model.probabilities(held, "cleaned").select("p_toxic", trained.word_buckets(F.col("cleaned"), BUCKETS).alias("at")).collect()
    for r in got:
        z = model.weights[r["at"], 0].sum() + model.weights[-1, 0]
        assert abs(r.p_toxic - 1 / (1 + np.exp(-z))) < 1e-9
    plan = model.probabilities(held, "cleaned")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    four = model.score_frame(held, "cleaned", "p").select("p", scoring.LexiconScorer()(F.col("cleaned")).alias("q")).collect()
    assert all(list(r.p[:3]) == list(r.q[:3]) for r in four)
    model.save(spark, str(tmp_path / "model"))
    again = trained.TrainedScorer.load(spark, str(tmp_path / "model"), {"language": "toxic"})
    assert again.labels == model.labels and (again.weights == model.weights).all()


def test_trained_scorer_as_default(rows):
    model = trained.train(rows, ["toxic"], categories={"language": "toxic"}, buckets=BUCKETS, steps=10)
    plain = {r.doc_id: r.raw_probabilities[3] for r in jobs.score_and_rate(rows, "text").collect()}
    scoring.set_default_scorer(model)
    try:
        found = {r.doc_id: r.raw_probabilities[3] for r in jobs.score_and_rate(rows, "text").collect()}
    finally:
        scoring.set_default_scorer(None)
    assert found != plain and found[900] == 0.0  # a null text has no analysis
    assert {r.doc_id: r.raw_probabilities[3] for r in jobs.score_and_rate(rows, "text").collect()} == plain


def test_nothing_to_learn_from(rows):
    model = trained.train(rows.limit(0), ["toxic"], buckets=BUCKETS)
    assert not model.weights.any()


def test_held_out_rows(spark):
    out = {r.label: r for r in catalog.QUERIES["trained_scorer_metrics"](spark, "/root/testdata/sf0.1").collect()}
    for r in out.values():
        assert r.tp + r.fp + r.fn + r.tn == r.n and r.log_loss < r.base_log_loss
    assert out["toxic"].precision >= 0.9 and out["toxic"].recall >= 0.45


def test_features_clean_each_text_once(rows, monkeypatch):
    plans = []
    monkeypatch.setattr(trained, "write_table", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write_table(df, name))
    trained.feature_table(rows, ["toxic", "spam"], buckets=BUCKETS)
    assert plans[0].count("regexp_extract_all") == 1
