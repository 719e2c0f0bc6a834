"""Severity, safety and display operators (V1-V12) against a plain
Python statement of the same rules."""

import random

from pyspark.sql import functions as F

from ratewise.functions import severity as V
from ratewise.plans.jobs import classification_columns


def _rescale(p):
    return 0.0 if p < 0.5 else max(0.0, min(100.0, (p - 0.5) / (1.0 - 0.5) * 100))


def _py(probs):
    e, v, s, u = _rescale(probs[3]), _rescale(probs[1]), _rescale(probs[0]), _rescale(probs[2])
    sev = min(100, e * 0.25 + v * 0.25 + s * 0.25 + u * 0.25)
    unsafe = e > 10 or v > 15 or s > 10 or u > 10
    level = ("Explicit" if (e > 30 or v > 35 or s > 30 or u > 30) else "Moderate" if unsafe else "Clean")
    return e, v, s, u, sev, not unsafe, level


def test_against_python(spark):
    rnd = random.Random(11)
    edge = [0.5, 0.55, 0.575, 0.65, 0.675, 0.4999, 1.0, 0.0]
    rows = [[rnd.choice(edge) if rnd.random() < .3 else rnd.random() for _ in range(4)] for _ in range(300)]
    df = spark.createDataFrame([(r,) for r in rows], "probs array<double>")
    cats = V.category_percentages("probs")
    out = df.withColumns(cats).withColumn("raw_probabilities", F.col("probs")).withColumns(
        classification_columns()).collect()
    for r, probs in zip(out, rows):
        e, v, s, u, sev, safe, level = _py(probs)
        assert (r.explicit, r.violence, r.sexual_content, r.substance_use) == (e, v, s, u)
        assert r.severity == sev and 0 <= r.severity <= 100
        assert (r.kid_safe, r.safety_level) == (safe, level)
        assert r.kid_safe == (r.safety_level == "Clean")
        assert r.rating_color == {"Explicit": "#E81123", "Moderate": "#FF8C00", "Clean": "#1DB954"}[level]
        assert abs(r.csi_probability - 100 * sum(probs) / 4) < 1e-9


def test_float32_widening(spark):
    # float32(0.55) is slightly above 0.55: the rescale must use the widened value
    df = spark.createDataFrame([([0.55, 0.55, 0.55, 0.55],)], "probs array<float>")
    r = df.select(V.rescale(V.prob("probs", 1)).alias("x")).first().x
    import numpy as np
    assert r == (float(np.float32(0.55)) - 0.5) / 0.5 * 100


def test_bands_badge_recommendation(spark):
    df = spark.createDataFrame([(35.5, 30.5, "Adults only - not suitable for minors", True),
                                (15.5, 10.5, "Safe for family listening", False),
                                (15.0, 10.0, "ADULTS ONLY", True)],
                               "v double, e double, rec string, k boolean")
    got = df.select(V.violence_band("v").alias("vb"), V.category_band("e").alias("eb"),
                    V.display_recommendation(F.col("rec")).alias("r"), V.safety_badge("k").alias("b")).collect()
    assert [(g.vb, g.eb, g.r, g.b) for g in got] == [
        ("high", "high", "", "SAFE"), ("mid", "mid", "Safe for family listening", "UNSAFE"), ("", "", "", "SAFE")]


def test_sigmoid(spark):
    import math
    df = spark.createDataFrame([(-3.0,), (0.0,), (2.25,)], "z double")
    got = [r.p for r in df.select(V.sigmoid("z").alias("p")).collect()]
    assert [round(g, 12) for g in got] == [round(1 / (1 + math.exp(-z)), 12) for z in (-3.0, 0.0, 2.25)]


def test_score_space_raw_vs_rescaled(spark):
    from ratewise.plans.jobs import with_classification
    # p(violence) = 0.6: raw space -> M-T (0.6 in (0.4, 0.7]); rescaled -> 20 % -> M-P
    df = spark.createDataFrame([([0.0, 0.6, 0.0, 0.0],)], "probs array<double>")
    base = df.withColumns(V.category_percentages("probs")).withColumn("raw_probabilities", F.col("probs"))
    resc = with_classification(base).first()
    raw = with_classification(base, score_space="raw").first()
    assert (resc.mcr_rating, raw.mcr_rating) == ("M-P", "M-T")
    assert resc.safety_level == raw.safety_level == "Moderate"


def test_cleaned_empty_flag(spark):
    from ratewise.plans.jobs import score_and_rate
    df = spark.createDataFrame([(1, "Привет мир"), (2, "you idiot"), (3, None)], "id long, text string")
    got = {r.id: (r.cleaned_empty, r.mcr_rating, r.total_words) for r in score_and_rate(df).collect()}
    assert got[1] == (True, "M-E", 2) and got[3] == (True, "M-E", 0) and got[2][0] is False
