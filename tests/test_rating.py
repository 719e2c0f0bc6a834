"""Rating rules: golden boundary rows (FIXTURES F4) and properties."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ratewise.functions import rating as R

# violence, sexual, language, substance, rating, descriptors, highest concern
GOLDEN = [
    (0, 0, 0, 0, "M-E", "", "violence"),
    (.05, .05, .05, .05, "M-E", "", "violence"),
    (0, 0, .06, 0, "M-P", "Mild Language", "language"),
    (.06, 0, 0, 0, "M-P", "", "violence"),
    (.40, .40, .40, .40, "M-P", "Mild Language", "violence"),
    (.41, 0, 0, 0, "M-T", "Violence", "violence"),
    (.70, .70, .70, .70, "M-T", "Strong Language; Violence; Suggestive Themes; Drug Reference", "violence"),
    (.71, .71, .71, .71, "M-R", "Explicit Language; Intense Violence; Sexual Content; Drug Abuse", "violence"),
    (.85, .85, .85, .85, "M-R", "Explicit Language; Intense Violence; Sexual Content; Drug Abuse", "violence"),
    (.86, .86, 0, 0, "M-AO", "Intense Violence; Sexual Content", "violence"),
    (.86, 0, 0, 0, "M-R", "Intense Violence", "violence"),
    (.95, 0, 0, 0, "M-R", "Intense Violence", "violence"),
    (.96, 0, 0, 0, "M-AO", "Graphic Violence", "violence"),
    (0, .96, 0, 0, "M-AO", "Graphic Sexual Content", "sexual"),
    (0, 0, .96, 0, "M-AO", "Explicit Language", "language"),
    (0, 0, 0, .96, "M-AO", "Glorified Drug Use", "substance"),
    (.2, .5, .5, .1, "M-T", "Strong Language; Suggestive Themes", "sexual"),
    (0, 0, 0, .3, "M-P", "", "substance"),
]

COLS = ["v", "s", "l", "d"]


def _df(spark, rows):
    return spark.createDataFrame([tuple(float(x) for x in r[:4]) for r in rows],
                                 "v double, s double, l double, d double")


def test_golden_rows(spark):
    df = _df(spark, GOLDEN).select(
        R.mcr_rating(*COLS).alias("rating"),
        F.array_join(R.descriptors(*COLS), "; ").alias("desc"),
        R.highest_concern(*COLS).alias("hc"),
        R.descriptor_text(*COLS).alias("text"),
        R.final_rating(*COLS).alias("final"),
        R.max_score(*COLS).alias("m"))
    got = df.collect()
    for row, exp in zip(got, GOLDEN):
        assert (row.rating, row.desc, row.hc) == exp[4:], exp
        if exp[5]:
            assert row.text == exp[5]
            assert row.final == (exp[4] if exp[4] == "M-E" else f"{exp[4]}: {exp[5]}")
        else:
            assert row.text == {"M-E": "Everyone", "M-P": "Parental Guidance Suggested"}.get(exp[4], "None")
            assert row.final == exp[4]
        assert row.m == max(exp[:4])


def test_clip_null_nan_and_out_of_range(spark):
    df = spark.createDataFrame([(float("nan"), None, 1.7, -3.0)], "v double, s double, l double, d double")
    r = df.select(R.mcr_rating(*COLS).alias("r"), R.max_score(*COLS).alias("m"),
                  R.highest_concern(*COLS).alias("hc")).first()
    # NaN / NULL are 0, 1.7 clips to 1 (> 0.95 -> M-AO), -3 clips to 0
    assert (r.r, r.m, r.hc) == ("M-AO", 1.0, "language")


def _python_rating(v, s, l, d):
    c = [min(1.0, max(0.0, x)) for x in (v, s, l, d)]
    m = max(c)
    if m > 0.95 or sum(x > 0.85 for x in c) >= 2:
        return "M-AO"
    for code, up in (("M-E", .05), ("M-P", .40), ("M-T", .70), ("M-R", .95)):
        if m <= up:
            return code
    return "M-AO"


def test_random_rows_match_brute_force_and_properties(spark):
    rnd = random.Random(7)
    grid = [0, .05, .0500001, .4, .40001, .7, .70001, .85, .850001, .95, .950001, 1]
    rows = [tuple(rnd.choice(grid) if rnd.random() < .5 else rnd.random() for _ in range(4))
            for _ in range(400)]
    df = _df(spark, rows)
    got = [r.r for r in df.select(R.mcr_rating(*COLS).alias("r")).collect()]
    assert got == [_python_rating(*r) for r in rows]
    # permutation invariance of the rating
    perm = [tuple(r[i] for i in p) for r in rows[:50] for p in itertools.permutations(range(4))]
    gp = [r.r for r in _df(spark, perm).select(R.mcr_rating(*COLS).alias("r")).collect()]
    assert all(len(set(gp[i * 24:(i + 1) * 24])) == 1 for i in range(50))
    # monotone: raising one score never lowers the rating level
    order = {c: i for i, c in enumerate(["M-E", "M-P", "M-T", "M-R", "M-AO"])}
    up = [tuple(min(1.0, x + 0.1) if j == 0 else x for j, x in enumerate(r)) for r in rows]
    gu = [r.r for r in _df(spark, up).select(R.mcr_rating(*COLS).alias("r")).collect()]
    assert all(order[b] >= order[a] for a, b in zip(got, gu))


def test_no_descriptors_only_for_low_ratings(spark):
    rows = [tuple(random.Random(i).random() ** 3 for _ in range(4)) for i in range(300)]
    df = _df(spark, rows).select(R.mcr_rating(*COLS).alias("r"), F.size(R.descriptors(*COLS)).alias("n"))
    assert all(r.r in ("M-E", "M-P") for r in df.collect() if r.n == 0)


def test_rating_filter_matches_rating(spark):
    rows = [tuple(random.Random(i).random() for _ in range(4)) for i in range(300)] + [r[:4] for r in GOLDEN]
    df = _df(spark, rows)
    order = ["M-E", "M-P", "M-T", "M-R", "M-AO"]
    for code in order:
        a = df.filter(R.rating_filter(code, *COLS)).count()
        b = df.filter(R.rating_level(R.mcr_rating(*COLS)) <= order.index(code)).count()
        assert a == b, code


def test_lookups_and_struct(spark):
    df = _df(spark, [GOLDEN[9]]).select(R.rating_struct(*COLS).alias("x"))
    x = df.first().x
    assert x.rating == "M-AO"
    assert x.details.recommendation == "Adults only - not suitable for minors"
    assert x.details.rating_explanation == "Content suitable only for adults ages 18 and up"
    assert list(x.descriptors) == ["Intense Violence", "Sexual Content"]
    names = spark.createDataFrame([(c,) for c in ["M-E", "M-P", "M-T", "M-R", "M-AO", "X"]], "r string")
    got = [r.n for r in names.select(R.long_name(F.col("r")).alias("n")).collect()]
    assert got == ["Everyone", "Parental Guidance Suggested", "Teen", "Restricted", "Adults Only", ""]


def test_display_variant_differs_for_mp(spark):
    df = _df(spark, [GOLDEN[3]])
    r = R.mcr_rating(*COLS)
    d = R.descriptors(*COLS)
    row = df.select(R.descriptor_text_from(r, d).alias("batch"),
                    R.display_descriptor_text_from(r, d).alias("display")).first()
    assert (row.batch, row.display) == ("Parental Guidance Suggested", "None")
