"""SQL functions equal the Column builders."""

import random

from pyspark.sql import functions as F

from ratewise.functions import rating as R
from ratewise.functions import sqlfuncs


def test_sql_functions_equal_columns(spark):
    sqlfuncs.register(spark)
    rnd = random.Random(5)
    rows = [tuple(rnd.random() ** 2 for _ in range(4)) for _ in range(300)] + [(float("nan"), None, 2.0, -1.0)]
    df = spark.createDataFrame(rows, "v double, s double, l double, d double")
    df.createOrReplaceTempView("u2_scores")
    sql = spark.sql("""SELECT mcr_rating(v, s, l, d) AS r, mcr_descriptor_text(v, s, l, d) AS t,
                              mcr_final_rating(v, s, l, d) AS f, mcr_highest_concern(v, s, l, d) AS h,
                              mcr_max_score(v, s, l, d) AS m, mcr_recommendation(mcr_rating(v, s, l, d)) AS rec
                       FROM u2_scores""").collect()
    c = ["v", "s", "l", "d"]
    col = df.select(R.mcr_rating(*c).alias("r"), R.descriptor_text(*c).alias("t"), R.final_rating(*c).alias("f"),
                    R.highest_concern(*c).alias("h"), R.max_score(*c).alias("m"),
                    R.recommendation(R.mcr_rating(*c)).alias("rec")).collect()
    assert [tuple(r) for r in sql] == [tuple(r) for r in col]


def test_single_song_sql(spark):
    sqlfuncs.register(spark)
    r = spark.sql("SELECT mcr_final_rating(0.2, 0.5, 0.5, 0.1) AS f, mcr_long_name('M-T') AS n").first()
    assert (r.f, r.n) == ("M-T: Strong Language; Suggestive Themes", "Teen")


def test_clip01_sql(spark):
    sqlfuncs.register(spark)
    r = spark.sql("""SELECT mcr_clip01(CAST(NULL AS DOUBLE)) AS a, mcr_clip01(CAST('NaN' AS DOUBLE)) AS b,
                            mcr_clip01(CAST('Infinity' AS DOUBLE)) AS c, mcr_clip01(-0.5) AS d, mcr_clip01(0.25) AS e""").first()
    assert tuple(r) == (0.0, 0.0, 1.0, 0.0, 0.25)


def test_text_and_safety_functions_equal_columns(spark):
    from ratewise.functions import severity as V
    from ratewise.functions import text as X
    sqlfuncs.register(spark)
    texts = spark.createDataFrame([("I'm here, DON'T stop mama's 3x",), (None,), ("café \"quoted\" it's",)], "t string")
    got = texts.selectExpr("mcr_clean_text(t) AS c", "mcr_word_count(t) AS w").collect()
    want = texts.select(X.clean_text("t").alias("c"), X.word_count("t").alias("w")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    rows = [(a, b, c, d) for a in (0.0, 10.5, 31.0) for b in (15.0, 15.5, 36.0) for c in (0.0, 100.0) for d in (10.0, 30.0)]
    df = spark.createDataFrame(rows, "e double, v double, s double, u double")
    got = df.selectExpr("mcr_severity(e, v, s, u)", "mcr_kid_safe(e, v, s, u)", "mcr_safety_level(e, v, s, u)",
                        "mcr_descriptors(v / 100, s / 100, e / 100, u / 100)").collect()
    args = ("e", "v", "s", "u")
    want = df.select(V.severity(*args), V.kid_safe(*args), V.safety_level(*args),
                     R.descriptors(F.col("v") / 100, F.col("s") / 100, F.col("e") / 100, F.col("u") / 100)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_callers_functions_are_not_replaced(spark):
    import pytest
    other = spark.newSession()
    other.sql("CREATE TEMPORARY FUNCTION mcr_severity(x INT) RETURNS INT RETURN x")
    known = set(sqlfuncs._REGISTERED)
    sqlfuncs._REGISTERED.clear()
    try:
        with pytest.raises(ValueError, match="mcr_severity"):
            sqlfuncs.register(other)
    finally:
        sqlfuncs._REGISTERED.update(known)
