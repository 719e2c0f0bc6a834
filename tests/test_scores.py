"""Score coercion and quality counts (FIXTURES F5)."""

from pyspark.sql import functions as F

from ratewise.functions.scores import clean_score
from ratewise.operators.quality import score_quality

CASES = [
    (None, 0.0, "missing"), ("", 0.0, "missing"), ("NA", 0.0, "missing"), ("nan", 0.0, "missing"),
    ("None", 0.0, "missing"),
    ("abc", 0.0, "non_numeric"), ("1d", 0.0, "non_numeric"), ("0.5f", 0.0, "non_numeric"),
    ("1,000", 0.0, "non_numeric"), ("1_000", 0.0, "non_numeric"), ("0x1A", 0.0, "non_numeric"),
    ("True", 0.0, "non_numeric"),
    ("-0.2", 0.0, "out_of_range"), ("-inf", 0.0, "out_of_range"),
    ("1.7", 1.0, "out_of_range"), ("inf", 1.0, "out_of_range"), ("Infinity", 1.0, "out_of_range"),
    ("0.5", 0.5, None), (" 0.5 ", 0.5, None), (".5", 0.5, None), ("5e-1", 0.5, None),
    ("INF", 1.0, "out_of_range"), ("-INF", 0.0, "out_of_range"), ("INFINITY", 1.0, "out_of_range"), ("iNf", 1.0, "out_of_range"),
    ("5.", 1.0, "out_of_range"), ("+0.3", 0.3, None), ("1.0E-4", 0.0001, None),
]


def test_string_scores(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "x string")
    got = [r.y for r in df.select(clean_score("x", df.schema["x"].dataType).alias("y")).collect()]
    assert got == [c[1] for c in CASES]
    q = score_quality(df, ["x"]).first().asDict()
    assert q["n_rows"] == len(CASES)
    for kind in ("missing", "non_numeric", "out_of_range"):
        assert q[f"x_{kind}"] == sum(c[2] == kind for c in CASES), kind


def test_numeric_and_boolean_scores(spark):
    df = spark.createDataFrame([(float("nan"), True), (None, False), (0.25, None), (3.0, True)],
                               "d double, b boolean")
    t = {f.name: f.dataType for f in df.schema.fields}
    got = df.select(clean_score("d", t["d"]).alias("d"), clean_score("b", t["b"]).alias("b")).collect()
    assert [(r.d, r.b) for r in got] == [(0.0, 1.0), (0.0, 0.0), (0.25, 0.0), (1.0, 1.0)]
    q = score_quality(df, ["d", "b"]).first()
    assert (q.d_missing, q.d_out_of_range, q.b_missing) == (2, 1, 1)


def test_clip_idempotent(spark):
    df = spark.range(200).select((F.rand(3) * 4 - 2).alias("x"))
    once = df.select(clean_score("x", df.schema["x"].dataType).alias("y"))
    twice = once.select(clean_score("y", once.schema["y"].dataType).alias("z"), "y")
    assert twice.filter("z <> y").count() == 0


def test_whitespace_around_numbers(spark):
    df = spark.createDataFrame([("\t0.5\n",), (" 1e-1 ",), ("\r.25",)], "x string")
    got = [r.y for r in df.select(clean_score("x", df.schema["x"].dataType).alias("y")).collect()]
    assert got == [0.5, 0.1, 0.25]
