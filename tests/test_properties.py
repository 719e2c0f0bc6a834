"""Property tests with generated rows (hypothesis): rating, descriptors and
highest concern against a plain-Python statement of the rules, with the
engine's NULL/NaN -> 0 decision (SURVEY H3)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratewise.functions import rating as R

EDGES = [0.0, 0.05, 0.4, 0.7, 0.85, 0.95, 1.0, -1.0, 2.0, float("nan"), float("inf"), float("-inf")]
score = st.one_of(st.sampled_from(EDGES), st.floats(min_value=-0.5, max_value=1.5, allow_nan=False))
rows = st.lists(st.tuples(score, score, score, score), min_size=1, max_size=40)


def _clip(x):
    if x is None or math.isnan(x):
        return 0.0
    return min(1.0, max(0.0, x))


def _tier(x, tiers):
    for limit, text in tiers:
        if x > limit:
            return text
    return None


def _python(v, s, l, d):
    v, s, l, d = (_clip(x) for x in (v, s, l, d))
    m = max(v, s, l, d)
    if m > 0.95 or sum(x > 0.85 for x in (v, s, l, d)) >= 2:
        r = "M-AO"
    else:
        r = next((c for c, up in (("M-E", .05), ("M-P", .4), ("M-T", .7), ("M-R", .95)) if m <= up), "M-AO")
    descs = [t for t in (
        _tier(l, [(0.7, "Explicit Language"), (0.4, "Strong Language"), (0.05, "Mild Language")]),
        _tier(v, [(0.95, "Graphic Violence"), (0.7, "Intense Violence"), (0.4, "Violence")]),
        _tier(s, [(0.95, "Graphic Sexual Content"), (0.7, "Sexual Content"), (0.4, "Suggestive Themes")]),
        _tier(d, [(0.95, "Glorified Drug Use"), (0.7, "Drug Abuse"), (0.4, "Drug Reference")])) if t]
    concern = next(n for n, x in (("violence", v), ("sexual", s), ("language", l), ("substance", d)) if x == m)
    return r, "; ".join(descs), concern, m


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_rules_match_python(spark, data):
    df = spark.createDataFrame(data, "v double, s double, l double, d double")
    c = ["v", "s", "l", "d"]
    got = df.select(R.mcr_rating(*c).alias("r"), F.array_join(R.descriptors(*c), "; ").alias("t"),
                    R.highest_concern(*c).alias("h"), R.max_score(*c).alias("m")).collect()
    assert [tuple(g) for g in got] == [_python(*row) for row in data]
