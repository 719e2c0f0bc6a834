"""Expected counts of FIXTURES F7 and F8 at sf0.01."""

from conftest import SF_CHECK
from ratewise.plans import catalog


def test_f7_counts(spark):
    q = catalog.QUERIES
    assert {r.rating: r.n for r in q["rating_histogram"](spark, SF_CHECK).collect()} == {
        "M-AO": 1142, "M-E": 288, "M-P": 4115, "M-R": 4550, "M-T": 4905}
    assert {r.descriptor: r.n for r in q["descriptor_counts"](spark, SF_CHECK).collect()} == {
        "Mild Language": 5526, "Violence": 2275, "Suggestive Themes": 2265, "Drug Reference": 2263,
        "Strong Language": 2245, "Parental Guidance Suggested": 1922, "Explicit Language": 1688,
        "Drug Abuse": 1421, "Sexual Content": 1421, "Intense Violence": 1412, "Everyone": 288,
        "Graphic Violence": 269, "Graphic Sexual Content": 266, "Glorified Drug Use": 261}
    assert {r.highest_concern: r.n for r in q["highest_concern_counts"](spark, SF_CHECK).collect()} == {
        "violence": 3773, "language": 3766, "sexual": 3742, "substance": 3719}


def test_f8_safety_levels(spark):
    got = {r.safety_level: r.n for r in catalog.QUERIES["safety_levels"](spark, SF_CHECK).collect()}
    assert got == {"Clean": 47, "Moderate": 61, "Explicit": 392}
