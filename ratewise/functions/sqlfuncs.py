"""The rating, safety and text rules as Spark SQL functions.

``register(spark)`` creates temporary SQL functions (``CREATE TEMPORARY
FUNCTION ... RETURN expr``).  Spark inlines SQL functions into the calling
plan, so ``SELECT mcr_rating(v, s, l, d) FROM t`` compiles to the same
projection as the DataFrame builders.  All names begin with ``mcr_``; a
function of the caller's with such a name is never replaced unasked.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ratewise.constants import (
    CONTRACTIONS,
    PUNCT_PATTERN,
    SAFETY_HIGH,
    SAFETY_MEDIUM,
    SEVERITY_CAP,
    SEVERITY_WEIGHTS,
    VIOLENCE_SAFETY_HIGH,
    VIOLENCE_SAFETY_MEDIUM,
)
from ratewise.functions import sql_text as S
from ratewise.functions import text as X

_ARGS = "v DOUBLE, s DOUBLE, l DOUBLE, d DOUBLE"
_PERCENT = "explicit DOUBLE, violence DOUBLE, sexual_content DOUBLE, substance_use DOUBLE"
_PARTS = ("explicit", "violence", "sexual_content", "substance_use")
_CV, _CS, _CL, _CD = (S.clip01(x) for x in ("v", "s", "l", "d"))


def _rating() -> str:
    return S.rating(_CV, _CS, _CL, _CD)


def _raw(pattern: str) -> str:
    """Raw SQL string literal."""
    quote = '"' if "'" in pattern else "'"
    if quote in pattern:
        raise ValueError(f"both quotes in {pattern!r}")
    return f"r{quote}{pattern}{quote}"


def _above(limit: float, violence: float) -> str:
    return "(" + " OR ".join(f"{p} > {violence if p == 'violence' else limit}" for p in _PARTS) + ")"


def _clean_text() -> str:
    """T18 (token mode) of the argument ``t``."""
    text = "coalesce(t, '')"
    expanded = text
    for word, to in CONTRACTIONS:
        expanded = f"regexp_replace({expanded}, {_raw(X.contraction_pattern(word))}, '{to}')"
    base = f"CASE WHEN contains({text}, \"'\") AND {text} RLIKE {_raw(X.ANY_CONTRACTION)} THEN {expanded} ELSE {text} END"
    spaced = f"regexp_replace(lower({base}), {_raw(PUNCT_PATTERN)}, ' ')"
    joined = f"array_join(regexp_extract_all({spaced}, {_raw(X.TOKEN_PATTERN)}, 1), ' ')"
    return f"trim(regexp_replace(regexp_replace({joined}, {_raw(chr(92) + 'P{ASCII}+')}, ''), ' +', ' '))"


FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # name: (arguments, return type, body)
    "mcr_clip01": ("x DOUBLE", "DOUBLE", S.clip01("x")),
    "mcr_max_score": (_ARGS, "DOUBLE", S.max_score(_CV, _CS, _CL, _CD)),
    "mcr_rating": (_ARGS, "STRING", _rating()),
    "mcr_descriptor_text": (_ARGS, "STRING", S.descriptor_text(_CV, _CS, _CL, _CD, _rating())),
    "mcr_final_rating": (_ARGS, "STRING", S.final_rating(
        _CV, _CS, _CL, _CD, _rating(), S.descriptor_text(_CV, _CS, _CL, _CD, _rating()))),
    "mcr_highest_concern": (_ARGS, "STRING", S.highest_concern(_CV, _CS, _CL, _CD)),
    "mcr_recommendation": ("rating STRING", "STRING", S.recommendation("rating")),
    "mcr_explanation": ("rating STRING", "STRING", S.explanation("rating")),
    "mcr_long_name": ("rating STRING", "STRING", S.long_name("rating")),
    "mcr_descriptors": (_ARGS, "ARRAY<STRING>", f"array_compact(array({', '.join(S.descriptors(_CV, _CS, _CL, _CD))}))"),
    "mcr_severity": (_PERCENT, "DOUBLE", f"least({SEVERITY_CAP}D, " + " + ".join(f"{p} * {w}D" for p, w in zip(_PARTS, SEVERITY_WEIGHTS)) + ")"),
    "mcr_kid_safe": (_PERCENT, "BOOLEAN", f"NOT {_above(SAFETY_MEDIUM, VIOLENCE_SAFETY_MEDIUM)}"),
    "mcr_safety_level": (_PERCENT, "STRING", f"CASE WHEN {_above(SAFETY_HIGH, VIOLENCE_SAFETY_HIGH)} THEN 'Explicit' "
                                             f"WHEN {_above(SAFETY_MEDIUM, VIOLENCE_SAFETY_MEDIUM)} THEN 'Moderate' ELSE 'Clean' END"),
    "mcr_clean_text": ("t STRING", "STRING", _clean_text()),
    "mcr_word_count": ("t STRING", "INT", f"CAST(regexp_count(coalesce(t, ''), {_raw(X.NOT_WS + '+')}) AS INT)"),
}

#: Sessions (by application) whose functions of these names are ours.
_REGISTERED: set[str] = set()


def register(spark: SparkSession, replace: bool = False) -> list[str]:
    """Create all SQL functions in the session.  A name that the caller has
    defined is an error unless ``replace``."""
    ours = spark.sparkContext.applicationId in _REGISTERED
    if not (replace or ours):
        taken = [n for n in FUNCTIONS if spark.catalog.functionExists(n)]
        if taken:
            raise ValueError(f"functions of these names exist: {taken}")
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    _REGISTERED.add(spark.sparkContext.applicationId)
    return list(FUNCTIONS)
