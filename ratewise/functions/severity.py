"""Severity and safety operators as Column expressions.

Input is the scorer's probability array in label order
(sexual, violence, substance, language); float32 values are widened to
double *before* any threshold arithmetic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratewise.functions.scores import fill_missing
from ratewise.constants import (
    HIDDEN_RECOMMENDATION_PHRASES,
    RESCALE_THRESHOLD,
    SAFETY_COLORS,
    SAFETY_HIGH,
    SAFETY_MEDIUM,
    SEVERITY_CAP,
    SEVERITY_WEIGHTS,
    VIOLENCE_SAFETY_HIGH,
    VIOLENCE_SAFETY_MEDIUM,
)
from ratewise.functions import rating as R

# 1-based positions in the label-ordered probability array.
P_SEXUAL, P_VIOLENCE, P_SUBSTANCE, P_LANGUAGE = 1, 2, 3, 4

CATEGORY_COLUMNS = ["explicit", "violence", "sexual_content", "substance_use"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(z) -> Column:
    """M5: independent logistic per label."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def prob(probs, pos: int) -> Column:
    """V3: element of the probability array as double (1-based); NULL and NaN
    count as 0."""
    return fill_missing(F.element_at(_c(probs), pos).cast("double"))


def rescale(p) -> Column:
    """V1 + V2: p < 0.5 -> 0, else (p - 0.5) / (1 - 0.5) * 100, clamped."""
    p = fill_missing(_c(p))
    t = RESCALE_THRESHOLD
    raw = F.when(p < t, F.lit(0.0)).otherwise((p - F.lit(t)) / (F.lit(1.0) - F.lit(t)) * F.lit(100.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def category_percentages(probs) -> dict[str, Column]:
    """V3: explicit <- language, violence <- violence, sexual_content <-
    sexual, substance_use <- substance, each rescaled to 0..100."""
    return {
        "explicit": rescale(prob(probs, P_LANGUAGE)),
        "violence": rescale(prob(probs, P_VIOLENCE)),
        "sexual_content": rescale(prob(probs, P_SEXUAL)),
        "substance_use": rescale(prob(probs, P_SUBSTANCE)),
    }


def severity(explicit, violence, sexual_content, substance_use) -> Column:
    """V4 (as coded): weighted sum of the four percentages, capped at 100.
    Terms are added left to right in this order."""
    terms = [_c(x) * F.lit(w) for x, w in zip(
        (explicit, violence, sexual_content, substance_use), SEVERITY_WEIGHTS)]
    total = reduce(lambda a, b: a + b, terms)
    return F.least(F.lit(SEVERITY_CAP), total)


def csi_probability(probs) -> Column:
    """V5 (as documented): mean of the four probabilities on 0..100."""
    ps = [prob(probs, i) for i in (1, 2, 3, 4)]
    return F.lit(100.0) * reduce(lambda a, b: a + b, ps) / F.lit(4.0)


def _any_above(explicit, violence, sexual_content, substance_use, limit, violence_limit) -> Column:
    return ((_c(explicit) > limit) | (_c(violence) > violence_limit)
            | (_c(sexual_content) > limit) | (_c(substance_use) > limit))


def kid_safe(explicit, violence, sexual_content, substance_use) -> Column:
    """V7: unsafe when explicit/sexual/substance > 10 or violence > 15."""
    return ~_any_above(explicit, violence, sexual_content, substance_use,
                       SAFETY_MEDIUM, VIOLENCE_SAFETY_MEDIUM)


def safety_level(explicit, violence, sexual_content, substance_use) -> Column:
    """V8: Explicit (> 30, violence > 35), Moderate (> 10, violence > 15),
    else Clean."""
    args = (explicit, violence, sexual_content, substance_use)
    return (F.when(_any_above(*args, SAFETY_HIGH, VIOLENCE_SAFETY_HIGH), F.lit("Explicit"))
            .when(_any_above(*args, SAFETY_MEDIUM, VIOLENCE_SAFETY_MEDIUM), F.lit("Moderate"))
            .otherwise(F.lit("Clean")))


def rating_color(level) -> Column:
    """V9: colour attribute of a safety level."""
    expr = F
    for name, color in SAFETY_COLORS.items():
        expr = expr.when(_c(level) == name, F.lit(color))
    return expr


def category_band(value, high: float = SAFETY_HIGH, mid: float = SAFETY_MEDIUM) -> Column:
    """V10: 'high' / 'mid' / '' band of a percentage (strict >)."""
    v = _c(value)
    return F.when(v > high, F.lit("high")).when(v > mid, F.lit("mid")).otherwise(F.lit(""))


def violence_band(value) -> Column:
    return category_band(value, VIOLENCE_SAFETY_HIGH, VIOLENCE_SAFETY_MEDIUM)


def display_recommendation(rec) -> Column:
    """Blank a recommendation that mentions adults only / minors."""
    low = F.lower(_c(rec))
    hidden = reduce(lambda a, b: a | b, [low.contains(p) for p in HIDDEN_RECOMMENDATION_PHRASES])
    return F.when(hidden, F.lit("")).otherwise(_c(rec))


def safety_badge(kid_safe_col) -> Column:
    """V12."""
    return F.when(_c(kid_safe_col), F.lit("SAFE")).otherwise(F.lit("UNSAFE"))


def percent_scores(explicit, violence, sexual_content, substance_use) -> tuple[Column, ...]:
    """V6: percentages -> unit scores in rating order (v, s, l, d)."""
    return (_c(violence) / 100.0, _c(sexual_content) / 100.0,
            _c(explicit) / 100.0, _c(substance_use) / 100.0)
