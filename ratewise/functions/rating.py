"""Rating rules as native Column expressions.

Every builder takes the four score columns in the canonical order
(violence, sexual, language, substance) and clips them itself, so callers
holding dirty values still get the right rating.  All of it compiles into
one whole-stage-codegen projection; no Python runs per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratewise.constants import (
    CONCERN_ORDER,
    DESCRIPTOR_SEPARATOR,
    EMPTY_DESCRIPTOR_DISPLAY,
    EMPTY_DESCRIPTOR_TEXT,
    EXPLANATIONS,
    LADDER,
    LANGUAGE_TIERS,
    LONG_NAMES,
    MULTIPLE_HIGH,
    MULTIPLE_HIGH_COUNT,
    NO_DESCRIPTOR,
    RATINGS,
    RECOMMENDATIONS,
    SEXUAL_TIERS,
    SINGLE_EXTREME,
    SUBSTANCE_TIERS,
    VIOLENCE_TIERS,
)
from ratewise.functions.scores import clip01

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clipped(v, s, l, d) -> list[Column]:
    return [clip01(_c(x)) for x in (v, s, l, d)]


def max_score(v, s, l, d) -> Column:
    """R2: largest of the four clipped scores."""
    return F.greatest(*_clipped(v, s, l, d))


def adults_only(v, s, l, d) -> Column:
    """R3 + R4: any score > 0.95, or at least two scores > 0.85."""
    cs = _clipped(v, s, l, d)
    high = reduce(lambda a, b: a + b, [(x > MULTIPLE_HIGH).cast("int") for x in cs])
    return (F.greatest(*cs) > SINGLE_EXTREME) | (high >= MULTIPLE_HIGH_COUNT)


def ladder_rating(m: Column) -> Column:
    """Rating from the max score; upper bounds inclusive."""
    expr = F
    for code, upper in LADDER:
        expr = expr.when(m <= upper, F.lit(code))
    return expr.otherwise(F.lit("M-AO"))


def mcr_rating(v, s, l, d) -> Column:
    """Adults-only rules first, then the ladder."""
    return F.when(adults_only(v, s, l, d), F.lit("M-AO")).otherwise(
        ladder_rating(max_score(v, s, l, d)))


def rating_of_clipped(v: Column, s: Column, l: Column, d: Column) -> Column:
    """R3-R6 on scores already clipped to [0, 1] (no re-clipping)."""
    cs = [v, s, l, d]
    high = reduce(lambda a, b: a + b, [(x > MULTIPLE_HIGH).cast("int") for x in cs])
    m = F.greatest(*cs)
    return F.when((m > SINGLE_EXTREME) | (high >= MULTIPLE_HIGH_COUNT), F.lit("M-AO")).otherwise(
        ladder_rating(m))


def tier_descriptors(v: Column, s: Column, l: Column, d: Column) -> list[Column]:
    """R7-R10 on clipped scores, in list order (language, violence, sexual,
    substance); each NULL when no tier applies."""
    return [_tier(l, LANGUAGE_TIERS), _tier(v, VIOLENCE_TIERS),
            _tier(s, SEXUAL_TIERS), _tier(d, SUBSTANCE_TIERS)]


def concern_of_clipped(v: Column, s: Column, l: Column, d: Column, m: Column) -> Column:
    """R15 given clipped scores and their max."""
    cs = dict(zip(["violence", "sexual", "language", "substance"], (v, s, l, d)))
    expr = F
    for name in CONCERN_ORDER:
        expr = expr.when(cs[name] == m, F.lit(name))
    return expr


def rating_level(rating: Column) -> Column:
    """Ordinal 0..4 of a rating code (M-E=0 ... M-AO=4), NULL if unknown."""
    expr = F
    for i, code in enumerate(RATINGS):
        expr = expr.when(rating == code, F.lit(i))
    return expr


def _tier(x: Column, tiers) -> Column:
    expr = F
    for limit, text in tiers:
        expr = expr.when(x > limit, F.lit(text))
    return expr  # no match -> NULL


def language_descriptor(l) -> Column:
    """R7 (only language has the mild tier (0.05, 0.40])."""
    return _tier(clip01(_c(l)), LANGUAGE_TIERS)


def violence_descriptor(v) -> Column:
    """R8."""
    return _tier(clip01(_c(v)), VIOLENCE_TIERS)


def sexual_descriptor(s) -> Column:
    """R9."""
    return _tier(clip01(_c(s)), SEXUAL_TIERS)


def substance_descriptor(d) -> Column:
    """R10."""
    return _tier(clip01(_c(d)), SUBSTANCE_TIERS)


def descriptor_list(tiers: list[Column]) -> Column:
    """R11 from the four nullable tier columns: ARRAY<STRING> of the
    present ones, in order.  Built with concat_ws (skips NULL) and split
    rather than a lambda filter, so it stays inside whole-stage codegen."""
    has = F.coalesce(*tiers).isNotNull()
    return F.when(has, F.split(F.concat_ws(DESCRIPTOR_SEPARATOR, *tiers), DESCRIPTOR_SEPARATOR, -1)) \
        .otherwise(F.array().cast("array<string>"))


def descriptors(v, s, l, d) -> Column:
    """ARRAY<STRING> in the order language, violence, sexual, substance."""
    return descriptor_list([language_descriptor(l), violence_descriptor(v),
                            sexual_descriptor(s), substance_descriptor(d)])


def descriptor_text_from(rating: Column, descs: Column) -> Column:
    """R12: '; '-joined descriptors; if none: M-E 'Everyone',
    M-P 'Parental Guidance Suggested', otherwise 'None'."""
    empty = F
    for code, text in EMPTY_DESCRIPTOR_TEXT.items():
        empty = empty.when(rating == code, F.lit(text))
    empty = empty.otherwise(F.lit(NO_DESCRIPTOR))
    return F.when(F.size(descs) > 0, F.array_join(descs, DESCRIPTOR_SEPARATOR)).otherwise(empty)


def descriptor_text(v, s, l, d) -> Column:
    return descriptor_text_from(mcr_rating(v, s, l, d), descriptors(v, s, l, d))


def display_descriptor_text_from(rating: Column, descs: Column) -> Column:
    """Display variant: no descriptors -> 'Everyone' for M-E, else 'None'."""
    empty = F
    for code, text in EMPTY_DESCRIPTOR_DISPLAY.items():
        empty = empty.when(rating == code, F.lit(text))
    empty = empty.otherwise(F.lit(NO_DESCRIPTOR))
    return F.when(F.size(descs) > 0, F.array_join(descs, DESCRIPTOR_SEPARATOR)).otherwise(empty)


def final_rating_from(rating: Column, descs: Column, text: Column) -> Column:
    """R14: '<rating>: <descriptor text>' unless M-E or no descriptors."""
    return F.when((rating != "M-E") & (F.size(descs) > 0),
                  F.concat(rating, F.lit(": "), text)).otherwise(rating)


def final_rating(v, s, l, d) -> Column:
    r = mcr_rating(v, s, l, d)
    ds = descriptors(v, s, l, d)
    return final_rating_from(r, ds, descriptor_text_from(r, ds))


def highest_concern(v, s, l, d) -> Column:
    """Arg-max category; ties go to violence, sexual, language,
    substance in that order (an all-zero row is 'violence')."""
    cs = dict(zip(["violence", "sexual", "language", "substance"], _clipped(v, s, l, d)))
    m = F.greatest(*cs.values())
    expr = F
    for name in CONCERN_ORDER:
        expr = expr.when(cs[name] == m, F.lit(name))
    return expr


def _lookup(rating: Column, table: dict[str, str]) -> Column:
    expr = F
    for code, text in table.items():
        expr = expr.when(rating == code, F.lit(text))
    return expr.otherwise(F.lit(""))


def explanation(rating: Column) -> Column:
    """R16 (unknown code -> '')."""
    return _lookup(_c(rating), EXPLANATIONS)


def recommendation(rating: Column) -> Column:
    """R17 (unknown code -> '')."""
    return _lookup(_c(rating), RECOMMENDATIONS)


def long_name(rating: Column) -> Column:
    """R18 (unknown code -> '')."""
    return _lookup(_c(rating), LONG_NAMES)


def rating_struct(v, s, l, d) -> Column:
    """The whole rating result as one nested struct."""
    cs = _clipped(v, s, l, d)
    r = mcr_rating(*cs)
    return F.struct(
        r.alias("rating"),
        F.struct(cs[0].alias("violence"), cs[1].alias("sexual"),
                 cs[2].alias("language"), cs[3].alias("substance")).alias("scores"),
        descriptors(*cs).alias("descriptors"),
        F.greatest(*cs).alias("max_score"),
        F.struct(explanation(r).alias("rating_explanation"),
                 highest_concern(*cs).alias("highest_concern"),
                 recommendation(r).alias("recommendation")).alias("details"),
    )


def rating_filter(rating_code: str, v, s, l, d) -> Column:
    """Predicate on the *clean* score columns equivalent to
    ``mcr_rating(...) <= rating_code`` for the ladder ratings, written so
    that Parquet min/max statistics can prune row groups (a filter on the
    derived rating cannot be pushed into the scan)."""
    if rating_code not in RATINGS:
        raise ValueError(f"unknown rating {rating_code!r}")
    if rating_code == "M-AO":
        return F.lit(True)
    upper = dict(LADDER)[rating_code]
    cols = [_c(x) for x in (v, s, l, d)]
    pred = reduce(lambda a, b: a & b, [x <= upper for x in cols])
    # scores at or below 0.95 never trip the single-extreme rule, but two of
    # them above 0.85 do: only M-R needs that extra condition.
    if upper > MULTIPLE_HIGH:
        high = reduce(lambda a, b: a + b, [(x > MULTIPLE_HIGH).cast("int") for x in cols])
        pred = pred & (high < MULTIPLE_HIGH_COUNT)
    return pred
