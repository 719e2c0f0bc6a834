"""The rating rules as SQL text.

The fragments use only CASE, greatest/least, coalesce, isnan and
concat_ws, which Spark SQL and DuckDB read the same way, so the same text
defines the Spark SQL functions and can be read by other engines.
"""

from __future__ import annotations

from ratewise.constants import (
    CONCERN_ORDER,
    EMPTY_DESCRIPTOR_DISPLAY,
    EMPTY_DESCRIPTOR_TEXT,
    EXPLANATIONS,
    LADDER,
    LANGUAGE_TIERS,
    LONG_NAMES,
    MULTIPLE_HIGH,
    MULTIPLE_HIGH_COUNT,
    NO_DESCRIPTOR,
    RECOMMENDATIONS,
    SEXUAL_TIERS,
    SINGLE_EXTREME,
    SUBSTANCE_TIERS,
    VIOLENCE_TIERS,
)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def clip01(x: str) -> str:
    return f"greatest(0.0, least(1.0, coalesce(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, 0.0)))"


def max_score(v: str, s: str, l: str, d: str) -> str:
    return f"greatest({v}, {s}, {l}, {d})"


def rating(v: str, s: str, l: str, d: str) -> str:
    """Rating of four *clipped* scores."""
    m = max_score(v, s, l, d)
    high = " + ".join(f"CAST({x} > {MULTIPLE_HIGH} AS INTEGER)" for x in (v, s, l, d))
    ladder = " ".join(f"WHEN {m} <= {upper} THEN {q(code)}" for code, upper in LADDER)
    return (f"CASE WHEN {m} > {SINGLE_EXTREME} OR ({high}) >= {MULTIPLE_HIGH_COUNT} THEN 'M-AO' "
            f"{ladder} ELSE 'M-AO' END")


def _tier(x: str, tiers) -> str:
    whens = " ".join(f"WHEN {x} > {limit} THEN {q(text)}" for limit, text in tiers)
    return f"CASE {whens} END"


def descriptors(v: str, s: str, l: str, d: str) -> list[str]:
    """Four nullable descriptor expressions in list order."""
    return [_tier(l, LANGUAGE_TIERS), _tier(v, VIOLENCE_TIERS),
            _tier(s, SEXUAL_TIERS), _tier(d, SUBSTANCE_TIERS)]


def has_descriptors(v: str, s: str, l: str, d: str) -> str:
    return f"coalesce({', '.join(descriptors(v, s, l, d))}) IS NOT NULL"


def descriptor_text(v: str, s: str, l: str, d: str, rating_expr: str, display: bool = False) -> str:
    empty_map = EMPTY_DESCRIPTOR_DISPLAY if display else EMPTY_DESCRIPTOR_TEXT
    empties = " ".join(f"WHEN {rating_expr} = {q(code)} THEN {q(text)}" for code, text in empty_map.items())
    joined = f"concat_ws('; ', {', '.join(descriptors(v, s, l, d))})"
    return (f"CASE WHEN {has_descriptors(v, s, l, d)} THEN {joined} "
            f"{empties} ELSE {q(NO_DESCRIPTOR)} END")


def final_rating(v: str, s: str, l: str, d: str, rating_expr: str, text_expr: str) -> str:
    return (f"CASE WHEN {rating_expr} <> 'M-E' AND {has_descriptors(v, s, l, d)} "
            f"THEN concat({rating_expr}, ': ', {text_expr}) ELSE {rating_expr} END")


def highest_concern(v: str, s: str, l: str, d: str) -> str:
    m = max_score(v, s, l, d)
    cols = dict(zip(["violence", "sexual", "language", "substance"], (v, s, l, d)))
    whens = " ".join(f"WHEN {cols[name]} = {m} THEN {q(name)}" for name in CONCERN_ORDER)
    return f"CASE {whens} END"


def lookup(rating_expr: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {rating_expr} = {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {whens} ELSE '' END"


def explanation(rating_expr: str) -> str:
    return lookup(rating_expr, EXPLANATIONS)


def recommendation(rating_expr: str) -> str:
    return lookup(rating_expr, RECOMMENDATIONS)


def long_name(rating_expr: str) -> str:
    return lookup(rating_expr, LONG_NAMES)
