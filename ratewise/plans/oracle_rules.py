"""The rating rules as DuckDB SQL for the oracle, every limit and text a
literal of this file: nothing is imported from the code under test, so a wrong
constant there shows as a difference.
"""

from __future__ import annotations

LANGUAGE = "CASE WHEN {l} > 0.70 THEN 'Explicit Language' WHEN {l} > 0.40 THEN 'Strong Language' WHEN {l} > 0.05 THEN 'Mild Language' END"
VIOLENCE = "CASE WHEN {v} > 0.95 THEN 'Graphic Violence' WHEN {v} > 0.70 THEN 'Intense Violence' WHEN {v} > 0.40 THEN 'Violence' END"
SEXUAL = "CASE WHEN {s} > 0.95 THEN 'Graphic Sexual Content' WHEN {s} > 0.70 THEN 'Sexual Content' WHEN {s} > 0.40 THEN 'Suggestive Themes' END"
SUBSTANCE = "CASE WHEN {d} > 0.95 THEN 'Glorified Drug Use' WHEN {d} > 0.70 THEN 'Drug Abuse' WHEN {d} > 0.40 THEN 'Drug Reference' END"


def clip01(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) OR {x} < 0.0 THEN 0.0 WHEN {x} > 1.0 THEN 1.0 ELSE {x} END)"


def max_score(v: str, s: str, l: str, d: str) -> str:
    return f"greatest({v}, {s}, {l}, {d})"


def rating(v: str, s: str, l: str, d: str) -> str:
    m = max_score(v, s, l, d)
    high = " + ".join(f"({x} > 0.85)::int" for x in (v, s, l, d))
    return (f"CASE WHEN {m} > 0.95 OR {high} >= 2 THEN 'M-AO' WHEN {m} <= 0.05 THEN 'M-E' WHEN {m} <= 0.40 THEN 'M-P' "
            f"WHEN {m} <= 0.70 THEN 'M-T' ELSE 'M-R' END")


def descriptors(v: str, s: str, l: str, d: str) -> list[str]:
    return [t.format(v=v, s=s, l=l, d=d) for t in (LANGUAGE, VIOLENCE, SEXUAL, SUBSTANCE)]


def _any(v: str, s: str, l: str, d: str) -> str:
    return f"({l} > 0.05 OR {v} > 0.40 OR {s} > 0.40 OR {d} > 0.40)"


def descriptor_text(v: str, s: str, l: str, d: str, r: str, display: bool = False) -> str:
    guidance = "" if display else f"WHEN {r} = 'M-P' THEN 'Parental Guidance Suggested' "
    return (f"CASE WHEN {_any(v, s, l, d)} THEN concat_ws('; ', {', '.join(descriptors(v, s, l, d))}) "
            f"WHEN {r} = 'M-E' THEN 'Everyone' {guidance}ELSE 'None' END")


def final_rating(v: str, s: str, l: str, d: str, r: str, text: str) -> str:
    return f"CASE WHEN {r} <> 'M-E' AND {_any(v, s, l, d)} THEN concat({r}, ': ', {text}) ELSE {r} END"


def highest_concern(v: str, s: str, l: str, d: str) -> str:
    m = max_score(v, s, l, d)
    return f"CASE {m} WHEN {v} THEN 'violence' WHEN {s} THEN 'sexual' WHEN {l} THEN 'language' ELSE 'substance' END"


def explanation(r: str) -> str:
    return (f"CASE {r} WHEN 'M-E' THEN 'Content generally suitable for all ages' WHEN 'M-P' THEN 'Some material may not be suitable for children' "
            "WHEN 'M-T' THEN 'Content generally suitable for ages 13 and up' WHEN 'M-R' THEN 'Under 17 requires accompanying parent or adult guardian' "
            "WHEN 'M-AO' THEN 'Content suitable only for adults ages 18 and up' ELSE '' END")


def recommendation(r: str) -> str:
    return (f"CASE {r} WHEN 'M-E' THEN 'Safe for family listening' WHEN 'M-P' THEN 'Parents should review before allowing young children to listen' "
            "WHEN 'M-T' THEN 'Appropriate for ages 13+ teenagers' WHEN 'M-R' THEN 'Parental discretion strongly advised' "
            "WHEN 'M-AO' THEN 'Adults only - not suitable for minors' ELSE '' END")


def long_name(r: str) -> str:
    return (f"CASE {r} WHEN 'M-E' THEN 'Everyone' WHEN 'M-P' THEN 'Parental Guidance Suggested' WHEN 'M-T' THEN 'Teen' "
            "WHEN 'M-R' THEN 'Restricted' WHEN 'M-AO' THEN 'Adults Only' ELSE '' END")


def text(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"
