"""Text cleaning as native Column expressions.

The cleaner works on the whole text instead of line by line.  That gives
the same result: no contraction pattern and no token can span a newline,
newline is whitespace, blank lines vanish when whitespace is collapsed,
and lines are re-joined by a single space anyway.

Token mode (default) is our native stand-in for a treebank tokeniser:
lower-case, punctuation -> space, split on whitespace, strip edge
punctuation, drop a trailing clitic, keep tokens made only of letters,
then keep ASCII letters.  Regex mode keeps ASCII words with Unicode word
boundaries.  Both are a handful of JVM regex passes, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratewise.constants import (
    CLITIC_ALTERNATION,
    CONTRACTIONS,
    POS_MAP,
    REGEX_WORD,
    WS_CHARS,
    WS_CLASS,
)

NOT_WS = f"[^{WS_CHARS}]"
EDGE_CHARS = f"[^\\p{{L}}\\p{{N}}{WS_CHARS}]*+"
# One token of the token-mode rule; group 1 is the kept word.  The
# look-arounds pin the match to whole whitespace-delimited tokens.  Every run is
# possessive and the clitic's apostrophe belongs to the run before it, so a
# token is read once, whatever it holds.
TOKEN_PATTERN = (
    f"(?<!{NOT_WS}){EDGE_CHARS}(\\p{{L}}++){EDGE_CHARS}"
    f"(?:(?<=')(?:{CLITIC_ALTERNATION}){EDGE_CHARS})?(?!{NOT_WS})"
)

# The same rule in one pass over a text whose wide punctuation and runs of - and .
# are blanked already (``word_tokens``): single punctuation separates like white
# space, and a token that is no word is taken whole with an empty group 1, so
# that matches follow each other and nothing looks back at every character.
WIDE_PUNCT = "“”‘’…—"
_SEPARATORS = WS_CHARS + r",:;@#$%&?!()\[\]{}<>\"«»"
_EDGE = f"[^\\p{{L}}\\p{{N}}{_SEPARATORS}]*+"
TOKEN_OR_REST = (
    f"{_EDGE}(\\p{{L}}++){_EDGE}(?:(?<=')(?:{CLITIC_ALTERNATION}){_EDGE})?(?![^{_SEPARATORS}])"
    f"|[^{_SEPARATORS}]++"
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_to_empty(t) -> Column:
    """T1."""
    return F.coalesce(_c(t), F.lit(""))


def contraction_pattern(word: str) -> str:
    """Case-insensitive, Unicode word-bounded pattern of one contraction."""
    return f"(?iU)\\b{word}\\b"


# One pass that tells whether any contraction occurs at all.
ANY_CONTRACTION = "(?iU)\\b(?:" + "|".join(w for w, _ in CONTRACTIONS) + ")\\b"


def expand_contractions(t) -> Column:
    """T5: the fixed contraction list, applied in order.  Contractions and what
    they stand for cannot reach over a space, so only the pieces between spaces
    that hold an ASCII apostrophe pay for the 38 ordered replacements.  The
    lambda also keeps them out of the generated method, which would else be too
    long for the JVM to compile."""
    t = _c(t)

    def expanded(piece: Column) -> Column:
        out = piece
        for word, repl in CONTRACTIONS:
            out = F.regexp_replace(out, contraction_pattern(word), repl)
        return F.when(piece.contains("'"), out).otherwise(piece)

    return F.when(t.contains("'"), F.array_join(F.transform(F.split(t, " ", -1), expanded), " ")).otherwise(t)


def strip_ws(t) -> Column:
    """Strip Python whitespace (SQL trim strips spaces only)."""
    return F.regexp_replace(_c(t), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def split_lines(t) -> Column:
    """Split on newline only."""
    return F.split(null_to_empty(t), "\n", -1)


def nonblank_lines(t) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(split_lines(t), lambda x: strip_ws(x)), lambda x: x != "")


def word_tokens(t) -> Column:
    """Token-mode words (lower-case, letters only, not yet ASCII).

    Of a run of - or . an odd one may stay; it stands at a token's edge, where
    it is dropped."""
    spaced = F.lower(_c(t))
    for mark in ("--", "..", *WIDE_PUNCT):
        spaced = F.replace(spaced, F.lit(mark), F.lit(" " * len(mark)))
    return F.array_remove(F.regexp_extract_all(spaced, F.lit(TOKEN_OR_REST), 1), "")


def regex_tokens(t) -> Column:
    """ASCII words with Unicode word boundaries, lower-cased."""
    return F.transform(F.regexp_extract_all(_c(t), F.lit(REGEX_WORD), 0), lambda w: F.lower(w))


def _finish(joined: Column, letters_only: bool = False) -> Column:
    """T16 + T17: keep ASCII letters and spaces, collapse, strip.

    When the joined words are known to hold letters only (token and regex
    modes), dropping every non-ASCII character is the same operation and
    Java runs ``\\P{ASCII}+`` many times faster than ``[^a-zA-Z ]``."""
    pattern = r"\P{ASCII}+" if letters_only else "[^a-zA-Z ]"
    letters = F.regexp_replace(joined, pattern, "")
    return F.trim(F.regexp_replace(letters, "  +", " "))


def normalize_quotes(t) -> Column:
    """Optional (H22): curly apostrophes to ASCII, so "don’t" expands too."""
    return F.translate(_c(t), "\u2019\u2018", "''")


def clean_text(t, mode: str = "token", normalize_quotes_first: bool = False) -> Column:
    """Full cleaner (no lemmatiser: T13).  ``normalize_quotes_first``
    (off by default, as in the rules) maps curly apostrophes to ASCII first."""
    src = null_to_empty(t)
    if normalize_quotes_first:
        src = normalize_quotes(src)
    base = expand_contractions(src)
    if mode == "token":
        toks = word_tokens(base)
    elif mode == "regex":
        toks = regex_tokens(base)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return _finish(F.array_join(toks, " "), letters_only=True)


def word_count(t) -> Column:
    """Number of whitespace-separated words of the raw text."""
    return F.regexp_count(null_to_empty(t), F.lit(f"{NOT_WS}+")).cast("int")


def char_count(t) -> Column:
    """Characters (code points)."""
    return F.length(null_to_empty(t)).cast("int")


def is_blank(t) -> Column:
    """NULL, empty or whitespace only."""
    return ~null_to_empty(t).rlike(NOT_WS)


def lemma_pos(tag) -> Column:
    """Penn tag -> lemma part of speech (default 'n')."""
    first = F.substring(_c(tag), 1, 1)
    expr = F
    for k, v in POS_MAP.items():
        expr = expr.when(first == k, F.lit(v))
    return expr.otherwise(F.lit("n"))
