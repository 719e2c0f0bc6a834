"""Constants of the rating rules.

Everything in the block marked FIXED VALUES must stay equal to the rules
this engine reproduces: changing one changes every rating.  Everything
after it is ours (patterns of the native tokeniser, the stand-in lexicon).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (rating rules; keep exactly as written)
# ---------------------------------------------------------------------------

# Rating codes, least to most restrictive.
RATINGS = ["M-E", "M-P", "M-T", "M-R", "M-AO"]

# Upper bounds (inclusive) of the max-score ladder: M-E <= 0.05 < M-P <= 0.40
# < M-T <= 0.70 < M-R <= 0.95 < M-AO.
LADDER = [("M-E", 0.05), ("M-P", 0.40), ("M-T", 0.70), ("M-R", 0.95)]

# Adults-only overrides: any score above SINGLE_EXTREME, or at least
# MULTIPLE_HIGH_COUNT scores above MULTIPLE_HIGH.
SINGLE_EXTREME = 0.95
MULTIPLE_HIGH = 0.85
MULTIPLE_HIGH_COUNT = 2

# Descriptor tiers per category, checked top-down with strict ">".
# Language has a mild tier (0.05, 0.40] and no 0.95 tier.
LANGUAGE_TIERS = [(0.70, "Explicit Language"), (0.40, "Strong Language"),
                  (0.05, "Mild Language")]
VIOLENCE_TIERS = [(0.95, "Graphic Violence"), (0.70, "Intense Violence"),
                  (0.40, "Violence")]
SEXUAL_TIERS = [(0.95, "Graphic Sexual Content"), (0.70, "Sexual Content"),
                (0.40, "Suggestive Themes")]
SUBSTANCE_TIERS = [(0.95, "Glorified Drug Use"), (0.70, "Drug Abuse"),
                   (0.40, "Drug Reference")]

# Descriptor list order: language, violence, sexual, substance.
# Highest-concern tie order: violence, sexual, language, substance.
CONCERN_ORDER = ["violence", "sexual", "language", "substance"]

# Empty-descriptor text (batch export) and the display variant.
EMPTY_DESCRIPTOR_TEXT = {"M-E": "Everyone", "M-P": "Parental Guidance Suggested"}
EMPTY_DESCRIPTOR_DISPLAY = {"M-E": "Everyone"}
NO_DESCRIPTOR = "None"
DESCRIPTOR_SEPARATOR = "; "

EXPLANATIONS = {
    "M-E": "Content generally suitable for all ages",
    "M-P": "Some material may not be suitable for children",
    "M-T": "Content generally suitable for ages 13 and up",
    "M-R": "Under 17 requires accompanying parent or adult guardian",
    "M-AO": "Content suitable only for adults ages 18 and up",
}
RECOMMENDATIONS = {
    "M-E": "Safe for family listening",
    "M-P": "Parents should review before allowing young children to listen",
    "M-T": "Appropriate for ages 13+ teenagers",
    "M-R": "Parental discretion strongly advised",
    "M-AO": "Adults only - not suitable for minors",
}
LONG_NAMES = {
    "M-E": "Everyone",
    "M-P": "Parental Guidance Suggested",
    "M-T": "Teen",
    "M-R": "Restricted",
    "M-AO": "Adults Only",
}

# Display recommendation is blanked when it contains either phrase
# (case-insensitive).
HIDDEN_RECOMMENDATION_PHRASES = ["adults only", "not suitable for minors"]

# Model label order of the four probabilities.
LABEL_ORDER = ["sexual", "violence", "substance", "language"]

# Probability -> percentage rescale: below the threshold is 0, above it
# maps linearly to 0..100.
RESCALE_THRESHOLD = 0.5

# Severity index: weights of explicit, violence, sexual_content,
# substance_use (in that order), capped at 100.
SEVERITY_WEIGHTS = [0.25, 0.25, 0.25, 0.25]
SEVERITY_CAP = 100.0

# Safety ladder on percentages (strict ">"); violence has its own limits.
SAFETY_HIGH = 30.0
SAFETY_MEDIUM = 10.0
VIOLENCE_SAFETY_HIGH = 35.0
VIOLENCE_SAFETY_MEDIUM = 15.0
SAFETY_COLORS = {"Explicit": "#E81123", "Moderate": "#FF8C00", "Clean": "#1DB954"}

SCALING_METHOD = "original_default"

# Contractions, expanded in this order, case-insensitive, on word
# boundaries, ASCII apostrophe only.
CONTRACTIONS = [
    ("I'm", "I am"), ("you're", "you are"), ("he's", "he is"), ("she's", "she is"),
    ("it's", "it is"), ("we're", "we are"), ("they're", "they are"),
    ("I've", "I have"), ("you've", "you have"), ("we've", "we have"), ("they've", "they have"),
    ("I'll", "I will"), ("you'll", "you will"), ("he'll", "he will"), ("she'll", "she will"),
    ("we'll", "we will"), ("they'll", "they will"),
    ("I'd", "I would"), ("you'd", "you would"), ("he'd", "he would"), ("she'd", "she would"),
    ("we'd", "we would"), ("they'd", "they would"),
    ("don't", "do not"), ("doesn't", "does not"), ("didn't", "did not"),
    ("won't", "will not"), ("wouldn't", "would not"), ("can't", "can not"),
    ("couldn't", "could not"), ("shouldn't", "should not"), ("mustn't", "must not"),
    ("wasn't", "was not"), ("weren't", "were not"), ("aren't", "are not"), ("isn't", "is not"),
    ("ain't", "am not"), ("let's", "let us"),
]

# Penn Treebank tag initial -> lemma part of speech (default "n").
POS_MAP = {"J": "a", "V": "v", "N": "n", "R": "r"}

# Default score column names of a rating input table.
DEFAULT_SCORE_COLUMNS = {
    "violence": "violence_score",
    "sexual": "sexual_score",
    "language": "language_score",
    "substance": "substance_score",
}

# Export layout: 18 columns in this order.
EXPORT_COLUMNS = [
    "song_index", "song", "text",
    "sexual_score", "violence_score", "substance_score", "language_score",
    "sexual", "violence", "substance", "language",
    "explicit_edit",
    "MCR_rating", "MCR_descriptors", "MCR_max_score",
    "MCR_highest_concern", "MCR_recommendation", "MCR_final_rating",
]

# Tokens read as missing by the CSV reader this engine mirrors.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

# ---------------------------------------------------------------------------
# Our own patterns (Java regex, also valid for RE2 unless noted)
# ---------------------------------------------------------------------------

# The 29 characters Python's str.isspace() accepts: ASCII whitespace,
# \x1c-\x1f, \x85 and the Unicode separators (Zs, Zl, Zp).  Written with
# \p{Z} rather than listing code points above U+00FF, which makes Java's
# negated classes many times slower; the same text is valid RE2.
WS_CHARS = r"\t\n\x0b\x0c\r\x1c-\x1f\x{85}\p{Z}"
WS_CLASS = f"[{WS_CHARS}]"

# A text the numeric coercion accepts (others become NULL).
NUM_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

# Token separators of the native tokeniser.
PUNCT_PATTERN = "[,:;@#$%&?!()\\[\\]{}<>\"“”‘’«»…—]|--+|\\.\\.+"

# Clitic endings left after contraction expansion (mama's -> mama).
CLITIC_ALTERNATION = "s|m|d|re|ve|ll"

# Regex-mode token: ASCII word with Unicode word boundaries (Java only).
REGEX_WORD = r"(?U)\b[a-zA-Z]+\b"
