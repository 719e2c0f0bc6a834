"""Reference SQL (DuckDB dialect) for every registered query.

Written independently of the DataFrame code: plain CTEs over the driver
tables, with the rules' values as literals here and in ``oracle_rules``; nothing
is imported from the code under test.  Column
names equal the Spark query's; floats that went through sums, averages or
exp() are rounded the same way on both sides.
"""

from __future__ import annotations

from ratewise.plans import oracle_rules as S

# Fixed values of the rules, stated again here.
CONTRACTIONS = [
    ("I'm", "I am"), ("you're", "you are"), ("he's", "he is"),
    ("she's", "she is"), ("it's", "it is"), ("we're", "we are"),
    ("they're", "they are"), ("I've", "I have"), ("you've", "you have"),
    ("we've", "we have"), ("they've", "they have"), ("I'll", "I will"),
    ("you'll", "you will"), ("he'll", "he will"), ("she'll", "she will"),
    ("we'll", "we will"), ("they'll", "they will"), ("I'd", "I would"),
    ("you'd", "you would"), ("he'd", "he would"), ("she'd", "she would"),
    ("we'd", "we would"), ("they'd", "they would"), ("don't", "do not"),
    ("doesn't", "does not"), ("didn't", "did not"), ("won't", "will not"),
    ("wouldn't", "would not"), ("can't", "can not"), ("couldn't", "could not"),
    ("shouldn't", "should not"), ("mustn't", "must not"), ("wasn't", "was not"),
    ("weren't", "were not"), ("aren't", "are not"), ("isn't", "is not"),
    ("ain't", "am not"), ("let's", "let us"),
]
CLITIC_ALTERNATION = 's|m|d|re|ve|ll'
PUNCT_PATTERN = '[,:;@#$%&?!()\\[\\]{}<>"“”‘’«»…—]|--+|\\.\\.+'
WS_CLASS = r'[\t\n\x0b\x0c\r\x1c-\x1f\x{85}\p{Z}]'

# The stand-in lexicon: (weight, terms) tiers per label, and the bias.
LABEL_ORDER = ['sexual', 'violence', 'substance', 'language']
BIAS = -3.0
LEXICON = {
    'sexual': [
        (0.75, 'lust kiss bed body strip'),
        (1.5, 'sex sexy naked nude seduce'),
    ],
    'violence': [
        (0.75, 'blood fight die dead war knife punch'),
        (1.5, 'kill killed murder gun guns shoot stab'),
    ],
    'substance': [
        (0.75, 'pills beer wine whiskey vodka drunk high smoke'),
        (1.5, 'cocaine heroin meth weed drug drugs'),
    ],
    'language': [
        (0.75, 'clown pathetic loser stupid disgusting damn hell crap'),
        (1.5, 'trash idiot scum worthless moron'),
    ],
}

# --- derived score tables ---------------------------------------------------

F7 = """
f7 AS (
  SELECT o_orderkey AS song_index,
         x1*x1*x1 AS violence_score, x2*x2*x2 AS sexual_score,
         x3*x3*x3 AS language_score, x4*x4*x4 AS substance_score
  FROM (SELECT o_orderkey,
               ((o_orderkey*7919)%1009)/CAST(1008 AS DOUBLE) AS x1,
               ((o_orderkey*6133)%1013)/CAST(1012 AS DOUBLE) AS x2,
               ((o_orderkey*3571)%1019)/CAST(1018 AS DOUBLE) AS x3,
               ((o_orderkey*2749)%1021)/CAST(1020 AS DOUBLE) AS x4
        FROM orders))"""

F10 = """
f10 AS (
  SELECT o_orderkey AS song_index,
         CAST(x1*1.2 - 0.1 AS VARCHAR) AS violence_score,
         CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE CAST(x2*x2*x2 AS VARCHAR) END AS sexual_score,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'NA'
              ELSE CAST(x3*x3*x3 AS VARCHAR) END AS language_score,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'inf'
              WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN '-INFINITY'
              WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'INF'
              ELSE CAST(x4*x4*x4 AS VARCHAR) END AS substance_score
  FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority,
               ((o_orderkey*7919)%1009)/CAST(1008 AS DOUBLE) AS x1,
               ((o_orderkey*6133)%1013)/CAST(1012 AS DOUBLE) AS x2,
               ((o_orderkey*3571)%1019)/CAST(1018 AS DOUBLE) AS x3,
               ((o_orderkey*2749)%1021)/CAST(1020 AS DOUBLE) AS x4
        FROM orders))"""


def _p(i: int) -> str:
    z = f"(CAST(embedding[{i}] AS DOUBLE) * 8.0)"
    return f"(0.5 + 0.5 * {z} / (1.0 + abs({z})))"


F8 = f"""
f8 AS (
  SELECT vec_id, label, {_p(1)} AS p0, {_p(2)} AS p1, {_p(3)} AS p2, {_p(4)} AS p3
  FROM embeddings)"""


def rated_cte(src: str, name: str = "rated") -> str:
    """Rating columns over a CTE with clean score columns."""
    v, s, l, d = (S.clip01(c) for c in ("violence_score", "sexual_score", "language_score", "substance_score"))
    r = S.rating(v, s, l, d)
    text = S.descriptor_text(v, s, l, d, r)
    return f"""
{name} AS (
  SELECT *, {r} AS MCR_rating,
         {text} AS MCR_descriptors,
         {S.max_score(v, s, l, d)} AS MCR_max_score,
         {S.highest_concern(v, s, l, d)} AS MCR_highest_concern,
         {S.recommendation(r)} AS MCR_recommendation,
         {S.final_rating(v, s, l, d, r, text)} AS MCR_final_rating
  FROM {src})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


RATED_F7 = with_(F7, rated_cte("f7"))

# --- numeric coercion of text scores ----------------------------------------

NUM = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
NA_LIST = "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', " \
          "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"


def coerce(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{NUM}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def clean(x: str) -> str:
    return S.clip01(coerce(x))


SCORE_COLS = ["violence_score", "sexual_score", "language_score", "substance_score"]

# --- text cleaning ------------------------------------------------------------

PUNCT = PUNCT_PATTERN
EDGE = r"[^\p{L}\p{N}]*"
TOKEN = f"^{EDGE}(\\p{{L}}+){EDGE}(?:''(?:{CLITIC_ALTERNATION}))?{EDGE}$"


def expand_sql(x: str) -> str:
    out = x
    for word, repl in CONTRACTIONS:
        pat = "\\b" + word.replace("'", "''") + "\\b"
        out = f"regexp_replace({out}, '{pat}', '{repl}', 'gi')"
    return out


def finish_sql(joined: str) -> str:
    return f"trim(regexp_replace(regexp_replace({joined}, '[^a-zA-Z ]', '', 'g'), ' +', ' ', 'g'))"


def token_list_sql(text: str) -> str:
    t = f"lower({expand_sql(f'coalesce({text}, {chr(39)}{chr(39)})')})"
    spaced = f"regexp_replace({t}, '{PUNCT}', ' ', 'g')"
    toks = f"string_split_regex({spaced}, '{WS_CLASS}')"
    cores = f"list_transform({toks}, lambda w: regexp_extract(w, '{TOKEN}', 1))"
    return f"list_filter({cores}, lambda w: w <> '')"


def clean_token_sql(text: str) -> str:
    return finish_sql(f"array_to_string({token_list_sql(text)}, ' ')")


def clean_regex_sql(text: str) -> str:
    t = expand_sql(f"coalesce({text}, '')")
    words = f"regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+')"
    ascii_words = f"list_filter({words}, lambda w: regexp_full_match(w, '[a-zA-Z]+'))"
    return finish_sql(f"lower(array_to_string({ascii_words}, ' '))")


def word_count_sql(text: str) -> str:
    return f"CAST(len(list_filter(string_split_regex(coalesce({text}, ''), '{WS_CLASS}'), lambda w: w <> '')) AS INTEGER)"


# --- lexicon scorer -------------------------------------------------------------

def logit_sql(tokens: str, label: str) -> str:
    z = f"CAST({BIAS} AS DOUBLE)"
    for w, terms in LEXICON[label]:
        inlist = ", ".join(S.text(t) for t in terms.split())
        z = f"({z} + CAST(len(list_filter({tokens}, lambda t: t IN ({inlist}))) AS DOUBLE) * {w})"
    return z


def probs_sql(cleaned: str) -> list[str]:
    tokens = f"string_split({cleaned}, ' ')"
    return [f"(1.0 / (1.0 + exp(-{logit_sql(tokens, lab)})))" for lab in LABEL_ORDER]


def rescale_sql(p: str) -> str:
    raw = f"(CASE WHEN {p} < 0.5 THEN 0.0 ELSE ({p} - 0.5) / (1.0 - 0.5) * 100.0 END)"
    return f"greatest(0.0, least(100.0, {raw}))"
