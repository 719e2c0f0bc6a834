"""Operator 9: quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document.  The ledger row holds the
measurements and one ``failures`` long with a bit per failed rule.  A policy
is a named, versioned set of rules, that is a mask; applying one is a single
bitwise test, and the effect of dropping or adding a rule (ablation) is read
off the counts per distinct mask without touching the texts again.

Cases: a null or empty text has no words and fails ``few_words`` only.  A null
id, repeated rows and any other columns do not matter: the ledger is computed
row by row, and keeps no input column but the id.  An empty table gives an
empty ledger.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, once, pack, unpack

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rule -> predicate over the measurements.  The position is the rule's bit;
#: append new rules, never reorder.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * word_chars"),
    ("repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 7 * n_lines"),
    ("long_words", "n_words >= 50 and word_chars > 40 * n_words"),
    ("short_words", "n_words >= 50 and 2 * word_chars < 3 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_phrases"),
    "web-1": ("few_words", "repeated_phrases", "symbols", "repeated_lines", "long_words", "short_words"),
}


def mask(rules: Sequence[str]) -> int:
    return sum(BITS[r] for r in rules)


def repeated_words(words: Column, n: Column, df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside a 3-word window that occurs twice
    or more in the row.

    Window hashes are sorted as plain longs with the window's position in the
    low bits, so equal windows are neighbours; the full 64-bit hashes of
    neighbours are compared before a window counts as repeated.
    """
    # bits needed for a position in this row; the hash keeps the others
    bits = F.length(F.bin(n.cast("long")))
    df = df.withColumn("__w", words).withColumn("__n", n)
    df = df.withColumn("__t", F.expr(
        "case when __n < 3 then cast(array() as array<bigint>) else "
        "transform(sequence(0, __n - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) end"))
    df = df.withColumn("__bits", bits).withColumn("__low", F.expr("shiftleft(1L, __bits) - 1"))
    df = df.withColumn("__s", F.expr("sort_array(transform(__t, (h, i) -> shiftleft(h, __bits) | i))"))
    df = df.withColumn("__p", F.expr(
        "sort_array(transform(filter(__s, (x, j) -> "
        "(j > 0 and shiftright(x, __bits) = shiftright(__s[j - 1], __bits)"
        "  and __t[int(x & __low)] = __t[int(__s[j - 1] & __low)])"
        " or (j + 1 < size(__s) and shiftright(x, __bits) = shiftright(__s[j + 1], __bits)"
        "  and __t[int(x & __low)] = __t[int(__s[j + 1] & __low)])), x -> x & __low))"))
    # each window adds the words up to the next one, at most three
    return df.withColumn("n_repeat_words", F.expr(
        "aggregate(transform(__p, (p, j) -> case when j + 1 < size(__p) then least(3L, __p[j + 1] - p) else 3L end),"
        " 0L, (a, x) -> a + x)")).drop("__w", "__n", "__t", "__bits", "__low", "__s", "__p")


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and every measurement the rules use.
    Map-only: no shuffle, no Python."""
    df = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    df = df.withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD_PATTERN), F.lit(0)))
    df = df.withColumn("__lines", F.expr(r"filter(split(__text, '\n', -1), x -> length(translate(x, ' \t\u000b\f\r', '')) > 0)"
                                         .replace(r"\u000b", "\x0b").replace(r"\f", "\x0c")))
    df = df.select(
        "__id", "__words",
        F.size("__words").alias("__count"),
        F.length(F.translate("__text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    df = repeated_words(F.col("__words"), F.col("__count"), df)
    return df.select(F.col("__id").alias(id_col), F.col("__count").cast("long").alias("n_words"),
                     "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus ``failures``, the bit set of failed rules, evaluated
    once: a filter on it is not pushed into the measurements."""
    bits = [F.when(F.expr(test), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long") for name, test in RULES]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measurements(docs, id_col, text_col).withColumn("failures", once(failures))


def rejected(failures: Column, policy: str) -> Column:
    return failures.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) != 0


def apply_policy(ledger_df: DataFrame, policy: str) -> DataFrame:
    """Add ``policy`` and ``kept`` by one bitwise test per row."""
    return ledger_df.withColumn("policy", F.lit(policy)).withColumn("kept", ~rejected(F.col("failures"), policy))


def ablations(ledger_df: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents failing it, documents only it
    rejects (they would stay without it), and documents the policy rejects.

    One bitwise aggregation to at most 2**rules distinct masks (partial before
    the exchange), then a few rows.
    """
    rules = POLICIES[policy]
    whole = mask(rules)
    counts = ledger_df.groupBy(F.col("failures").bitwiseAND(F.lit(whole).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit(r).alias("rule"),
                     F.sum(F.when(F.col("m").bitwiseAND(F.lit(BITS[r]).cast("long")) != 0, F.col("n"))).alias("failed"),
                     F.sum(F.when(F.col("m") == BITS[r], F.col("n"))).alias("only_this"),
                     F.sum(F.when(F.col("m") != 0, F.col("n"))).alias("rejected")) for r in rules]
    out = counts.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r"))
    return out.select(F.lit(policy).alias("policy"), "r.rule",
                      *[F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in ("failed", "only_this", "rejected")])


def quality_rows(docs: DataFrame, policy: str = "web-1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, then ``failures`` and ``policy``."""
    df = ledger(docs, id_col, text_col)
    base = rejected(F.col("failures"), "base-1")
    return apply_policy(df, policy).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failures", "policy")


def keep_good(docs: DataFrame, policy: str = "web-1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns.

    The row travels as one struct, so no column of the input can clash with
    the measurements; the step stays map-only.
    """
    return unpack(quality_rows(pack(docs, text_col), policy, "__row", "__text0").filter("kept"))
