r"""A lemmatiser learned from the corpus.

No word list is given: inflection is read off the words themselves, by suffix
paradigms (signatures) and their description length.

1. **Splits.**  Every word type of ``least_stem + 1`` letters and more is cut
   into stem and ending of up to four letters; the ``ENDINGS`` most productive
   endings (types they end x their length) are candidates.
2. **Paradigms.**  A stem's paradigm is the set of endings it occurs with, the
   empty one included.  Writing ``T`` stems and ``E`` endings instead of
   ``T x E`` words saves ``(E - 1) * letters of stems + (T - 1) * letters of
   endings - POINTER * (T + E)`` letters; paradigms of fewer than ``least``
   stems or without a saving go.  A word takes the split whose paradigm saves
   most.  Its lemma is the stem with the paradigm's shortest ending.
3. **Rules.**  The pairs (word, lemma) are compressed to a trie over word ends:
   each node holds the commonest change (letters cut, letters added) among the
   words that end so, nodes that agree with their parent go.  The rules give a
   lemma to words never seen; the words that the rules get wrong are kept as
   exceptions, and a given table of exceptions comes before both.

All steps are aggregates over word types.  The rules number at most
``MAX_RULES``; exceptions are a table that joins like any lemma table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions import text as X
from ratewise.session import write_table

LEAST_STEM, LONGEST_ENDING = 3, 4
ENDINGS, LEAST, POINTER = 64, 5, 3
#: Letters of a word's end that rules look at, and rules kept.
DEPTH, MAX_RULES = 5, 2000


class Lemmatiser(NamedTuple):
    rules: DataFrame       # suffix, cut, add
    exceptions: DataFrame  # token, lemma


def word_types(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, n): lower-case words of letters, counted over all documents."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.explode(F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def _splits(types: DataFrame) -> DataFrame:
    """(w, stem, ending) with endings of 0 to 4 letters."""
    longest = F.least(F.lit(LONGEST_ENDING), F.length("w") - LEAST_STEM)
    return (types.filter(F.length("w") >= LEAST_STEM).select("w", F.explode(F.sequence(F.lit(0), longest)).alias("k"))
            .select("w", F.expr("left(w, length(w) - k)").alias("stem"), F.expr("right(w, k)").alias("ending")))


def paradigms(types: DataFrame, least: int = LEAST) -> DataFrame:
    """(w, stem, ending, paradigm, stems, saved, base): the best split of every
    word that has one."""
    splits = write_table(_splits(types), "splits")
    productive = (splits.filter("ending <> ''").groupBy("ending").agg(F.count(F.lit(1)).alias("n"))
                  .orderBy(F.desc(F.col("n") * F.length("ending")), "ending").limit(ENDINGS).select("ending"))
    productive = productive.unionByName(productive.sparkSession.createDataFrame([("",)], "ending string"))
    # a stem has at most ENDINGS + 1 endings
    held = splits.join(F.broadcast(productive), "ending")
    sets = (held.groupBy("stem").agg(F.array_sort(F.collect_set("ending")).alias("endings")).filter(F.size("endings") > 1)
            .select("stem", "endings", F.array_join("endings", "|").alias("paradigm")))
    sets = write_table(sets, "stems")
    size = F.size(F.first("endings"))
    ends = F.length(F.array_join(F.first("endings"), ""))
    found = sets.groupBy("paradigm").agg(
        F.count(F.lit(1)).alias("stems"), F.element_at(F.array_sort(F.first("endings"), _shorter), 1).alias("base"),
        ((size - 1) * F.sum(F.length("stem")) + (F.count(F.lit(1)) - 1) * ends - POINTER * (F.count(F.lit(1)) + size)).alias("saved"))
    found = found.filter((F.col("stems") >= least) & (F.col("saved") > 0))
    ways = held.join(sets.select("stem", "paradigm"), "stem").join(found, "paradigm")
    best = ways.groupBy("w").agg(F.max(F.struct("saved", F.length("stem").alias("size"), "stem", "ending", "paradigm", "stems", "base")).alias("b"))
    return best.select("w", "b.stem", "b.ending", "b.paradigm", "b.stems", "b.saved", "b.base")


def _shorter(a: Column, b: Column) -> Column:
    return F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)


def _suffixes(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.least(F.lit(DEPTH), F.length(word) - 1)), lambda k: F.right(word, k))


def pairs(types: DataFrame, least: int = LEAST) -> DataFrame:
    """(w, n, lemma, cut, add) of every word type; a word without a paradigm is
    its own lemma."""
    found = paradigms(types, least)
    whole = types.join(found.select("w", "stem", "ending", "base"), "w", "left")
    return whole.select("w", "n", F.coalesce(F.concat("stem", "base"), "w").alias("lemma"),
                        F.coalesce(F.when(F.col("ending") != F.col("base"), F.length("ending")), F.lit(0)).alias("cut"),
                        F.coalesce(F.when(F.col("ending") != F.col("base"), F.col("base")), F.lit("")).alias("add"))


def rule_trie(known: DataFrame, least: int = LEAST) -> DataFrame:
    """(suffix, cut, add, n): the trie's nodes that differ from their parents."""
    ends = known.filter(F.length("w") > 1).select(F.explode(_suffixes(F.col("w"))).alias("suffix"), "cut", "add")
    votes = ends.groupBy("suffix", "cut", "add").agg(F.count(F.lit(1)).alias("n"))
    nodes = (votes.groupBy("suffix").agg(F.max(F.struct("n", (-F.col("cut")).alias("less"), "add")).alias("b"), F.sum("n").alias("n"))
             .filter(F.col("n") >= least).select("suffix", (-F.col("b.less")).alias("cut"), "b.add", "n"))
    parent = nodes.select(F.col("suffix").alias("up"), F.col("cut").alias("up_cut"), F.col("add").alias("up_add"))
    joined = nodes.join(parent, F.expr("right(suffix, length(suffix) - 1)") == F.col("up"), "left")
    same = (F.col("cut") == F.coalesce("up_cut", F.lit(0))) & (F.col("add") == F.coalesce("up_add", F.lit("")))
    return joined.filter(~same).select("suffix", "cut", "add", "n").orderBy(F.desc("n"), "suffix").limit(MAX_RULES)


def apply_rules(df: DataFrame, rules: DataFrame, word: str, out: str) -> DataFrame:
    """Add the lemma that the longest matching rule gives: one lookup for each
    length of ending, in broadcast tables of at most ``MAX_RULES`` rows together."""
    held = df
    for k in range(1, DEPTH + 1):
        of_length = rules.filter(F.length("suffix") == k).select(F.col("suffix").alias(f"__s{k}"), F.struct("cut", "add").alias(f"__r{k}"))
        held = held.join(F.broadcast(of_length), F.when(F.length(word) > k, F.right(F.col(word), F.lit(k))) == F.col(f"__s{k}"), "left").drop(f"__s{k}")
    found = [f"__r{k}" for k in range(DEPTH, 0, -1)]
    held = held.withColumn("__hit", F.coalesce(*found)).drop(*found)
    cut = F.coalesce("__hit.cut", F.lit(0))
    lemma = F.concat(F.left(F.col(word), F.length(word) - cut), F.coalesce("__hit.add", F.lit("")))
    return held.withColumn(out, F.when(F.length(word) - cut >= LEAST_STEM, lemma).otherwise(F.col(word))).drop("__hit")


def learn(docs: DataFrame, text_col: str = "text", least: int = LEAST, given: DataFrame | None = None) -> Lemmatiser:
    """Rules and exceptions from the words of all documents; ``given`` is an
    optional table (token, lemma) that overrides what was learned."""
    known = write_table(pairs(write_table(word_types(docs, text_col), "word-types"), least), "word-lemmas")
    rules = write_table(rule_trie(known, least), "lemma-rules")
    wrong = apply_rules(known, rules, "w", "__by_rule").filter(F.col("__by_rule") != F.col("lemma")).select(F.col("w").alias("token"), "lemma")
    if given is not None:
        wrong = wrong.join(given.select("token"), "token", "left_anti").unionByName(given.select("token", "lemma"))
    return Lemmatiser(rules, write_table(wrong, "lemma-exceptions"))


def lemmas(words: DataFrame, model: Lemmatiser, word: str = "w", out: str = "lemma") -> DataFrame:
    """Add the lemma of a word column: exceptions first, then rules."""
    known = model.exceptions.select(F.col("token").alias(word), F.col("lemma").alias("__own"))
    by_rule = apply_rules(words, model.rules, word, out).join(known, word, "left")
    return by_rule.withColumn(out, F.coalesce("__own", out)).drop("__own")


def lemmatised_text(docs: DataFrame, model: Lemmatiser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """T18 with learned lemmas: (id, cleaned).  Each row's distinct tokens meet
    the lemma tables once; a row is put together within its own group."""
    rows = docs.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"),
                       X.word_tokens(X.expand_contractions(X.null_to_empty(text_col))).alias("__t"))
    rows = write_table(rows, "tokens")
    distinct = rows.select("__row", F.explode(F.array_distinct("__t")).alias("w"))
    found = lemmas(distinct, model).filter("lemma <> w").groupBy("__row").agg(
        F.map_from_entries(F.collect_list(F.struct("w", "lemma"))).alias("__m"))
    joined = rows.join(found, "__row", "left")
    words = F.transform("__t", lambda t: F.coalesce(F.try_element_at(F.col("__m"), t), t))
    return joined.select(F.col("__id").alias(id_col), X._finish(F.array_join(words, " ")).alias("cleaned"))
