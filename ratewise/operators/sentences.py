r"""Sentence boundaries learned from the texts themselves.

Abbreviations and frequent sentence starters are found without labels, by the
log-likelihood statistics of Kiss and Strunk ("Unsupervised Multilingual
Sentence Boundary Detection", 2006), as aggregates over all documents:

1. A word type that nearly always ends in a period, is short, and holds inner
   periods is an abbreviation.
2. A type that follows sentence ends far more often than chance is a sentence
   starter.  Only distinct (ending word, next word) pairs meet the first table.

A sentence ends at a line end, at ``!`` or ``?``, and at a period, except after
an abbreviation whose next word is not a capitalised starter.  Texts are read
twice.  The statistics count words (and, behind a possible end, pairs of words)
as they stand, in Arrow within each task, and look at each different one once.  The sentences need the
places where one may end, found in numpy over whole batches in linear time; only
the periods among them meet the abbreviations, and no text is shuffled.

Tokens are runs of characters other than space and ``\t``..``\r``; a null text
has no sentence.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.session import write_table

#: Scores from which a type is an abbreviation, and a starter.
ABBREVIATION, STARTER = 0.3, 30.0
#: Share of periods behind an abbreviation, by hypothesis.
ALWAYS = 0.99

#: Characters of text that a batch of possible ends is worked out for at once.
SLICE = 200_000
#: Bytes of text whose tokens are counted at once, and counts that a task holds.
COUNTED, HELD = 4_000_000, 500_000


class Statistics(NamedTuple):
    types: DataFrame     # type, c_period, c_plain, score, is_abbreviation
    starters: DataFrame  # type, c_after, c_total, g2


def _core(token: Column) -> Column:
    return F.rtrim(F.ltrim(token, F.lit("\"'([")), F.lit("\"')]"))


def _type(core: Column) -> Column:
    """The word as counted: lower-case, without its period; null if it is no
    word of letters and inner periods."""
    word = F.when(core.endswith("."), F.left(core, F.length(core) - 1)).otherwise(core)
    return F.when(core.rlike(r"^\p{L}[\p{L}.]*+\z"), _lower(word))


def _lower(word: Column) -> Column:
    """With a-z for A-Z; of an ASCII word these are all capitals."""
    ascii_only = F.octet_length(word) == F.length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _counted_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, next, n): how often each token occurs; a token that ends in a
    period, ``!`` or ``?`` (closing quotes and brackets aside) together with the
    one behind it in its line, if there is one.  Counted in every task before
    anything moves, over slices of ``COUNTED`` bytes and ``HELD`` rows."""
    size, room = COUNTED, HELD

    def count(texts: pa.Array) -> pa.Table:
        lines = pc.split_pattern(texts, "\n").flatten()
        split = pc.ascii_split_whitespace(lines)
        coded = split.flatten().dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy()
        line = np.repeat(np.arange(len(lines)), pc.list_value_length(split).to_numpy())
        some = (pc.binary_length(names).to_numpy() > 0)[code]  # white space at a line's ends leaves empty strings
        code, line = code[some].astype(np.int64), line[some]
        ends = pc.match_substring_regex(names, r"""[.!?]["')\]]*$""").to_numpy(zero_copy_only=False)
        paired = np.r_[ends[code[:-1]] & (line[1:] == line[:-1]), np.zeros(min(1, len(code)), bool)]
        alone = np.bincount(code[~paired], minlength=len(names))
        first = np.flatnonzero(paired)
        pairs, n = np.unique(code[first] * len(names) + code[first + 1], return_counts=True)
        single = np.flatnonzero(alone)
        token, after = names.take(pa.array(np.r_[single, pairs // max(1, len(names))])), names.take(pa.array(pairs % max(1, len(names))))
        return pa.table({"token": token, "next": pa.concat_arrays([pa.nulls(len(single), token.type), after]), "n": pa.array(np.r_[alone[single], n])})

    def merged(held: list[pa.Table]) -> pa.Table:
        # of one slice each row is there once already
        return held[0] if len(held) == 1 else pa.concat_tables(held).group_by(["token", "next"], use_threads=False).aggregate([("n", "sum")]).select(
            ["token", "next", "n_sum"]).rename_columns(["token", "next", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            texts = batch.column(0).drop_null()
            group = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // size
            cut = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(texts)]
            for a, b in zip(cut, cut[1:]):
                held.append(count(texts.slice(a, b - a)))
                if sum(t.num_rows for t in held) > room:
                    held = [merged(held)]
                    if held[0].num_rows > room // 2:  # else there is room for more of them
                        yield from held.pop().to_batches(max_chunksize=100_000)
        if held:
            yield from merged(held).to_batches(max_chunksize=100_000)

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "token string, next string, n long")
    return counted.groupBy("token", "next").agg(F.sum("n").alias("n"))


def _log_l(p: Column, k: Column, n: Column) -> Column:
    """Binomial log-likelihood; 0 * log 0 is 0."""
    part = lambda count, share: F.when(count > 0, count * F.log(share)).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def statistics(docs: DataFrame, text_col: str = "text") -> Statistics:
    """Both tables, from one scan of the texts."""
    tokens = _counted_tokens(docs, text_col).select(_core(F.col("token")).alias("core"), _core(F.col("next")).alias("next"), "n")
    tokens = tokens.select(_type(F.col("core")).alias("type"), F.col("core").endswith(".").alias("period"),
                           F.col("next").isNotNull().alias("followed"), _type(F.col("next")).alias("next"), "n")
    tokens = write_table(tokens, "token-counts")
    period, plain = (F.sum(F.when(which, F.col("n")).otherwise(0)) for which in (F.col("period"), ~F.col("period")))
    counted = write_table(tokens.groupBy("type").agg(period.alias("c_period"), plain.alias("c_plain")), "token-types")
    whole = counted.agg(F.sum(F.col("c_period") + F.col("c_plain")).alias("all"), F.sum("c_period").alias("ends"))
    types = counted.filter("type is not null").join(F.broadcast(whole))  # one row
    share = F.col("ends") / F.col("all")
    likely = 2.0 * (F.col("c_period") * F.log(F.lit(ALWAYS)) + F.col("c_plain") * F.log(F.lit(1 - ALWAYS)) - _log_l(share, F.col("c_period"), F.col("c_period") + F.col("c_plain")))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inner).cast("double")
    score = likely * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("c_plain"))
    types = types.filter("c_period > 0").withColumn("score", score).withColumn("is_abbreviation", F.col("score") >= ABBREVIATION)
    types = write_table(types.select("type", "c_period", "c_plain", "score", "is_abbreviation"), "period-types")
    # sure ends, and the words behind them
    abbreviations = write_table(types.filter("is_abbreviation").select("type"), "abbreviations")
    pairs = tokens.filter("followed").select(F.when(F.col("period"), F.col("type")).alias("type"), "next", "n")
    sure = write_table(pairs.join(abbreviations, "type", "left_anti").groupBy("next").agg(F.sum("n").alias("c_after")), "sure-ends")
    totals = counted.filter("type is not null").select("type", (F.col("c_period") + F.col("c_plain")).alias("c_total"))
    all_ends = sure.agg(F.sum("c_after").alias("n_ends")).join(F.broadcast(whole.select("all")))
    starters = (sure.filter("next is not null").withColumnRenamed("next", "type").join(totals, "type").join(F.broadcast(all_ends)))
    k, n1, w, n = F.col("c_after"), F.col("n_ends"), F.col("c_total"), F.col("all")
    p, p1, p2 = w / n, k / n1, F.when(n > n1, (w - k) / (n - n1)).otherwise(0.0)
    g2 = 2.0 * (_log_l(p1, k, n1) + _log_l(p2, w - k, n - n1) - _log_l(p, k, n1) - _log_l(p, w - k, n - n1))
    starters = starters.filter(p1 > p).withColumn("g2", g2).filter(F.col("g2") >= STARTER).select("type", "c_after", "c_total", "g2")
    return Statistics(types, write_table(starters, "starters"))


def possible_ends(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, starts, ends, at, token, next): every row's text cut wherever a
    sentence may end, as code points (end exclusive, without the white space
    behind); ``at`` are the cuts that a period makes, with the token there and
    the one behind it.  Rows without a token are left out."""
    limit = SLICE

    def cut(texts: list[str]) -> list[pa.Array]:
        text = "\n".join(texts) + "\n"
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(size + 1) - size - 1
        inside = ~((c == 32) | ((c >= 9) & (c <= 13)))
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
        start, end = edge[::2], edge[1::2]
        row = np.searchsorted(base, start, side="right") - 1
        last = np.r_[row[1:] != row[:-1], np.ones(min(1, len(row)), bool)]
        lines = np.flatnonzero(c == 10)
        line = np.r_[np.searchsorted(lines, start[1:]) > np.searchsorted(lines, end[:-1]), np.ones(min(1, len(row)), bool)]
        # the token's last character without closing quotes and brackets
        closes = (c == 34) | (c == 39) | (c == 41) | (c == 93)
        kept = np.maximum.accumulate(np.where(closes, np.int32(-1), np.arange(len(c), dtype=np.int32)))[end - 1]
        char = np.where(kept >= start, c[kept], 0)
        period = char == 46
        stops = np.flatnonzero(period | (char == 33) | (char == 63) | line | last)
        soft = np.flatnonzero((period & ~line & ~last)[stops])
        first = np.r_[np.zeros(min(1, len(stops)), np.int64), stops[:-1] + 1]
        n = np.bincount(row[stops], minlength=len(texts))
        offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        cuts = [pa.ListArray.from_arrays(offsets, pa.array(x - base[row[stops]])) for x in (start[first], end[stops])]
        mine = row[stops[soft]]
        place = soft - (np.cumsum(n) - n)[mine]
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(mine, minlength=len(texts)))].astype(np.int32))
        token, after = ([text[a:b] for a, b in zip(start[t].tolist(), end[t].tolist())] for t in (stops[soft], stops[soft] + 1))
        return cuts + [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(place.astype(np.int32)), pa.array(token, pa.string()), pa.array(after, pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            group = np.cumsum([len(t) for t in texts]) // limit
            for a, b in zip(np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if texts else [],
                            [*(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(texts)]):
                part = batch.slice(a, b - a).drop_columns(["__text"])
                yield pa.RecordBatch.from_arrays([*part.columns, *cut(texts[a:b])], names=names)

    names = [*keys, "starts", "ends", "at", "token", "next"]
    rows = docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(run, f"{kinds}, starts array<long>, ends array<long>, at array<int>, token array<string>, next array<string>")
    return out.filter(F.size("ends") > 0)


def _not_ends(cuts: DataFrame, stats: Statistics, keys: list[str]) -> DataFrame:
    """(keys, places): the cuts behind abbreviations."""
    held = cuts.select(*keys, F.explode(F.arrays_zip("at", "token", "next")).alias("p")).select(
        *keys, "p.at", _type(_core(F.col("p.token"))).alias("type"), _core(F.col("p.next")).alias("next"))
    held = held.select(*keys, "at", "type", _type(F.col("next")).alias("next_type"), F.col("next").rlike(r"^\p{Lu}").alias("upper"))
    held = held.join(stats.types.filter("is_abbreviation").select("type"), "type", "left_semi")
    starts = stats.starters.select(F.col("type").alias("next_type"), F.lit(True).alias("starts"))
    held = held.join(starts, "next_type", "left").filter(~(F.col("upper") & F.coalesce("starts", F.lit(False))))
    return held.groupBy(*keys).agg(F.collect_set("at").alias("places"))


def inner_periods(docs: DataFrame, stats: Statistics, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, places): the possible ends of a row that are a period but end no
    sentence.  Only periods leave their row."""
    return _not_ends(possible_ends(docs, keys, text_col), stats, keys)


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stats: Statistics | None = None) -> DataFrame:
    """(id, n, start, end): the sentences of every row in order, as code points
    of the text (end exclusive, without the white space behind)."""
    stats = stats or statistics(docs, text_col)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    cuts = write_table(possible_ends(rows, ["__id", "__row"], "__text"), "sentence-ends")
    held = cuts.select("__id", "__row", "starts", "ends").join(_not_ends(cuts, stats, ["__row"]), "__row", "left")
    whole = F.sequence(F.lit(0), F.size("ends") - 1)
    held = held.withColumn("__k", F.when(F.col("places").isNull(), whole).otherwise(F.array_except(whole, "places")))

    def span(k: Column, n: Column) -> Column:
        begin = F.when(n == 0, F.lit(0)).otherwise(F.get(F.col("__k"), n - 1) + 1)
        return F.struct(n.alias("n"), F.get(F.col("starts"), begin).alias("start"), F.get(F.col("ends"), k).alias("end"))

    return held.select(F.col("__id").alias(id_col), F.explode(F.transform("__k", span)).alias("s")).select(id_col, "s.n", "s.start", "s.end")
