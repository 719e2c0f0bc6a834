r"""Operator 12: phrase collocation mining over sorted count streams.

A text (A-Z lower-cased) is cut into pieces at ``[.,;:!?\x0A-\x0D]`` and those
into words ``[^\x20\x09]+``.  Everything is counted per language.

Counting.  Three passes over the texts give all phrases of 1 to 5 words that
occur ``least`` times or more: words; word pairs; longer phrases.  A phrase
reaches the threshold only if all shorter ones inside it do, so a pass emits
only phrases whose words (pairs) pass a bit table of the last pass's survivors.
The table has a fixed size whatever the input; a false positive costs a row,
never a result.  Every slice of texts is counted before it leaves the task, the
task's rows are merged before the exchange, and the exchange is keyed by whole
phrases, so no word or pair is hot.  Phrases are grouped by a 128-bit hash
inside a slice and by their text after it.

Estimation.  The counts are laid out as two streams, sorted in prefix order (by
first, second, ... word) and in suffix order (by last, last but one, ... word).
In prefix order a phrase comes right behind its own beginnings, so one lockstep
scan hands every phrase the counts of its first 1 to 4 words, and its largest
extension to the right; in suffix order, the same for its endings and
extensions to the left.  The streams are range partitioned and sorted, no hash
table of phrases is built.  A longer phrase that contains another never occurs
more often than some one-word extension of it, so these decide what is dropped.

Cases: null and empty texts have no words; a null language is ``und``; repeated
rows count as often as they occur; equal scores are ordered by count, then by
the phrase's bytes; an empty table, or no phrase that often, gives an empty
result; a text of any length is read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, slices
from .textkit import Prefix, flat, lower_ascii, mix

LONGEST = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"
#: Bits of the table of survivors that every task holds (8 MB).
TABLE_BITS = 26
#: Bytes of text counted at once.
COUNTED = 1_500_000

_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
_U = np.uint64


class Words(NamedTuple):
    data: np.ndarray    # bytes of the slice, one space, and what goes before a phrase
    starts: np.ndarray
    ends: np.ndarray
    joined: np.ndarray  # word i and i + 1 stand in one piece
    text: np.ndarray    # text of each word
    keys: np.ndarray    # two hashes of each word
    lead: np.ndarray    # (start, size) in data of each text's language and a line feed


def words(column: pa.Array, languages: list[str] | None = None) -> Words:
    data, offsets = flat(column)
    data = lower_ascii(data).astype(np.uint8, copy=False)
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    breaks = np.r_[0, np.cumsum(kind == 2)]
    text = np.searchsorted(offsets, starts, side="right") - 1
    joined = (breaks[ends[:-1]] == breaks[starts[1:]]) & (text[:-1] == text[1:]) if len(starts) else np.zeros(0, bool)
    one, two = Prefix(data).ranges(starts, ends), Prefix(data ^ np.uint8(0xA5)).ranges(starts, ends)
    place, held, at = {}, [], len(data) + 1
    for x in dict.fromkeys(languages or []):
        held.append(np.frombuffer((x + "\n").encode(), np.uint8))
        place[x] = (at, len(held[-1]))
        at += len(held[-1])
    lead = np.array([place[x] for x in languages or []], np.int64).reshape(-1, 2)
    return Words(np.concatenate([data, np.full(1, 32, np.uint8), *held]), starts, ends, joined, text, np.stack([one, two]), lead)


def phrase_keys(w: Words, at: np.ndarray, n: int, lang: np.ndarray) -> np.ndarray:
    """Two hashes of the language and the ``n`` words from each ``at`` on."""
    out = mix(lang[w.text[at]] + w.keys[:, at])
    for j in range(1, n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + w.keys[:, at + j])
    return out


def language_keys(languages: list[str]) -> np.ndarray:
    data, offsets = flat(pa.array(languages, pa.string()))
    return Prefix(data).ranges(offsets[:-1], offsets[1:]) if len(languages) else np.zeros(0, _U)


def phrase_texts(w: Words, at: np.ndarray, n: int) -> pa.Array:
    """The phrases as strings: the language and a line feed (which no word
    holds), then the words joined by one space."""
    first = np.empty((len(at), 2 * n), np.int64)
    size = np.ones_like(first)
    first[:, 0], size[:, 0] = w.lead[w.text[at]].T
    first[:, 2::2] = w.lead[:, 0].min(initial=len(w.data)) - 1  # the space
    index = at[:, None] + np.arange(n)
    first[:, 1::2] = w.starts[index]
    size[:, 1::2] = w.ends[index] - w.starts[index]
    first, size = first.reshape(-1), size.reshape(-1)
    end = np.cumsum(size)
    data = w.data[np.arange(end[-1] if len(end) else 0) + np.repeat(first - end + size, size)]
    offsets = np.r_[0, end[2 * n - 1::2 * n]].astype(np.int64)
    return pa.Array.from_buffers(pa.large_utf8(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())


def counted(w: Words, at: np.ndarray, n: int, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one occurrence, count) of each distinct phrase of ``n`` words
    that begins at the places ``at``, phrases of one first word together (rows
    with a common beginning take less room in the exchange)."""
    key, second = phrase_keys(w, at, n, lang)
    half = _U(32)
    key = (w.keys[0, at] >> half << half) | (key >> half)
    order = np.argsort(key, kind="stable")
    key, second = key[order], second[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    if (second[1:] != second[:-1])[~new[1:]].any():  # equal first hashes of different phrases
        sub = np.lexsort((second, key))
        order, key, second = order[sub], key[sub], second[sub]
        new[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
    begin = np.flatnonzero(new)
    return at[order[begin]], np.diff(np.r_[begin, len(at)])


def _listed(bits: np.ndarray | None, key: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(key), bool)
    at = key >> _U(64 - TABLE_BITS)
    return (bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) != 0


def places(w: Words, lang: np.ndarray, sizes: tuple[int, ...], bits: np.ndarray | None) -> dict[int, np.ndarray]:
    """Where the phrases of each size begin whose words (pairs, for three words
    and more) are all listed."""
    out = {}
    count = len(w.starts)
    unit = 1 if sizes[0] <= 2 else 2
    ok = np.ones(count, bool)
    if unit == 2:
        ok = np.r_[w.joined, np.zeros(min(count, 1), bool)]
    at = np.flatnonzero(ok)
    ok[at] = _listed(bits, phrase_keys(w, at, unit, lang)[0])
    for n in sizes:
        good = ok.copy()
        for j in range(1, n - unit + 1):
            good[:max(count - j, 0)] &= ok[j:]
            good[max(count - j, 0):] = False
        for j in range(n - 1):
            good[:max(count - 1 - j, 0)] &= w.joined[j:]
            good[max(count - 1 - j, 0):] = False
        out[n] = np.flatnonzero(good)
    return out


def phrase_counts(docs: DataFrame, sizes: tuple[int, ...], table: np.ndarray | None) -> DataFrame:
    """(lang, phrase, f): exact counts of the phrases of ``sizes`` words that
    pass the table, over all of ``docs`` (lang, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", COUNTED):
                langs = part.column("lang").to_pylist()
                w, lang = words(part.column("text"), langs), language_keys(langs)
                for n, at in places(w, lang, sizes, shared.value).items():
                    at, f = counted(w, at, n, lang)
                    yield pa.RecordBatch.from_arrays([phrase_texts(w, at, n), pa.array(f)], names=["key", "f"])

    counts = docs.mapInArrow(run, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\n", -1)
    return counts.select(F.left("key", F.length("key") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), "f")


def survivors(counts: DataFrame, n: int) -> np.ndarray:
    """Bit table of the phrases of ``n`` words: at most 2**TABLE_BITS bits
    reach the driver, whatever the number of phrases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch.column("phrase"))
            at = np.arange(0, len(w.starts), n)
            key = phrase_keys(w, at, n, language_keys(batch.column("lang").to_pylist()))[0] >> _U(64 - TABLE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((key >> _U(6)).astype(np.int64)), pa.array((_U(1) << (key & _U(63))).view(np.int64))], names=["at", "bits"])

    bits = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    for batch in counts.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        bits[batch.column("at").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return bits


def count_streams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to 5 words with f >= ``least``,
    and (lang, n) with the number of words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text")).filter("text is not null")
    # the rarer words of a language are written as one row, for its total
    single = (phrase_counts(texts, (1,), None).groupBy("lang", F.when(F.col("f") >= least, F.col("phrase")).alias("phrase"))
              .agg(F.sum("f").alias("f")))
    single = scratch(single, "words")
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    often = single.filter("phrase is not null")
    pairs = scratch(phrase_counts(texts, (2,), survivors(often, 1)).filter(F.col("f") >= least), "pairs")
    longer = scratch(phrase_counts(texts, tuple(range(3, LONGEST + 1)), survivors(pairs, 2)).filter(F.col("f") >= least), "longer")
    return often.unionByName(pairs).unionByName(longer), totals


def _scan(stream: DataFrame, order: list[str], parts: list[str], extension: str) -> DataFrame:
    """One scan of the counts sorted by ``order``: ``parts[k - 1]`` becomes the
    count of the phrase's first k words in that order, ``extension`` the
    largest count of a phrase with one more word behind."""
    held = stream.repartitionByRange("lang", order[0])
    spec = Window.partitionBy("lang", order[0]).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols: list[Column] = [F.last(F.when(F.col("size") == k, F.col("f")), ignorenulls=True).over(spec).alias(parts[k - 1]) for k in range(1, LONGEST)]
    held = held.select("*", *cols)
    longest = [F.when(F.col("size") == n, F.max(F.when(F.col("size") == n + 1, F.col("f"))).over(Window.partitionBy("lang", *order[:n])))
               for n in range(2, LONGEST)]
    return held.select("*", F.coalesce(*longest, F.lit(0)).alias(extension))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, cover: int = 100, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top``
    phrases; one is dropped if a longer one holds it and occurs at least
    ``cover`` per cent as often."""
    counts, totals = count_streams(docs, text_col, lang_col, least)
    w = F.split("phrase", " ")
    front, back = [f"w{i}" for i in range(1, LONGEST + 1)], [f"v{i}" for i in range(1, LONGEST + 1)]
    stream = counts.select("*", F.size(w).alias("size"), *[F.get(w, F.lit(i)).alias(c) for i, c in enumerate(front)],
                           *[F.get(F.reverse(w), F.lit(i)).alias(c) for i, c in enumerate(back)])
    heads, tails = [f"h{k}" for k in range(1, LONGEST)], [f"t{k}" for k in range(1, LONGEST)]
    known = scratch(_scan(stream, front, heads, "after").drop(*front), "prefix-stream")
    known = _scan(known, back, tails, "before").filter("size >= 2").filter(100 * F.greatest("after", "before") < cover * F.col("f"))
    known = known.join(F.broadcast(totals), "lang")  # one row per language
    big = "cast({} as decimal(18, 0))"
    options = []
    for k in range(1, LONGEST):
        r = "case " + " ".join(f"when size = {n} then t{n - k}" for n in range(k + 1, LONGEST + 1)) + " end"
        score = f"(1000 * ({big.format('f')} * {big.format('n')})) div ({big.format(f'h{k}')} * {big.format(f'({r})')})"
        options.append(f"case when size > {k} then struct({score} as score, {k} as k, h{k} as l, {r} as r) end")
    known = known.withColumn("best", F.expr(f"array_min(array({', '.join(options)}))"))
    out = known.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
