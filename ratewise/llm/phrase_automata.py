r"""Operator 8: repeated-phrase removal with sharded Aho-Corasick automata.

Words are ``[^\x20\x09-\x0D]+``, unchanged; a window is ``WINDOW`` consecutive
words.  Every word covered by a window whose words also start earlier (smaller
id, or same text and earlier) is removed.

1. Recurring passages are confirmed by the radix passes of ``repeats``: runs of
   windows that recur as a whole are settled there, the first one staying.
2. Passages that recur in part are dealt to shards by their anchor gram.  A
   shard compiles an automaton of the windows that it has seen twice (its
   symbols are words, so a node is a word) and streams all its passages through
   it, which locates every occurrence word for word; all but the first of each
   window are removed.
3. A gram with more than ``repeats.HOT`` kinds of passages is dealt to no
   shard: its windows are settled by their hashes, the first place of each
   found by partial aggregation, the later ones by a join.

A shard's automaton holds the windows of one Arrow batch of grams, whatever the
corpus' size; of equal passages only the first goes to a shard.

Cases: null and empty texts have no words; texts of fewer words than a window
lose nothing; rows with the same id and text are one text (neither is earlier);
rows without id come last, in an order fixed by their text; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from . import textkit as K
from .common import WORD_PATTERN, once, slices
from .minhash import groups

WINDOW = 20
GRAM = 4

_word = re.compile(rb"[^ \t-\r]+")


def kind(window: int = WINDOW, gram: int = GRAM) -> R.Kind:
    if window - gram > 255 or gram > window:
        raise ValueError("the window must have fewer than 256 grams")
    return R.Kind(window, gram, R.word_units(gram))


def _units(data: bytes, low: np.ndarray, end: np.ndarray) -> list[bytes]:
    words = _word.findall(data)
    return [b" ".join(words[a:b]) for a, b in zip(low.tolist(), end.tolist())]


def automaton(passages: list[list[int]], window: int):
    """Automaton over word numbers of the windows that occur more than once in
    the passages, or None."""
    import ahocorasick
    flat = np.concatenate([np.array(p, np.int64) for p in passages])
    size = np.array([len(p) for p in passages])
    h = K.Prefix(K.mix(flat)).windows(window)
    end = np.cumsum(size)
    inside = np.ones(len(flat), bool)
    for j in range(1, window):  # no window starts in a passage's last words
        inside[np.maximum(end - j, end - size)] = False
    starts = np.flatnonzero(inside[:len(h)])
    _, at, times = np.unique(h[starts], return_index=True, return_counts=True)
    phrases = starts[at[times > 1]]
    if not len(phrases):
        return None
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, p in enumerate(phrases.tolist()):
        found.add_word(tuple(flat[p:p + window].tolist()), i)
    found.make_automaton()
    return found


def _locate(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "key"):
            number: dict[bytes, int] = {}
            passages = [[number.setdefault(w, len(number) + 1) for w in units.split(b" ")] for units in table.column("units").to_pylist()]
            found = automaton(passages, window)
            if found is None:
                continue
            r, t = table.column("r").to_pylist(), table.column("t").to_pylist()
            low = (table.column("loc").to_numpy() >> 16).tolist()
            places: list[tuple[int, int, int, int]] = []  # phrase, id, start, row
            for i, p in enumerate(passages):
                places += [(phrase, r[i], low[i] + end - window + 1, i) for end, phrase in found.iter(tuple(p))]
            places.sort()
            out, last, first = [], -1, (0, 0)
            for phrase, doc, start, i in places:
                if phrase != last:
                    last, first = phrase, (doc, start)
                elif (doc, start) > first:
                    out.append((doc, t[i], start, start + window))
            if out:
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["r", "t", "a", "b"])
    return run


def _marks(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, hot: int) -> DataFrame:
    words = once(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_PATTERN), F.lit(0)))
    measured = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), words.alias("__words"))
    facts = {"n_words": F.size("__words").cast("long"), "sha": F.sha2(F.array_join("__words", " "), 256)}
    marks = R.mark(measured, "__id", "__text", kind(window, gram), True, facts, _units, hot)
    last = marks.probes.repartition("key").sortWithinPartitions("key").mapInArrow(_locate(window), "r long, t int, a long, b long")
    return R.joined(marks, last.unionByName(R.told_apart(marks, window, True)))


def kept_words(part: pa.RecordBatch, window: int) -> Iterator[tuple[list[bytes], np.ndarray] | None]:
    """(words, mask) of each text with a mark."""
    for text, whole, cuts in zip(*[part.column(n).to_pylist() for n in ("text", "whole", "cuts")]):
        if text is None or not (whole or cuts):
            yield None
        else:
            words = _word.findall(text.encode())
            yield words, R.cut_mask(len(words), window, whole, cuts)


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, sha = [], []
                for x, untouched in zip(kept_words(part, window), part.column("sha").to_pylist()):
                    n.append(0 if x is None else int(x[1].sum()))
                    sha.append(untouched if x is None else hashlib.sha256(b" ".join(w for w, c in zip(x[0], x[1].tolist()) if not c)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_words"), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                                                 names=["id", "n_words", "n_removed", "kept_sha256"])
    return run


def phrase_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                gram: int = GRAM, hot: int = R.HOT) -> DataFrame:
    """id, n_words, n_removed, kept_sha256."""
    rows = _marks(docs, id_col, text_col, window, gram, hot)
    kind_of_id = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    out = rows.select("id", "n_words", "sha", "text", "whole", "cuts").mapInArrow(
        _cut(window), f"id {kind_of_id}, n_words long, n_removed long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
               gram: int = GRAM, hot: int = R.HOT) -> DataFrame:
    """id and the kept words, joined by one space, of each text that lost any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                left = [None if x is None else b" ".join(w for w, c in zip(x[0], x[1].tolist()) if not c).decode() for x in kept_words(part, window)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(left, pa.string())], names=["id", "text"])

    rows = _marks(docs, id_col, text_col, window, gram, hot)
    kind_of_id = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    out = rows.filter("text is not null").select("id", "text", "whole", "cuts").mapInArrow(run, f"id {kind_of_id}, text string")
    return out.filter("text is not null").withColumnRenamed("id", id_col)
