"""Operator 3: exact substring de-duplication by depth-limited radix passes.

Every byte covered by a ``WINDOW``-byte string that also starts anywhere else
in the corpus is removed.  The suffixes are ordered only as deep as the window
(see ``repeats``): the groups left after the last pass are the repeated
windows.  The digits start at the window's anchor rather than at its first
byte, which changes the order of the groups but not the groups, and lets all
suffixes around one anchor move as one row.

Cases: null and empty texts have no bytes; texts shorter than the window lose
nothing; equal rows (also with the same id) are two texts and lose what they
share; windows never cross texts; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from . import textkit as K
from .common import slices
from .minhash import groups

WINDOW = 200
GRAM = 32


def kind(window: int = WINDOW, gram: int = GRAM) -> R.Kind:
    if window - gram > 255 or gram > window:
        raise ValueError("the window must have fewer than 256 grams")
    return R.Kind(window, gram, R.byte_units(gram))


def _units(data: bytes, low: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [data[a:b] for a, b in zip(low.tolist(), end.tolist())]


def once_each(table: pa.Table) -> pa.Table:
    """Rows of one text and place once (repeated input rows bring them again)."""
    h = np.zeros(table.num_rows, np.uint64)
    for name in ("key", "r", "t", "loc"):
        h = K.mix(h * np.uint64(K._BASE) + table.column(name).to_numpy().astype(np.int64).view(np.uint64))
    _, first = np.unique(h, return_index=True)
    return table if len(first) == len(h) else table.take(pa.array(np.sort(first)))


def _last_digits(window: int):
    """Windows of different runs of one gram, told apart by all their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "key"):
            table = once_each(table)
            key = table.column("key").to_numpy().view(np.uint64)
            low, _, high = R.placed(table.column("loc").to_numpy())
            data, offsets = K.flat(table.column("units").combine_chunks())
            count = high - low + 1
            row = np.repeat(np.arange(len(count)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = offsets[:-1][row] + nth
            h = K.mix(K.Prefix(data).ranges(start, start + window) ^ K.mix(key)[row])
            _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
            hit = (times[inverse] > 1) & table.column("alone").to_numpy()[row]
            # neighbouring windows of a run make one cut
            i = np.flatnonzero(hit)
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1] + 1) | (row[i[1:]] != row[i[:-1]])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(i)) - 1
            a, b = i[begin], i[end[:len(begin)]]
            take = pa.array(row[a])
            yield pa.RecordBatch.from_arrays(
                [table.column("r").combine_chunks().take(take), table.column("t").combine_chunks().take(take),
                 pa.array(low[row[a]] + nth[a]), pa.array(low[row[b]] + nth[b] + window)], names=["r", "t", "a", "b"])
    return run


def removed(part: pa.RecordBatch, window: int) -> Iterator[tuple[bytes, np.ndarray] | None]:
    """(bytes, mask) of each text with a mark."""
    for text, whole, cuts in zip(*[part.column(n).to_pylist() for n in ("text", "whole", "cuts")]):
        if text is None or not (whole or cuts):
            yield None
        else:
            data = text.encode()
            yield data, R.cut_mask(len(data), window, whole, cuts)


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, spans, sha = [], [], []
                for x, untouched in zip(removed(part, window), part.column("sha").to_pylist()):
                    if x is None:
                        n.append(0), spans.append(0), sha.append(untouched)
                        continue
                    data, mask = x
                    n.append(int(mask.sum()))
                    spans.append(int((mask[1:] & ~mask[:-1]).sum() + mask[0]))
                    sha.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~mask].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(n, pa.int64()), pa.array(spans, pa.int64()),
                                                  pa.array(sha, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def _marks(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, hot: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = {"n_bytes": F.octet_length(text).cast("long"), "sha": F.sha2(F.encode(text, "UTF-8"), 256)}
    marks = R.mark(docs, id_col, text_col, kind(window, gram), False, facts, _units, hot)
    last = marks.probes.repartition("key").sortWithinPartitions("key").mapInArrow(_last_digits(window), "r long, t int, a long, b long")
    return R.joined(marks, last.unionByName(R.told_apart(marks, window, False)))


def substring_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, hot: int = R.HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = _marks(docs, id_col, text_col, window, gram, hot)
    kind_of_id = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    out = rows.select("id", "n_bytes", "sha", "text", "whole", "cuts").mapInArrow(
        _cut(window), f"id {kind_of_id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def kept_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
               gram: int = GRAM, hot: int = R.HOT) -> DataFrame:
    """id and the remaining bytes of each text that lost any, as binary (a cut
    may fall inside a character)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                left = [None if x is None else np.frombuffer(x[0], np.uint8)[~x[1]].tobytes() for x in removed(part, window)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(left, pa.binary())], names=["id", "kept"])

    rows = _marks(docs, id_col, text_col, window, gram, hot)
    kind_of_id = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    out = rows.filter("text is not null").select("id", "text", "whole", "cuts").mapInArrow(run, f"id {kind_of_id}, kept binary")
    return out.withColumnRenamed("id", id_col)
