"""Repeated windows of a corpus, found by radix passes over runs of windows.

The windows of ``window`` consecutive units (bytes or words) of every text are
to be grouped by equality.  A corpus has as many windows as units, so they are
not sorted one by one: consecutive windows that share an anchor (their smallest
gram, a place that depends on their content alone) travel as one run, and the
passes take the most significant digit first:

* digit 1, the anchor gram: runs whose gram occurs once leave (their windows
  are unique);
* digit 2, all units the run's windows cover: runs equal as a whole are
  settled together;
* last digits: only of grams with several different runs, one run of each kind
  brings its units, and its windows are told apart one by one in the task of
  its gram.  A gram with more than ``HOT`` kinds goes to no task as a whole:
  each of its windows is a row of its own, a hash of all its units, and the
  hashes that recur are found by partial aggregation and joined back.

Hot values are folded by partial aggregation before an exchange; joins on hot
grams are plain equi-joins that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import SLICE_BYTES, scratch, slices

#: Rows without an id are numbered above this by their text.
NAMELESS = 1 << 62
#: Kinds of runs of one gram beyond which its windows are rows of their own.
HOT = 2000


class Units(NamedTuple):
    hashes: K.Prefix        # range hashes over units
    grams: np.ndarray       # hash of the gram at each unit
    first: np.ndarray       # first[d]:first[d+1] are the units of text d


class Kind(NamedTuple):
    """What a window is made of."""
    window: int
    gram: int
    units: Callable[[np.ndarray, np.ndarray], Units]   # of (bytes, offsets)


def byte_units(gram: int) -> Callable[[np.ndarray, np.ndarray], Units]:
    def units(data: np.ndarray, offsets: np.ndarray) -> Units:
        p = K.Prefix(data)
        return Units(p, p.windows(gram), offsets)
    return units


def word_units(gram: int) -> Callable[[np.ndarray, np.ndarray], Units]:
    def units(data: np.ndarray, offsets: np.ndarray) -> Units:
        w = K.words(data, offsets)
        h = K.Prefix(data).ranges(w.starts, w.ends)
        return Units(K.Prefix(h), K.chain(h, gram), w.first)
    return units


def row_number(id_col: Column, text: Column) -> list[Column]:
    """(r, t): the id (or a number above all ids) and a checksum of the text,
    so rows that share an id by mistake are still told apart."""
    nameless = F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(NAMELESS))
    return [F.coalesce(id_col.cast("long"), nameless).alias("r"), F.hash(text).alias("t")]


def place(low: np.ndarray, anchor: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First window start, and the anchor's distance from the first and last
    window (each below 256), in one long that sorts by the start."""
    return (low << 16) | ((anchor - low) << 8) | (anchor - high)


def placed(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = loc >> 16
    anchor = low + ((loc >> 8) & 255)
    return low, anchor, anchor - (loc & 255)


def _scan(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = K.flat(part.column("text"))
                u = kind.units(data, offsets)
                x = K.runs(u.grams, u.first, kind.window, kind.gram)
                doc = np.searchsorted(u.first, x.low, side="right") - 1
                loc = place(x.low - u.first[doc], x.anchor - u.first[doc], x.high - u.first[doc])
                c = K.mix(u.hashes.ranges(x.low, x.high + kind.window) + (loc & 0xFFFF).astype(np.uint64))
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.grams[x.anchor].view(np.int64)), pa.array(c.view(np.int64)), part.column("r").take(take),
                     part.column("t").take(take), pa.array(loc)], names=["g", "c", "r", "t", "loc"])
    return run


def run_rows(docs: DataFrame, id_col: str, text_col: str, kind: Kind) -> DataFrame:
    text = F.col(text_col)
    return docs.select(*row_number(F.col(id_col), text), text.alias("text")).filter(
        F.octet_length("text") >= kind.window).mapInArrow(_scan(kind), "g long, c long, r long, t int, loc long")


class Marked(NamedTuple):
    texts: DataFrame     # r, t, id, facts, text (null if untouched), whole: runs settled as removed, probe: runs to tell apart
    probes: DataFrame    # key, r, t, loc, alone, units: runs of grams with several kinds, at most ``hot``
    windows: DataFrame   # g, h, r, t, a, alone: windows of runs of grams with more kinds


def mark(docs: DataFrame, id_col: str, text_col: str, kind: Kind, first_stays: bool, facts: dict[str, Column],
         units_of: Callable, hot: int = HOT) -> Marked:
    """Passes 1 and 2, and the units for the last.

    ``first_stays``: of equal windows the earliest (by id, then place) is not
    removed; otherwise all are.  ``facts``: columns computed from every text.
    ``units_of``: (text, first unit, end unit) pairs to the units' binary."""
    rows = run_rows(docs, id_col, text_col, kind)
    # written, so that each join is of two plain exchanges and a hot gram can be split
    common = scratch(rows.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "grams")
    found = scratch(rows.join(common, "g"), "runs")
    classes = scratch(found.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("r", "loc", "t")).alias("rep")), "run-classes")
    kinds = scratch(classes.groupBy("g").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "gram-kinds")
    if first_stays:
        whole = found.join(classes.filter("n > 1").select("g", "c", "rep"), ["g", "c"]).filter(
            "r > rep.r or r = rep.r and shiftright(loc, 16) > shiftright(rep.loc, 16)")
    else:
        whole = found.join(classes.filter("n > 1").select("g", "c"), ["g", "c"])
    probes = classes.join(kinds, "g").select(
        "rep.r", "rep.t", F.struct("rep.loc", "g", (F.col("kinds") > hot).alias("hot"), (F.col("n") == 1).alias("alone")).alias("m"))
    # as many marks as a text has runs, at most
    whole = whole.groupBy("r", "t").agg(F.collect_set("loc").alias("whole"))
    probes = probes.groupBy("r", "t").agg(F.collect_set("m").alias("probe"))
    every = docs.select(F.col(id_col).alias("id"), *row_number(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"),
                        *[f.alias(n) for n, f in facts.items()])
    # both joins on the row's number: the text moves once
    texts = scratch(every.join(whole, ["r", "t"], "left").join(probes, ["r", "t"], "left").select(
        "id", "r", "t", *facts, F.when(F.col("whole").isNotNull() | F.col("probe").isNotNull(), F.col("text")).alias("text"),
        "whole", "probe"), "marked-texts")
    asked = texts.filter("probe is not null").select("r", "t", "text", "probe")
    few = asked.withColumn("probe", F.filter("probe", lambda m: ~m["hot"])).filter(F.size("probe") > 0)
    many = asked.withColumn("probe", F.filter("probe", lambda m: m["hot"])).filter(F.size("probe") > 0)
    return Marked(texts, few.mapInArrow(_bring(units_of, kind.window), "key long, r long, t int, loc long, alone boolean, units binary"),
                  many.mapInArrow(_apart(kind), "g long, h long, r long, t int, a long, alone boolean"))


def _bring(units_of: Callable, window: int):
    """The units of each probe.  Repeated rows of a task bring theirs once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[tuple] = []
                for r, t, text, probe in zip(*[part.column(n).to_pylist() for n in ("r", "t", "text", "probe")]):
                    if (r, t) in done:
                        continue
                    done.add((r, t))
                    low, _, high = placed(np.array([m["loc"] for m in probe], np.int64))
                    for m, units in zip(probe, units_of(text.encode(), low, high + window)):
                        out.append((m["g"], r, t, m["loc"], m["alone"], units))
                if out:
                    cols = list(zip(*out))
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "r", "t", "loc", "alone", "units"])
    return run


def _apart(kind: Kind):
    """Every window of each probe as a row: the gram, a hash of all its units,
    and its place.  Repeated rows of a task give theirs once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4):
                new = []
                for i, row in enumerate(zip(part.column("r").to_pylist(), part.column("t").to_pylist())):
                    if row not in done:
                        done.add(row)
                        new.append(i)
                if not new:
                    continue
                part = part.take(pa.array(new))
                u = kind.units(*K.flat(part.column("text")))
                probe = part.column("probe")
                m = probe.flatten()
                low, _, high = placed(m.field("loc").to_numpy())
                count = high - low + 1
                of = np.repeat(np.arange(len(count)), count)
                doc = np.repeat(np.arange(len(probe)), probe.value_lengths().to_numpy())[of]
                a = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                start = u.first[doc] + a
                h = u.hashes.ranges(start, start + kind.window)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [m.field("g").take(pa.array(of)), pa.array(h.view(np.int64)), part.column("r").take(take), part.column("t").take(take),
                     pa.array(a), m.field("alone").take(pa.array(of))], names=["g", "h", "r", "t", "a", "alone"])
    return run


def told_apart(marks: Marked, window: int, first_stays: bool) -> DataFrame:
    """The cuts (r, t, a, b) among the windows of hot grams.

    Equal windows are folded before the exchange, and the join back is of two
    written tables, so a window of any number of rows can be split."""
    rows = scratch(marks.windows, "windows")
    if first_stays:
        at = F.struct("r", "a")
        seen = rows.groupBy("g", "h").agg(F.min(at).alias("x"), F.max(at).alias("y")).filter("x < y").select("g", "h", "x")
        hit = at > F.col("x")
    else:
        # repeated input rows give one place several times
        at = F.xxhash64("r", "t", "a")
        seen = rows.groupBy("g", "h").agg(F.min(at).alias("x"), F.max(at).alias("y")).filter("x < y").select("g", "h")
        hit = F.col("alone")
    return rows.join(scratch(seen, "repeated-windows"), ["g", "h"]).filter(hit).select("r", "t", "a", (F.col("a") + window).alias("b"))


def joined(marks: Marked, last: DataFrame) -> DataFrame:
    """The marked texts with the ``cuts`` (first unit, end unit) that the last
    pass found for them."""
    cuts = last.groupBy("r", "t").agg(F.collect_set(F.struct("a", "b")).alias("cuts"))
    settled = marks.texts.filter("probe is null").drop("probe")
    asked = marks.texts.filter("probe is not null").drop("probe").join(cuts, ["r", "t"], "left")
    return asked.unionByName(settled.withColumn("cuts", F.lit(None).cast(asked.schema["cuts"].dataType)))


def cut_mask(n: int, window: int, whole: list[int] | None, cuts: list[dict] | None) -> np.ndarray:
    """True for the units of a text that any removed window covers."""
    edge = np.zeros(n + 1, np.int64)
    if whole:
        low, _, high = placed(np.array(whole, np.int64))
        np.add.at(edge, low, 1)
        np.add.at(edge, high + window, -1)
    for c in cuts or ():
        edge[c["a"]] += 1
        edge[c["b"]] -= 1
    return np.cumsum(edge[:-1]) > 0
