"""Operator 13: hard-negative mining by segment summary filtering.

Every vector is stored with the mean and deviation of its segments, at several
levels (1, 4 and 16 segments).  For two vectors x and y,

    sum over segments of  len * (mean_x * mean_y  -/+  dev_x * dev_y)

bounds their inner product from below and above.  A pass over all rows takes
the coarsest level first, keeps the (anchor, row) pairs whose bounds still meet
what the anchor looks for, refines those by the next level, and scores what is
left exactly, in integers.  What an anchor looks for is a set of score windows
with the k best of each; the k-th best found so far (at first: among a sample
of rows, a true lower bound) is the bar that the upper bound has to reach.

The anchors are the stated query set.  They go through in rounds of about
``ROUND``, each held by every task as one broadcast of bounded size, against
all rows: one pass finds each anchor's positives, a second its negatives in the
windows that the positives' scores set.  A task keeps at most k rows a window;
the tasks' lists are merged by native windows.

Cases: rows with a null id, label or vector, or a null or non-finite component,
take no part; vectors of fewer components than the longest are padded with
zeros (an empty vector scores 0 with all); rows that share the anchor's id are
neither its positives nor its negatives; anchors equal in id, label and vector
are one anchor, otherwise repeated rows count as often as they occur; ties go
to the smaller id; an anchor without positives, or a positive without
negatives, gives no row; an empty table gives an empty result; other columns
are ignored.  Scores that do not fit a long raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

#: Segments of each level of summaries.
LEVELS = (1, 4, 16)
#: Anchors held by a task at once (about 1 kB each).
ROUND = 20_000
#: Rows compared at once, and anchors.
ROWS, ANCHORS = 2048, 256
#: Anchors whose rows give the first bars.
SAMPLE = 1024
NONE = np.iinfo(np.int64).min


def quantised(batches: Iterator[pa.RecordBatch], dims: int, factor: float) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, codes, summary) of (vec_id, label, vector)."""
    for batch in batches:
        lists = batch.column("vector")
        size = np.diff(lists.offsets.to_numpy())
        codes = np.zeros((batch.num_rows, dims))
        if size.sum():
            codes[np.arange(dims) < size[:, None]] = np.floor(lists.flatten().to_numpy() * factor)
        summary = np.concatenate([x for level in LEVELS for x in summaries(codes, level)], axis=1).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _lists(codes), _lists(summary)],
                                         names=["vec_id", "label", "codes", "summary"])


def _lists(matrix: np.ndarray) -> pa.Array:
    n, m = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(matrix.reshape(-1)))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(rows, len(flat) // rows if rows else 0)


def cuts(dims: int, level: int) -> np.ndarray:
    """Borders of ``level`` segments of nearly equal length (fewer if short)."""
    return np.unique(np.linspace(0, dims, level + 1).astype(np.int64))


def summaries(codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, both times the root of the
    segment's length, so that plain inner products of them give the bounds."""
    at = cuts(codes.shape[1], level)
    if len(at) < 2:
        return np.zeros((len(codes), 0)), np.zeros((len(codes), 0))
    length = np.diff(at).astype(float)
    mean = np.add.reduceat(codes, at[:-1], axis=1) / length
    square = np.add.reduceat((codes - np.repeat(mean, np.diff(at), axis=1)) ** 2, at[:-1], axis=1) / length
    return mean * np.sqrt(length), np.sqrt(square * length)


class Rows(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    codes: np.ndarray
    summary: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        n = batch.num_rows
        return Rows(batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("codes"), n), _matrix(batch.column("summary"), n))

    def take(self, at) -> Rows:
        return Rows(self.ids[at], self.labels[at], self.codes[at], self.summary[at])


class Wanted(NamedTuple):
    """What each anchor looks for: windows low..high of scores (inclusive; low
    above high: none), the best k of each, and the first bars."""
    anchors: Rows
    low: np.ndarray   # (anchors, windows)
    high: np.ndarray
    bar: np.ndarray
    k: int
    same: bool        # rows of the anchor's own label, or of any other


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: in doubles where those are exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 2.0 ** 53:
        return x @ y.T
    if most >= 2.0 ** 62:
        raise OverflowError("inner products do not fit a long: scale the vectors down")
    return x.astype(np.int64) @ y.astype(np.int64).T


def candidates(a: Rows, x: Rows, least: np.ndarray, most: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs whose bounds meet ``least``..``most``
    at every level; scores are exact."""
    at_a, at_x = np.arange(len(a.ids)), np.arange(len(x.ids))
    alive = (a.labels[:, None] == x.labels) == same
    alive &= a.ids[:, None] != x.ids
    at = 0
    for level in LEVELS:
        m = max(len(cuts(a.codes.shape[1], level)) - 1, 0)
        mean, dev = slice(at, at + m), slice(at + m, at + 2 * m)
        at += 2 * m
        keep_a, keep_x = alive.any(axis=1), alive.any(axis=0)
        if not keep_a.all() or not keep_x.all():
            at_a, at_x, alive = at_a[keep_a], at_x[keep_x], alive[np.ix_(keep_a, keep_x)]
        if not alive.size:
            break
        middle = a.summary[at_a, mean] @ x.summary[at_x, mean].T
        spread = a.summary[at_a, dev] @ x.summary[at_x, dev].T
        spread += 1 + 1e-5 * (spread + np.abs(middle))  # single precision
        alive &= middle + spread >= least[at_a, None]
        alive &= middle - spread <= most[at_a, None]
    i, j = np.nonzero(alive)
    if not len(i):
        return i, j, np.zeros(0)
    if len(i) * 16 < alive.size:  # few left: pair by pair
        left, right = a.codes[at_a[i]], x.codes[at_x[j]]
        bound = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
        if bound < 2.0 ** 53:
            return at_a[i], at_x[j], np.einsum("ij,ij->i", left, right)
    return at_a[i], at_x[j], exact_scores(a.codes[at_a], x.codes[at_x])[i, j]


class Best:
    """The k best rows of every window of some anchors."""

    def __init__(self, wanted: Wanted):
        shape = (*wanted.low.shape, wanted.k)
        self.w = wanted
        self.score = np.full(shape, NONE)
        self.ids = np.zeros(shape, np.int64)
        self.row = np.full(shape, -1)
        self.bar = np.maximum(wanted.low, wanted.bar)

    def look(self, x: Rows, first_row: int) -> None:
        """Compare rows with all anchors, in blocks of anchors (of equal label,
        where the labels have to agree)."""
        if self.w.same:
            for label in np.unique(x.labels):
                rows, own = np.flatnonzero(x.labels == label), np.flatnonzero(self.w.anchors.labels == label)
                for i in range(0, len(own), ANCHORS):
                    self._block(own[i:i + ANCHORS], x.take(rows), rows + first_row)
        else:
            for i in range(0, len(self.w.anchors.ids), ANCHORS):
                self._block(np.arange(i, min(i + ANCHORS, len(self.w.anchors.ids))), x, np.arange(len(x.ids)) + first_row)

    def _block(self, at: np.ndarray, x: Rows, rows: np.ndarray) -> None:
        w = self.w
        open_ = w.low[at] <= w.high[at]
        least = np.where(open_, self.bar[at], np.iinfo(np.int64).max).min(axis=1).astype(float)
        most = np.where(open_, w.high[at], NONE).max(axis=1).astype(float)
        a, j, s = candidates(w.anchors.take(at), x, least, most, w.same)
        s = s.astype(np.int64)
        for n in range(w.low.shape[1]):
            own = at[a]
            hit = (s >= self.bar[own, n]) & (s <= w.high[own, n])
            if hit.any():
                self._add(n, own[hit], s[hit], x.ids[j[hit]], rows[j[hit]])

    def _add(self, n: int, a: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        k = self.w.k
        touched = np.unique(a)
        old = self.row[touched, n] >= 0
        a = np.r_[np.repeat(touched, k)[old.reshape(-1)], a]
        score = np.r_[self.score[touched, n][old], score]
        ids = np.r_[self.ids[touched, n][old], ids]
        row = np.r_[self.row[touched, n][old], row]
        order = np.lexsort((row, ids, -score, a))
        a, score, ids, row = a[order], score[order], ids[order], row[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        kept = rank < k
        place = (a[kept], n, rank[kept])
        self.score[place], self.ids[place], self.row[place] = score[kept], ids[kept], row[kept]
        self.bar[touched, n] = np.maximum(self.bar[touched, n], self.score[touched, n, k - 1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, id, score), a row once for each anchor that keeps it."""
        a, n, r = np.nonzero(self.row >= 0)
        pair = np.stack([a, self.row[a, n, r]])
        _, once = np.unique(pair, axis=1, return_index=True) if len(a) else (None, np.zeros(0, np.int64))
        a, n, r = a[once], n[once], r[once]
        return a, self.ids[a, n, r], self.score[a, n, r]


def search(rows: DataFrame, wanted: Wanted) -> DataFrame:
    """(a, id, score): the tasks' best rows of each anchor's windows."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = Best(shared.value), 0
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                best.look(Rows.of(part), seen)
                seen += part.num_rows
        a, ids, score = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(ids), pa.array(score)], names=["a", "id", "score"])

    return rows.mapInArrow(run, "a int, id long, score long")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _first_bars(wanted: Wanted, sample: Rows) -> Wanted:
    """The k-th best among the sample's rows bounds the k-th best of all."""
    best = Best(wanted)
    best.look(sample, 0)
    return wanted._replace(bar=best.score[:, :, -1])


def vectors(table: DataFrame, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding", factor: float = 256.0) -> DataFrame:
    """(vec_id, label, codes, summary) of the rows that take part, written once."""
    v = F.col(vector_col)
    part = table.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                        v.cast("array<double>").alias("vector"))
    part = part.filter("vec_id is not null and label is not null and vector is not null and "
                       "not exists(vector, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    dims = part.agg(F.max(F.size("vector"))).first()[0] or 0
    return scratch(part.mapInArrow(lambda batches: quantised(batches, dims, factor), "vec_id long, label long, codes array<double>, summary array<float>"), "vectors")


def mine(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         per_round: int = ROUND) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    over ``vectors(...)``: for each anchor and each of its ``positives`` best
    rows of its label, the ``negatives`` best rows of other labels that score
    ``low`` to ``high`` per cent of the positive."""
    spark = table.sparkSession
    anchors = scratch(table.filter(is_anchor).distinct(), "anchors")
    rounds = -(-anchors.count() // per_round)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for r in range(rounds):
        held = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).toArrow().combine_chunks().to_batches()
        if held:
            done = _round(table, Rows.of(held[0]), positives, negatives, low, high)
            out = done if rounds == 1 else out.unionByName(scratch(done, "negatives"))
    return out


def _round(table: DataFrame, anchors: Rows, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    n = len(anchors.ids)
    sample = anchors.take(slice(0, SAMPLE))
    all_ = np.full((n, 1), NONE)
    first = _first_bars(Wanted(anchors, all_ + 1, np.full((n, 1), np.iinfo(np.int64).max), all_, positives, True), sample)
    found = scratch(_ranked(search(table, first), ["a"], positives).withColumnRenamed("rank", "place"), "positives")
    lo, hi = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)
    for row in found.collect():  # at most ``positives`` for each anchor of the round
        lo[row.a, row.place - 1] = -(-low * row.score // 100)
        hi[row.a, row.place - 1] = high * row.score // 100
    second = _first_bars(Wanted(anchors, lo, hi, np.full_like(lo, NONE), negatives, False), sample)
    names = table.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(anchors.ids.tolist())], "a int, anchor_id long")
    pairs = (found.select("a", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(F.broadcast(names), "a")
             .join(search(table, second), "a")
             .filter(f"{low} * cast(positive_score as decimal(20,0)) <= 100 * cast(score as decimal(20,0)) and "
                     f"100 * cast(score as decimal(20,0)) <= {high} * cast(positive_score as decimal(20,0))"))
    return _ranked(pairs, ["a", "place"], negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def negative_rows(embeddings: DataFrame) -> DataFrame:
    """The contract's result: every 100th vector is an anchor, every 7th has
    its label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors(embeddings, label=label), F.col("vec_id") % 100 == 0)
