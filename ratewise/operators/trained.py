"""Trained multi-label scorer (M4, M8).

Logistic regression over hashed words, one weight vector per label, fitted by
L-BFGS with an L2 penalty.

* **Features.**  Each distinct cleaned word of a text is hashed to one of
  ``buckets`` numbers; a bucket counts once if the text holds it.  Whole texts
  count, and the feature table holds bucket numbers only, so training never sees
  a text again.
* **Training.**  One pass over the feature table per step.  A task adds up the
  gradients of its rows in blocks of the weight vector; blocks are added group
  by group until at most ``FAN`` are left of each, as in a tree aggregation, so
  neither a reducer nor the driver holds more than ``FAN`` times the model.  A row's share is rounded to multiples of 2**-32 and added
  in integers: the fit does not depend on how the rows are partitioned.
* **Scoring.**  Native and map-only: the weights are one constant array inside
  the expression, looked up per bucket.  The same column runs on streams.

Which rows train and which are held out follows from the id and a seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.constants import LABEL_ORDER
from ratewise.functions import severity as V
from ratewise.functions import text as X
from ratewise.operators.scoring import LexiconScorer
from ratewise.session import write_table

BUCKETS = 1 << 16
PENALTY = 3e-4
STEPS = 30
#: Weights per row of a gradient block, and blocks added at once.
BLOCK, FAN = 4096, 32
#: Gradients are added in integer multiples of this.
UNIT = 2.0 ** -32
#: One of this many rows is held out.
FOLDS = 5


def word_buckets(cleaned: Column, buckets: int = BUCKETS) -> Column:
    """Sorted distinct buckets of a cleaned text's words."""
    words = F.array_remove(F.split(cleaned, " "), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))))


def held_out(id_col: str, seed: int = 0, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(folds)) == 0


def feature_table(rows: DataFrame, labels: Sequence[str], text_col: str = "text", buckets: int = BUCKETS, mode: str = "token") -> DataFrame:
    """(at: buckets of the text, y: 0/1 per label, null where unknown), written
    once.  Rows without any label or any word carry nothing and are left out."""
    y = F.array(*[F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double")) for c in labels])
    known = rows.filter(F.coalesce(*[F.col(c).cast("double") for c in labels]).isNotNull())
    table = known.select(word_buckets(X.clean_text(text_col, mode), buckets).alias("at"), y.alias("y"))
    # filtered when read: a filter here would be pushed below, and clean every text twice
    return write_table(table, "features").filter(F.size("at") > 0)


def loss_and_gradient(at: np.ndarray, size: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed log-loss, rows per label, and summed gradient of a batch, both in
    units; ``w`` is (buckets + 1, labels), the bias last."""
    z = np.add.reduceat(w[at], np.r_[0, np.cumsum(size)[:-1]], axis=0) + w[-1]
    known = ~np.isnan(y)
    t = np.where(known, y, 0.0)
    loss = np.where(known, np.logaddexp(0.0, z) - t * z, 0.0)
    r = np.where(known, 0.5 * (1.0 + np.tanh(0.5 * z)) - t, 0.0)
    share = np.rint(r / UNIT)
    row = np.repeat(np.arange(len(size)), size)
    # sums of whole numbers below 2**53 are exact in doubles
    g = np.stack([np.r_[np.bincount(at, share[row, c], len(w) - 1), share[:, c].sum()] for c in range(w.shape[1])], axis=1)
    return np.rint(loss / UNIT).sum().astype(np.int64), known.sum(axis=0), g.astype(np.int64)


def _sum_blocks(table: pa.Table) -> pa.Table:
    """Add up the arrays of one block."""
    total = np.sum(np.stack([np.frombuffer(b, np.int64) for b in table.column("sums").to_pylist()]), axis=0)
    return pa.table({"part": table.column("part").slice(0, 1), "block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def total_gradient(features: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-loss, rows per label, gradient) of the whole table at ``w``."""
    shared = features.sparkSession.sparkContext.broadcast(w)
    labels = w.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w = shared.value
        sums = np.zeros(w.size + labels + 1, np.int64)  # gradient, rows, loss
        for batch in batches:
            at, y = batch.column("at"), batch.column("y")
            size = np.diff(at.offsets.to_numpy())
            if len(size):
                known = y.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, labels)
                loss, n, g = loss_and_gradient(at.flatten().to_numpy(), size, known, w)
                sums += np.r_[g.reshape(-1), n, loss]
        part = TaskContext.get().partitionId()
        for i in range(0, len(sums), BLOCK):
            if sums[i:i + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([sums[i:i + BLOCK].tobytes()], pa.binary())],
                                                 names=["part", "block", "sums"])

    schema = "part int, block int, sums binary"
    sums, left = features.mapInArrow(run, schema), features.rdd.getNumPartitions()
    while left > FAN:
        sums = (sums.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("block", "part")
                .applyInArrow(lambda t: _sum_blocks(t), schema))
        left = -(-left // FAN)
    out = np.zeros(w.size + labels + 1, np.int64)
    for r in sums.collect():  # at most FAN times the model
        block = np.frombuffer(bytes(r.sums), np.int64)
        out[r.block:r.block + len(block)] += block
    shared.unpersist()
    return out[-1] * UNIT, out[w.size:-1], out[:w.size].reshape(w.shape) * UNIT


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = STEPS, memory: int = 8,
             tolerance: float = 1e-5) -> np.ndarray:
    """L-BFGS with a backtracking line search."""
    x = start
    f, g = evaluate(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max(initial=0.0) < tolerance:
            break
        d, alphas = g.copy(), []
        for s, y in reversed(past):
            alphas.append((s * d).sum() / (s * y).sum())
            d -= alphas[-1] * y
        if past:
            s, y = past[-1]
            d *= (s * y).sum() / (y * y).sum()
        else:
            d *= 1.0 / max(1e-12, np.abs(g).max())
        for (s, y), a in zip(past, reversed(alphas)):
            d += (a - (y * d).sum() / (s * y).sum()) * s
        slope, step = -(g * d).sum(), 1.0
        if slope >= 0:  # curvature lost in rounding: steepest descent
            past, d, slope = [], g, -(g * g).sum()
        while True:
            f2, g2 = evaluate(x - step * d)
            if f2 <= f + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        if f2 > f:
            break
        s, y = -step * d, g2 - g
        if (s * y).sum() > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, f, g = x + s, f2, g2
    return x


def fit(features: DataFrame, labels: int, buckets: int = BUCKETS, penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Weights (buckets + 1, labels), the bias last; the bias has no penalty."""
    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, n, g = total_gradient(features, w)
        # every label counts by its own number of rows
        n = np.maximum(n, 1)
        free = np.where(np.arange(len(w))[:, None] < buckets, w, 0.0)
        return loss / n.max() + 0.5 * penalty * (free ** 2).sum(), g / n.max() + penalty * free

    return minimise(evaluate, np.zeros((buckets + 1, labels)), steps)


@dataclass
class TrainedScorer:
    """Probabilities of the trained labels, as native columns.

    As a scorer of the four categories, ``categories`` names the trained label
    that stands for a category; a category without one keeps the word list's
    probability."""

    labels: list[str]
    weights: np.ndarray
    categories: dict[str, str]
    base: LexiconScorer

    @property
    def buckets(self) -> int:
        return len(self.weights) - 1

    def logit(self, at: Column, label: str) -> Column:
        """``at``: the buckets of a text.  The array is a constant of the plan."""
        column = self.weights[:, self.labels.index(label)]
        w = F.split(F.lit(",".join(map(repr, column[:-1].tolist()))), ",").cast("array<double>")
        total = F.aggregate(at, F.lit(0.0), lambda s, i: s + F.get(w, i))
        return F.lit(float(column[-1])) + total

    def probabilities(self, df: DataFrame, cleaned: str, prefix: str = "p_") -> DataFrame:
        """One column per trained label."""
        held = df.withColumn("__at", word_buckets(F.col(cleaned), self.buckets))
        return held.withColumns({prefix + c: V.sigmoid(self.logit(F.col("__at"), c)) for c in self.labels}).drop("__at")

    def score_frame(self, df: DataFrame, cleaned: str, out: str) -> DataFrame:
        held = df.withColumns({"__at": word_buckets(F.col(cleaned), self.buckets), "__tokens": self.base.hits(F.split(F.col(cleaned), " "))})
        probs = [V.sigmoid(self.logit(F.col("__at"), self.categories[c]) if c in self.categories else self.base.logit(F.col("__tokens"), c))
                 for c in LABEL_ORDER]
        return held.withColumn(out, F.array(*probs)).drop("__at", "__tokens")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(b, c, float(self.weights[b, i])) for i, c in enumerate(self.labels) for b in np.flatnonzero(self.weights[:, i]).tolist()]
        rows += [(-1, c, float(self.buckets)) for c in self.labels]
        spark.createDataFrame(rows, "bucket int, label string, weight double").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, categories: dict[str, str]) -> TrainedScorer:
        rows = spark.read.parquet(path).collect()  # at most the model's size
        labels = sorted({r.label for r in rows})
        w = np.zeros((int(next(r.weight for r in rows if r.bucket < 0)) + 1, len(labels)))
        for r in rows:
            if r.bucket >= 0:
                w[r.bucket, labels.index(r.label)] = r.weight
        return TrainedScorer(labels, w, categories, LexiconScorer())


def train(rows: DataFrame, labels: Sequence[str], text_col: str = "text", categories: dict[str, str] | None = None, buckets: int = BUCKETS,
          penalty: float = PENALTY, steps: int = STEPS) -> TrainedScorer:
    """Fit on every row of ``rows`` (a text and 0/1 label columns, null: unknown)."""
    labels = sorted(labels)
    features = feature_table(rows, labels, text_col, buckets)
    return TrainedScorer(labels, fit(features, len(labels), buckets, penalty, steps), categories or {}, LexiconScorer())


def held_out_metrics(scored: DataFrame, labels: Sequence[str], prefix: str = "p_", threshold: float = 0.5) -> DataFrame:
    """label, n, tp, fp, fn, tn, precision, recall, log_loss, base_log_loss of
    held-out rows (the base always answers the label's share)."""
    rows = None
    for c in labels:
        one = scored.filter(F.col(c).isNotNull()).select(F.lit(c).alias("label"), (F.col(c) > 0).alias("y"), F.col(prefix + c).alias("p"))
        rows = one if rows is None else rows.unionByName(one)
    hit, p = F.col("p") > threshold, F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    out = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"),
        F.count_if(~hit & F.col("y")).alias("fn"), F.count_if(~hit & ~F.col("y")).alias("tn"),
        F.avg(-F.log(F.when(F.col("y"), p).otherwise(1 - p))).alias("log_loss"))
    share = (F.col("tp") + F.col("fn")) / F.col("n")
    return out.select("label", "n", "tp", "fp", "fn", "tn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
                      F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.round("log_loss", 6).alias("log_loss"),
                      F.round(F.when((share > 0) & (share < 1), -share * F.log(share) - (1 - share) * F.log(1 - share)).otherwise(0.0), 6).alias("base_log_loss"))
