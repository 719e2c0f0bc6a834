"""Scores against 0/1 labels: exact ROC and isotonic calibration.

Both start from tie groups, one row per key and distinct score (rounded to
``digits`` decimals, so that a key has at most ``10 ** digits + 1`` of them),
which rows are folded to before anything is shuffled.

* **ROC.**  Groups are range partitioned by (key, score).  Running totals are a
  window inside each range plus the prefix sums of the ranges' totals; no window
  runs over a whole key.  The area is a sum of integers.
* **Isotonic regression.**  Pool-adjacent-violators on every range, then on the
  blocks of neighbouring ranges, group by group, until one is left: pooling
  adjacent violators inside a part never contradicts the solution of the whole,
  so merging partial solutions gives the same blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.session import write_table

DIGITS = 6
#: Ranges, and neighbouring parts merged at once.
RANGES, FAN = 64, 8


def tie_groups(scored: DataFrame, key: str, score: str, label: str, digits: int = DIGITS) -> DataFrame:
    """(key, p, pos, neg) of the rows with a score and a label."""
    known = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(key, (F.round(score, digits) + 0.0).alias("p")).agg(
        F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg"))


def _ranges(groups: DataFrame, key: str, ranges: int) -> DataFrame:
    """The groups with the number of their range, written once."""
    return write_table(groups.repartitionByRange(ranges, key, "p").withColumn("part", F.spark_partition_id()), "score-ranges")


def roc(scored: DataFrame, key: str, score: str, label: str, digits: int = DIGITS, ranges: int = RANGES) -> DataFrame:
    """key, n_pos, n_neg, auc, threshold, tp, fp: the exact area under the ROC
    curve (ties count half; null without both classes) and the threshold
    (score >= threshold) of the largest true minus false positive rate, the
    highest if several."""
    held = _ranges(tie_groups(scored, key, score, label, digits), key, ranges)
    parts = held.groupBy(key, "part").agg(F.sum("pos").alias("part_pos"), F.sum("neg").alias("part_neg"))
    later = Window.partitionBy(key).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = parts.select(key, "part", *[F.coalesce(F.sum(f"part_{c}").over(later), F.lit(0)).alias(f"above_{c}") for c in ("pos", "neg")])
    whole = held.groupBy(key).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    inside = Window.partitionBy(key, "part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = (held.withColumns({"in_pos": F.sum("pos").over(inside), "in_neg": F.sum("neg").over(inside)}).join(F.broadcast(parts), [key, "part"])
           .join(F.broadcast(whole), key)  # a row per key
           .select(key, "p", "pos", "neg", "n_pos", "n_neg", (F.col("above_pos") + F.col("in_pos")).alias("tp"), (F.col("above_neg") + F.col("in_neg")).alias("fp")))
    big = lambda c: F.col(c).cast("decimal(18,0)")
    twice = F.sum(big("neg") * (2 * big("tp") - big("pos")))
    gain = big("tp") * big("n_neg") - big("fp") * big("n_pos")
    out = run.groupBy(key, "n_pos", "n_neg").agg(twice.alias("twice"), F.max(F.struct(gain.alias("gain"), "p", "tp", "fp")).alias("best"))
    area = F.try_divide(F.col("twice").cast("double"), 2.0 * F.col("n_pos") * F.col("n_neg"))
    return out.select(key, "n_pos", "n_neg", area.alias("auc"), F.col("best.p").alias("threshold"), "best.tp", "best.fp")


def pool(mean_of: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool adjacent violators: (sum, weight, first row) of each block, for rows
    in order of their scores, given as sums and weights."""
    total, size, first = [], [], []
    for i, (s, w) in enumerate(zip(mean_of.tolist(), weight.tolist())):
        at = i
        # means compared by products: sums and weights are whole numbers
        while total and total[-1] * w >= s * size[-1]:
            s, w, at = s + total.pop(), w + size.pop(), first.pop()
        total.append(s)
        size.append(w)
        first.append(at)
    return np.array(total, np.int64), np.array(size, np.int64), np.array(first, np.int64)


def _pooled(table: pa.Table, key: str) -> pa.Table:
    table = table.sort_by([("low", "ascending")])
    total, size, first = pool(table.column("pos").to_numpy(), table.column("n").to_numpy())
    last = np.r_[first[1:], table.num_rows] - 1
    take = lambda c, at: table.column(c).take(pa.array(at))
    return pa.table({key: take(key, first), "part": take("part", first), "low": take("low", first), "high": take("high", last),
                     "pos": pa.array(total), "n": pa.array(size)})


def isotonic(scored: DataFrame, key: str, score: str, label: str, digits: int = DIGITS, ranges: int = RANGES, fan: int = FAN) -> DataFrame:
    """key, low, high, n, pos, calibrated: the blocks of the isotonic fit of
    the label on the score, the lowest first."""
    held = _ranges(tie_groups(scored, key, score, label, digits), key, ranges)
    blocks = held.select(key, "part", F.col("p").alias("low"), F.col("p").alias("high"), "pos", (F.col("pos") + F.col("neg")).alias("n"))
    kind = held.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, part int, low double, high double, pos long, n long"
    left = ranges
    while True:
        blocks = blocks.groupBy(key, "part").applyInArrow(lambda t: _pooled(t, key), schema)
        if left == 1:
            break
        blocks, left = blocks.withColumn("part", (F.col("part") / fan).cast("int")), -(-left // fan)
    return blocks.select(key, "low", "high", "n", "pos", (F.col("pos") / F.col("n")).alias("calibrated"))


def calibrated(scored: DataFrame, blocks: DataFrame, key: str, score: str, out: str = "calibrated", digits: int = DIGITS) -> DataFrame:
    """Add the calibrated probability: that of the last block that begins at
    or below the score (the first block below all)."""
    fit = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("low", "calibrated"))).alias("__fit"))
    held = scored.join(F.broadcast(fit), key, "left")
    p = F.round(score, digits) + 0.0
    below = F.filter("__fit", lambda b: b["low"] <= p)
    value = F.coalesce(F.try_element_at(below, F.lit(-1))["calibrated"], F.try_element_at("__fit", F.lit(1))["calibrated"])
    return held.withColumn(out, F.when(F.col(score).isNotNull(), value)).drop("__fit")


def errors(groups: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """key, n, brier, brier_calibrated over tie groups."""
    fitted = calibrated(groups, blocks, key, "p")
    loss = lambda c: F.round(F.sum(F.col("pos") * (1 - F.col(c)) ** 2 + F.col("neg") * F.col(c) ** 2) / F.sum(F.col("pos") + F.col("neg")), 9)
    return fitted.groupBy(key).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), loss("p").alias("brier"), loss("calibrated").alias("brier_calibrated"))
