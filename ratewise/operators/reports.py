"""Statistics and reports over rated tables.

Each group-by is a two-phase hash aggregate: the partial aggregate in every
map task collapses a hot key (say one rating holding a third of all rows)
to one row per task before the shuffle.  Windows only ever run on the
already-aggregated handful of rows, or behind a partial group limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.constants import DESCRIPTOR_SEPARATOR, NO_DESCRIPTOR


def rating_histogram(rated: DataFrame, rating_col: str = "MCR_rating") -> DataFrame:
    """G1 + G2 + K1: count and percent of rows per rating, sorted by code."""
    counts = rated.groupBy(F.col(rating_col).alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # <= 5 rows after the aggregate
    return (counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 6))
            .orderBy("rating"))


def descriptor_counts(rated: DataFrame, text_col: str = "MCR_descriptors") -> DataFrame:
    """G3 + U5: frequency of each descriptor text; 'None' rows are skipped,
    'Everyone' and 'Parental Guidance Suggested' count."""
    # filter after the explode: a filter on the derived text itself would be
    # pushed below the rating projections with the whole rule set inlined
    d = (rated.select(F.explode(F.split(F.col(text_col), DESCRIPTOR_SEPARATOR, -1)).alias("descriptor"))
         .filter(F.col("descriptor") != NO_DESCRIPTOR))
    return d.groupBy("descriptor").agg(F.count(F.lit(1)).alias("n"))


def descriptor_top(rated: DataFrame, k: int = 10, text_col: str = "MCR_descriptors") -> DataFrame:
    """K2: the k most common descriptors; ties by descriptor name."""
    return descriptor_counts(rated, text_col).orderBy(F.desc("n"), F.asc("descriptor")).limit(k)


def top_k(df: DataFrame, k: int, order_col: str, tie_col: str) -> DataFrame:
    """K3: global top-k (TakeOrderedAndProject: k rows per task, then merge)."""
    return df.orderBy(F.desc(order_col), F.asc(tie_col)).limit(k)


def top_k_by_group(df: DataFrame, k: int, group_col: str, order_col: str, tie_col: str) -> DataFrame:
    """K3 per group: ``row_number() <= k`` over the group.  Spark plans a
    partial WindowGroupLimit before the exchange, so each task forwards at
    most k rows per group and a hot group never lands whole in one task."""
    w = Window.partitionBy(group_col).orderBy(F.desc(order_col), F.asc(tie_col))
    return (df.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def compliance_rollup(scored: DataFrame, group_col: str = "lang",
                      rating_col: str = "mcr_rating", severity_col: str = "severity") -> DataFrame:
    """Counts and mean severity by group x rating with subtotals, and
    the share of each row within its group.

    The scored rows are aggregated once by (group, rating), partially before
    the exchange; the roll-up and the windows run over those few rows."""
    cells = scored.groupBy(group_col, rating_col).agg(F.count(F.lit(1)).alias("n"), F.sum(severity_col).alias("s"),
                                                      F.count(severity_col).alias("k"))
    agg = (cells.rollup(group_col, rating_col)
           .agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("k"), 6).alias("avg_severity"),
                F.grouping_id().alias("level")))
    in_group = F.sum(F.when(F.col("level") == 0, F.col("n"))).over(Window.partitionBy(group_col))
    whole = F.max(F.when(F.col("level") == 3, F.col("n"))).over(Window.partitionBy())
    share = (F.when(F.col("level") == 0, F.col("n") * 100.0 / in_group)
             .when(F.col("level") == 1, F.col("n") * 100.0 / whole)
             .otherwise(F.lit(100.0)))
    return agg.select(group_col, rating_col, "n", "avg_severity", "level",
                      F.round(share, 6).alias("share_pct"))


def label_check(scored: DataFrame, prob_col: str = "p_language",
                label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """Confusion counts of a score against a 0/1 label at a threshold.
    Join the labels to the texts before scoring: only labelled rows are then
    cleaned and scored."""
    pred = F.col(prob_col) > threshold
    truth = F.col(label_col) == 1
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pred & truth).alias("tp"),
        F.count_if(pred & ~truth).alias("fp"),
        F.count_if(~pred & truth).alias("fn"),
        F.count_if(~pred & ~truth).alias("tn"),
    )
