"""Joins that survive hot keys.

``salted_lookup_join`` joins a large table to a lookup table holding one row
per key and the number of rows that have the key.  A key of more than
``target`` rows is dealt to ``ceil(rows / target)`` buckets on the large side
and its lookup row is repeated as often, so a task's share of a key does not
grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT, BUCKETS = "__salt", "__buckets"
#: Rows of one key that a task should get at most.
ROWS_PER_TASK = 1_000_000


def buckets_of(rows: Column, target: int = ROWS_PER_TASK) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(target))).cast("int")


def salted_lookup_join(big: DataFrame, lookup: DataFrame, key: str, rows_col: str, spread_by: Column,
                       target: int = ROWS_PER_TASK, how: str = "inner") -> DataFrame:
    """Equi-join on ``key``; ``rows_col`` of ``lookup`` is the key's row count.
    ``spread_by`` must be stable for a retried task.  The table of hot keys has
    at most total rows / target entries; the optimiser picks how to join it."""
    hot = lookup.filter(F.col(rows_col) > target).select(key, buckets_of(F.col(rows_col), target).alias(BUCKETS))
    salted = (big.withColumn(SALT, F.xxhash64(spread_by)).join(hot, key, "left")
              .withColumn(SALT, F.pmod(F.col(SALT), F.coalesce(BUCKETS, F.lit(1))).cast("int")).drop(BUCKETS))
    repeated = lookup.withColumn(SALT, F.explode(F.sequence(F.lit(0), buckets_of(F.col(rows_col), target) - 1)))
    return salted.join(repeated, [key, SALT], how).drop(SALT)
