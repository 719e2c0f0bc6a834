"""Parallelism of CPU-bound text work.

A scan normally gives enough tasks.  Where it does not (one file with a single
row group), the caller asks for a number of partitions, as an argument or by
the session setting ``ratewise.text.partitions``.  Nothing is looked up or run
while the plan is built, and without a setting no exchange is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTITIONS_CONF = "ratewise.text.partitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash-partition the rows by their scan position (stable for a retried
    scan task, even when one key holds a third of all rows)."""
    partitions = partitions or int(df.sparkSession.conf.get(PARTITIONS_CONF, "0"))
    if not partitions or df.isStreaming:
        return df
    return df.repartition(partitions, F.xxhash64(F.monotonically_increasing_id()))
