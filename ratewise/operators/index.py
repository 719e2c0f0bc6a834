"""Distributed 0..n-1 row index in scan order.

The rows are written once, tagged with their partition and place; the counts
and the index both read that table, so they cannot disagree on the partitions
(a plan that runs twice may be partitioned differently each time).  No window
over the rows: only the counts, one per written partition, are prefix-summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.session import write_table

_PID, _MID = "__pid", "__mid"


def with_row_index(df: DataFrame, name: str = "song_index", first: bool = True) -> DataFrame:
    """Add ``name`` = position of the row in scan order (partition order, then
    order inside the partition).  Writes the tagged rows when called."""
    tagged = write_table(df.withColumns({_PID: F.spark_partition_id(), _MID: F.monotonically_increasing_id()}), "indexed")
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy(_PID).agg(F.count(F.lit(1)).alias("n"))
               .select(_PID, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__off")))
    # monotonically_increasing_id = (partition << 33) + position in partition
    pos = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    # a row without an offset is an error, never dropped
    off = F.coalesce(F.col("__off"), F.raise_error(F.lit("row index: a partition has no offset")).cast("long"))
    out = tagged.join(offsets, _PID, "left").withColumn(name, off + pos).drop(_PID, _MID, "__off")
    return out.select(name, *df.columns) if first else out
