"""Operator 2: contiguous shards of near-equal bytes (DataFrame functions only).

Rows are ordered by id.  The order is cut into many range partitions; each
partition's byte and row totals (one row each) are prefix-summed, so a row's
global byte offset is its partition's offset plus a running sum inside the
partition.  The shard is the offset's place among equal byte targets.  Text is
read once to measure it and never shuffled.

Cases: a null text has size 1 and no checksum; null ids come first; rows with
the same id and text are interchangeable, and rows with one id are ordered by
checksum and then by place in the input; a text larger than a target fills its
shard alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

SHARDS = 8


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, checksum, place in the input): all that sharding moves."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("__at"))


def by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot, offset (bytes before the row)."""
    order = ["__id", "text_crc32", "__at"]
    # Written once: both the totals and the rows must see the same partitions.
    parts = scratch(measured(docs, id_col, text_col).repartitionByRange(*order)
                    .withColumn("__part", F.spark_partition_id()), "shard-rows")
    # One row per range partition, whatever the table holds.
    totals = parts.groupBy("__part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("__part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("__b0"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"),
                            F.sum("b").over(everything).alias("__total"))
    inside = Window.partitionBy("__part").orderBy(*order)
    rows = (parts
            .withColumn("__b", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
            .withColumn("__n", F.row_number().over(inside) - 1)
            .join(F.broadcast(offsets), "__part")
            .withColumn("offset", F.col("__b0") + F.col("__b"))
            .withColumn("__row", F.col("__n0") + F.col("__n"))
            # the row's middle decides, so no shard misses its target by more than one text
            .withColumn("shard", F.expr(f"cast(least({shards - 1}, (2 * offset + size) * {shards} div (2 * __total)) as int)")))
    first = rows.groupBy("shard").agg(F.min("__row").alias("__first"))  # one row per shard
    return (rows.join(F.broadcast(first), "shard")
            .select(F.col("__id").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("__row") - F.col("__first")).cast("long").alias("slot"), "offset"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, then ``offset``."""
    return by_bytes(docs, shards, id_col, text_col).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "offset")
