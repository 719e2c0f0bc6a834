"""Structured Streaming jobs.

* ``rating_stream`` (J3): new rows are rated with the same stateless
  columns as the batch job; no state, no watermark.
* ``windowed_rating_counts`` (J4): counts per (event-time window, rating)
  with a watermark; append mode emits a window once the watermark passes
  its end, so late rows beyond the delay are dropped and windows still
  open when the input ends are not emitted.

Sinks are Parquet folders with a checkpoint beside them.  The caller names the
folder; a query started again on the same folder goes on where it stopped, each
row once.  Nothing is collected on the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.operators import rate
from ratewise.session import ensure_checkpoint_dir
from ratewise.sources import tables


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of a table with its batch schema; by default a micro-batch
    takes all files there are."""
    reader = spark.readStream.schema(tables.table(spark, sf_dir, name).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(tables.stream_path(sf_dir, name))


def event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    return table_stream(spark, sf_dir, "events", max_files_per_trigger)


def rating_stream(events: DataFrame) -> DataFrame:
    """Stateless rating of each arriving event."""
    scored = tables.event_scores(events)
    return rate.rate_scores(scored).select(
        "event_id", "ts", "event_type", "MCR_rating", "MCR_descriptors", "MCR_max_score")


def windowed_rating_counts(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rating counts per event-time window, watermarked."""
    rated = rating_stream(events)
    return (rated.withWatermark("ts", delay)
            .groupBy(F.window("ts", window).alias("w"), "MCR_rating")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(tables.utc_date(F.col("w.start")).alias("window_start"),
                    tables.utc_date(F.col("w.end")).alias("window_end"), "MCR_rating", "n"))


def run_to_parquet(stream: DataFrame, base: str, output_mode: str = "append") -> str:
    """Run a streaming frame over what its source holds, writing Parquet to
    ``base``/out with the checkpoint in ``base``/checkpoint; returns the output
    folder.  Call it again on the same ``base`` for what has arrived since."""
    out = f"{base}/out"
    q = (stream.writeStream.format("parquet").outputMode(output_mode)
         .option("path", out).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def new_base(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex[:8]}"
