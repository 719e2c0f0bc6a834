"""Readers of the driver tables and the score tables derived from them.

Derived tables are plain projections of a scan (no shuffle), so they scale
with their source and keep Parquet column pruning / filter push-down.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (Parquet)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _unit(k: Column, mult: int, mod: int) -> Column:
    return ((k * F.lit(mult)) % F.lit(mod)) / F.lit(float(mod - 1))


def _cube(x: Column) -> Column:
    return x * x * x


# Multiplier / modulus pairs of the four deterministic score generators
# (violence, sexual, language, substance) over an integer key.
SCORE_GENERATORS = [(7919, 1009), (6133, 1013), (3571, 1019), (2749, 1021)]


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one score quadruple per order, keyed by ``song_index``.

    ``x_i = ((k * a_i) % m_i) / (m_i - 1)`` and score ``= x_i^3`` with
    ``k = o_orderkey``; cubes push most scores low like real catalogues."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    xs = [_unit(k, a, m) for a, m in SCORE_GENERATORS]
    return o.select(
        k.alias("song_index"),
        _cube(xs[0]).alias("violence_score"),
        _cube(xs[1]).alias("sexual_score"),
        _cube(xs[2]).alias("language_score"),
        _cube(xs[3]).alias("substance_score"),
    )


def order_raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the F7 generators rendered as *text* score columns with dirt
    driven by order attributes: negative and > 1 numbers (violence),
    non-numeric text (sexual, status P), missing values (language: NULL for
    5-LOW, 'NA' for 4-NOT SPECIFIED) and infinities (substance, status F and
    1-URGENT)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    xs = [_unit(k, a, m) for a, m in SCORE_GENERATORS]
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        k.alias("song_index"),
        (xs[0] * F.lit(1.2) - F.lit(0.1)).cast("string").alias("violence_score"),
        F.when(status == "P", prio).otherwise(_cube(xs[1]).cast("string")).alias("sexual_score"),
        F.when(prio == "5-LOW", F.lit(None).cast("string"))
         .when(prio == "4-NOT SPECIFIED", F.lit("NA"))
         .otherwise(_cube(xs[2]).cast("string")).alias("language_score"),
        F.when((status == "F") & (prio == "1-URGENT"), F.lit("inf"))
         .when((status == "F") & (prio == "2-HIGH"), F.lit("-INFINITY"))
         .when((status == "O") & (prio == "2-HIGH"), F.lit("INF"))
         .otherwise(_cube(xs[3]).cast("string")).alias("substance_score"),
    )


def embedding_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: four probabilities per embedding row, label order
    (sexual, violence, substance, language): ``z = 8 * e_i``,
    ``p = 0.5 + 0.5 * z / (1 + |z|)``."""
    e = table(spark, sf_dir, "embeddings")

    def p(i: int) -> Column:
        z = F.col("embedding")[i].cast("double") * F.lit(8.0)
        return F.lit(0.5) + F.lit(0.5) * z / (F.lit(1.0) + F.abs(z))

    return e.select(F.col("vec_id"), F.col("label"),
                    F.array(p(0), p(1), p(2), p(3)).alias("probs"))


def event_time(df: DataFrame, col: str = "ts") -> Column:
    """Event time as TIMESTAMP (an instant), independent of the session time
    zone: a TIMESTAMP_NTZ wall clock is read as UTC.  Watermarks need
    TIMESTAMP; the plain cast would read the wall clock in the session zone."""
    from pyspark.sql import types as T
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        tz = df.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")
        return F.from_utc_timestamp(c.cast("timestamp"), tz)
    return c


def utc_date(c: Column) -> Column:
    """Calendar date (UTC) of an instant, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(c) / F.lit(86400)).cast("int"))


def event_scores(events: DataFrame) -> DataFrame:
    """Score quadruple per event (same generators as F7 over ``event_id``)
    with ``ts`` as TIMESTAMP (UTC wall clock).  A pure projection, so it
    works on batch and streaming frames alike."""
    k = F.col("event_id")
    xs = [_unit(k, a, m) for a, m in SCORE_GENERATORS]
    return events.select(
        "event_id", event_time(events).alias("ts"), "event_type",
        _cube(xs[0]).alias("violence_score"), _cube(xs[1]).alias("sexual_score"),
        _cube(xs[2]).alias("language_score"), _cube(xs[3]).alias("substance_score"))


def stream_path(sf_dir: str, name: str) -> str:
    """Path of a table usable by the streaming file source (a glob, since
    the source wants a directory or pattern, not a bare file)."""
    return os.path.join(sf_dir, f"{name}.parque[t]")
