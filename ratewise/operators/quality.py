"""Data-quality counts of score columns.

One aggregate pass with ``count_if`` per column, or the same expressions as
an ``Observation`` that rides along with a write, so the input is scanned
once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ratewise.functions.scores import (
    coerce_numeric,
    fill_missing,
    is_missing,
    is_non_numeric,
    is_out_of_range,
)


def _flag_columns(df: DataFrame, cols: list[str]) -> dict[str, Column]:
    """Per score column: the coerced value and the missing flag, computed
    once so the three counts below reuse them."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for c in cols:
        out[f"__num_{c}"] = coerce_numeric(c, types[c])
        out[f"__miss_{c}"] = is_missing(c, types[c])
    return out


def _count_exprs(cols: list[str]) -> list[Column]:
    exprs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        num, miss = F.col(f"__num_{c}"), F.col(f"__miss_{c}")
        filled = fill_missing(num)
        exprs += [
            F.count_if(~miss & num.isNull()).alias(f"{c}_non_numeric"),
            F.count_if(miss).alias(f"{c}_missing"),
            F.count_if((filled < 0.0) | (filled > 1.0)).alias(f"{c}_out_of_range"),
        ]
    return exprs


def score_quality(df: DataFrame, cols: list[str]) -> DataFrame:
    """G4 + G5 as a one-row DataFrame (partial aggregation per task)."""
    flags = _flag_columns(df, cols)
    return df.select(*[v.alias(k) for k, v in flags.items()]).agg(*_count_exprs(cols))


def observe_quality(df: DataFrame, cols: list[str], name: str = "score_quality") -> tuple[DataFrame, Observation]:
    """Same counts as metrics of the next action on the returned frame (the
    flag columns are added for the metrics and dropped again)."""
    obs = Observation(name)
    flags = _flag_columns(df, cols)
    observed = df.withColumns(flags).observe(obs, *_count_exprs(cols)).drop(*flags)
    return observed, obs


def quality_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """G4 in long form: one row per score column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in cols:
        t = types[c]
        parts.append(F.struct(
            F.lit(c).alias("column"),
            F.count_if(is_non_numeric(c, t)).alias("non_numeric"),
            F.count_if(is_missing(c, t)).alias("missing"),
            F.count_if(is_out_of_range(c, t)).alias("out_of_range")))
    row = df.agg(F.array(*parts).alias("q"))
    return row.select(F.inline("q"))
