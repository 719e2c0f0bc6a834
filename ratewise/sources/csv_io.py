"""CSV source and sinks.

Scores are read as text (no schema inference) and coerced by the rating
step; pass-through columns such as a song titled "NA" stay literal.
Multi-line CSV is read by many tasks per file (``csv_split``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.sources.csv_split import read_split_csv

_RAW = "__raw_record"


def read_score_csv(spark: SparkSession, path: str, multiline: bool = True, whole_files: bool = False) -> DataFrame:
    """Header, quotes, embedded newlines; every column as STRING.

    Short rows are padded with missing values; a row with more fields than the
    header raises when it is read (its fields would otherwise shift or be lost).
    ``multiline=False`` is for files without line breaks inside fields (one scan
    instead of two); ``whole_files`` reads each multi-line file in one task, with
    quotes that do not follow RFC 4180 read as Spark's own reader does."""
    # without column pruning, else a pruned read no longer sees how many fields a row has
    reader = (spark.read.option("header", True).option("multiLine", multiline).option("columnPruning", False)
              .option("quote", '"').option("escape", '"'))
    names = reader.option("inferSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _RAW]])
    if multiline and not whole_files:
        df = read_split_csv(spark, path, schema, _RAW)
    else:
        df = (reader.schema(schema).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", _RAW).csv(path))
    # the reader marks short and long rows alike: count the separators outside quotes
    bare = F.regexp_replace(F.col(_RAW), r'"(?:[^"]|"")*+"', "")
    too_long = F.regexp_count(bare, F.lit(",")) >= len(names)
    message = F.concat(F.lit(f"more than {len(names)} fields: "), F.left(F.col(_RAW), F.lit(200)),
                       F.left(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")), F.lit(0)))
    return df.filter(F.when(F.col(_RAW).isNotNull() & too_long, F.raise_error(message).cast("boolean")).otherwise(True)).drop(_RAW)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, no index, quotes doubled, white space kept; the target is a
    directory of part files written by all tasks in parallel."""
    (df.write.mode(mode)
     .option("header", True)
     .option("quote", '"')
     .option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def read_export_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read an export back (all columns as text)."""
    return read_score_csv(spark, path)
