"""Multi-line CSV read by many tasks.

A file is cut into byte ranges like any text file, and whether a range begins
inside a quoted field is worked out from quote parities:

1. One scan counts the quotes of every range.  Doubled quotes add two, so the
   parity of all quotes before a range says whether it begins inside a field;
   the prefix sums run over one row per range.
2. A second scan walks each range's lines from its known state and puts the
   lines of a record together.  Records within a range are done.  What a range
   has of a record that it shares with its neighbours, at most its first and its
   last lines, is written out as a fragment.
3. Fragments (two per range at most) are joined to records by a small shuffle
   keyed by the record's first range; a record over many ranges is one group.

No task reads more than its own range, however the line breaks and quotes fall.
Quotes must follow RFC 4180: a quote inside a field stands in a quoted field,
doubled.  Blank lines between records are skipped, CRLF ends a record like LF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.session import write_table

#: Kinds of text that a range yields.
WHOLE, CLOSE, OPEN, INSIDE = 0, 1, 2, 3
#: Ranges whose states are sent to every task (about 100 bytes each).
MAX_RANGES = 1_000_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, range, line): the physical lines, in file order within a range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("line"))


def range_states(lines: DataFrame) -> DataFrame:
    """(file, range, inside): does the range's first line begin in a field?"""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "range").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return odd.select("file", "range", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, range, inside, line) of whole ranges -> (file, range, kind,
    first, text)."""
    key, inside, held, kind, seen = None, False, [], WHOLE, False

    def out(texts: pa.Array | list, kinds: list[int], firsts: list[bool]) -> pa.RecordBatch:
        n = len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(kinds, pa.int32()), pa.array(firsts, pa.bool_()),
             texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())], names=["file", "range", "kind", "first", "text"])

    def left() -> Iterator[pa.RecordBatch]:
        """The lines held at the end of a range: a record that goes on."""
        nonlocal held
        if held:
            k = INSIDE if kind == CLOSE else OPEN
            yield out(["\n".join(held)], [k], [k == OPEN and key[1] == 0 and not seen])
            held = []

    for batch in batches:
        files, ranges = batch.column("file"), batch.column("range").to_numpy()
        names = pc.rank(files, tiebreaker="dense").to_numpy() if batch.num_rows else np.zeros(0)
        cut = np.flatnonzero(np.r_[True, (ranges[1:] != ranges[:-1]) | (names[1:] != names[:-1])]) if batch.num_rows else []
        for a, b in zip(cut, [*cut[1:], batch.num_rows]):
            part = batch.slice(a, b - a)
            here = (part.column("file")[0].as_py(), int(ranges[a]))
            if here != key:
                if key is not None:
                    yield from left()
                key, inside, seen = here, part.column("inside")[0].as_py(), False
                kind = CLOSE if inside else WHOLE
            lines = part.column("line")
            open_after = (np.cumsum(pc.count_substring(lines, '"').to_numpy()) + int(inside)) % 2 == 1
            ends = np.flatnonzero(~open_after)
            if not len(ends):
                held += lines.to_pylist()
                inside = True
                continue
            # the first record takes what is held; the others are runs of lines up to an end
            first = "\n".join([*held, *lines.slice(0, ends[0] + 1).to_pylist()])
            starts = np.r_[ends[:-1] + 1, ends[-1] + 1].astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(starts), lines.slice(0, ends[-1] + 1).cast(pa.string()))
            texts = pa.concat_arrays([pa.array([first], pa.string()), pc.binary_join(runs, "\n").cast(pa.string())])
            kinds = [kind] + [WHOLE] * (len(texts) - 1)
            firsts = [False] * len(texts)
            if key[1] == 0 and not seen:
                filled = np.flatnonzero(pc.not_equal(pc.utf8_rtrim(texts, "\r"), "").to_numpy(zero_copy_only=False))
                if len(filled):
                    firsts[filled[0]], seen = True, True
            yield out(texts, kinds, firsts)
            kind = WHOLE
            held = lines.slice(ends[-1] + 1).to_pylist()
            inside = bool(open_after[-1])
    if key is not None:
        yield from left()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(first, text): every record of the files as one text without its line
    end; ``first`` marks the first record of each file."""
    lines = _lines(spark, path)
    states = write_table(range_states(lines), "csv-ranges")
    n = states.count()
    if n > MAX_RANGES:
        raise ValueError(f"{n} ranges: raise spark.sql.files.maxPartitionBytes so that there are at most {MAX_RANGES}")
    # a broadcast join keeps the lines in order
    known = lines.join(F.broadcast(states), ["file", "range"]).select("file", "range", "inside", "line")
    texts = write_table(known.mapInArrow(_records, "file string, range long, kind int, first boolean, text string"), "csv-records")
    cut = texts.filter(F.col("kind") != WHOLE)
    # a range's closing lines come before its opening ones
    place = F.struct("range", F.when(F.col("kind") == OPEN, 1).otherwise(0).alias("late"))
    begun = F.sum(F.when(F.col("kind") == OPEN, 1).otherwise(0)).over(
        Window.partitionBy("file").orderBy("range", F.when(F.col("kind") == OPEN, 1).otherwise(0)))
    owner = cut.select("file", "range", "kind", begun.alias("record"))  # keys only
    joined = (cut.join(owner, ["file", "range", "kind"]).groupBy("file", "record")
              .agg(F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct(place.alias("place"), "text"))).alias("parts"))
              .select("first", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text")))
    records = texts.filter(F.col("kind") == WHOLE).select("first", "text").unionByName(joined)
    cr = F.col("text").endswith("\r")
    return records.filter("text not in ('', '\r')").withColumn("text", F.when(cr, F.left("text", F.length("text") - 1)).otherwise(F.col("text")))


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """The rows of multi-line CSV files with a header, all columns as text."""
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    if corrupt:
        options["columnNameOfCorruptRecord"] = corrupt
    rows = csv_records(spark, path).filter(~F.col("first"))
    # a generator: filters on its columns are not moved below it, where each would parse the record again
    return rows.select(F.inline(F.array(F.from_csv("text", _ddl(schema), options))))


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` string" for f in schema.fields)
