"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: Separators of ``[^\x20\x09-\x0D]+`` words, as a Java/Spark character class.
WORD_PATTERN = r"[^ \t-\r]+"
#: Spark's setting to remove an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A batch is worked off in slices of about this many bytes of text.
SLICE_BYTES = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the folder named by
    ``spark.checkpoint.dir`` and read it back.

    Later steps start from the written rows: a lost executor costs a re-read,
    never a recomputation, and two readers see the same rows.  The shuffle
    files behind the table are of no more use and are removed with the write.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def once(column: Column) -> Column:
    """``column``, evaluated once per row where it stands.

    The always-true test of the partition number keeps the optimiser from
    copying a costly expression into filters and lambdas above it, where it
    would run again for every reference (or every array element)."""
    return F.when(F.spark_partition_id() >= 0, column)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """128-bit key of a row's (id, text); identical rows share it."""
    return [F.xxhash64(doc_id, text).alias("k1"),
            F.xxhash64(F.lit("row key"), text, doc_id).alias("k2")]


def text_key(text: Column) -> list[Column]:
    """128-bit key of a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text key"), text).alias("t2")]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of a batch holding about ``size`` bytes of
    ``column`` each (a longer single text is a slice of its own)."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def per_text(docs: DataFrame, id_col: str, text_col: str, factory: Callable[[], Callable[[list[str]], list[pa.Array]]],
             fields: str, size: int = SLICE_BYTES) -> DataFrame:
    """Map-only Arrow step: ``factory()`` runs once per task and gives the
    function from a list of texts (null: empty) to one Arrow array per field.

    The result has ``id_col`` first; it may be of any type, also a struct that
    carries a whole row."""
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    extra = T.StructType.fromDDL(fields)
    schema = T.StructType([T.StructField(id_col, source.schema["__id"].dataType), *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or factory()
            for part in slices(batch, "__text", size):
                texts = ["" if t is None else t for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("__id"), *work(texts)], names=schema.names)

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(__row, __text0): the whole row as one struct, and its text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").alias("__text0"))


def unpack(packed: DataFrame, replaced: dict[str, Column] | None = None) -> DataFrame:
    """The packed rows' columns, some of them replaced."""
    names = packed.schema["__row"].dataType.names
    return packed.select(*[(replaced or {}).get(c, F.col(f"__row.`{c}`")).alias(c) for c in names])


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file on the driver."""
    import public_tokenizers
    return public_tokenizers.path(name)
